"""Registered queries: tag lists, change sets, versions and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake import catalogs as C
from medialake.bindings import ORDERS_AS_OF
from medialake.functions.text import full_name
from medialake.operators import changes, tagging
from medialake.operators import presets as P
from medialake.plans.registry import query


@query(
    "tag_add_remove",
    """
    WITH a AS (
        SELECT photo_id, CASE WHEN list_contains(tags, 'promo') THEN tags ELSE list_append(tags, 'promo') END AS t
        FROM tagged_photos)
    SELECT photo_id, array_to_string(list_filter(t, lambda x: x <> 'bolt'), ',') AS tag_text FROM a
    """,
    "tagged_photos",
)
def tag_add_remove(lake):
    edited = tagging.edit_tags(lake.tagged_photos(), add="  promo ", remove="bolt")
    return edited.select("photo_id", F.array_join("tags", ",").alias("tag_text"))


@query(
    "tag_toggle",
    """
    SELECT photo_id, array_to_string(CASE WHEN list_contains(tags, 'small')
                                          THEN list_filter(tags, lambda x: x <> 'small')
                                          ELSE list_append(tags, 'small') END, ',') AS tag_text
    FROM tagged_photos
    """,
    "tagged_photos",
)
def tag_toggle(lake):
    return tagging.toggle_tag(lake.tagged_photos(), "small").select(
        "photo_id", F.array_join("tags", ",").alias("tag_text")
    )


@query(
    "suggest_except",
    """
    WITH u AS (
        SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct(tags)) AS tag FROM tagged_photos)
        WHERE contains(lower(tag), 'e') GROUP BY 1),
    ranked AS (SELECT list(tag ORDER BY n DESC, tag) AS all_tags FROM u)
    SELECT photo_id,
           array_to_string(list_slice(list_filter(all_tags, lambda x: NOT list_contains(tags, x)), 1, 5), ',')
             AS candidates
    FROM tagged_photos, ranked
    """,
    "tagged_photos",
)
def suggest_except(lake):
    photos = lake.tagged_photos()
    found = tagging.tag_candidates(photos, tagging.tag_usage(photos), "E")
    return found.select("photo_id", F.array_join("candidates", ",").alias("candidates"))


@query(
    "merged_tags",
    """
    SELECT preset_id, array_to_string(list_sort(list_distinct(list_transform(
               list_concat(string_split(p_name, ' '), [p_type, upper(string_split(p_name, ' ')[1])]),
               lambda x: lower(x)))), ',') AS tag_text
    FROM (SELECT p_partkey AS preset_id, p_name, p_type FROM part)
    """,
)
def merged_tags(lake):
    part = lake.raw("part").withColumnRenamed("p_partkey", "preset_id")
    own = part.select("preset_id", F.split("p_name", " ").alias("tags"))
    extra = part.select(
        "preset_id",
        F.array(F.col("p_type"), F.upper(F.get(F.split("p_name", " "), F.lit(0)))).alias("tags"),
    )
    merged = tagging.merged_tags(own, extra, "preset_id")
    return merged.select("preset_id", F.array_join(F.array_sort("tags"), ",").alias("tag_text"))


@query(
    "patch_update",
    """
    SELECT project_id, CASE WHEN project_id % 5 = 0 AND project_id % 2 = 0 THEN upper(name) ELSE name END AS name,
           CASE WHEN project_id % 5 = 0 THEN 'archived' ELSE status END AS status,
           CASE WHEN project_id % 5 = 0 THEN TIMESTAMP '2001-12-01' ELSE updated_at END AS updated_at
    FROM projects
    """,
    "projects",
)
def patch_update(lake):
    projects = lake.projects().select("project_id", "name", "status", "updated_at")
    patches = projects.filter("project_id % 5 = 0").select(
        "project_id",
        F.when(F.col("project_id") % 2 == 0, F.upper("name")).alias("name"),
        F.lit("archived").alias("status"),
    )
    return changes.patch(projects, patches, "project_id", ORDERS_AS_OF)


SETTINGS = """
    WITH cur AS (
        SELECT project_id, '{date}_{counter}' AS file_rule, CAST(project_id % 50 AS INTEGER) AS counter_start,
               TIMESTAMP '2001-01-01' AS updated_at
        FROM projects WHERE status <> 'active'),
    new AS (
        SELECT project_id, CASE WHEN stored_count > 1 THEN CAST(7 AS INTEGER) END AS counter_start
        FROM projects WHERE status <> 'archived')
    """


def settings(lake):
    """Settings of archived and draft projects, and patches for draft and active ones: every project is
    on one side, drafts are on both."""
    projects = lake.projects()
    current = projects.filter("status <> 'active'").select(
        "project_id",
        F.lit("{date}_{counter}").alias("file_rule"),
        (F.col("project_id") % 50).cast("int").alias("counter_start"),
        F.lit("2001-01-01").cast("timestamp_ntz").alias("updated_at"),
    )
    patches = projects.filter("status <> 'archived'").select(
        "project_id", F.when(F.col("stored_count") > 1, F.lit(7)).alias("counter_start")
    )
    return current, patches


@query(
    "upsert_defaults",
    SETTINGS
    + """
    SELECT coalesce(cur.project_id, new.project_id) AS project_id,
           CASE WHEN cur.project_id IS NULL THEN '{project}_{date}_{counter}' ELSE file_rule END AS file_rule,
           coalesce(new.counter_start, cur.counter_start, 1) AS counter_start,
           CASE WHEN new.project_id IS NOT NULL THEN TIMESTAMP '2001-12-01' ELSE updated_at END AS updated_at
    FROM cur FULL JOIN new ON cur.project_id = new.project_id
    """,
    "projects",
)
def upsert_defaults(lake):
    current, patches = settings(lake)
    return changes.upsert(current, patches, "project_id", C.AUTOMATION_DEFAULTS, ORDERS_AS_OF)


@query(
    "insert_absent",
    SETTINGS
    + """
    SELECT * FROM cur UNION ALL
    SELECT project_id, 'seeded', 1, TIMESTAMP '2001-12-01' FROM projects WHERE status = 'active'
    """,
    "projects",
)
def insert_absent(lake):
    current, patches = settings(lake)
    seeds = patches.select(
        "project_id",
        F.lit("seeded").alias("file_rule"),
        F.lit(1).alias("counter_start"),
        F.lit(ORDERS_AS_OF).cast("timestamp_ntz").alias("updated_at"),
    )
    return changes.insert_absent(current, seeds, ["project_id"])


@query(
    "append_projects",
    """
    SELECT project_id, name, status FROM projects
    UNION ALL SELECT -project_id - 1, name || ' II', NULL FROM projects WHERE status = 'archived'
    """,
    "projects",
)
def append_projects(lake):
    projects = lake.projects().select("project_id", "name", "status")
    added = projects.filter("status = 'archived'").select(
        (-F.col("project_id") - 1).alias("project_id"), F.concat("name", F.lit(" II")).alias("name")
    )
    return changes.append_rows(projects, added)


@query(
    "replace_settings",
    SETTINGS
    + """
    SELECT * FROM cur WHERE project_id NOT IN (SELECT project_id FROM new) UNION ALL
    SELECT project_id, 'fixed', 3, TIMESTAMP '2001-12-01' FROM new
    """,
    "projects",
)
def replacesettings(lake):
    current, patches = settings(lake)
    rows = patches.select(
        "project_id", F.lit("fixed").alias("file_rule"), F.lit(3).alias("counter_start")
    )
    return changes.replace_rows(current, rows, "project_id", ORDERS_AS_OF)


@query(
    "camera_status",
    """
    SELECT s_suppkey AS camera_id,
           CASE WHEN s_suppkey % 3 = 0 THEN 'connected' WHEN s_suppkey % 3 = 1 THEN 'syncing'
                ELSE 'disconnected' END AS status,
           CASE WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '2001-12-01' ELSE TIMESTAMP '2001-01-01' END AS last_sync
    FROM supplier
    """,
)
def camera_status(lake):
    cameras = lake.cameras().select(
        "camera_id",
        F.lit("disconnected").alias("status"),
        F.lit("2001-01-01").cast("timestamp_ntz").alias("last_sync"),
    )
    updates = cameras.filter("camera_id % 3 < 2").select(
        "camera_id", F.when(F.col("camera_id") % 3 == 0, "connected").otherwise("syncing").alias("status")
    )
    return changes.camera_status(cameras, updates, ORDERS_AS_OF)


@query(
    "cascade_delete",
    """
    SELECT photo_id, project_id FROM photos
    WHERE project_id NOT IN (SELECT project_id FROM projects WHERE status = 'archived')
    """,
    "photos projects",
)
def cascade_delete(lake):
    removed = lake.projects().filter("status = 'archived'")
    return changes.cascade_delete(
        lake.photos().select("photo_id", "project_id"), removed, "project_id"
    )


@query(
    "preset_purge",
    """
    SELECT project_id, default_preset_id AS preset_id FROM projects
    WHERE default_preset_id NOT IN (SELECT preset_id FROM presets WHERE is_public)
    """,
    "projects presets",
)
def preset_purge(lake):
    defaults = lake.projects().select("project_id", F.col("default_preset_id").alias("preset_id"))
    presets = lake.presets()
    _, kept = P.delete_preset(presets, defaults, presets.filter("is_public"))
    return kept.select("project_id", "preset_id")


@query(
    "batch_tag",
    """
    SELECT photo_id, CASE WHEN status = 'raw' AND NOT list_contains(tags, 'todo')
                          THEN array_to_string(list_append(tags, 'todo'), ',')
                          ELSE array_to_string(tags, ',') END AS tag_text
    FROM tagged_photos
    """,
    "tagged_photos",
)
def batch_tag(lake):
    photos = lake.tagged_photos().select("photo_id", "status", "tags")
    tagged = changes.batch_where(photos, F.col("status") == "raw", "tag", F.lit("todo"))
    return tagged.select("photo_id", F.array_join("tags", ",").alias("tag_text"))


@query(
    "batch_preset",
    """
    SELECT photo_id, CASE WHEN camera_id % 4 = 0 THEN 7 ELSE preset_id END AS preset_id FROM photos
    """,
    "photos",
)
def batch_preset(lake):
    photos = lake.photos().select("photo_id", "camera_id", "preset_id")
    return changes.batch_where(photos, F.col("camera_id") % 4 == 0, "preset", F.lit(7)).drop("camera_id")


@query(
    "batch_export",
    """
    SELECT photo_id, array_to_string(CASE WHEN status = 'published' AND NOT list_contains(export_formats, '1x1')
                                          THEN list_append(export_formats, '1x1') ELSE export_formats END, ',') AS formats
    FROM photos
    """,
    "photos",
)
def batch_export(lake):
    photos = lake.photos().select("photo_id", "status", "export_formats")
    done = changes.batch_where(photos, F.col("status") == "published", "export", F.lit("1x1"))
    return done.select("photo_id", F.array_join("export_formats", ",").alias("formats"))


@query(
    "batch_delete",
    """
    SELECT project_id, status FROM projects WHERE user_id NOT IN (SELECT user_id FROM users WHERE NOT is_active)
    """,
    "projects users",
)
def batch_delete(lake):
    """Projects left after those of inactive users, a selection by key, were deleted."""
    projects = lake.projects().select("project_id", "user_id", "status")
    return changes.batch_action(projects, lake.users().filter("NOT is_active"), "user_id", "delete").drop("user_id")


ALL_SETTINGS = [
    ("default_preset_name", "string", "NULL"), ("auto_apply_new", "boolean", "true"),
    ("retro_apply_existing", "boolean", "false"), ("export_format", "string", "'PNG'"),
    ("file_rule", "string", "'{project}_{date}_{counter}'"), ("counter_start", "int", "1"),
    ("include_original_name", "boolean", "true"), ("enable_watermark", "boolean", "false"),
    ("wm_position", "string", "'Bottom-Right'"), ("wm_opacity", "int", "35"),
    ("default_tags", "string", "''"), ("smart_auto_tagging", "boolean", "false"),
    ("min_long_edge_px", "int", "2000"), ("min_exposure_quality", "int", "0"),
    ("auto_flag_low_quality", "boolean", "true"), ("ai_distribution", "boolean", "false"),
    ("ai_notes", "string", "''"), ("export_scheduling_on", "boolean", "false"),
]


@query(
    "upsert_all_defaults",
    """
    SELECT project_id, updated_at,
    """
    + ", ".join(f"CASE WHEN status <> 'active' THEN NULL ELSE {sql} END AS {name}" for name, _, sql in ALL_SETTINGS)
    + """, CASE WHEN status <> 'active' THEN NULL ELSE '1:1,4:5,3:2,16:9' END AS aspects,
           CASE WHEN status <> 'active' THEN NULL ELSE '' END AS storage_channels
    FROM (SELECT project_id, status,
                 CASE WHEN status <> 'archived' THEN TIMESTAMP '2001-12-01' ELSE TIMESTAMP '2001-01-01' END AS updated_at
          FROM projects)
    """,
    "projects",
)
def upsert_all_defaults(lake):
    """Settings with every column: rows that are there keep their nulls, new ones get all defaults."""
    projects = lake.projects()
    kinds = {name: kind for name, kind, _ in ALL_SETTINGS} | dict.fromkeys(("aspects", "storage_channels"), "array<string>")
    current = projects.filter("status <> 'active'").select(
        "project_id",
        F.lit("2001-01-01").cast("timestamp_ntz").alias("updated_at"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()],
    )
    patches = projects.filter("status <> 'archived'").select("project_id")
    out = changes.upsert(current, patches, "project_id", C.AUTOMATION_DEFAULTS, ORDERS_AS_OF)
    lists = {c: F.array_join(c, ",") for c in ("aspects", "storage_channels")}
    return out.withColumns(lists)


@query(
    "selection_toggle",
    """
    SELECT user_id FROM users WHERE is_active <> (user_id % 4 = 0)
    """,
    "users",
)
def selection_toggle(lake):
    users = lake.users()
    return changes.toggle_selection(
        users.filter("is_active"), users.filter("user_id % 4 = 0"), "user_id"
    )


@query(
    "duplicate_preset",
    """
    SELECT preset_id, name, shared FROM presets
    UNION ALL SELECT -1, name || ' (Copy)', false FROM presets WHERE preset_id = 12
    """,
    "presets",
)
def duplicate_preset(lake):
    copied = P.duplicate_preset(
        lake.presets().select("preset_id", "name", "shared"), 12, -1, ORDERS_AS_OF
    )
    return copied


@query(
    "retention",
    """
    SELECT event_id, check_time FROM health WHERE check_time >= TIMESTAMP '2024-02-20' - INTERVAL 30 DAYS
    """,
    "health",
)
def retention(lake):
    kept = changes.retain(lake.health(), "check_time", C.HEALTH_KEEP_DAYS, "2024-02-20 00:00:00")
    return kept.select("event_id", "check_time")


@query(
    "retention_removed",
    """
    SELECT count(*) FILTER (check_time < TIMESTAMP '2024-02-20' - INTERVAL 30 DAYS) AS removed FROM health
    """,
    "health",
)
def retention_removed(lake):
    return changes.expired_count(
        lake.health(), "check_time", C.HEALTH_KEEP_DAYS, "2024-02-20 00:00:00"
    )


@query(
    "changed_rows",
    """
    SELECT project_id, CASE WHEN project_id % 7 = 0 THEN 'removed' ELSE 'changed' END AS change
    FROM projects WHERE project_id % 7 = 0 OR (project_id % 11 = 0 AND status <> 'draft')
    UNION ALL SELECT -1 - project_id, 'added' FROM projects WHERE project_id % 13 = 0
    """,
    "projects",
)
def changed_rows(lake):
    saved = lake.projects().select("project_id", "name", "status")
    draft = (
        saved.filter("project_id % 7 <> 0")
        .withColumn(
            "status", F.when(F.col("project_id") % 11 == 0, "draft").otherwise(F.col("status"))
        )
        .unionByName(
            saved.filter("project_id % 13 = 0").withColumn("project_id", -1 - F.col("project_id"))
        )
    )
    return changes.changed_rows(saved, draft, "project_id")


EDITS = """
    WITH v AS (
        SELECT *, row_number() OVER w AS version, lag(exposure) OVER w AS prev_exposure,
               lag(contrast) OVER w AS prev_contrast
        FROM edits WINDOW w AS (PARTITION BY item_id ORDER BY turn))
    """


@query(
    "version_log",
    EDITS
    + """
    SELECT item_id, turn, version, exposure, prev_exposure,
           CASE WHEN version > 1 THEN CAST(item_id AS VARCHAR) || '_v' || CAST(version - 1 AS VARCHAR) END
             AS previous_id
    FROM v
    """,
    "edits",
)
def version_log(lake):
    log = P.version_log(lake.edits(), "item_id", "turn", "adjustments")

    def value(c):
        return F.try_element_at(c, F.lit("exposure"))

    return log.select(
        "item_id",
        "turn",
        "version",
        value("adjustments").alias("exposure"),
        value("prev_adjustments").alias("prev_exposure"),
        "previous_id",
    )


@query(
    "rollback",
    EDITS
    + """
    , last AS (SELECT item_id, max(version) AS last FROM v GROUP BY 1)
    SELECT item_id, version, exposure, CAST(NULL AS VARCHAR) AS note FROM v
    UNION ALL
    SELECT v.item_id, last + 1, exposure, 'Rolled back to version ' || CAST(version AS VARCHAR)
    FROM v JOIN last ON last.item_id = v.item_id
    WHERE version = v.item_id % 5 + 1 AND version < last
    """,
    "edits",
)
def rollback(lake):
    log = P.version_log(lake.edits(), "item_id", "turn", "adjustments").select(
        "item_id", "version", F.try_element_at("adjustments", F.lit("exposure")).alias("exposure")
    )
    requests = lake.edits().select("item_id", (F.col("item_id") % 5 + 1).alias("target")).distinct()
    last = lake.edits().groupBy("item_id").agg(F.count(F.lit(1)).alias("last"))
    return P.rollback(log, requests, "item_id", "exposure", last)


@query(
    "edit_diff",
    EDITS
    + """
    SELECT item_id, turn, exposure - coalesce(prev_exposure, 0) AS exposure_diff,
           contrast - coalesce(prev_contrast, 0) AS contrast_diff,
           1 + CAST(contrast IS NOT NULL AS INTEGER) AS adjustments
    FROM v
    """,
    "edits",
)
def edit_diff(lake):
    diff = P.edit_diff(lake.edits(), "item_id", "turn")
    return diff.select(
        "item_id",
        "turn",
        F.try_element_at("diff", F.lit("exposure")).alias("exposure_diff"),
        F.try_element_at("diff", F.lit("contrast")).alias("contrast_diff"),
        F.size("adjustments").alias("adjustments"),
    )


@query(
    "preset_versions",
    """
    SELECT preset_id, CASE WHEN preset_id % 2 = 0 THEN 4 ELSE 3 END AS version,
           CAST(CASE WHEN preset_id % 2 = 0 THEN preset_id % 10 + 1 ELSE preset_id % 10 END AS DOUBLE) AS settings,
           CASE WHEN preset_id % 2 = 0 THEN CAST(preset_id AS VARCHAR) || '_v3' END AS history
    FROM presets
    """,
    "presets",
)
def preset_versions(lake):
    presets = lake.presets().select(
        "preset_id",
        F.lit(3).alias("version"),
        F.lit("2001-01-01").cast("timestamp_ntz").alias("last_edited"),
        (F.col("preset_id") % 10).cast("double").alias("settings"),
        F.lit(None)
        .cast(
            "array<struct<id:string,version:int,created_at:timestamp_ntz,settings:double,changes:array<string>>>"
        )
        .alias("previous_versions"),
    )
    edits = presets.filter("preset_id % 2 = 0").select(
        "preset_id", (F.col("settings") + 1).alias("new_settings")
    )
    out = P.add_versions(presets, edits, ORDERS_AS_OF)
    return out.select(
        "preset_id",
        "version",
        "settings",
        F.get("previous_versions", F.lit(0))["id"].alias("history"),
    )


@query(
    "full_names",
    """
    SELECT user_id, trim(coalesce(CASE WHEN user_id % 3 <> 0 THEN name END, '') || ' '
                         || coalesce(CASE WHEN user_id % 5 <> 0 THEN plan END, '')) AS full_name
    FROM users
    """,
    "users",
)
def full_names(lake):
    u = lake.users()
    first = F.when(F.col("user_id") % 3 != 0, F.col("name"))
    last = F.when(F.col("user_id") % 5 != 0, F.col("plan"))
    return u.select("user_id", full_name(first, last).alias("full_name"))
