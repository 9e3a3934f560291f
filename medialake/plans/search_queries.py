"""Registered queries: search, filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.functions import numbers
from medialake.operators import filters, search, stats, tagging
from medialake.plans.ordering import sequenced
from medialake.plans.registry import query


@query(
    "photo_search",
    """
    SELECT photo_id, project_id, title, status, created_at
    FROM tagged_photos
    WHERE (contains(lower(title), 'ring') OR contains(lower(description), 'ring')
           OR len(list_filter(tags, lambda t: contains(lower(t), 'ring'))) > 0)
      AND status = 'published' AND list_has_any(tags, ['red', 'blue', 'promo'])
      AND created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'
    ORDER BY created_at DESC, photo_id
    """,
    "tagged_photos",
)
def photo_search(lake):
    found = search.photo_search(
        lake.tagged_photos(),
        "RING",
        tags=["red", "blue", "promo"],
        status="published",
        start="1996-01-01 00:00:00",
        end="1999-12-31 00:00:00",
    )
    return found.select("photo_id", "project_id", "title", "status", "created_at")


FACETED = """
    SELECT photo_id, title, camera, location, preset_name, created_at
    FROM search_assets
    WHERE (contains(lower(title), 'an') OR contains(lower(original), 'an')
           OR len(list_filter(tags, lambda t: contains(lower(t), 'an'))) > 0
           OR coalesce(contains(lower(camera), 'an'), false)
           OR coalesce(contains(lower(location), 'an'), false))
      AND len(list_filter(tags, lambda t: contains(lower(t), 'e'))) > 0
      AND contains(lower(preset_name), 'brand#1') AND contains(lower(location), 'r')
      AND contains(lower(camera), 'n')
      AND contains(strftime(created_at, '%Y-%m-%dT%H:%M:%SZ'), '1998-0')
    """


@query("faceted_search", FACETED, "search_assets")
def faceted_search(lake):
    facets = [
        ("tag", "E"),
        ("preset", "brand#1"),
        ("location", "R"),
        ("camera", "n"),
        ("date", "1998-0"),
        ("lens", "ignored"),
    ]
    found = search.faceted_search(lake.search_assets(), "AN", facets)
    return found.select("photo_id", "title", "camera", "location", "preset_name", "created_at")


@query(
    "search_by_camera",
    """
    SELECT photo_id, camera, preset_name FROM search_assets
    WHERE contains(lower(title), 'widget') OR contains(lower(original), 'widget')
       OR len(list_filter(tags, lambda t: contains(lower(t), 'widget'))) > 0
       OR coalesce(contains(lower(camera), 'widget'), false)
       OR coalesce(contains(lower(location), 'widget'), false)
    ORDER BY coalesce(camera, ''), photo_id
    """,
    "search_assets",
)
def search_by_camera(lake):
    found = search.faceted_search(lake.search_assets(), "widget")
    return search.sort_results(found.select("photo_id", "camera", "preset_name"), "camera")


@query(
    "caption_search",
    """
    SELECT doc_id, lang, source FROM captions
    WHERE contains(lower(title), 'tion') OR contains(lower(description), 'ringing')
    """,
    "captions",
)
def caption_search(lake):
    captions = lake.captions()
    hit = search.contains_ci("title", "TION") | search.contains_ci("description", "ringing")
    return captions.filter(hit).select("doc_id", "lang", "source")


@query(
    "gallery_filter",
    """
    WITH numbered AS (
        SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at, photo_id) AS seq,
               CASE WHEN preset_id % 10 <> 0 THEN title ELSE '' END AS shown
        FROM tagged_photos)
    SELECT photo_id AS id, project_id, 400 AS width, 300 AS height,
           CASE WHEN shown <> '' THEN shown ELSE 'Photo ' || CAST(seq AS VARCHAR) END AS filename,
           CASE upload_status WHEN 'synced' THEN 'synced' WHEN 'error' THEN 'offline'
                ELSE 'processing' END AS uploaded_state,
           status <> 'raw' AS processed, array_to_string(tags, ' ') AS tag_text
    FROM numbered
    WHERE status <> 'raw'
      AND (contains(lower(CASE WHEN shown <> '' THEN shown ELSE 'Photo ' || CAST(seq AS VARCHAR) END), 'o 1')
           OR len(list_filter(tags, lambda t: contains(lower(t), 'o 1'))) > 0)
    """,
    "tagged_photos",
)
def gallery_filter(lake):
    photos = lake.tagged_photos().withColumn(
        "title", F.when(F.col("preset_id") % 10 != 0, F.col("title")).otherwise("")
    )
    # Only photos without a title show their number, so only these meet the numbers, which are counted
    # on the three columns of the order alone.
    order = lake.photos().select("project_id", "created_at", "photo_id")
    numbers = sequenced(order, ["project_id"], ["created_at", "photo_id"], F.date_trunc("hour", "created_at"))
    untitled = F.coalesce(F.col("title") == "", F.lit(True))
    numbered = photos.filter(~untitled).withColumn("seq", F.lit(None).cast("long")).unionByName(
        photos.filter(untitled).join(numbers.select("project_id", "photo_id", "seq"), ["project_id", "photo_id"])
    )
    found = filters.gallery_filter(filters.gallery_items(numbered), "processed", "O 1")
    return found.select(
        "id", "project_id", "width", "height", "filename", "uploaded_state", "processed",
        F.array_join("tags", " ").alias("tag_text"),
    )


@query("status_tab", "SELECT project_id, name FROM projects WHERE status = 'draft'", "projects")
def status_tab(lake):
    return filters.status_tab(lake.projects(), "draft").select("project_id", "name")


@query(
    "visible_presets",
    "SELECT preset_id, name, owner_id, is_public FROM presets WHERE owner_id = 42 OR is_public",
    "presets",
)
def visible_presets(lake):
    seen = filters.visible_presets(lake.presets(), user_id=42)
    return seen.select("preset_id", "name", "owner_id", "is_public")


@query("public_presets", "SELECT preset_id, name FROM presets WHERE is_public", "presets")
def public_presets(lake):
    return filters.visible_presets(lake.presets(), 42, public_only=True).select("preset_id", "name")


@query(
    "photos_of_project",
    "SELECT photo_id, project_id, status FROM photos WHERE project_id = 7",
    "photos",
)
def photos_of_project(lake):
    return filters.by_key(lake.photos(), "project_id", 7).select("photo_id", "project_id", "status")


@query("project_lookup", "SELECT project_id, name, status FROM projects WHERE project_id = 77", "projects")
def project_lookup(lake):
    return filters.lookup(lake.projects(), "project_id", 77).select("project_id", "name", "status")


@query(
    "rest_page",
    """
    SELECT project_id, name FROM projects WHERE status = 'active'
    ORDER BY updated_at DESC, project_id LIMIT 1000
    """,
    "projects",
)
def rest_page(lake):
    return filters.rest_query(
        lake.projects(),
        equals={"status": "active"},
        select=["project_id", "name"],
        order=[F.desc("updated_at")],
        limit=5000,
        key="project_id",
    )


@query(
    "template_search",
    """
    SELECT preset_id, name, category FROM presets
    WHERE (contains(lower(name), 'pro') OR contains(lower(description), 'pro')) AND category = 'PROMO'
    """,
    "presets",
)
def template_search(lake):
    found = filters.catalog_search(
        lake.presets(), "PRO", "PROMO", scalars=["name", "description"]
    )
    return found.select("preset_id", "name", "category")


@query("active_users", "SELECT user_id, name FROM users WHERE is_active", "users")
def active_users(lake):
    return filters.active_rows(lake.users()).select("user_id", "name")


@query(
    "preset_sections",
    """
    SELECT CASE WHEN shared THEN 'team' ELSE 'personal' END AS section, count(*) AS presets
    FROM presets GROUP BY 1
    """,
    "presets",
)
def preset_sections(lake):
    return filters.section_counts(lake.presets())


@query(
    "apply_set",
    """
    SELECT event_id, item_id FROM queue
    WHERE status = 'completed' AND item_id IN (SELECT user_id FROM users WHERE is_active)
    """,
    "users queue",
)
def apply_set(lake):
    chosen = filters.active_rows(lake.users()).withColumnRenamed("user_id", "item_id")
    return filters.apply_set(lake.queue(), chosen, "item_id").select("event_id", "item_id")


@query(
    "sync_states",
    """
    WITH s AS (
        SELECT upload_status, upload_progress,
               CASE WHEN upload_progress = 1 OR upload_status = 'synced' THEN 'synced'
                    WHEN upload_status IN ('error', 'paused', 'queued', 'uploading') THEN upload_status
                    ELSE 'synced' END AS sync_state
        FROM photos),
    l AS (
        SELECT sync_state,
               CASE WHEN sync_state = 'synced' OR upload_progress >= 1 THEN 'Synced'
                    WHEN sync_state = 'uploading'
                    THEN CAST(CAST(floor(upload_progress * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS VARCHAR) || '%'
                    WHEN sync_state = 'queued' THEN 'Queued' WHEN sync_state = 'paused' THEN 'Paused'
                    ELSE 'Error' END AS label
        FROM s)
    SELECT sync_state, label, count(*) AS photos FROM l GROUP BY 1, 2
    """,
    "photos",
)
def sync_states(lake):
    shown = filters.with_sync_state(lake.photos())
    label = numbers.progress_label(F.col("sync_state"), F.col("upload_progress"))
    return shown.groupBy("sync_state", label.alias("label")).agg(F.count(F.lit(1)).alias("photos"))


@query(
    "active_preset",
    "SELECT preset_id, preset_id = 17 AS is_active FROM presets",
    "presets",
)
def active_preset(lake):
    return filters.activate_preset(lake.presets(), 17).select("preset_id", "is_active")


@query(
    "autocomplete",
    """
    WITH c AS (
        SELECT t.tag AS value, 1 AS kind, created_at, photo_id, t.pos AS pos
        FROM search_assets, (SELECT unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos) t
        UNION ALL SELECT camera, 2, created_at, photo_id, 0 FROM search_assets
        UNION ALL SELECT location, 3, created_at, photo_id, 0 FROM search_assets),
    f AS (
        SELECT value, min(kind) AS kind FROM c WHERE contains(lower(value), 'an') GROUP BY value),
    g AS (
        SELECT c.value, c.kind, c.created_at, c.photo_id, c.pos,
               row_number() OVER (PARTITION BY c.value ORDER BY c.created_at, c.photo_id, c.pos) AS rn
        FROM c JOIN f ON c.value = f.value AND c.kind = f.kind)
    SELECT value, kind AS rank FROM g WHERE rn = 1
    ORDER BY kind, created_at, photo_id, pos, value LIMIT 5
    """,
    "search_assets",
)
def autocomplete(lake):
    return search.autocomplete(lake.search_assets(), "AN")


def _counted_projects(lake):
    return lake.projects().join(stats.photo_counts(lake.photos()), "project_id", "left")


PROJECT_LIST = """
    SELECT project_id, name, updated_at, coalesce(n, 0) AS photo_count
    FROM projects LEFT JOIN (SELECT project_id AS pid, count(*) AS n FROM photos GROUP BY 1)
      ON pid = project_id
    WHERE contains(lower(name), 'urgent')
    """


@query("project_list_recent", PROJECT_LIST + " ORDER BY updated_at DESC, project_id", "projects photos")
def project_list_recent(lake):
    found = search.project_list(_counted_projects(lake), "URGENT", "recent")
    return found.select(
        "project_id", "name", "updated_at", F.coalesce("photo_count", F.lit(0)).alias("photo_count")
    )


@query(
    "projects_alphabetical",
    "SELECT project_id, name FROM projects ORDER BY name, project_id",
    "projects",
)
def projects_alphabetical(lake):
    return search.project_list(lake.projects(), sort="alpha").select("project_id", "name")


@query(
    "largest_projects",
    """
    SELECT project_id, name, coalesce(n, 0) AS photo_count
    FROM projects LEFT JOIN (SELECT project_id AS pid, count(*) AS n FROM photos GROUP BY 1)
      ON pid = project_id
    ORDER BY photo_count DESC, project_id LIMIT 5
    """,
    "projects photos",
)
def largest_projects(lake):
    ranked = search.project_list(_counted_projects(lake), sort="imgs_desc").limit(5)
    return ranked.select("project_id", "name", "photo_count")


@query(
    "recent_projects",
    "SELECT project_id, name FROM projects ORDER BY updated_at DESC, project_id LIMIT 3",
    "projects",
)
def recent_projects(lake):
    found = search.top(lake.projects(), 3, F.desc("updated_at"), "project_id")
    return found.select("project_id", "name")


TAG_USAGE = """
    SELECT tag, count(*) AS usage
    FROM (SELECT unnest(list_distinct(tags)) AS tag FROM tagged_photos) GROUP BY tag
    """


@query("tags_by_usage", TAG_USAGE + " ORDER BY usage DESC, tag", "tagged_photos")
def tags_by_usage(lake):
    return tagging.tags_by_usage(tagging.tag_usage(lake.tagged_photos()))


@query(
    "tag_search",
    f"SELECT * FROM ({TAG_USAGE}) WHERE contains(lower(tag), 'o') ORDER BY usage DESC, tag",
    "tagged_photos",
)
def tag_search(lake):
    return tagging.tags_by_usage(tagging.tag_usage(lake.tagged_photos()), query="O")


@query(
    "tag_preview",
    """
    SELECT photo_id,
           array_to_string(list_transform(list_slice(tags, 1, 2), lambda t: '#' || t), ' ') AS shown,
           CASE WHEN len(tags) > 2 THEN '+' || CAST(len(tags) - 2 AS VARCHAR) ELSE '' END AS more
    FROM tagged_photos
    """,
    "tagged_photos",
)
def tag_preview(lake):
    return tagging.tag_preview(lake.tagged_photos(), shown=2)


@query(
    "smallest_projects",
    """
    SELECT project_id, name, coalesce(n, 0) AS photo_count,
           row_number() OVER (ORDER BY coalesce(n, 0), project_id) AS place
    FROM projects LEFT JOIN (SELECT project_id AS pid, count(*) AS n FROM photos GROUP BY 1) ON pid = project_id
    QUALIFY place <= 20
    """,
    "projects photos",
)
def smallest_projects(lake):
    found = search.placed(_counted_projects(lake), 20, *search.project_order("imgs_asc"))
    return found.select("project_id", "name", F.coalesce("photo_count", F.lit(0)).alias("photo_count"), "place")


@query(
    "oldest_projects",
    """
    SELECT project_id, name, row_number() OVER (ORDER BY updated_at, project_id) AS place
    FROM projects QUALIFY place <= 20
    """,
    "projects",
)
def oldest_projects(lake):
    found = search.placed(lake.projects(), 20, *search.project_order("oldest"))
    return found.select("project_id", "name", "place")


FOUND = """
    WITH f AS (
        SELECT * FROM search_assets
        WHERE contains(lower(title), 'widget') OR contains(lower(original), 'widget')
           OR len(list_filter(tags, lambda t: contains(lower(t), 'widget'))) > 0
           OR coalesce(contains(lower(camera), 'widget'), false) OR coalesce(contains(lower(location), 'widget'), false))
    """


@query(
    "search_by_time",
    FOUND
    + """
    SELECT photo_id, created_at, row_number() OVER (ORDER BY created_at DESC, photo_id) AS place
    FROM f QUALIFY place <= 50
    """,
    "search_assets",
)
def search_by_time(lake):
    found = search.faceted_search(lake.search_assets(), "widget").select("photo_id", "created_at")
    return search.placed(found, 50, *search.result_order("time"))


@query(
    "search_by_preset",
    FOUND
    + """
    SELECT photo_id, preset_name, row_number() OVER (ORDER BY coalesce(preset_name, ''), photo_id) AS place
    FROM f QUALIFY place <= 50
    """,
    "search_assets",
)
def search_by_preset(lake):
    found = search.faceted_search(lake.search_assets(), "widget").select("photo_id", "preset_name")
    return search.placed(found, 50, *search.result_order("preset"))


@query(
    "search_by_relevance",
    FOUND + "SELECT photo_id, row_number() OVER (ORDER BY photo_id) AS place FROM f QUALIFY place <= 50",
    "search_assets",
)
def search_by_relevance(lake):
    found = search.faceted_search(lake.search_assets(), "widget").select("photo_id")
    return search.placed(found, 50, *search.result_order())


@query(
    "preset_lists",
    "SELECT preset_id, name, CASE WHEN shared THEN 'team' ELSE 'personal' END AS section FROM presets",
    "presets",
)
def preset_lists(lake):
    return filters.sections(lake.presets()).select("preset_id", "name", "section")
