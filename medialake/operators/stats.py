"""Counts and summaries per project, user, organization, queue and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake import catalogs as C
from medialake.functions.numbers import round_half_up
from medialake.functions.times import as_moment


def _or0(name: str) -> Column:
    return F.coalesce(name, F.lit(0)).alias(name)


def status_counts() -> list[Column]:
    """The four nested photo counts."""
    status = F.col("status")
    return [
        F.count(F.lit(1)).alias("total_photos"),
        F.count_if(F.coalesce(status != "raw", F.lit(True))).alias("processed_photos"),
        F.count_if(status.isin("exported", "published")).alias("exported_photos"),
        F.count_if(status == "published").alias("published_photos"),
    ]


def project_stats(
    projects: DataFrame, photos: DataFrame, as_of: str, tagged: DataFrame | None = None
) -> DataFrame:
    """Photo counts by status, distinct tags and last activity, with zeros for empty projects.

    The counts and the tags are aggregated apart and meet with one row per project. The counts then
    shuffle one narrow partial row per project and task, and only (project, tag) pairs are exploded.
    Distinct tags are first reduced per pair, so a project with a large share of the photos is
    spread over tasks. ``tagged`` may give (project_id, tags) when these are stored apart.
    """
    counts = photos.groupBy("project_id").agg(
        *status_counts(), F.max("updated_at").alias("last_activity")
    )
    tags = (
        (photos if tagged is None else tagged)
        .select("project_id", F.explode("tags").alias("tag"))
        .groupBy("project_id")
        .agg(F.count_distinct("tag").alias("total_tags"))
    )
    names = ["total_photos", "processed_photos", "exported_photos", "published_photos", "total_tags"]
    return (
        projects.select("project_id")
        .join(counts, "project_id", "left")
        .join(tags, "project_id", "left")
        .select(
            "project_id",
            *[_or0(c) for c in names],
            F.coalesce("last_activity", as_moment(as_of)).alias("last_activity"),
        )
    )


def photo_counts(photos: DataFrame) -> DataFrame:
    return photos.groupBy("project_id").agg(F.count(F.lit(1)).alias("photo_count"))


def user_stats(
    users: DataFrame, projects: DataFrame, photos: DataFrame, presets: DataFrame, cameras: DataFrame
) -> DataFrame:
    """Owned projects, photos, presets, cameras, storage and plan per user. Every child is counted
    per owner before it is joined."""
    work = (
        projects.select("project_id", "user_id")
        .join(photo_counts(photos), "project_id", "left")
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("total_projects"),
            F.sum(F.coalesce("photo_count", F.lit(0))).alias("total_photos"),
        )
    )
    own_presets = presets.groupBy(F.col("owner_id").alias("user_id")).agg(
        F.count(F.lit(1)).alias("total_presets")
    )
    own_cameras = cameras.groupBy(F.col("owner_id").alias("user_id")).agg(
        F.count(F.lit(1)).alias("total_cameras")
    )
    joined = users.select("user_id", "plan")
    for part in (work, own_presets, own_cameras):
        joined = joined.join(part, "user_id", "left")
    return joined.select(
        "user_id",
        _or0("total_projects"),
        _or0("total_photos"),
        _or0("total_presets"),
        _or0("total_cameras"),
        (F.coalesce("total_photos", F.lit(0)) * C.MB_PER_PHOTO).alias("storage_mb"),
        F.coalesce("plan", F.lit(C.PLAN_DEFAULT)).alias("plan"),
    )


def quick_stats(projects: DataFrame, organizations: DataFrame) -> DataFrame:
    """Projects, active projects and organizations as one row."""
    orgs = organizations.agg(F.count(F.lit(1)).alias("n"))
    return projects.agg(
        F.count(F.lit(1)).alias("projects"),
        F.count_if(F.col("status") == "active").alias("active_projects"),
    ).withColumn("organizations", orgs.scalar())


def projects_per_org(organizations: DataFrame, projects: DataFrame) -> DataFrame:
    counts = projects.groupBy("org_id").agg(F.count(F.lit(1)).alias("projects"))
    return organizations.join(counts, "org_id", "left").select("org_id", "org_name", _or0("projects"))


def queue_summary(items: DataFrame, by: list[str] = ()) -> DataFrame:
    """Queue counts, mean progress and completion flags. An empty queue has a null mean."""
    status = F.col("status")
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(status == "pending").alias("pending"),
        F.count_if(status == "syncing").alias("syncing"),
        F.count_if(status == "failed").alias("failed"),
        F.avg("progress").alias("mean_progress"),
        round_half_up(F.avg("progress")).alias("shown_progress"),
        F.bool_and(status == "completed").alias("all_completed"),
        F.bool_or(status == "syncing").alias("any_syncing"),
        F.try_divide(F.count_if(status == "completed"), F.count(F.lit(1))).alias("done_ratio"),
    )


def presence(collaborators: DataFrame, by: list[str] = ()) -> DataFrame:
    """Collaborators online and in all, and whether anyone is online."""
    online = F.col("is_online")
    return collaborators.groupBy(*by).agg(
        F.count_if(online).alias("online"),
        F.count(F.lit(1)).alias("collaborators"),
        F.bool_or(online).alias("any_online"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of named tables as one JSON object."""
    counts = None
    for name in sorted(tables):
        one = tables[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    # One entry per named table, so the collected list has a fixed length.
    entries = F.sort_array(F.collect_list(F.struct("name", "n")))
    return counts.agg(F.to_json(F.map_from_entries(entries)).alias("table_counts"))


def hit_ratio(df: DataFrame, hits: Column, reads: Column, by: list[str] = ()) -> DataFrame:
    """Hits in percent of hits and reads, from exact sums, two digits."""
    h, r = F.sum(hits), F.sum(reads)
    ratio = F.try_divide(h * F.lit(100.0), h + r)
    return df.groupBy(*by).agg(h.alias("hits"), r.alias("reads"), F.round(ratio, 2).alias("hit_ratio"))


def slow_ops(df: DataFrame, active: Column, seconds: Column, by: list[str] = ()) -> DataFrame:
    """Active operations, and those active for more than a second."""
    return df.groupBy(*by).agg(
        F.count_if(active).alias("active"), F.count_if(active & (seconds > 1.0)).alias("slow")
    )


def pass_ratio(checks: DataFrame, run: str) -> DataFrame:
    """Passed checks of each run and whether all passed."""
    ok = F.col("status") == "success"
    return checks.groupBy(run).agg(
        F.count_if(ok).alias("passed"),
        F.count(F.lit(1)).alias("checks"),
        F.bool_and(ok).alias("all_passed"),
    )


def facet_counts(photos: DataFrame, cameras: DataFrame) -> DataFrame:
    """Counts behind the filter chips: six fixed facets, then one per camera, from one pass.

    Photos are counted per camera for all facets at once; the fixed facets are sums of those rows.
    """
    synced = F.coalesce(F.col("upload_status") == "synced", F.lit(False))
    edited = F.coalesce(F.col("status") != "raw", F.lit(True))
    tests = {
        "synced": synced,
        "unsynced": ~synced,
        "published": F.col("status") == "published",
        "edited": edited,
        "unedited": ~edited,
        "preset-applied": F.col("preset_id").isNotNull(),
    }
    per_camera = photos.groupBy("camera_id").agg(
        F.count(F.lit(1)).alias("_all"), *[F.count_if(t).alias(n) for n, t in tests.items()]
    )

    def chip(facet: Column, camera: Column, count: Column) -> Column:
        return F.struct(
            facet.alias("facet"), camera.cast("string").alias("camera"), count.cast("long").alias("n")
        )

    nobody = F.lit(None)
    fixed = [chip(F.lit(n), nobody, F.col(f"`{n}`")) for n in tests]
    own = chip(F.col("camera_name"), F.col("camera_id"), F.col("_all"))
    counted = per_camera.join(cameras, "camera_id", "left").select(F.inline(F.array(*fixed, own)))
    # The fixed facets also show when there are no photos at all.
    zeros = photos.sparkSession.range(1).select(
        F.inline(F.array(*[chip(F.lit(n), nobody, F.lit(0)) for n in tests]))
    )
    return (
        counted.unionByName(zeros)
        .filter("facet IS NOT NULL")
        .groupBy("facet", "camera")
        .agg(F.sum("n").alias("photos"))
        .select("facet", "photos")
    )


def project_panel(
    projects: DataFrame, photos: DataFrame, presets: DataFrame, cameras: DataFrame
) -> DataFrame:
    """Photo, published and unedited counts with the names of the project's preset and camera."""
    counts = photos.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("photo_count"),
        F.count_if(F.col("status") == "published").alias("published_count"),
        F.count_if(F.col("status") == "raw").alias("unedited_count"),
    )
    looks = presets.select(
        F.col("preset_id").alias("default_preset_id"), F.col("name").alias("preset_name")
    )
    return (
        projects.select("project_id", F.col("name").alias("title"), "default_preset_id", "camera_id")
        .join(counts, "project_id", "left")
        .join(looks, "default_preset_id", "left")
        .join(cameras.select("camera_id", "camera_name"), "camera_id", "left")
        .select(
            "project_id",
            "title",
            _or0("photo_count"),
            _or0("published_count"),
            _or0("unedited_count"),
            "preset_name",
            F.col("camera_name").alias("camera"),
        )
    )


def reconcile(stored: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """Stored against counted numbers per key: ``stored_count`` and ``actual_count`` columns."""
    return (
        stored.select(key, "stored_count")
        .join(counted.select(key, "actual_count"), key, "left")
        .select(key, "stored_count", _or0("actual_count"))
        .withColumn("delta", F.col("stored_count") - F.col("actual_count"))
        .withColumn("matches", F.col("delta") == 0)
    )
