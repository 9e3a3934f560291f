"""Health history: recent view, checks per bucket, gaps, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from medialake import catalogs as C


def recent_checks(history: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Checks of the last hours, newest first."""
    moment = F.lit(as_of).cast(history.schema["check_time"].dataType)
    return (
        history.filter(F.col("check_time") > moment - F.make_dt_interval(hours=F.lit(hours)))
        .select("check_time", "check_type", "status", "response_time_ms", "details", "event_id")
        .orderBy(F.desc("check_time"), "event_id")
    )


def log_check(
    spark, check_type: str, status: str, as_of: str, details: str | None = None, ms: int | None = None
) -> DataFrame:
    """One health record, to be appended to the history."""
    return spark.range(1).select(
        F.lit(as_of).cast("timestamp").alias("check_time"),
        F.lit(check_type).alias("check_type"),
        F.lit(status).alias("status"),
        F.lit(details).cast("string").alias("details"),
        F.lit(ms).cast("int").alias("response_time_ms"),
    )


def check_buckets(history: DataFrame, seconds: int = C.HEALTH_BUCKET_SECONDS) -> DataFrame:
    """Checks and failures per type and fixed bucket of time."""
    return (
        history.groupBy("check_type", F.window("check_time", f"{seconds} seconds").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("checks"),
            F.count_if(F.col("status") == "fail").alias("failures"),
        )
        .select("check_type", F.col("w.start").alias("bucket"), "checks", "failures")
    )


def missed_buckets(history: DataFrame, seconds: int = C.HEALTH_BUCKET_SECONDS) -> DataFrame:
    """Buckets between the first and last check of a type in which it did not run.

    The expected buckets are generated in two steps, days and then the buckets of each day, with a
    shuffle between, so that no task makes a type's whole range; those present are reduced to
    distinct buckets before the two meet.
    """
    present = check_buckets(history, seconds).select("check_type", "bucket")
    step, day = F.make_dt_interval(secs=F.lit(seconds)), F.make_dt_interval(days=F.lit(1))
    # Days count from the first bucket of the type, so that a day holds its buckets whole only where
    # the bucket length divides a day; others would drift.
    if 86_400 % seconds:
        raise ValueError("the bucket length must divide a day")
    days = (
        present.groupBy("check_type")
        .agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
        .select("check_type", "b", F.explode(F.sequence("a", "b", day)).alias("day"))
        .repartition("check_type", "day")
    )
    until = F.least(F.col("day") + day - step, F.col("b"))
    expected = days.select("check_type", F.explode(F.sequence("day", until, step)).alias("bucket"))
    return expected.join(present, ["check_type", "bucket"], "left_anti")


def health_report(history: DataFrame, counts: DataFrame, as_of: str) -> DataFrame:
    """Service report as one JSON object: status, time, state, uptime since the first check in
    seconds, table counts and version.

    ``counts`` is the one-row JSON of table counts; it is read as a scalar.
    """
    moment = F.lit(as_of).cast(history.schema["check_time"].dataType)
    first = history.agg(F.min("check_time").alias("first"), F.count(F.lit(1)).alias("checks"))
    return first.select(
        F.to_json(
            F.struct(
                F.lit("healthy").alias("status"),
                F.lit(as_of).alias("timestamp"),
                F.lit("healthy").alias("database"),
                F.timestamp_diff("SECOND", F.col("first"), moment).alias("uptime"),
                F.from_json(counts.scalar(), "map<string,bigint>").alias("table_counts"),
                F.lit("1.0.0").alias("version"),
            )
        ).alias("report")
    )


def performance_report(
    operations: DataFrame, active: Column, seconds: Column, hits: Column, reads: Column, as_of: str
) -> DataFrame:
    """Active and slow operations and the cache hit ratio as one JSON object."""
    total = F.sum(hits) + F.sum(reads)
    return operations.agg(
        F.count_if(active).alias("active_connections"),
        F.round(F.try_divide(F.sum(hits) * F.lit(100.0), total), 2).alias("cache_hit_ratio"),
        F.count_if(active & (seconds > 1.0)).alias("slow_queries"),
    ).select(F.to_json(F.struct("*", F.lit(as_of).alias("timestamp"))).alias("report"))


def syncs_last_day(queue: DataFrame, as_of: str, by: str) -> DataFrame:
    """Completed syncs per owner in the last 24 hours."""
    moment = F.lit(as_of).cast(queue.schema["ts"].dataType)
    return (
        queue.filter(
            (F.col("status") == "completed")
            & (F.col("ts") > moment - F.make_dt_interval(hours=F.lit(24)))
        )
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("syncs"))
    )


STRETCH = 4096  # gap-long slots handled as one group


def session_slots(activity: DataFrame, key: str, gap_seconds: float, last: Column | None = None) -> DataFrame:
    """Activity reduced to one row per gap-long slot, which always lies in a single run. Slots of
    several parts of the activity may be put together again by ``merged_slots``.

    ``last`` is a struct that begins with the order of the rows; its greatest value is kept.
    """
    gap = int(gap_seconds * 1_000_000)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return activity.groupBy(key, F.floor(micros / F.lit(gap)).cast("long").alias("_slot")).agg(
        F.min("ts").alias("opened"),
        F.max("ts").alias("last_active"),
        F.count(F.lit(1)).alias("events"),
        F.max(F.lit(None).cast("string") if last is None else last).alias("last"),
    )


def merged_slots(slots: DataFrame, key: str) -> DataFrame:
    return slots.groupBy(key, "_slot").agg(
        F.min("opened").alias("opened"),
        F.max("last_active").alias("last_active"),
        F.sum("events").alias("events"),
        F.max("last").alias("last"),
    )


def sessions_of_slots(slots: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """Connections as runs of slots, closed once silence is longer than the gap.

    Runs are formed within stretches of a fixed number of slots. Only runs touching the edge of a
    stretch can continue in the next one; these few are joined up per key.
    """
    gap = int(gap_seconds * 1_000_000)
    slots = slots.withColumn("_stretch", F.floor(F.col("_slot") / F.lit(STRETCH)).cast("long"))
    pause = F.make_dt_interval(secs=F.lit(gap / 1_000_000))
    local = _merge_runs(
        slots, [key, "_stretch"], pause, F.min("_slot").alias("_a"), F.max("_slot").alias("_b")
    )
    edge = (F.col("_a") % STRETCH == 0) | ((F.col("_b") + 1) % STRETCH == 0)
    columns = [key, "opened", "last_active", "events", "last"]
    inner = local.filter(~edge).select(*columns)
    # At most two runs of each key and stretch.
    outer = _merge_runs(local.filter(edge), [key], pause).select(*columns)
    return inner.unionByName(outer).select(
        key, "opened", "last_active", (F.col("last_active") + pause).alias("closed"), "events", "last"
    )


def idle_sessions(activity: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """Connections as runs of activity, for keys of any size."""
    return sessions_of_slots(session_slots(activity, key, gap_seconds), key, gap_seconds).drop("last")


def _merge_runs(parts: DataFrame, keys: list[str], pause: Column, *more: Column) -> DataFrame:
    """Join neighbouring parts unless more than the pause lies between them."""
    along = W.partitionBy(*keys).orderBy("opened")
    starts = F.coalesce(F.col("opened") > F.lag("last_active").over(along) + pause, F.lit(True))
    marked = parts.withColumn("_start", starts.cast("int"))
    numbered = marked.withColumn("_run", F.sum("_start").over(along))
    return numbered.groupBy(*keys, "_run").agg(
        F.min("opened").alias("opened"),
        F.max("last_active").alias("last_active"),
        F.sum("events").alias("events"),
        F.max("last").alias("last"),
        *more,
    )


def latest_states(queue: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last known state of every item, by one small aggregate per item."""
    return queue.groupBy(key).agg(
        F.max_by(F.struct("status", "progress", "ts"), F.struct(*order)).alias("s"),
        F.count_if(F.col("status") == "completed").alias("completions"),
    ).select(key, "s.status", "s.progress", F.col("s.ts").alias("at"), "completions")
