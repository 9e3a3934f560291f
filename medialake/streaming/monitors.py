"""Monitors over operational streams.

There are two kinds. The live ones take and return a streaming DataFrame; they emit a window once the
watermark has closed it, and what arrives later than their delay is lost. The stored ones are for
events that are already there, in files whose order says nothing about time: every batch is reduced
to partial aggregates that can be added up, and the parts are put together when they are read. No
row is late for these, and every window counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake import catalogs as C
from medialake.operators import audit, health
from medialake.streaming.runner import run_parts


def health_windows(
    checks: DataFrame, length: str = "24 hours", slide: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Checks, failures and mean response of the sliding day, per check type; live, rows later than ``delay`` are lost."""
    return (
        checks.withWatermark("check_time", delay)
        .groupBy(F.window("check_time", length, slide).alias("w"), "check_type")
        .agg(
            F.count(F.lit(1)).alias("checks"),
            F.count_if(F.col("status") == "fail").alias("failures"),
            F.sum(F.col("response_time_ms").cast("long")).alias("total_ms"),
        )
        .select("check_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "checks", "failures", "total_ms")
    )


def check_buckets(
    checks: DataFrame, seconds: int = C.HEALTH_BUCKET_SECONDS, delay: str = "10 minutes"
) -> DataFrame:
    """Checks per type and fixed bucket; live, rows later than ``delay`` are lost."""
    return (
        checks.withWatermark("check_time", delay)
        .groupBy(F.window("check_time", f"{seconds} seconds").alias("w"), "check_type")
        .agg(F.count(F.lit(1)).alias("checks"))
        .select("check_type", F.col("w.start").alias("bucket"), "checks")
    )


def idle_sessions(
    activity: DataFrame, key: str, gap_seconds: int, delay: str = "10 minutes"
) -> DataFrame:
    """Connections, closed after a silent gap; live, rows later than ``delay`` are lost."""
    return (
        activity.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", f"{gap_seconds} seconds").alias("w"), key)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(key, F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "events")
    )


def debounced(
    edits: DataFrame,
    key: str,
    value: str,
    tie: str,
    gap_ms: int = C.NOTES_DEBOUNCE_MS,
    delay: str = "10 seconds",
) -> DataFrame:
    """The last value of every burst of edits, by time and then ``tie``; live, rows later than
    ``delay`` are lost."""
    return (
        edits.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", f"{gap_ms} milliseconds").alias("w"), key)
        .agg(F.max_by(value, F.struct("ts", tie)).alias(value), F.max("ts").alias("saved_at"))
        .select(key, "saved_at", value)
    )


def audit_alerts(
    events: DataFrame, pattern: str, id_: str, delay: str = "10 minutes"
) -> DataFrame:
    """Alert lines, each event once although it may be delivered again within the ``delay``; live."""
    return (
        audit.alerts(events, pattern)
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark([id_])
    )


def syncs_per_day(
    queue: DataFrame, by: str, slide: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Completed syncs in the sliding 24 hours; live, rows later than ``delay`` are lost."""
    return (
        queue.filter(F.col("status") == "completed")
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", "24 hours", slide).alias("w"), by)
        .agg(F.count(F.lit(1)).alias("syncs"))
        .select(by, F.col("w.end").alias("until"), "syncs")
    )


def _day_windows(parts: DataFrame, hour: str) -> DataFrame:
    """Each hourly row once for every full-hour window of 24 hours that holds it, as ``start``."""
    hours = F.sequence(F.col(hour) - F.make_dt_interval(hours=F.lit(23)), F.col(hour), F.make_dt_interval(hours=F.lit(1)))
    return parts.withColumn("start", F.explode(hours))


def run_health_windows(checks: DataFrame, name: str = "health-24h") -> DataFrame:
    """Checks, failures and response time of every 24 hours, from stored checks.

    Hours are counted first; only these few rows are copied into the windows that hold them.
    """

    def part(rows: DataFrame) -> DataFrame:
        return rows.groupBy("check_type", F.date_trunc("hour", "check_time").alias("hour")).agg(
            F.count(F.lit(1)).alias("checks"),
            F.count_if(F.col("status") == "fail").alias("failures"),
            F.sum(F.col("response_time_ms").cast("long")).alias("total_ms"),
        )

    sums = [F.sum(c).alias(c) for c in ("checks", "failures", "total_ms")]
    hours = run_parts(checks, name, part).groupBy("check_type", "hour").agg(*sums)
    return (
        _day_windows(hours, "hour")
        .groupBy("check_type", "start")
        .agg(*sums)
        .withColumn("end", F.col("start") + F.make_dt_interval(hours=F.lit(24)))
    )


def run_check_buckets(
    checks: DataFrame, seconds: int = C.HEALTH_BUCKET_SECONDS, name: str = "check-buckets"
) -> DataFrame:
    """Checks per type and fixed bucket, from stored checks."""

    def part(rows: DataFrame) -> DataFrame:
        return health.check_buckets(rows, seconds).select("check_type", "bucket", "checks")

    return run_parts(checks, name, part).groupBy("check_type", "bucket").agg(F.sum("checks").alias("checks"))


def run_idle_sessions(activity: DataFrame, key: str, gap_seconds: float, name: str = "idle-sessions") -> DataFrame:
    """Connections, closed after a silent gap, from stored activity; open ones count as well."""
    slots = run_parts(activity, name, lambda rows: health.session_slots(rows, key, gap_seconds))
    sessions = health.sessions_of_slots(health.merged_slots(slots, key), key, gap_seconds)
    return sessions.select(key, "opened", "closed", "events")


def run_debounced(
    edits: DataFrame, key: str, value: str, tie: str, gap_ms: int = C.NOTES_DEBOUNCE_MS, name: str = "notes"
) -> DataFrame:
    """The last value of every burst of stored edits, by time and then ``tie``."""
    last = F.struct("ts", tie, value)
    slots = run_parts(edits, name, lambda rows: health.session_slots(rows, key, gap_ms / 1000, last))
    bursts = health.sessions_of_slots(health.merged_slots(slots, key), key, gap_ms / 1000)
    return bursts.select(key, F.col("last.ts").alias("saved_at"), f"last.{value}")


def run_audit_alerts(events: DataFrame, pattern: str, id_: str, name: str = "alerts") -> DataFrame:
    """Alert lines of stored events, each event once however often it was delivered."""
    return run_parts(events, name, lambda rows: audit.alerts(rows, pattern)).dropDuplicates([id_])


def run_syncs_per_day(queue: DataFrame, by: str, name: str = "syncs") -> DataFrame:
    """Completed syncs in every 24 hours up to a full hour, from a stored queue."""

    def part(rows: DataFrame) -> DataFrame:
        done = rows.filter(F.col("status") == "completed")
        return done.groupBy(by, F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("syncs"))

    sums = F.sum("syncs").alias("syncs")
    hours = run_parts(queue, name, part).groupBy(by, "hour").agg(sums)
    windows = _day_windows(hours, "hour").groupBy(by, "start").agg(sums)
    return windows.select(by, (F.col("start") + F.make_dt_interval(hours=F.lit(24))).alias("until"), "syncs")


COMPACT_EVERY = 32  # batches whose parts are merged into one


def run_latest_states(queue: DataFrame, key: str, order: list[str], name: str = "states") -> DataFrame:
    """Latest state per item, from the latest states within every batch.

    A batch writes only its own items, as a part named by the batch, so a batch that is run again
    writes the same part again. After every ``COMPACT_EVERY`` batches their parts are merged into one
    of the next level, and so on, so there are few parts to read and each item is rewritten a number
    of times that grows with the logarithm of the batches.
    """
    fields = [c for c in queue.columns if c != key]
    by = F.struct(*[F.col(f"s.{o}") for o in order])

    def part(rows: DataFrame) -> DataFrame:
        done = F.count_if(F.col("status") == "completed")
        last = F.max_by(F.struct(*fields), F.struct(*order)).alias("s")
        return rows.groupBy(key).agg(last, done.alias("completions"))

    def merged(parts: DataFrame) -> DataFrame:
        return parts.groupBy(key).agg(F.max_by("s", by).alias("s"), F.sum("completions").alias("completions"))

    states = run_parts(queue, name, part, merged, COMPACT_EVERY)
    return merged(states).select(key, "s.*", "completions")
