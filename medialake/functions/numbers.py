"""Numeric expressions: rounding, clamping, bands, camera settings written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column) -> Column:
    """Round to a whole number with halves going up, also below zero (-2.5 gives -2)."""
    return F.floor(c + F.lit(0.5)).cast("long")


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def progress_label(state: Column, progress: Column) -> Column:
    """Status chip text: full progress counts as synced whatever the state says."""
    pct = clamp01(F.coalesce(progress, F.lit(0.0)))
    return (
        F.when((state == "synced") | (pct >= 1.0), F.lit("Synced"))
        .when(
            state == "uploading",
            F.concat(round_half_up(pct * F.lit(100.0)).cast("string"), F.lit("%")),
        )
        .when(state == "queued", F.lit("Queued"))
        .when(state == "paused", F.lit("Paused"))
        .otherwise(F.lit("Error"))
    )


def sync_state(status: Column, progress: Column) -> Column:
    """Upload status as shown: complete wins, known states pass, anything else is synced."""
    return (
        F.when((progress == 1.0) | (status == "synced"), F.lit("synced"))
        .when(status.isin("error", "paused", "queued", "uploading"), status)
        .otherwise(F.lit("synced"))
    )


def storage_band(used: Column, total: Column) -> Column:
    pct = F.try_divide(used * F.lit(100.0), total)
    return (
        F.when(pct > 80, F.lit("error")).when(pct > 60, F.lit("warning")).otherwise(F.lit("success"))
    )


def disk_band(pct: Column) -> Column:
    return F.when(pct < 90, F.lit("OK")).otherwise(F.lit("High"))


def slider_percent(value: Column, low: float = -100.0, high: float = 100.0) -> Column:
    return F.try_divide((value - F.lit(low)) * F.lit(100.0), F.lit(high) - F.lit(low))


def parse_shutter(c: Column) -> Column:
    """``1/1000`` and ``30s`` as seconds."""
    num = F.regexp_extract(c, r"^(\d+(?:\.\d+)?)/(\d+(?:\.\d+)?)s?$", 1).try_cast("double")
    den = F.regexp_extract(c, r"^(\d+(?:\.\d+)?)/(\d+(?:\.\d+)?)s?$", 2).try_cast("double")
    plain = F.regexp_extract(c, r"^(\d+(?:\.\d+)?)s?$", 1).try_cast("double")
    return F.coalesce(F.try_divide(num, den), plain)


def parse_aperture(c: Column) -> Column:
    """``f/2.8`` as 2.8."""
    return F.regexp_extract(c, r"^[fF]/(\d+(?:\.\d+)?)$", 1).try_cast("double")


def parse_size_mb(c: Column) -> Column:
    """``24.5 MB``, ``800 KB``, ``1.2 GB`` as megabytes."""
    n = F.regexp_extract(c, r"^(\d+(?:\.\d+)?)\s*([KMG]B)$", 1).try_cast("double")
    unit = F.regexp_extract(c, r"^(\d+(?:\.\d+)?)\s*([KMG]B)$", 2)
    return (
        F.when(unit == "KB", n / F.lit(1024.0))
        .when(unit == "GB", n * F.lit(1024.0))
        .otherwise(n)
    )
