"""Data quality: orphans, enum members, e-mail, duplicates, low-quality photos, settings checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake import catalogs as C
from medialake.functions.text import email_is_valid, trimmed
from medialake.operators.changes import union_all


def _violation(df: DataFrame, rule: str, entity: str, id_: str, detail: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"),
        F.lit(entity).alias("entity"),
        F.col(id_).cast("string").alias("id"),
        detail.cast("string").alias("detail"),
    )


def orphans(projects: DataFrame, photos: DataFrame) -> DataFrame:
    """Photos of unknown projects, projects without photos, and covers that do not exist.

    A cover's slot belongs to its project, so one join and one aggregate per project (whether it has
    photos, and whether one of them has the cover's slot) answer both questions about projects;
    photos are read once more to name those of unknown projects.
    """
    no_project = photos.join(projects.select("project_id"), "project_id", "left_anti")
    seen = (
        projects.select("project_id", "status", "cover_slot")
        .join(photos.select("project_id", "slot"), "project_id", "left")
        .groupBy("project_id", "status", "cover_slot")
        .agg(F.count("slot").alias("photos"), F.count_if(F.col("slot") == F.col("cover_slot")).alias("covers"))
    )

    def found(when: Column, rule: str, detail: str) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule"), F.col(detail).cast("string").alias("detail")))

    rules = F.array_compact(
        F.array(
            found(F.col("photos") == 0, "project without photos", "status"),
            found(F.col("cover_slot").isNotNull() & (F.col("covers") == 0), "cover photo missing", "cover_slot"),
        )
    )
    broken = seen.select(F.col("project_id").cast("string").alias("id"), F.inline(rules)).select(
        "rule", F.lit("project").alias("entity"), "id", "detail"
    )
    return _violation(no_project, "photo without project", "photo", "photo_id", F.col("project_id")).unionByName(broken)


def enum_violations(df: DataFrame, entity: str, id_: str, column: str, allowed: list[str]) -> DataFrame:
    bad = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(allowed))
    return _violation(bad, f"{column} not allowed", entity, id_, F.col(column))


def invalid_emails(users: DataFrame) -> DataFrame:
    bad = users.filter(~F.coalesce(email_is_valid(F.col("email")), F.lit(False)))
    return _violation(bad, "email not valid", "user", "user_id", F.col("email"))


def duplicate_emails(users: DataFrame) -> DataFrame:
    """E-mail addresses used more than once, ignoring case and outer white space."""
    return (
        users.groupBy(F.lower(trimmed("email")).alias("email"))
        .agg(F.count(F.lit(1)).alias("users"))
        .filter("users > 1")
    )


def count_violations(reconciled: DataFrame, entity: str, key: str) -> DataFrame:
    return _violation(reconciled.filter("NOT matches"), "stored count differs", entity, key, F.col("delta"))


def low_quality(photos: DataFrame, settings: DataFrame) -> DataFrame:
    """Photos below their project's limits, where the project flags them. Projects without own
    settings use the defaults."""
    d = C.AUTOMATION_DEFAULTS
    s = settings.select(
        "project_id", "min_long_edge_px", "min_exposure_quality", "auto_flag_low_quality"
    )
    low = (
        F.col("long_edge") < F.coalesce("min_long_edge_px", F.lit(d["min_long_edge_px"]))
    ) | (
        F.col("exposure_quality")
        < F.coalesce("min_exposure_quality", F.lit(d["min_exposure_quality"]))
    )
    gate = F.coalesce("auto_flag_low_quality", F.lit(d["auto_flag_low_quality"]))
    return photos.join(s, "project_id", "left").select(
        "photo_id", "project_id", "long_edge", "exposure_quality", (gate & F.coalesce(low, F.lit(False))).alias("low_quality")
    )


def duplicate_assets(texts: DataFrame, key: str, content: str) -> DataFrame:
    """Groups of rows with equal content: checksum, number of copies and first key. The groups hold
    one small aggregate each, however many copies there are."""
    return (
        texts.select(key, F.sha2(content, 256).alias("checksum"))
        .groupBy("checksum")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_id"))
        .filter("copies > 1")
    )


def _present(keys: list[str], also: Column | None = None) -> list[Column]:
    ok = F.lit(True) if also is None else also
    return [
        F.coalesce(F.bool_or((F.col("key") == k) & ok), F.lit(False)).cast("int").alias(f"_has_{i}")
        for i, k in enumerate(keys)
    ]


def _missing(keys: list[str]) -> Column:
    found = sum((F.coalesce(f"_has_{i}", F.lit(0)) for i in range(len(keys))), F.lit(0))
    return (F.lit(len(keys)) - found).cast("long")


def environment_problems(settings: DataFrame, sources: DataFrame) -> DataFrame:
    """Per settings source: errors for required keys missing and for placeholders left in a
    production source, warnings for empty values.

    ``settings`` has every line of a source, also those that a later line of the same key replaces.

    ``sources`` has (source, production) and lists every source, also those without any setting.
    The few required keys are tested by conditional aggregates over a source's own rows, so sources
    and keys are not multiplied.
    """
    keys = C.REQUIRED_SERVER_KEYS
    upper = F.col("key").rlike("^[A-Z_]*$")
    seen = settings.groupBy("source").agg(
        *_present(keys),
        F.count_if(upper & (F.col("value") == "")).alias("_empty"),
        F.bool_or(F.contains("value", F.lit(C.PLACEHOLDER))).alias("_placeholder"),
    )
    left = F.when(F.col("production") & F.coalesce("_placeholder", F.lit(False)), 1).otherwise(0)
    errors = (_missing(keys) + left).cast("long")
    return sources.join(seen, "source", "left").select(
        "source",
        errors.alias("errors"),
        F.coalesce("_empty", F.lit(0)).alias("warnings"),
        (errors == 0).alias("valid"),
    )


def device_problems(settings: DataFrame, sources: DataFrame) -> DataFrame:
    """Per device: a warning for each wanted key that is missing or empty."""
    keys = C.WANTED_DEVICE_KEYS
    seen = settings.groupBy("source").agg(*_present(keys, F.col("value") != ""))
    return sources.select("source").join(seen, "source", "left").select(
        "source", _missing(keys).alias("warnings"), (_missing(keys) == 0).alias("clean")
    )
