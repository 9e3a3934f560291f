"""Preset rules, matching, usage, versions and defaults."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake import catalogs as C
from medialake.functions.text import contains_ci
from medialake.plans.ordering import sequenced


def _place(*words: str) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | F.contains("_place", F.lit(word))
    return test


def rule_conditions() -> dict[str, Column]:
    """Condition of each rule over ``_place`` and ``_camera`` (location and camera in lower case),
    iso, hour, shutter (seconds) and aperture. A missing measurement fails its test."""
    hour, iso = F.col("hour"), F.col("iso")
    return {
        "Track Day": _place("pit", "track", "race") & ((iso > 800) | hour.between(6, 18)),
        "Night Shooter": ((hour < 6) | (hour > 20))
        & ((F.col("shutter") < F.lit(1.0 / 60.0)) | (iso > 1600)),
        "Portrait Pro": _place("studio", "portrait", "headshot") & (F.col("aperture") > 0) & (F.col("aperture") < F.lit(2.8)),
        "Landscape Master": _place("mountain", "forest", "beach", "park") & hour.between(6, 18),
        "Urban Edge": _place("city", "urban", "street", "building") & hour.between(8, 20),
        "Vintage Film": (iso <= 400)
        | F.contains("_camera", F.lit("film"))
        | F.contains("_camera", F.lit("analog")),
        "Sunset Glow": (hour.between(16, 19) | hour.between(5, 8))
        & _place("beach", "mountain", "park"),
        "Aston Mono": _place("street", "architecture", "portrait") & hour.between(10, 16),
    }


def _bits(tests: dict[str, Column]) -> Column:
    """The rules that hold as one number: bit p is set for the rule of priority p."""
    mask = F.lit(0)
    for priority, name, _ in C.PRESET_RULES:
        bit = F.when(tests[name], 1 << priority).otherwise(0)
        mask = mask.bitwiseOR(bit)
    return mask


def _top_priority(mask: Column) -> Column:
    """Priority of the highest rule in the mask, null when it is empty."""
    out = None
    for priority, _, _ in C.PRESET_RULES:
        hit = mask >= (1 << priority)
        out = F.when(hit, priority) if out is None else out.when(hit, priority)
    return out


def with_met_rules(assets: DataFrame) -> DataFrame:
    """Add ``met``, the mask of the rules each photo meets."""
    return (
        assets.withColumns(
            {
                "_place": F.lower(F.coalesce("location", F.lit(""))),
                "_camera": F.lower(F.coalesce("camera", F.lit(""))),
            }
        )
        .withColumn("met", _bits(rule_conditions()))
        .drop("_place", "_camera")
    )


def with_served_rules(presets: DataFrame) -> DataFrame:
    """Add ``served``, the mask of the rules each preset serves by its name or description."""
    tests = {
        name: contains_ci("name", name) | contains_ci("description", words)
        for _, name, words in C.PRESET_RULES
    }
    return presets.withColumn("served", _bits(tests))


def rule_presets(presets: DataFrame, seq: str = "preset_id") -> DataFrame:
    """First preset serving each rule.

    Every preset tests all rules in its own row, so no pairs of rule and preset are formed; the
    result has at most one row per rule.
    """
    rules = F.array(
        *[
            F.struct(F.lit(priority).alias("priority"), F.lit(name).alias("rule"))
            for priority, name, _ in C.PRESET_RULES
        ]
    )
    return (
        with_served_rules(presets)
        .filter("served <> 0")
        .select("preset_id", F.col(seq).alias("_seq"), "served", F.inline(rules))
        .filter(F.expr("(served & shiftleft(1, priority)) <> 0"))
        .groupBy("rule", "priority")
        .agg(F.min_by("preset_id", "_seq").alias("preset_id"))
    )


def preset_match(assets: DataFrame, presets: DataFrame) -> DataFrame:
    """Best preset of every photo: the highest rule it meets that some preset serves.

    The presets are first reduced to one row: a mask of served rules and a map of at most eight
    entries, read as a scalar. Photos are then matched in their own row, without join or shuffle.
    Confidence is the rule's priority in percent of ten.
    """
    # At most one entry per rule, so the collected list is bounded by the rule list.
    found = rule_presets(presets).agg(
        F.struct(
            F.coalesce(F.bit_or(F.expr("shiftleft(1, priority)")), F.lit(0)).alias("mask"),
            F.map_from_entries(F.collect_list(F.struct("priority", "preset_id"))).alias("ids"),
        ).alias("found")
    )
    names = F.create_map(*[F.lit(x) for p, n, _ in C.PRESET_RULES for x in (p, n)])
    matched = (
        with_met_rules(assets)
        .select("photo_id", "met", found.scalar().alias("_found"))
        .withColumn("_top", _top_priority(F.col("met").bitwiseAND(F.col("_found.mask"))))
    )
    return matched.select(
        "photo_id",
        F.bit_count("met").alias("rules_met"),
        F.try_element_at(names, F.col("_top")).alias("rule"),
        F.try_element_at("_found.ids", F.col("_top")).alias("matched_preset_id"),
        (F.coalesce("_top", F.lit(0)) * 10).alias("confidence"),
    )


def applied_confidence(assets: DataFrame, presets: DataFrame) -> DataFrame:
    """Confidence in the preset each photo already uses: the highest rule that the photo meets and
    that this preset serves, in percent of ten; zero without one. Only the two masks are joined."""
    photos = with_met_rules(assets).select("photo_id", "preset_id", "met")
    looks = with_served_rules(presets).select("preset_id", "served")
    top = _top_priority(F.col("met").bitwiseAND(F.col("served")))
    return photos.join(looks, "preset_id", "left").select(
        "photo_id", "preset_id", (F.coalesce(top, F.lit(0)) * 10).alias("confidence")
    )


def preset_usage(presets: DataFrame, photos: DataFrame) -> DataFrame:
    used = photos.groupBy("preset_id").agg(F.count(F.lit(1)).alias("_n"))
    return presets.select("preset_id", "name").join(used, "preset_id", "left").select(
        "preset_id", "name", F.coalesce("_n", F.lit(0)).alias("applied_count")
    )


def default_presets(projects: DataFrame, defaults: DataFrame, presets: DataFrame) -> DataFrame:
    """Default preset of each project; null when none is set or it was deleted."""
    looks = presets.select("preset_id", F.col("name").alias("preset_name"))
    return (
        projects.select("project_id")
        .join(defaults.select("project_id", "preset_id"), "project_id", "left")
        .join(looks, "preset_id", "left")
        .select(
            "project_id",
            F.when(F.col("preset_name").isNotNull(), F.col("preset_id")).alias("preset_id"),
            "preset_name",
        )
    )


STEP = 1000  # turns of an item that are handled together


def _step(order: str) -> Column:
    return F.floor(F.col(order) / F.lit(STEP))


def version_log(edits: DataFrame, key: str, order: str, settings: str) -> DataFrame:
    """Versions of each item: number, settings, and the settings and id of the version before.
    ``order`` is a number."""
    log = sequenced(edits, [key], [order], _step(order), lag=[settings])
    return log.withColumns(
        {
            "version": F.col("seq"),
            "previous_id": F.when(
                F.col("seq") > 1,
                F.concat(F.col(key).cast("string"), F.lit("_v"), (F.col("seq") - 1).cast("string")),
            ),
        }
    ).drop("seq")


def rollback(
    log: DataFrame, requests: DataFrame, key: str, settings: str, last: DataFrame | None = None
) -> DataFrame:
    """Append one version per request whose settings equal an older version's.

    ``log`` has (key, version, settings); ``requests`` has (key, target), one per key. A request for
    an unknown version, or for the current one, changes nothing. ``last`` may give (key, last), the
    last version of each key, where it is known more cheaply than from the log.
    """
    if last is None:
        last = log.groupBy(key).agg(F.max("version").alias("last"))
    # The log is read once: the row of a wanted version stands for itself and for the new version.
    asked = requests.join(last, key).filter("target < last")
    row = F.struct("version", settings, F.lit(None).cast("string").alias("note"))
    fresh = F.struct(
        (F.col("last") + 1).alias("version"),
        settings,
        F.concat(F.lit("Rolled back to version "), F.col("target").cast("string")).alias("note"),
    )
    both = F.when(F.col("version") == F.col("target"), F.array(row, fresh)).otherwise(F.array(row))
    return log.join(asked, key, "left").select(key, F.inline(both))


def add_versions(presets: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """New settings for presets, the old ones kept in the embedded history.

    ``presets`` has (preset_id, version, last_edited, settings, previous_versions); ``changes`` has
    (preset_id, new_settings), one per preset.
    """
    old = F.struct(
        F.concat("preset_id", F.lit("_v"), F.col("version").cast("string")).alias("id"),
        F.col("version").alias("version"),
        F.col("last_edited").alias("created_at"),
        F.col("settings").alias("settings"),
        F.array().cast("array<string>").alias("changes"),
    )
    history = F.when(
        F.col("previous_versions").isNull(), F.array(old)
    ).otherwise(F.array_append("previous_versions", old))
    hit = F.col("new_settings").isNotNull()
    edited = F.lit(as_of).cast(presets.schema["last_edited"].dataType)
    return presets.join(changes, "preset_id", "left").select(
        *[
            c
            for c in presets.columns
            if c not in ("version", "last_edited", "settings", "previous_versions")
        ],
        F.when(hit, F.col("version") + 1).otherwise(F.col("version")).alias("version"),
        F.when(hit, edited).otherwise(F.col("last_edited")).alias("last_edited"),
        F.when(hit, F.col("new_settings")).otherwise(F.col("settings")).alias("settings"),
        F.when(hit, history).otherwise(F.col("previous_versions")).alias("previous_versions"),
    )


def edit_diff(edits: DataFrame, key: str, order: str) -> DataFrame:
    """Change of every adjustment against the edit before; missing values are left out, and a
    value without a predecessor counts from zero."""
    rows = sequenced(edits, [key], [order], _step(order), lag=["adjustments"])
    empty = F.create_map().cast("map<string,double>")
    kept = F.map_filter("adjustments", lambda k, v: v.isNotNull())
    before = F.map_filter(F.coalesce("prev_adjustments", empty), lambda k, v: v.isNotNull())
    diff = F.map_filter(
        F.map_zip_with(kept, before, lambda k, a, b: a - F.coalesce(b, F.lit(0.0))),
        lambda k, v: v.isNotNull(),
    )
    return rows.select(key, order, kept.alias("adjustments"), diff.alias("diff"))


def duplicate_preset(presets: DataFrame, preset_id: Any, new_id: Any, as_of: str) -> DataFrame:
    """Add a copy of one preset with its counters reset."""
    stamp = F.lit(as_of)
    resets = {
        "preset_id": F.lit(new_id),
        "name": F.concat("name", F.lit(" (Copy)")),
        "created_at": stamp,
        "last_edited": stamp,
        "version": F.lit(1),
        "applied_count": F.lit(0),
        "is_active": F.lit(False),
        "shared": F.lit(False),
    }
    copy = presets.filter(F.col("preset_id") == F.lit(preset_id)).withColumns(
        {n: c.cast(presets.schema[n].dataType) for n, c in resets.items() if n in presets.columns}
    )
    return presets.unionByName(copy)


def delete_preset(
    presets: DataFrame, defaults: DataFrame, removed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Presets and project defaults without the removed presets."""
    gone = removed.select("preset_id")
    return (
        presets.join(gone, "preset_id", "left_anti"),
        defaults.join(gone, "preset_id", "left_anti"),
    )
