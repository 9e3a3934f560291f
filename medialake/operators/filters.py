"""Filters, lookups and projections over any entity frame."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake import catalogs as C
from medialake.functions import numbers, text


def by_key(df: DataFrame, key: str, value: Any | None) -> DataFrame:
    """Rows with the given foreign key; no value means no filter."""
    return df if value is None else df.filter(F.col(key) == F.lit(value))


def lookup(df: DataFrame, key: str, value: Any) -> DataFrame:
    """At most one row; empty when missing. The key is unique, so the limit leaves nothing out."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def visible_presets(presets: DataFrame, user_id: Any = None, public_only: bool = False) -> DataFrame:
    """Public presets only, else a user's own and public ones, else all."""
    if public_only:
        return presets.filter("is_public")
    if user_id is not None:
        return presets.filter((F.col("owner_id") == F.lit(user_id)) | F.col("is_public"))
    return presets


def rest_query(
    df: DataFrame,
    equals: dict[str, Any] | None = None,
    select: list[str] | None = None,
    order: list[Column | str] | None = None,
    limit: int | None = None,
    *,
    key: str,
) -> DataFrame:
    """Table endpoint: equality filters, column list, order and the page cap.

    ``key`` is a unique column that completes the order, so that a page is well defined.
    """
    for name, value in (equals or {}).items():
        df = by_key(df, name, value)
    df = df.orderBy(*(order or []), key)
    df = df.limit(C.PAGE_CAP if limit is None else min(limit, C.PAGE_CAP))
    return df.select(*select) if select else df


def gallery_filter(items: DataFrame, mode: str = "all", query: str = "") -> DataFrame:
    """Favourites, processed or unprocessed items, then file names or tags with the query."""
    if mode == "favorites":
        items = items.filter("favorite")
    elif mode == "processed":
        items = items.filter("processed")
    elif mode == "unprocessed":
        items = items.filter(~F.col("processed"))
    if query.strip():
        items = items.filter(
            text.contains_ci("filename", query) | text.any_contains_ci("tags", query)
        )
    return items


def status_tab(df: DataFrame, status: str = "all") -> DataFrame:
    return df if status == "all" else df.filter(F.col("status") == status)


def catalog_search(
    df: DataFrame,
    query: str,
    category: str = "all",
    scalars: list[str] | None = None,
    arrays: list[str] | None = None,
) -> DataFrame:
    """Any scalar column or list element contains the query, within one category or all."""
    tests = [text.contains_ci(c, query) for c in scalars or []]
    tests += [text.any_contains_ci(c, query) for c in arrays or []]
    df = df.filter(reduce(lambda a, b: a | b, tests))
    return df if category == "all" else df.filter(F.col("category") == category)


def active_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("is_active", F.lit(True)))


def not_revoked(keys: DataFrame, key_id: Any | None = None) -> DataFrame:
    return by_key(keys, "key_id", key_id).filter(~F.coalesce("revoked", F.lit(False)))


def sections(presets: DataFrame) -> DataFrame:
    """Presets labelled team or personal; lists stay rows, whatever their length."""
    return presets.withColumn("section", _section())


def section_counts(presets: DataFrame) -> DataFrame:
    return presets.groupBy(_section().alias("section")).agg(F.count(F.lit(1)).alias("presets"))


def _section() -> Column:
    return F.when(F.col("shared"), "team").otherwise("personal")


def apply_set(items: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Selected items that are completed."""
    done = items.filter(F.col("status") == "completed")
    return done.join(selected.select(key), key, "left_semi")


def gallery_items(photos: DataFrame) -> DataFrame:
    """Photos as gallery items: default size, file name, upload state, processed flag.

    ``seq`` is the place of the photo in its project, used when it has no title.
    """
    state = (
        F.when(F.col("upload_status") == "synced", "synced")
        .when(F.col("upload_status") == "error", "offline")
        .otherwise("processing")
    )
    named = F.when(F.col("title") != "", F.col("title"))
    return photos.select(
        F.col("photo_id").alias("id"),
        "project_id",
        F.lit(C.GALLERY_WIDTH).alias("width"),
        F.lit(C.GALLERY_HEIGHT).alias("height"),
        F.coalesce(named, F.concat(F.lit("Photo "), F.col("seq").cast("string"))).alias("filename"),
        state.alias("uploaded_state"),
        "upload_progress",
        F.coalesce(F.col("status") != "raw", F.lit(True)).alias("processed"),
        F.lit(False).alias("favorite"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def with_sync_state(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "sync_state", numbers.sync_state(F.col("upload_status"), F.col("upload_progress"))
    )


def mask_settings(settings: DataFrame) -> DataFrame:
    return settings.withColumn("value", text.mask_secret("key", "value"))


def activate_preset(presets: DataFrame, preset_id: Any) -> DataFrame:
    """Exactly the given preset is active."""
    return presets.withColumn("is_active", F.col("preset_id") == F.lit(preset_id))
