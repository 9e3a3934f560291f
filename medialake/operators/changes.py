"""Change sets applied to entity frames: patches, upserts, replacements, removals, retention.

Each returns the new state of the table. Change sets hold at most one row per key.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.functions.tags import add_tag
from medialake.session import file_system


def _stamp(df: DataFrame, column: str, as_of: str) -> Column:
    return F.lit(as_of).cast(df.schema[column].dataType)


def patch(
    current: DataFrame, patches: DataFrame, key: str, as_of: str, touched: str = "updated_at"
) -> DataFrame:
    """Overlay the given fields and touch the time; a null in a patch leaves the field alone.
    Patches of unknown keys are ignored."""
    fields = [c for c in patches.columns if c != key]
    p = patches.select(key, *[F.col(c).alias(f"_p_{c}") for c in fields], F.lit(True).alias("_hit"))
    joined = current.join(p, key, "left")
    out = []
    for c in current.columns:
        col = F.coalesce(f"_p_{c}", c) if c in fields else F.col(c)
        if c == touched:
            col = F.when(F.col("_hit"), _stamp(current, c, as_of)).otherwise(F.col(c))
        out.append(col.alias(c))
    return joined.select(*out)


def unknown_keys(current: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Patches that name no existing row."""
    return patches.join(current.select(key), key, "left_anti")


def upsert(
    current: DataFrame,
    patches: DataFrame,
    key: str,
    defaults: dict[str, Any],
    as_of: str,
    touched: str = "updated_at",
) -> DataFrame:
    """Patch existing rows and create missing ones from the defaults. Every column but the key and
    the time must have a default, which may be null."""
    fields = [c for c in patches.columns if c != key]
    if unknown := [c for c in current.columns if c not in (key, touched) and c not in defaults]:
        raise ValueError(f"no default for {', '.join(unknown)}")
    p = patches.select(key, *[F.col(c).alias(f"_p_{c}") for c in fields], F.lit(True).alias("_hit"))
    c_ = current.withColumn("_old", F.lit(True))
    joined = c_.join(p, key, "full")
    out = []
    for c in current.columns:
        kind = current.schema[c].dataType
        if c == key:
            col = F.col(c)
        elif c == touched:
            col = F.when(F.col("_hit"), _stamp(current, c, as_of)).otherwise(F.col(c))
        else:
            default = F.lit(defaults[c]).cast(kind)
            fresh = F.when(F.col("_old").isNull(), default).otherwise(F.col(c))
            col = F.coalesce(f"_p_{c}", fresh) if c in fields else fresh
        out.append(col.alias(c))
    return joined.select(*out)


def insert_absent(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add rows whose key is not there yet."""
    return current.unionByName(rows.join(current.select(*keys), keys, "left_anti"))


def replace_rows(
    current: DataFrame, rows: DataFrame, key: str, as_of: str, touched: str = "updated_at"
) -> DataFrame:
    """Put whole rows in place of those with the same key, or add them."""
    fresh = rows.withColumn(touched, _stamp(current, touched, as_of))
    return current.join(rows.select(key), key, "left_anti").unionByName(fresh)


def append_rows(current: DataFrame, rows: DataFrame) -> DataFrame:
    return current.unionByName(rows, allowMissingColumns=True)


def camera_status(cameras: DataFrame, updates: DataFrame, as_of: str) -> DataFrame:
    """New statuses; the sync time moves only for cameras that become connected."""
    u = updates.select("camera_id", F.col("status").alias("_new"))
    return cameras.join(u, "camera_id", "left").select(
        *[c for c in cameras.columns if c not in ("status", "last_sync")],
        F.coalesce("_new", "status").alias("status"),
        F.when(F.col("_new") == "connected", _stamp(cameras, "last_sync", as_of))
        .otherwise(F.col("last_sync"))
        .alias("last_sync"),
    )


def cascade_delete(children: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Children whose parent was not removed."""
    return children.join(removed.select(key), key, "left_anti")


def batch_action(
    rows: DataFrame, selected: DataFrame, key: str, action: str, value: Column | None = None
) -> DataFrame:
    """Apply one action to the selected rows: set a preset, add a tag, add a format, or delete.

    Where the selection is a condition on the rows themselves, ``batch_where`` needs no join.
    """
    picked = selected.select(key).distinct()
    if action == "delete":
        return rows.join(picked, key, "left_anti")
    marked = rows.join(picked.withColumn("_hit", F.lit(True)), key, "left")
    return batch_where(marked, F.col("_hit"), action, value).drop("_hit")


def batch_where(rows: DataFrame, selected: Column, action: str, value: Column | None = None) -> DataFrame:
    """The same for the rows that meet a condition, each in its own place."""
    hit = F.coalesce(selected, F.lit(False))
    if action == "delete":
        return rows.filter(~hit)
    target = {"preset": "preset_id", "tag": "tags", "export": "export_formats"}[action]
    new = value.cast(rows.schema[target].dataType) if action == "preset" else add_tag(F.col(target), value)
    return rows.withColumn(target, F.when(hit, new).otherwise(F.col(target)))


def toggle_selection(selected: DataFrame, toggled: DataFrame, key: str) -> DataFrame:
    """Selected ids after each toggled id changed its membership."""
    both = selected.select(key, F.lit(1).alias("_n")).unionByName(
        toggled.select(key, F.lit(1).alias("_n"))
    )
    return both.groupBy(key).agg((F.sum("_n") % 2).alias("_odd")).filter("_odd = 1").select(key)


def changed_rows(saved: DataFrame, draft: DataFrame, key: str) -> DataFrame:
    """Rows that differ between the saved table and a draft: added, removed or changed.

    Both sides are reduced to a key and a hash of the row, so wide rows are not shuffled.
    """
    columns = [c for c in saved.columns if c != key]

    def digest(df: DataFrame, name: str) -> DataFrame:
        text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        return df.select(key, F.sha2(text, 256).alias(name))

    a, b = digest(saved, "_a"), digest(draft, "_b")
    kind = (
        F.when(F.col("_a").isNull(), "added")
        .when(F.col("_b").isNull(), "removed")
        .when(F.col("_a") != F.col("_b"), "changed")
    )
    return a.join(b, key, "full").select(key, kind.alias("change")).filter("change IS NOT NULL")


def retain(df: DataFrame, ts: str, days: int, as_of: str) -> DataFrame:
    """Rows not older than the given number of days."""
    return df.filter(~_expired(df, ts, days, as_of))


def expired_count(df: DataFrame, ts: str, days: int, as_of: str) -> DataFrame:
    return df.agg(F.count_if(_expired(df, ts, days, as_of)).alias("removed"))


def _expired(df: DataFrame, ts: str, days: int, as_of: str) -> Column:
    limit = F.lit(as_of).cast(df.schema[ts].dataType) - F.make_dt_interval(F.lit(days))
    return F.coalesce(F.col(ts) < limit, F.lit(False))


def drop_old_days(spark, path: str, days: int, as_of: str) -> list[str]:
    """Remove the day folders of a history that lie wholly before the limit; returns their names.

    Only folder names are listed. The rows of the limit's own day are left to ``retain``.
    """
    fs, root = file_system(spark, path)
    limit = date.fromisoformat(as_of[:10]) - timedelta(days=days)
    dropped = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("check_date=") and name[11:] < limit.isoformat():
            fs.delete(status.getPath(), True)
            dropped.append(name)
    return sorted(dropped)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
