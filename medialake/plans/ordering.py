"""Numbering and looking back within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sequenced(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    prefix: Column,
    lag: list[str] | None = None,
    lookup: DataFrame | None = None,
) -> DataFrame:
    """Add ``seq`` (1, 2, ... within the key, by ``order``) and ``prev_<c>`` for each lag column.

    ``prefix`` is a coarse step of the order, such as the hour of a time: rows are numbered within
    one key and step, so a key of any size is spread over tasks. A small aggregate, one row per key
    and step, says how many rows lie before each step and which row was the last of them.

    ``order`` must be unique within a key and rise with ``prefix``. ``lookup``, with at most one row per
    key, adds its other columns, null for keys it lacks: it is joined to the small aggregate, where the
    rows of a key are together anyway, so the rows themselves need no shuffle for it.
    """
    lag = lag or []
    # One column for key and step: nulls are equal within it, and the join below needs no shuffle of
    # the rows after the window's.
    group = F.struct(*keys, prefix.alias("_step"))
    near = W.partitionBy("_group").orderBy(*order)
    rows = df.withColumn("_group", group).select(
        "*",
        F.row_number().over(near).cast("long").alias("_n"),
        *[F.lag(c).over(near).alias(f"_lag_{c}") for c in lag],
    )
    # The last row of a run, with its number, the run's size. All its columns are asked for, so that the
    # runs are read from the shuffle of the rows and need none of their own.
    last = F.max_by(F.struct("_n", *df.columns), "_n").alias("_last")
    runs = rows.groupBy("_group").agg(last).select(
        "_group", F.col("_last._n").alias("_size"), F.struct(*[F.col(f"_last.{c}") for c in lag or ["_n"]]).alias("_last")
    )
    along = W.partitionBy(*[F.col(f"_group.{k}") for k in keys]).orderBy("_group._step")
    before = F.sum("_size").over(along.rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select(
        "_group",
        *([F.col(f"_group.{k}").alias(k) for k in keys] if lookup else []),
        F.coalesce(before, F.lit(0)).alias("_offset"),
        F.lag("_last").over(along).alias("_before"),
    )
    found = [c for c in lookup.columns if c not in keys] if lookup else []
    if lookup:
        runs = runs.join(lookup, keys, "left").drop(*keys)
    first = F.col("_n") == 1
    return rows.join(runs, "_group").select(
        *df.columns,
        (F.col("_n") + F.col("_offset")).cast("long").alias("seq"),
        *[F.when(first, F.col(f"_before.{c}")).otherwise(F.col(f"_lag_{c}")).alias(f"prev_{c}") for c in lag],
        *found,
    )
