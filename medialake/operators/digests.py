"""Comparing large stored tables by digests of key ranges.

A range's digest is its number of rows and two sums of row hashes: it doesn't depend on the order of
rows, and repeated rows count. Digests form a tree: leaves are ranges of keys, every level above adds
up 16 neighbours. Two tables are compared from the top down, and only below ranges that differ;
then only the differing leaf ranges of the tables themselves are read and compared row by row.

Digests are kept beside a table and made again only for the partitions that changed, so a compare of
two tables that are nearly alike reads a few small rows and a few ranges. Null keys are one range.
Rows are told apart by two 64-bit hashes over all columns, nulls included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.session import scratch_path
from medialake.sources.stored import PART, StoredTable

BITS = 4  # a range holds two to this power ranges of the level below
LEVELS = 4  # above the leaves

_SUMS = ["n", "s1", "s2"]


def _hashes(columns: list[str]) -> list[Column]:
    """Two hashes of a row. A null is told from a missing value by a column of its own."""
    values = [c for name in sorted(columns) for c in (F.col(name).isNull(), F.col(name))]
    return [F.xxhash64(*values).cast("decimal(38,0)").alias("h1"), F.xxhash64(F.lit(1), *values).cast("decimal(38,0)").alias("h2")]


def leaf_digests(table: StoredTable, parts: list[int] | None = None) -> DataFrame:
    """`range`, `n`, `s1`, `s2` of the ranges (partitions) of a stored table, or of some of them."""
    rows = table.read_with_parts(parts)
    return (
        rows.select(F.col(PART).alias("range"), *_hashes(table.schema.names))
        .groupBy("range")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("h1").alias("s1"), F.sum("h2").alias("s2"))
    )


def digest_tree(leaves: DataFrame) -> DataFrame:
    """`level`, `range` and sums: the leaves (level 0) and every level above."""
    out = leaves.select(F.lit(0).alias("level"), "range", *_SUMS)
    # Each leaf names its range on every level; few rows, combined before the shuffle.
    levels = [F.struct(F.lit(k).alias("level"), F.shiftright("range", BITS * k).alias("range")) for k in range(1, LEVELS + 1)]
    above = leaves.select(F.explode(F.array(*levels)).alias("at"), *_SUMS).groupBy("at").agg(*[F.sum(c).alias(c) for c in _SUMS])
    return out.unionByName(above.select("at.level", "at.range", *_SUMS))


def kept_tree(table: StoredTable, path: str) -> DataFrame:
    """A table's digest tree, written beside it and read back."""
    tree = digest_tree(leaf_digests(table))
    tree.write.parquet(path)
    return table.spark.read.schema(tree.schema).parquet(path)


def differing_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """`range`: the leaves in which two digest trees differ, found from the top down."""
    apart = None
    for level in range(LEVELS, -1, -1):
        left, right = (t.filter(F.col("level") == level).drop("level") for t in (a, b))
        if apart is not None:  # only what is below a range that differs
            up = apart.withColumnRenamed("range", "up")
            left, right = (
                t.withColumn("up", F.shiftright("range", BITS)).join(up, "up", "left_semi").drop("up") for t in (left, right)
            )
        same = F.lit(True)
        for c in _SUMS:
            right = right.withColumnRenamed(c, f"_{c}")
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        apart = left.join(right, "range", "full").filter(~same).select("range")
    return apart


def changed_keys(saved: DataFrame, draft: DataFrame, key: str) -> DataFrame:
    """Keys whose rows differ, rows counted as often as they are there: `key`, `change` (added, removed
    or changed) and the numbers of rows `n_saved`, `n_draft`."""
    def marked(df: DataFrame, here: int) -> DataFrame:
        return df.select(key, *_hashes(df.columns), F.lit(here).alias("_a"), F.lit(1 - here).alias("_b"))

    rows = marked(saved, 1).unionByName(marked(draft, 0))
    kinds = rows.groupBy(key, "h1", "h2").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    keys = kinds.groupBy(key).agg(
        F.sum("_a").alias("n_saved"), F.sum("_b").alias("n_draft"), F.max(F.col("_a") != F.col("_b")).alias("_apart")
    )
    kind = F.when(F.col("n_saved") == 0, "added").when(F.col("n_draft") == 0, "removed").otherwise("changed")
    return keys.filter("_apart").select(key, kind.alias("change"), "n_saved", "n_draft")


def changed_in_tables(saved: StoredTable, draft: StoredTable, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """`changed_keys` of two stored tables that are cut into the same ranges. `trees` may give their
    digest trees, where these are kept."""
    a, b = trees or (kept_tree(saved, scratch_path(saved.spark, "digests")), kept_tree(draft, scratch_path(draft.spark, "digests")))
    ranges = sorted(r[0] for r in differing_ranges(a, b).collect())  # at most the tables' partitions
    return changed_keys(saved.read(ranges), draft.read(ranges), saved.key)
