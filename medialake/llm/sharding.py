"""Sharding by histogram sort: exact splitters by counting, then one exchange.

Rows are ordered by a key and cut into shards of near equal bytes. Splitters are found without
sorting: each round counts, over all rows, the exact bytes and rows between candidate boundaries, and
puts new candidates only where a splitter still lies too far from its target. When all are within
the tolerance (or a single row is left between two candidates), rows are exchanged once, straight
into the piece of the shard where they belong; the counts already say at which slot a piece begins.

The order is by key and, among equal keys, by place in the input, so that a key that holds any share
of the rows is cut like every other. Only (key, place, size) and the columns asked for are moved;
they are written to the shared folder first, so all rounds see the same places. The rounds read
(key, place, size) alone, whatever is asked for; texts that are carried move in the one exchange.

Special cases: a null key is smaller than all others; a null text has no byte and size 1. Repeated
rows are rows of their own. An empty table gives no row. Columns of the input that are not asked for
are not read, and internal names can't clash with them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from medialake.llm.common import saved

_PLACES = 53  # bits of a place within one key: partitions and their rows
_TYPE = "decimal(38,0)"


def _piece_of(rank: Column, bounds: list[int]) -> Column:
    """How many of the sorted boundaries a rank has reached, by binary search."""
    steps = [1 << k for k in reversed(range(max(1, len(bounds).bit_length())))]
    padded = bounds + [10**38 - 1] * (2 * steps[0] - 1 - len(bounds))
    table = F.split(F.lit(",".join(map(str, padded))), ",").cast(f"array<{_TYPE}>")
    found = F.lit(0)
    return F.aggregate(
        F.lit(steps), found, lambda at, step: at + F.when(F.get(table, at + step - 1) <= rank, step).otherwise(0)
    )


class _Cuts:
    """What is known of the order so far: exact bytes and rows below every boundary counted."""

    def __init__(self, low: int, high: int, size: int, rows: int):
        self.known = {low: (0, 0), high: (size, rows)}
        self._sort()

    def _sort(self) -> None:
        self.bounds = sorted(self.known)
        self.sizes = [self.known[k][0] for k in self.bounds]  # these rise as well

    def add(self, counted: dict[int, tuple[int, int]]) -> None:
        self.known |= counted
        self._sort()

    def around(self, target: float) -> tuple[int, int]:
        """The boundaries next to a target of bytes: the last at or below it, and the one above."""
        i = min(bisect_right(self.sizes, target), len(self.bounds) - 1)
        return self.bounds[i - 1], self.bounds[i]

    def best(self, target: float) -> int:
        """The boundary closest to a target, the lowest of those equally close."""
        i = min(bisect_right(self.sizes, target), len(self.bounds) - 1)
        below, above = self.sizes[i - 1], self.sizes[i]
        return self.bounds[bisect_left(self.sizes, below if target - below <= above - target else above)]


def _histogram(rows: DataFrame, bounds: list[int]) -> list[tuple[int, int]]:
    """Bytes and rows of the pieces between sorted boundaries; the driver sees one row a piece."""
    pieces = rows.groupBy(_piece_of(F.col("rank"), bounds).alias("piece")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")
    )
    out = [(0, 0)] * (len(bounds) + 1)
    for piece, size, n in pieces.collect():
        out[piece] = (size, n)
    return out


def splitters(rows: DataFrame, n_pieces: int, tolerance: float, probes: int = 32) -> tuple[list[int], _Cuts, int]:
    """Boundaries of `n_pieces` pieces of near equal bytes, what is below them, and rounds taken.

    A boundary is final when it is within `tolerance` of a piece from its target, or when no
    boundary comes closer because one row fills the gap.
    """
    low, high, size, n = rows.agg(F.min("rank"), F.max("rank"), F.sum("size"), F.count(F.lit(1))).first()
    if not n:
        return [], _Cuts(0, 1, 0, 0), 0
    cuts = _Cuts(int(low), int(high) + 1, size, n)
    targets = [size * k / n_pieces for k in range(1, n_pieces)]
    rounds = 0
    while True:
        asked: set[int] = set()
        for t in targets:
            if abs(cuts.known[cuts.best(t)][0] - t) <= tolerance * size / n_pieces:
                continue
            a, b = cuts.around(t)
            if cuts.known[b][1] - cuts.known[a][1] > 1 and b - a > 1:
                asked.update(a + (b - a) * k // (probes + 1) for k in range(1, probes + 1))
        bounds = sorted(asked - cuts.known.keys())
        if not bounds:
            return sorted({cuts.best(t) for t in targets}), cuts, rounds
        rounds += 1
        # All boundaries are counted together, so pieces add up from the lowest rank.
        below_size, below_n, counted = 0, 0, {}
        for bound, (s, m) in zip(bounds, _histogram(rows, bounds), strict=False):
            below_size, below_n = below_size + s, below_n + m
            counted[bound] = (below_size, below_n)
        cuts.add(counted)


def sharded(
    docs: DataFrame,
    n_shards: int,
    key: str,
    carry: dict[str, Column],
    text_col: str = "text",
    tolerance: float = 0.001,
    rows_per_piece: int = 1_000_000,
    bytes_per_piece: int = 256 << 20,
) -> DataFrame:
    """The columns of `carry`, `size`, `shard` (0 to n_shards - 1) and `slot` (from 0, gapless).

    Sizes are UTF-8 bytes of the text plus 1. Shards hold contiguous ranges of the integer column
    `key`, and slots follow it. A shard is exchanged in pieces of about `rows_per_piece` rows or
    `bytes_per_piece` bytes of text, whichever are smaller.
    """
    low = docs.agg(F.min(key).cast(_TYPE)).first()
    lowest = F.lit(Decimal(int(low[0] or 0) - 1)).cast(_TYPE)
    above = F.coalesce(F.col(key).cast(_TYPE) - lowest, F.lit(0).cast(_TYPE))
    names = [f"c{i}" for i in range(len(carry))]
    rows = saved(
        docs.select(
            (above * F.lit(Decimal(1 << _PLACES)) + F.monotonically_increasing_id()).cast(_TYPE).alias("rank"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
            *[c.alias(n) for n, c in zip(names, carry.values(), strict=True)],
        ),
        "sharding",
        "zstd",
    )
    n, n_bytes = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    per_shard = max(1, -(-n // (n_shards * rows_per_piece)), -(-(n_bytes or 0) // (n_shards * bytes_per_piece)))
    bounds, cuts, _ = splitters(rows, n_shards * per_shard, tolerance)
    total = cuts.sizes[-1]
    starts = [cuts.best(total * k / n_shards) for k in range(n_shards)]
    edges = sorted({*bounds, *starts})
    shard_of, first_of = [], []
    for edge in [cuts.bounds[0], *edges]:
        shard = bisect_right(starts, edge) - 1
        shard_of.append(shard)
        first_of.append(cuts.known[edge][1] - cuts.known[starts[shard]][1])
    # One piece is one task's partition, so a row's place in it is its place in the sorted partition.
    placed = (
        rows.withColumn("piece", _piece_of(F.col("rank"), edges).cast("int"))
        .repartitionById(len(edges) + 1, F.col("piece"))
        .sortWithinPartitions("rank")
    )
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)

    def at_piece(values: list[int]) -> Column:
        return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>"), F.col("piece"))

    return placed.select(
        *[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)],
        "size",
        at_piece(shard_of).cast("int").alias("shard"),
        (at_piece(first_of) + within).alias("slot"),
    )


def write_shards(shards: DataFrame, path: str) -> None:
    """Write sharded rows as one folder a shard, in the order of their slots within each file."""
    ordered = shards.sortWithinPartitions("shard", "slot")
    ordered.write.option("compression", "zstd").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of written shards; `schema` is that of the rows that were written."""
    return spark.read.schema(schema).parquet(path)
