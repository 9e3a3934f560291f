"""N-gram Jaccard join: documents whose shingle sets are alike, found by signature trees.

A set's signature is a bitmap with a bit for each of its shingles, one or two bits a shingle wide. The
leaves of a tree are sets; an inner node holds the OR of the bitmaps below it, their range of sizes and
the greatest number of shingles that share a bit with another of their set. Two sets share at most
their common bits plus the lesser of these numbers, and so do any two sets below two nodes: pairs of
trees are walked together, and a pair of nodes is left where that bound is too low for its sizes.

Trees are made where links can be. Sets in reach share one of the first hashes of their sorted
shingles (as many as the smaller overlap leaves room to differ, and one more; k of them with k more),
and their sizes are in the same or the next band of a logarithmic scale. A set that shares fewer than k
of its first hashes with any others, for a k of its size, goes at once. For the others there is a tree for each such hash and band;
large ones are cut in tiles that meet pairwise, trees of the same members are one. A first round has
the least hashes only; the second has all, but only where sets meet that the first left apart.

The walks leave spanning forests of pairs within the bounds. Within their components, trees whose
leaves carry the shingles are walked again and every pair left is compared exactly, unless it is
already linked. No pair in reach escapes: bounds, hashes and bands are exact.

Special cases: a null text, or one without words, has the empty set and is linked with nothing; with
fewer words than a shingle has, all are one shingle. Rows that share a doc_id stay separate rows; a
null doc_id is never a component's smallest unless all are null. Shingles are told apart by 64-bit
hashes, sets by 128 bits. Other columns, whatever their names, are not read. An empty table gives no
rows. A shingle that very many texts of one size share makes as many pairs of tiles as its tiles have:
they are cheap to leave, but the work is quadratic in them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import saved
from medialake.llm.components import connected_components
from medialake.llm.simhash import shingle_set

_FANOUT = 8
_TILE = 1024  # sets of a tree in one task
_TILE_SHINGLES = 1 << 20  # shingles of a tree in one task, where they are compared
_FIRST = 3  # hashes of a set in the first round
_WORDS = 1 << 20  # words of bitmaps compared at once


def prefix_length(n: int, percent: int, shared: int = 1) -> int:
    """How many of a set's n shingles, in any one order, hold `shared` ones of every set in reach."""
    return n - (percent * n + 99) // 100 + shared


def least_shared(n: int, percent: int) -> int:
    """How many shingles a set must share with others in its longer prefix to be looked at: a third of
    the prefix that holds one, and no more than any set in reach has."""
    return max(1, min(prefix_length(n, percent) // 3, n - prefix_length(n, percent) + 1))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The bitmap of a set, a power of two wide: halves of a wider one OR-combine to a narrower."""
    width = max(64, 1 << (len(shingles) - 1).bit_length())
    at = shingles & np.uint64(width - 1)
    bits = np.zeros(width // 64, np.uint64)
    np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return bits


class SignatureTree:
    """Levels from the leaves up: bitmaps, sizes from and to, and shingles beyond one a bit."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray):
        spare = sizes - np.bitwise_count(bitmaps).sum(1, dtype=np.int64)
        self.levels = [(bitmaps, sizes, sizes, spare)]
        while len(sizes) > _FANOUT:
            bits, low, high, spare = self.levels[-1]
            at = np.arange(0, len(bits), _FANOUT)
            sizes = np.minimum.reduceat(low, at)
            up = (np.bitwise_or.reduceat(bits, at), sizes, np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at))
            self.levels.append(up)


def _within(a, b, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs (i, j) of two levels may have sets in reach below them."""
    bits_a, low_a, high_a, spare_a = a
    bits_b, low_b, high_b, spare_b = b
    ok = (100 * high_a[i] >= percent * low_b[j]) & (100 * high_b[j] >= percent * low_a[i])
    i, j, at = i[ok], j[ok], np.flatnonzero(ok)
    most = np.minimum(np.minimum(high_a[i], high_b[j]), np.minimum(spare_a[i], spare_b[j]))
    step = max(_WORDS // bits_a.shape[1], 1)
    for k in range(0, len(i), step):
        x, y = i[k : k + step], j[k : k + step]
        shared = np.bitwise_count(bits_a[x] & bits_b[y]).sum(1, dtype=np.int64)
        most[k : k + step] = np.minimum(shared + np.minimum(spare_a[x], spare_b[y]), np.minimum(high_a[x], high_b[y]))
    # An overlap o is enough if o / (x + y - o) is.
    ok[at] = (100 + percent) * most >= percent * (low_a[i] + low_b[j])
    return ok


def walk(a: SignatureTree, b: SignatureTree | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves of two trees, or of one with itself (each once), that the bounds leave."""
    same = b is None
    b = a if same else b
    depth = max(len(a.levels), len(b.levels)) - 1

    def level(t: SignatureTree, k: int):
        return t.levels[min(k, len(t.levels) - 1)]

    n, m = len(level(a, depth)[1]), len(level(b, depth)[1])
    i, j = np.divmod(np.arange(n * m), m)
    if same:
        i, j = i[i <= j], j[i <= j]
    held = [(depth, i, j)]
    while held:
        k, i, j = held.pop()
        ok = _within(level(a, k), level(b, k), i, j, percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if k == 0:
            yield (i[i < j], j[i < j]) if same else (i, j)
            continue
        # A tree that ends below this level stands still until the other has come down to it.
        for at in range(0, len(i), 1 << 12):
            x, y = i[at : at + (1 << 12)], j[at : at + (1 << 12)]
            for t, left in ((a, True), (b, False)):
                if k < len(t.levels):
                    n_below = len(t.levels[k - 1][1])
                    child = (x if left else y)[:, None] * _FANOUT + np.arange(_FANOUT)
                    keep = (child < n_below).ravel()
                    other = np.repeat(y if left else x, _FANOUT)[keep]
                    x, y = (child.ravel()[keep], other) if left else (other, child.ravel()[keep])
            if same:
                x, y = x[x <= y], y[x <= y]
            held.append((k - 1, x, y))


def _folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps brought to the width of the narrowest."""
    width = min(map(len, bitmaps)) // 8
    rows = [np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, width), axis=0) for x in bitmaps]
    return np.array(rows, np.uint64)


class _Shingles:
    """Sets as places in their common vocabulary, to compare one with many."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.start = np.cumsum(self.size) - self.size
        names, self.at = np.unique(np.concatenate(sets), return_inverse=True)
        self.held = np.zeros(len(names), bool)

    def alike(self, i: int, j: np.ndarray, percent: int) -> np.ndarray:
        """Which of the sets j are in reach of set i."""
        own = self.at[self.start[i] : self.start[i] + self.size[i]]
        self.held[own] = True
        n = self.size[j]
        first = np.cumsum(n) - n
        places = np.repeat(self.start[j] - first, n) + np.arange(int(n.sum()))
        both = np.add.reduceat(self.held[self.at[places]], first, dtype=np.int64)
        self.held[own] = False
        return 100 * both >= percent * (self.size[i] + n - both)


def joined(
    bitmaps: list[bytes], sizes: np.ndarray, left: np.ndarray, percent: int, sets: list[np.ndarray] | None = None
) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs within the bounds, with `sets` of those in reach. Rows on the
    left meet those that are not; if all rows are on one side, they meet each other."""
    bits = _folded(bitmaps)
    one_side = bool(left.all() or not left.any())
    parts = [np.arange(len(sizes))] if one_side else [np.flatnonzero(left), np.flatnonzero(~left)]
    # Like sets have like first words, so they come under one node.
    parts = [p[np.lexsort(bits[p][:, :4].T[::-1])] for p in parts]
    trees = [SignatureTree(bits[p], sizes[p]) for p in parts]
    label, out_i, out_j = np.arange(len(sizes)), [], []
    exact = _Shingles(sets) if sets is not None else None
    for i, j in walk(trees[0], None if one_side else trees[1], percent):
        i, j = parts[0][i], parts[-1][j]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        cut = np.flatnonzero(np.diff(i)) + 1
        for x, ys in zip(i[np.concatenate(([0], cut))].tolist() if len(i) else [], np.split(j, cut), strict=False):
            ys = ys[label[ys] != label[x]]
            if exact and len(ys):
                ys = ys[exact.alike(x, ys, percent)]
            if len(ys):
                _, once = np.unique(label[ys], return_index=True)  # one link for each group that joins
                out_i += [x] * len(once)
                out_j += ys[once].tolist()
                label[np.isin(label, label[ys])] = label[x]
    return out_i, out_j


# The join -----------------------------------------------------------------------------------------


def _row_key(id_col: str, text_col: str) -> Column:
    """What tells a row's id and text from those of other rows."""
    return F.md5(F.concat_ws(" ", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.md5(F.coalesce(text_col, F.lit("")).cast("binary"))).cast("binary"))


def shingle_rows(docs: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's `doc_id`, `row_key`, `n_shingles`, and unless that is 0 the set's hash `node`, its
    first hashes `prefix` and its `bitmap`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, prefix, bitmap = [], [], [], []
            for text in batch.column(1):
                held = shingle_set(text.as_py(), size)
                full = len(held) > 0
                n.append(len(held))
                node.append(xxhash.xxh3_128_digest(held.tobytes()) if full else None)
                long = prefix_length(len(held), percent, least_shared(len(held), percent))
                prefix.append(held[:long].view(np.int64) if full else None)
                bitmap.append(signature(held).tobytes() if full else None)
            made = [pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bitmap, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *made], ["doc_id", "row_key", "n_shingles", "node", "prefix", "bitmap"]
            )

    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _row_key(id_col, text_col).alias("row_key")
    )
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, row_key string, n_shingles long, node binary, prefix array<long>, bitmap binary"
    return narrow.mapInArrow(run, schema)


def _walked(groups: DataFrame, percent: int, with_sets: bool) -> DataFrame:
    """`u`, `v`: the forests of groups whose `rows` are structs of id, size, bitmap, `with_sets` shingles,
    and left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_u, out_v = [], []
            for rows in batch.column(0):
                ids, sizes, bitmaps, *sets, left = rows.values.flatten()
                held = [np.frombuffer(x, np.uint64) for x in sets[0].to_pylist()] if with_sets else None
                i, j = joined(bitmaps.to_pylist(), sizes.to_numpy(), left.to_numpy(zero_copy_only=False), percent, held)
                ids = ids.to_pylist()
                out_u += [ids[x] for x in i]
                out_v += [ids[x] for x in j]
            yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], ["u", "v"])

    return groups.mapInArrow(run, "u long, v long")


def _tiled(members: DataFrame, keys: list[str], row: list[str]) -> DataFrame:
    """`rows`: the members of each key in tiles, every two tiles of a key together once. `parts` says
    how many tiles a key has."""
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    copies = members.withColumn("tile", F.pmod(F.xxhash64("id"), "parts").cast("int")).select("*", other)
    lo, hi = F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi")
    side = (F.col("tile") < F.col("other")).alias("left")
    return copies.groupBy(*keys, lo, hi).agg(F.collect_list(F.struct(*row, side)).alias("rows")).select("rows")


def _candidates(shared: DataFrame, nodes: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """`u`, `v`: forests of the pairs within the bounds that share a hash. With `labels` (id, root)
    only trees are walked that hold sets of more than one root."""
    # Sets in reach are in the same band or the next, so a tree has a band and those of the band below.
    width = math.log(100 / percent) * 1.0001
    placed = shared.withColumn("band", F.floor(F.log("size") / width).cast("int"))
    if labels is None:
        placed = placed.withColumn("root", F.col("id"))
    else:
        placed = placed.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
        # Most hashes are shared within one root only; the others are looked up by band.
        roots = placed.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most"))
        placed = saved(placed.join(roots.where("least < most").select("token"), "token"), "apart")
    both = placed.select("token", "id", "root", "band", F.explode(F.lit([0, 1])).alias("up")).select(
        "token", "id", "root", (F.col("band") + F.col("up")).alias("band"), (F.col("up") == 0).alias("home")
    )
    n = F.count(F.lit(1))
    trees = (
        both.groupBy("token", "band")
        .agg(
            n.alias("n"),
            F.max("home").alias("has_home"),
            F.min("root").alias("least"),
            F.max("root").alias("most"),
            F.bit_xor(F.xxhash64("id", "home")).alias("x1"),
            F.bit_xor(F.xxhash64(F.lit(1), "home", "id")).alias("x2"),
        )
        .where("n > 1 and has_home and least < most")
        .groupBy("band", "n", "x1", "x2")
        .agg(F.min("token").alias("token"))
        .select("token", "band", F.ceil(F.col("n") / _TILE).cast("int").alias("parts"))
    )
    members = both.join(saved(trees, "trees"), ["token", "band"]).select("token", "band", "parts", "id")
    full = members.join(nodes.select("id", "size", "bitmap"), "id")
    return _walked(_tiled(full, ["token", "band"], ["id", "size", "bitmap"]), percent, False)


def _exact_links(
    nodes: DataFrame, roots: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str
) -> DataFrame:
    """`u`, `v`: forests of the sets in reach within the components `roots` (node, root)."""
    placed = nodes.join(roots.withColumnRenamed("node", "id"), "id").select("id", "size", "row_key", "root")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / _TILE), F.ceil(F.sum("size") / _TILE_SHINGLES)).cast("int")
    members = saved(placed.join(placed.groupBy("root").agg(parts.alias("parts")), "root"), "members")
    texts = docs.select(_row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    # Rows alike in id and text all find the set they stand for; the first goes on. The members grow
    # with the corpus, so the plan is that of a large join at every size.
    found = texts.join(members.select("row_key", "id", "root", "parts").hint("merge"), "row_key")
    found = found.groupBy("id", "root", "parts").agg(F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size) for t in batch.column(3)]
            made = [
                pa.array(list(map(len, sets)), pa.int64()),
                pa.array([signature(x).tobytes() for x in sets], pa.binary()),
                pa.array([x.tobytes() for x in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names)

    names = ["id", "root", "parts", "size", "bitmap", "shingles"]
    full = found.mapInArrow(cut, "id long, root long, parts int, size long, bitmap binary, shingles binary")
    return _walked(_tiled(full, ["root"], ["id", "size", "bitmap", "shingles"]), percent, True)


def similar_documents(
    docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`doc_id`, `n_shingles` and `component_id` of every row of `docs`.

    Two documents link if their sets of distinct shingles of `size` words have a Jaccard similarity
    of `percent` in a hundred or more; `component_id` is the smallest doc_id reachable over links.
    """
    rows = saved(shingle_rows(docs, size, percent, id_col, text_col), "shingle-rows")
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("one")
    sets = rows.where("node is not null").groupBy("node").agg(
        one, F.first("n_shingles").alias("size"), F.first("prefix").alias("prefix"), F.first("bitmap").alias("bitmap")
    )
    nodes = saved(
        sets.select(
            F.monotonically_increasing_id().alias("id"),
            "node",
            F.col("one.doc_id").alias("first"),
            F.col("one.row_key").alias("row_key"),
            "size",
            "prefix",
            "bitmap",
        ),
        "shingle-sets",
    )
    # Most hashes are in one prefix only and go here.
    placed = nodes.select("id", F.posexplode("prefix").alias("pos", "token"))
    common = placed.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token")
    held = saved(placed.join(common, "token"), "shared-hashes")
    # Where a set shares too few, none is in its reach.
    one = F.col("size") - F.floor((percent * F.col("size") + 99) / 100) + 1
    least = F.greatest(F.lit(1), F.least(F.floor(one / 3), F.col("size") - one + 1))
    counts = held.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(nodes.select("id", "size"), "id")
    asked = saved(counts.where(F.col("n") >= least).select("id", "size", one.alias("one")), "asked-sets")
    shared = held.join(asked, "id").where("pos < one").select("token", "id", "pos", "size")
    near = saved(_candidates(shared.where(F.col("pos") < _FIRST), nodes, None, percent), "near-sets")
    labels = saved(connected_components(near).withColumnRenamed("node", "id"), "labels")
    rest = _candidates(shared, nodes, labels, percent)
    roots = connected_components(near.unionByName(rest))
    links = connected_components(_exact_links(nodes, roots, docs, size, percent, id_col, text_col))
    grouped = nodes.join(links.withColumnRenamed("node", "id"), "id", "left").select(
        "node", "first", F.coalesce("root", "id").alias("root")
    )
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    # Written apart, so that the rows of a set with very many copies can be split in the join.
    named = saved(grouped.join(least, "root").select("node", "component_id"), "similar-sets")
    return rows.join(named, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
