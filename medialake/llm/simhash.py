"""SimHash near-dedup: fingerprints compared exactly, tile against tile.

Every text gets a SimHash over its word shingles. Distinct fingerprints are packed into tiles; tasks
compare two tiles with exclusive-or and bit counts. Two counts skip work: fingerprints within
`radius` bits differ in their population counts by `radius` at most, in all and summed over the
quarters of their first word. So for small radii tiles are keyed by the four quarter counts and only
tiles with near enough counts meet; within a pair of tiles, both are ordered by their whole count.

A task reports a spanning forest of the links it finds, at most one link for each fingerprint, so a
group of near copies never makes all its pairs. Components are then found over these links.

With a `share`, fingerprints only narrow a search. Two sets of that similarity share one of the first
hashes of their sorted shingles (as many as the share leaves room to differ, and one more), so only
fingerprints with such a hash in common are compared: all pairs of a few, tiles where many have it.
Fingerprints are over distinct shingles, and the components they
make are candidates: within each, texts are compared in chunks of bounded size, and two link only if
the exact similarity of their shingle sets is `share` or more. Spanning forests and the final
components are of these links alone. Texts with the same set are one node; those of components
with one node are not read again. Shingles are told apart by 64-bit hashes; the first hashes meet by
32 bits of them, which only adds pairs. The pairs of fingerprints that one very common hash brings
together are quadratic in the texts that have it among their first.

Special cases: a null text is empty; texts without words have fingerprint zero and link like any
other. Rows that share a doc_id stay separate rows; a null doc_id is never a component's smallest
unless all are null. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import saved, words_of
from medialake.llm.components import connected_components

_ROWS, _COLUMNS = 64, 2048  # fingerprints of two tiles compared at once, within a core's cache
_SEED = 42
_CHUNK_ROWS, _CHUNK_SHINGLES = 2048, 1 << 21  # of a candidate component, compared at once
_FEW = 16  # sets that share a first hash and meet pair by pair; more meet in tiles
_BUCKET = 1 << 19  # first hashes of all sets that are sorted together


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of `size` words joined by blanks, repeats included; a shorter text is one run."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, size: int, n_words: int = 1) -> np.ndarray:
    """`n_words` 64-bit words; a bit is set if it is set in over half of the shingles' hashes."""
    return _majority(_hashes(text, size), n_words)


def _hashes(text: str | None, size: int) -> np.ndarray:
    runs = shingles(words_of(text), size)
    return np.fromiter((xxhash.xxh64_intdigest(s, _SEED) for s in runs), np.uint64, len(runs))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    return np.unique(_hashes(text, size))


def first_hashes(shingles: np.ndarray, share: float) -> bytes:
    """32 bits of each of a set's first hashes: every set in reach has one of these among its own. The
    low bits, as the first hashes are alike in the high ones."""
    n = len(shingles)
    return shingles[: n - math.ceil(share * n - 1e-9) + 1].astype(np.uint32).tobytes()


def _majority(h: np.ndarray, n_words: int) -> np.ndarray:
    out = np.zeros(n_words, np.uint64)
    if not len(h):
        return out
    for k in range(n_words):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 15):
            part = h[at : at + (1 << 15)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]
        h = _mixed(h)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    """Another hash of a hash, for the further words of a wide fingerprint."""
    h = (h + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _cells(first: np.ndarray) -> np.ndarray:
    """The set bits of each quarter of a word, five bits apiece."""
    quarters = [np.bitwise_count((first >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int32) for k in range(4)]
    return (quarters[3] << 15) | (quarters[2] << 10) | (quarters[1] << 5) | quarters[0]


def _steps(radius: int) -> list[int]:
    """Differences between the cells of two fingerprints in reach, each unordered pair of cells once.

    A count is at most 16 of 31, so a sum that leaves its five bits meets no cell.
    """
    out = []
    for d in product(range(-radius, radius + 1), repeat=4):
        if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0):
            out.append((d[0] << 15) + (d[1] << 10) + (d[2] << 5) + d[3])
    return out


def fingerprints(
    docs: DataFrame,
    size: int,
    n_words: int = 1,
    cells: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: float | None = None,
) -> DataFrame:
    """`doc_id`, `fp` (the words as bytes, the highest first) and `cell` of every row.

    With a `share`, fingerprints are over distinct shingles, and there are also `mark` (the text's hash),
    `node` (the hash of the set of shingles), `n_shingles` (how many are in it) and `prefix`.
    """
    sets = share is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sets:
                held = [shingle_set(t.as_py(), size) for t in batch.column(1)]
                fps = [_majority(h, n_words) for h in held]
            else:
                fps = [fingerprint(t.as_py(), size, n_words) for t in batch.column(1)]
            words = np.array(fps, np.uint64).reshape(-1, n_words)
            packed = words.astype(">u8").tobytes()
            step = 8 * n_words
            fp = pa.array([packed[i : i + step] for i in range(0, len(packed), step)], pa.binary())
            cell = _cells(words[:, 0]) if cells else np.zeros(len(fps), np.int32)
            columns = {"doc_id": batch.column(0), "fp": fp, "cell": pa.array(cell, pa.int32())}
            if sets:
                columns["mark"] = batch.column(2)
                columns["node"] = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in held], pa.binary())
                columns["n_shingles"] = pa.array(list(map(len, held)), pa.int64())
                columns["prefix"] = pa.array([first_hashes(h, share) for h in held], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[_mark(text_col)] * sets)
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp binary, cell int"
    return narrow.mapInArrow(run, schema + ", mark string, node binary, n_shingles long, prefix binary" * sets)


def _mark(text_col: str) -> Column:
    """A text's hash."""
    return F.md5(F.coalesce(text_col, F.lit("")).cast("binary")).alias("mark")


def _one(doc_id: Column, mark: Column) -> Column:
    """A row's id and its text's hash; a null id is after all others."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), mark.alias("mark")).alias("one")


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 linked by (i, j): the least node that each reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare_tiles(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles (rows of words), as a spanning forest over rows of `a` then `b`."""
    n_a, dense = len(a), min(3, a.shape[1])
    pop_a, pop_b = (np.bitwise_count(x).sum(1, dtype=np.int32) for x in (a, b))
    by_a, by_b = np.argsort(pop_a, kind="stable"), np.argsort(pop_b, kind="stable")
    columns_a, columns_b = np.ascontiguousarray(a[by_a].T), np.ascontiguousarray(b[by_b].T)
    sorted_a, sorted_b = pop_a[by_a], pop_b[by_b]
    shift = 0 if same else n_a
    n = n_a if same else n_a + len(b)
    held_i, held_j, held = [], [], 0
    room = [np.empty((_ROWS, _COLUMNS), t) for t in (np.uint64, np.uint8, np.uint8)]

    def reduced():
        label = _forest(n, np.concatenate(held_i), np.concatenate(held_j))
        node = np.flatnonzero(label != np.arange(n))
        return node, label[node]

    for at in range(0, n_a, _ROWS):
        rows = np.arange(at, min(at + _ROWS, n_a))
        lo, hi = np.searchsorted(sorted_b, [sorted_a[rows[0]] - radius, sorted_a[rows[-1]] + radius + 1])
        lo = max(lo, at) if same else lo  # each pair of one tile once
        for c in range(lo, hi, _COLUMNS):
            width = min(_COLUMNS, hi - c)
            x, apart, more = (y[: len(rows), :width] for y in room)
            # The first words of all pairs, the others only of those that are still within the radius.
            for k in range(dense):
                np.bitwise_xor(columns_a[k, rows, None], columns_b[k, None, c : c + width], out=x)
                np.bitwise_count(x, out=more if k else apart)
                if k:
                    apart += more
            r, k = np.nonzero(apart <= radius)
            if len(r) and a.shape[1] > dense:
                rest = np.bitwise_count(columns_a[dense:, at + r] ^ columns_b[dense:, c + k]).sum(0, dtype=np.int32)
                near = apart[r, k] + rest <= radius
                r, k = r[near], k[near]
            if len(r):
                held_i.append(by_a[at + r])
                held_j.append(by_b[c + k] + shift)
                held += len(r)
                if held > 1 << 20:
                    i, j = reduced()
                    held_i, held_j, held = [i], [j], len(i)
    return reduced() if held_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(distinct: DataFrame, radius: int, n_words: int, tile: int) -> DataFrame:
    """`u`, `v`: links between the distinct fingerprints that span their components."""
    sizes = distinct.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    dealt = distinct.join(sizes, "cell").select(
        "cell", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / tile)).alias("chunk"), "fp"
    )
    tiles = saved(dealt.groupBy("cell", "chunk").agg(F.collect_list("fp").alias("fps")), "tiles")
    ids = tiles.select("cell", "chunk")
    steps = _steps(radius) if radius <= 4 else [0]
    pairs = (
        ids.select(F.col("cell").alias("cell_a"), F.col("chunk").alias("chunk_a"), F.explode(F.lit(steps)).alias("step"))
        .withColumn("cell", F.col("cell_a") + F.col("step"))
        .join(ids, "cell")
        .where((F.col("step") != 0) | (F.col("chunk_a") <= F.col("chunk")))
    )
    a = tiles.select(F.col("cell").alias("cell_a"), F.col("chunk").alias("chunk_a"), F.col("fps").alias("fps_a"))
    met = pairs.join(a, ["cell_a", "chunk_a"]).join(tiles, ["cell", "chunk"]).select(
        "fps_a", "fps", ((F.col("step") == 0) & (F.col("chunk_a") == F.col("chunk"))).alias("same")
    )

    def words(values: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(values), ">u8").astype(np.uint64).reshape(-1, n_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_u, out_v = [], []
            for x, y, same in zip(*batch.columns, strict=True):
                x, y, same = x.as_py(), y.as_py(), same.as_py()
                node, root = compare_tiles(words(x), words(y), radius, same)
                names = x if same else x + y
                out_u += [names[i] for i in node.tolist()]
                out_v += [names[i] for i in root.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.binary()), pa.array(out_v, pa.binary())], ["u", "v"])

    return met.mapInArrow(run, "u binary, v binary")


def few_pairs(token: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the owners of hashes: each pair that shares a hash which `_FEW` or fewer have, once and the
    lesser first; then the hashes that more have, with each of their owners."""
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    start = np.flatnonzero(np.diff(token.astype(np.int64), prepend=-1))
    size = np.diff(start, append=len(token))
    many = np.repeat(size > _FEW, size)
    few = (size > 1) & (size <= _FEW)
    start, size = start[few], size[few]
    member = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    after = np.repeat(start + size, size) - member - 1  # owners of the same hash that follow
    i = np.repeat(member, after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    ids, place = np.unique(np.concatenate((owner[i], owner[j])), return_inverse=True)
    u, v = place[: len(i)], place[len(i) :]
    pair = np.unique((np.minimum(u, v) * len(ids) + np.maximum(u, v))[u != v])
    u, v = np.divmod(pair, max(len(ids), 1))
    return ids[u], ids[v], token[many], owner[many]


def shared_hashes(nodes: DataFrame) -> DataFrame:
    """Which nodes (id, prefix) share a first hash: `u` and `v` where few do, `u` and `token` otherwise.

    Hashes are cut in as many even ranges as make about half a million of them each, and go packed.
    """
    total = nodes.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    buckets = max(1, -(-total // (4 * _BUCKET)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1).to_pylist()
            token = np.frombuffer(b"".join(held), np.uint32)
            owner = np.repeat(batch.column(0).to_numpy(), [len(x) // 4 for x in held])
            bucket = (token.astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            ends = [*edges[1:].tolist(), len(order)]
            parts = [(token[x].tobytes(), owner[x].tobytes()) for x in (order[a:b] for a, b in zip(edges.tolist(), ends, strict=False))]
            columns = [pa.array(bucket[order][edges]), *(pa.array([p[k] for p in parts], pa.binary()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "tokens", "owners"])

    def meet(group: pa.Table) -> pa.Table:
        token, owner = (
            np.frombuffer(b"".join(group.column(c).to_pylist()), kind) for c, kind in (("tokens", np.uint32), ("owners", np.int64))
        )
        u, v, token, owner = few_pairs(token, owner)
        columns = [
            pa.array(np.concatenate((u, owner))),
            pa.concat_arrays([pa.array(v), pa.nulls(len(owner), pa.int64())]),
            pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(token.astype(np.int64))]),
        ]
        return pa.Table.from_arrays(columns, ["u", "v", "token"])

    dealt = nodes.select("id", "prefix").mapInArrow(deal, "bucket long, tokens binary, owners binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "u long, v long, token long")


def prefix_links(nodes: DataFrame, radius: int, n_words: int, tile: int) -> DataFrame:
    """`u`, `v`: links between the fingerprints of those nodes (id, fp, prefix) that share a first hash;
    they span the components of these."""
    met = saved(shared_hashes(nodes), "shared-hashes")
    pairs = met.where("token is null").select("u", "v").distinct()
    u, v = (nodes.select(F.col("id").alias(c), F.col("fp").alias(f"fp_{c}")) for c in "uv")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, n_words) for c in batch.columns)
            ok = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= radius
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns], ["u", "v"])

    few = pairs.join(u, "u").join(v, "v").select("fp_u", "fp_v").mapInArrow(near, "u binary, v binary")
    many = met.where("token is not null").select(F.col("u").alias("id"), F.col("token").alias("cell"))
    # Where all of them are few this has no rows, and the tiles none.
    return few.unionByName(links(many.join(nodes.select("id", "fp"), "id").select("fp", "cell").distinct(), radius, n_words, tile))


def similar_sets(
    fps: np.ndarray, sets: list[np.ndarray], left: np.ndarray, radius: int, share: float
) -> tuple[list[int], list[int]]:
    """Links between rows whose fingerprints are within `radius` and whose sets have a similarity of
    `share` or more, as a spanning forest. Rows on the left meet those that are not; if all rows are
    on one side, they meet each other. Rows that are already linked are not compared."""
    n, size = len(sets), np.array(list(map(len, sets)), np.int64)
    start = np.cumsum(size) - size
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    held, label, out_i, out_j = np.zeros(len(names), bool), np.arange(n), [], []
    one_side = bool(left.all() or not left.any())
    right = np.flatnonzero(~left)
    for i in range(n) if one_side else np.flatnonzero(left).tolist():
        j = np.arange(i + 1, n) if one_side else right
        j = j[label[j] != label[i]]
        j = j[np.minimum(size[j], size[i]) / np.maximum(np.maximum(size[j], size[i]), 1) >= share]
        j = j[np.bitwise_count(fps[j] ^ fps[i]).sum(1, dtype=np.int64) <= radius]
        if not len(j):
            continue
        own = at[start[i] : start[i] + size[i]]
        held[own] = True
        first = np.cumsum(size[j]) - size[j]
        places = np.repeat(start[j] - first, size[j]) + np.arange(int(size[j].sum()))
        both = np.add.reduceat(held[at[places]], first, dtype=np.int64)
        held[own] = False
        j = j[both / (size[i] + size[j] - both) >= share]
        _, once = np.unique(label[j], return_index=True)  # one link for each group that joins
        out_i += [i] * len(once)
        out_j += j[once].tolist()
        label[np.isin(label, label[j])] = label[i]
    return out_i, out_j


def exact_links(
    members: DataFrame, docs: DataFrame, size: int, radius: int, share: float, n_words: int, id_col: str, text_col: str
) -> DataFrame:
    """`u`, `v`: links between the nodes of `members` (root, parts, node, fp, one) that span the
    components of exactly similar texts within each root. A root's nodes are in `parts` chunks; `one`
    is the id and the text's hash of a row of each node, so that only one of many copies is fetched."""
    texts = docs.select(_one(F.col(id_col), _mark(text_col)), F.col(text_col).alias("text"))
    met = texts.join(members, "one").dropDuplicates(["one"]).select("root", "parts", "node", "fp", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(t.as_py(), size).tobytes() for t in batch.column(4)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], sets], ["root", "parts", "node", "fp", "shingles"])

    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    copies = (
        met.mapInArrow(cut, "root binary, parts int, node binary, fp binary, shingles binary")
        .withColumn("chunk", F.pmod(F.xxhash64("node"), "parts").cast("int"))
        .select("root", "node", "fp", "shingles", "chunk", other)
    )
    a, b = F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b")
    row = F.struct("node", "fp", "shingles", (F.col("chunk") < F.col("other")).alias("left"))
    pairs = copies.groupBy("root", a, b).agg(F.collect_list(row).alias("rows")).select("rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_u, out_v = [], []
            for rows in batch.column(0):
                nodes, fps, sets, left = (rows.values.field(k) for k in range(4))
                nodes = nodes.to_pylist()
                words = np.frombuffer(b"".join(fps.to_pylist()), ">u8").astype(np.uint64).reshape(-1, n_words)
                held = [np.frombuffer(x, np.uint64) for x in sets.to_pylist()]
                i, j = similar_sets(words, held, left.to_numpy(zero_copy_only=False), radius, share)
                out_u += [nodes[x] for x in i]
                out_v += [nodes[x] for x in j]
            yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.binary()), pa.array(out_v, pa.binary())], ["u", "v"])

    return pairs.mapInArrow(run, "u binary, v binary")


def near_duplicates(
    docs: DataFrame,
    size: int = 3,
    radius: int = 3,
    n_words: int = 1,
    tile: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: float | None = None,
) -> DataFrame:
    """`doc_id`, `fingerprint` (hex) and `component_id` of every row of `docs`.

    Fingerprints of `64 * n_words` bits over shingles of `size` words link at `radius` or fewer
    differing bits; `component_id` is the smallest doc_id reachable over links. `tile` bounds the
    fingerprints of a tile; the bytes moved are in proportion to n * n / tile for large n. With a
    `share`, a link needs that exact similarity of the two texts' shingle sets as well, and only
    fingerprints whose sets share a first hash are compared.
    """
    if share is not None:
        return _exact_duplicates(docs, size, radius, n_words, tile, id_col, text_col, share)
    fps = saved(fingerprints(docs, size, n_words, radius <= 4, id_col, text_col), "fingerprints")
    distinct = fps.groupBy("fp", "cell").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(distinct, radius, n_words, tile))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def _exact_duplicates(
    docs: DataFrame, size: int, radius: int, n_words: int, tile: int, id_col: str, text_col: str, share: float
) -> DataFrame:
    fps = saved(fingerprints(docs, size, n_words, False, id_col, text_col, share), "fingerprints")
    sets = fps.groupBy("node", "fp", "n_shingles").agg(
        F.min("doc_id").alias("first"),
        F.min(_one(F.col("doc_id"), F.col("mark"))).alias("one"),
        F.first("prefix").alias("prefix"),
    )
    nodes = saved(sets.withColumn("id", F.monotonically_increasing_id()), "shingle-sets")
    near = connected_components(prefix_links(nodes, radius, n_words, tile))
    candidates = nodes.join(near.withColumnRenamed("node", "fp"), "fp", "left").select(
        "node", "fp", "one", "n_shingles", F.coalesce("root", "fp").alias("root")
    )
    n, weight = F.count(F.lit(1)), F.sum("n_shingles")
    parts = F.ceil(F.greatest(n / _CHUNK_ROWS, weight / _CHUNK_SHINGLES, F.lit(1))).cast("int").alias("parts")
    groups = candidates.groupBy("root").agg(n.alias("n"), parts).where("n > 1").drop("n")
    members = candidates.drop("n_shingles").join(groups, "root")
    roots = connected_components(exact_links(members, docs, size, radius, share, n_words, id_col, text_col))
    placed = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("node", "component_id")
    return fps.join(named, "node").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
