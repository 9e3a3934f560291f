"""Suffix-array dedup: bytes covered by a long string that starts anywhere else as well are removed.

Sorting every suffix of a corpus is not needed to find repeats of `LENGTH` bytes. Of each such string
the grams of `GRAM` bytes are hashed, and the place of the least hash is its anchor; equal strings
have equal anchors at equal places. So only anchors are compared, one in about a hundred bytes, and
only those whose gram is found at another anchor too.

An anchor's context is its gram with what a string around it can reach on both sides. Anchors with
equal contexts repeat all strings of the context. Where contexts differ, one of each kind is put into
a sparse suffix array of its gram: the contexts' right sides, and their left sides read backwards,
are sorted by mergesort, whose comparisons find the common extension by binary search over prefix
polynomial hashes and verify it on the bytes. In sorted order strings with a common start are next to
each other, so both sides fall into classes by length, and contexts in one class on both sides share a
string: each finds the farthest to the left and to the right in a sort for each reach.

A gram with more than `max_group` different contexts doesn't go to one task: each of its contexts is
cut into its strings, whose hashes are counted over all tasks, with the same outcome.

Special cases: a null text is empty. Every row is a document of its own, also where rows share an id
or repeat one another (then all of a text of `LENGTH` bytes or more goes). Matches never cross
documents. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from medialake.llm.common import saved

LENGTH = 400
GRAM = 200
REACH = LENGTH - GRAM  # how far a string reaches beyond its gram

_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_MASK = 2**64 - 1
_PART = 1 << 18  # bytes hashed together
_CELLS = 1 << 20  # reaches times contexts compared at once
_NONE = np.uint64(_MASK)


@cache
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2 ** 64."""
    n = 2 * _PART + 4 * LENGTH
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.ones(n, np.uint64)
        p[1:] = b
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class _Prefixes:
    """Prefix polynomial hashes of a run of bytes; any part's hash from two of them."""

    def __init__(self, values: np.ndarray, base: int):
        powers, self.inverse = _powers(base)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[: len(values)], out=self.sums[1:])

    def parts(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return _mixed(h)

    def all_of(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, size: int, pick: np.ufunc, pad: int) -> np.ndarray:
    """pick.reduce of every `size` neighbours."""
    n = len(x) - size + 1
    whole = np.full(-(-len(x) // size) * size, pad, x.dtype)
    whole[: len(x)] = x
    rows = whole.reshape(-1, size)
    ahead = pick.accumulate(rows, axis=1).ravel()
    back = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[size - 1 : size - 1 + n])


def anchors(pieces: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """Anchors of pieces of documents: (piece, place, gram hash, its second hash, context hash).

    A piece is (place in the document, first and last place wanted, bytes); several are hashed in one
    run. Places and contexts are the document's, contexts end where the piece does.
    """
    sizes = np.array([len(p[3]) for p in pieces])
    ends = np.cumsum(sizes)
    values = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8).astype(np.uint64) + np.uint64(1)
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    if len(values) < LENGTH:
        return empty
    end_of = np.repeat(ends, sizes)
    first, second = (_Prefixes(values, b) for b in _BASES)
    gram = first.all_of(GRAM) | np.uint64(1)
    at = np.arange(len(gram))
    gram[at + GRAM > end_of[: len(gram)]] = _NONE
    least = _sliding(gram, REACH + 1, np.minimum, _MASK)
    least[np.arange(len(least)) + LENGTH > end_of[: len(least)]] = 0
    padded = np.zeros(len(least) + 2 * REACH, np.uint64)
    padded[REACH : REACH + len(least)] = least
    # A gram is an anchor if it is the least of some string around it; equal ones all are.
    place = np.flatnonzero(_sliding(padded, REACH + 1, np.maximum, 0) == gram)
    piece = np.searchsorted(ends, place, "right")
    start = (ends - sizes)[piece]
    offset, low, high = (np.array([p[k] for p in pieces])[piece] for k in range(3))
    in_doc = place - start + offset
    wanted = (in_doc >= low) & (in_doc < high) & (gram[place] != _NONE)
    place, piece, start, in_doc = place[wanted], piece[wanted], start[wanted], in_doc[wanted]
    left, right = np.maximum(start, place - REACH), np.minimum(ends[piece], place + GRAM + REACH)
    context = second.parts(left, right)
    context = _mixed(context + (place - left).astype(np.uint64) * np.uint64(1024) + (right - place).astype(np.uint64))
    other = second.parts(place, place + GRAM)
    return piece, in_doc, gram[place].view(np.int64), other.view(np.int64), context.view(np.int64)


def _cut(raw: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """A document in pieces that overlap by all that an anchor depends on."""
    margin = 2 * LENGTH
    for a in range(0, max(1, len(raw)), _PART):
        lo, hi = max(0, a - margin), min(len(raw), a + _PART + margin)
        yield lo, a, a + _PART, raw[lo:hi]


def found_anchors(docs: DataFrame) -> DataFrame:
    """`gram`, `other`, `context`, `doc`, `row`, `size`, `place` of every anchor of `doc`, `row`, `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, of, sizes, n_held = [], [], [], 0
            for n, t in enumerate(batch.column(2)):
                raw = (t.as_py() or "").encode()
                if len(raw) >= LENGTH:
                    for piece in _cut(raw):
                        held.append(piece)
                        of.append(n)
                        sizes.append(len(raw))
                        n_held += len(piece[3])
                if held and (n_held >= _PART or n == batch.num_rows - 1):
                    # At most one piece is over the bound, so the tables of powers suffice.
                    for group in _groups(list(zip(held, of, sizes, strict=True))):
                        piece, place, gram, other, context = anchors([g[0] for g in group])
                        rows = np.array([g[1] for g in group])[piece] if len(piece) else piece
                        size = np.array([g[2] for g in group])[piece] if len(piece) else piece
                        arrays = [pa.array(x) for x in (gram, other, context)]
                        arrays += [batch.column(k).take(pa.array(rows)) for k in (0, 1)]
                        arrays += [pa.array(x.astype(np.int64)) for x in (size, place)]
                        yield pa.RecordBatch.from_arrays(arrays, ["gram", "other", "context", "doc", "row", "size", "place"])
                    held, of, sizes, n_held = [], [], [], 0

    kind = docs.schema["doc"].dataType.simpleString()
    schema = f"gram long, other long, context long, doc {kind}, row long, size long, place long"
    return docs.select("doc", "row", "text").mapInArrow(run, schema)


def _groups(pieces: list[tuple]) -> Iterator[list[tuple]]:
    group, n = [], 0
    for p in pieces:
        if group and n + len(p[0][3]) > 2 * _PART:
            yield group
            group, n = [], 0
        group.append(p)
        n += len(p[0][3])
    if group:
        yield group


def prefix_hashes(strings: list[bytes]) -> np.ndarray:
    """By string and n, the polynomial hash of its first n bytes (of its padding, beyond its end)."""
    padded = np.frombuffer(b"".join(s.ljust(REACH, b"\0") for s in strings), np.uint8).reshape(len(strings), REACH)
    hashes = np.zeros((REACH + 1, len(strings)), np.uint64)
    for n, column in enumerate(np.ascontiguousarray(padded.T)):
        hashes[n + 1] = hashes[n] * np.uint64(_BASES[0]) + column + np.uint64(1)
    return np.ascontiguousarray(hashes.T)


class _Sorted:
    """Strings in suffix order, by mergesort over hashed comparisons."""

    def __init__(self, strings: list[bytes], hashes: list[np.ndarray]):
        self.strings, self.hashes = strings, hashes
        self.order = sorted(range(len(strings)), key=cmp_to_key(self.compare))
        self.rank = [0] * len(strings)
        for k, i in enumerate(self.order):
            self.rank[i] = k
        self.steps = [self.common(i, j) for i, j in zip(self.order, self.order[1:], strict=False)]

    def common(self, i: int, j: int) -> int:
        """The length of the common start of two strings."""
        a, b = self.strings[i], self.strings[j]
        low, high = 0, min(len(a), len(b))
        x, y = self.hashes[i], self.hashes[j]
        while low < high:
            mid = (low + high + 1) // 2
            if x[mid] == y[mid]:
                low = mid
            else:
                high = mid - 1
        if a[:low] != b[:low]:  # hashes collided: the bytes decide
            low = next(n for n in range(low) if a[n] != b[n])
        return low

    def compare(self, i: int, j: int) -> int:
        a, b, n = self.strings[i], self.strings[j], self.common(i, j)
        return -1 if (a[n : n + 1], len(a)) < (b[n : n + 1], len(b)) else 1

    def classes(self, depths: np.ndarray) -> np.ndarray:
        """By depth and string, a number that only strings equal up to that depth share."""
        out = np.zeros((len(depths), len(self.order)), np.int64)
        np.cumsum(np.array(self.steps, np.int64) < depths[:, None], axis=1, out=out[:, 1:])
        return out[:, self.rank]


def extents(lefts: list[tuple[bytes, np.ndarray]], rights: list[tuple[bytes, np.ndarray]]) -> list[tuple[int, int] | None]:
    """For contexts of one gram: how far the strings go left and right that others share, if any.

    `lefts` are read backwards from the gram, `rights` forwards from its end, both with their hashes.
    A string reaches some bytes left and the rest of `REACH` right; two contexts share it if they are
    in one class on both sides. So the work is a sort of the contexts for each reach, however many
    share one side only.
    """
    left, right = (_Sorted([x[0] for x in side], [x[1] for x in side]) for side in (lefts, rights))
    n = len(lefts)
    if n == 2:
        a, b = left.steps[0], right.steps[0]
        return [(a, b) if a + b >= REACH else None] * 2
    # Classes change only where a common extension ends: between these, one reach stands for all.
    first = np.unique([0, *(k + 1 for k in left.steps), *(REACH - k for k in right.steps)])
    first = first[first <= REACH]
    last = np.append(first[1:] - 1, REACH)
    far, near = np.full(n, -1), np.full(n, REACH + 1)
    step = max(1, _CELLS // n)
    for low, high in ((first[a : a + step], last[a : a + step]) for a in range(0, len(first), step)):
        pairs = left.classes(low) * n + right.classes(REACH - low)
        keys = (pairs + np.arange(len(low))[:, None] * n * n).ravel()
        order = keys.argsort()
        met = np.flatnonzero(np.diff(keys[order]) == 0)
        shared = np.zeros(pairs.shape, bool)
        shared.ravel()[order[met]] = shared.ravel()[order[met + 1]] = True
        far = np.maximum(far, np.where(shared, high[:, None], -1).max(axis=0))
        near = np.minimum(near, np.where(shared, low[:, None], REACH + 1).min(axis=0))
    return [(f, REACH - b) if f >= 0 else None for f, b in zip(far.tolist(), near.tolist(), strict=True)]


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`gram`, `other`, `doc`, `row`, `place`, `left` (read backwards) and `right` of the wanted anchors."""
    places = wanted.groupBy("doc", "row").agg(F.collect_list(F.struct("gram", "other", "place")).alias("places"))
    joined = docs.alias("a").join(places.alias("b"), _same("a", "b")).select("a.doc", "a.row", "a.text", "b.places")
    kind = to_arrow_type(docs.schema["doc"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                raw = batch.column(2)[n].as_py().encode()
                places = batch.column(3)[n].values
                gram, other, place = places.flatten()
                at = place.to_pylist()
                left = [raw[max(0, p - REACH) : p][::-1] for p in at]
                right = [raw[p + GRAM : p + GRAM + REACH] for p in at]
                same = [pa.array([batch.column(k)[n].as_py()] * len(at), t) for k, t in ((0, kind), (1, pa.int64()))]
                arrays = [gram, other, *same, place, pa.array(left, pa.binary()), pa.array(right, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["gram", "other", "doc", "row", "place", "left", "right"])

    kind_name = docs.schema["doc"].dataType.simpleString()
    return joined.mapInArrow(
        run, f"gram long, other long, doc {kind_name}, row long, place long, left binary, right binary"
    )


def _same(a: str, b: str):
    return F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.row") == F.col(f"{b}.row"))


def _sorted_extents(contexts: DataFrame) -> DataFrame:
    """`doc`, `row`, `start`, `stop` for contexts that share strings, a gram at a time."""
    kind = contexts.schema["doc"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group, key = [], None

        def close() -> None:
            if len(group) > 1:
                sides = ([(g[k], g[k + 2]) for g in group] for k in (5, 6))
                for (_, _, doc, row, place, *_), found in zip(group, extents(*sides), strict=True):
                    if found:
                        out.append((doc, row, place - found[0], place + GRAM + found[1]))

        def taken() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = [arrow, pa.int64(), pa.int64(), pa.int64()]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc", "row", "start", "stop"]
            )

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            columns += [prefix_hashes(columns[k]) for k in (5, 6)] if batch.num_rows else [[], []]
            for row in zip(*columns, strict=True):
                if row[:2] != key:
                    close()
                    group, key = [], row[:2]
                group.append(row)
            if out:
                yield taken()
        close()
        yield taken()

    dealt = contexts.repartition("gram").sortWithinPartitions("gram", "other")
    return dealt.mapInArrow(run, f"doc {kind.simpleString()}, row long, start long, stop long")


def _counted_extents(contexts: DataFrame) -> DataFrame:
    """The same for grams of very many contexts: all strings of a context are counted by their hashes."""
    steps = F.sequence(F.lit(0), F.lit(REACH))

    def end(c: str, n):
        return F.substring(F.col(c), F.lit(1), n)

    strings = contexts.withColumn("reach", F.explode(steps)).where(
        (F.col("reach") <= F.length("left")) & (REACH - F.col("reach") <= F.length("right"))
    )
    parts = [end("left", F.col("reach")), end("right", REACH - F.col("reach"))]
    named = strings.select(
        "gram", "other", "doc", "row", "place", "reach", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2")
    )
    keys = ["gram", "other", "reach", "h1", "h2"]
    twice = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return (
        named.join(twice, keys, "left_semi")
        .groupBy("doc", "row", "place")
        .agg(F.max("reach").alias("far"), F.min("reach").alias("near"))
        .select("doc", "row", (F.col("place") - F.col("far")).alias("start"), (F.col("place") - F.col("near") + LENGTH).alias("stop"))
    )


def repeated_spans(docs: DataFrame, max_group: int = 50_000) -> DataFrame:
    """`doc`, `row`, `start`, `stop`: byte ranges of `docs` (doc, row, text) that repeat elsewhere."""
    all_anchors = saved(found_anchors(docs), "anchors")
    met = saved(
        all_anchors.groupBy("gram", "other").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared-grams"
    )
    shared = saved(all_anchors.join(met, ["gram", "other"]), "shared-anchors")
    kinds = saved(
        shared.groupBy("gram", "other", "context").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "row", "place")).alias("one")
        ),
        "contexts",
    )
    # Equal contexts: every string of the context repeats.
    equal = kinds.where("n > 1").select("gram", "other", "context")
    left = F.least("place", F.lit(REACH))
    right = F.least(F.col("size") - F.col("place") - GRAM, F.lit(REACH))
    spans = (
        shared.join(equal, ["gram", "other", "context"])
        .where(left + right >= REACH)
        .select("doc", "row", (F.col("place") - left).alias("start"), (F.col("place") + GRAM + right).alias("stop"))
    )
    # Different contexts of one gram: one of each is compared; what is found counts for single ones.
    sizes = kinds.groupBy("gram", "other").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    mixed = kinds.join(sizes.where("kinds > 1 and least = 1"), ["gram", "other"]).select(
        "gram", "other", "one.*", "kinds"
    )
    few = _sorted_extents(_contexts(docs, mixed.where(F.col("kinds") <= max_group)))
    many = _counted_extents(_contexts(docs, mixed.where(F.col("kinds") > max_group)))
    return spans.unionByName(few).unionByName(many)


def without_repeats(
    docs: DataFrame, max_group: int = 50_000, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """One row a document: `doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`, maybe `kept` bytes."""
    narrow = docs.select(
        F.col(id_col).alias("doc"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("row"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )
    spans = repeated_spans(narrow, max_group).groupBy("doc", "row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = narrow.alias("a").join(spans.alias("b"), _same("a", "b"), "left").select("a.doc", "a.text", "b.spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                runs: list[list[int]] = []
                for s in sorted((x["start"], x["stop"]) for x in found.as_py() or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            columns = list(zip(*out, strict=True)) or [()] * 5
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            n = 5 if with_text else 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *made[:n]], ["doc_id", *names[:n]])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(run, schema + (", kept binary" if with_text else ""))
