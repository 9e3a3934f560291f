"""Benchmark decontamination: size-partitioned MinHash containment search.

The containment of a short test item in a long document can't be read off a MinHash of the whole
document: the item's share of it is too small. So items are partitioned by their number of
shingles, each class reaching up to twice its lower bound, and for each class the documents are cut
into overlapping windows of one and a half times the class's upper bound. A passage of any item of
the class lies within a window whole. For the class's bounds a containment `t` then means a Jaccard
similarity of at least t/2 / (3/2 + (1-t)/2) between item and window, which sets how many MinHash
values are compared: enough that a pair escapes all of them with a probability of at most `miss`.
Any pair that agrees in one value is a candidate; candidates are verified with the exact shingle
sets of the item and of the whole document.

Two kinds of items have too little to hash and are looked up instead, exactly. An item that repeats
itself has few distinct shingles for its length: a document that holds enough of them holds one of any
few (as many as may be missing, and one more). An item of fewer words than a shingle is searched for as
that run of words.

Items are the stated query set. They are taken in blocks of at most `block` items, one pass over the
documents for each block, so what a task holds of them is bounded whatever their number. An item is found
where its shingles lie together; shingles scattered over a long document are not searched for.

Special cases: null texts and texts without words hold no shingle and match nothing; an item shorter
than a shingle is one shingle, its whole word sequence, found wherever a document has these words in a
row. Repeated documents each report their items;
items that share an item_id are told apart by their texts, and a pair is reported once with the
larger containment. Null ids are kept as they are. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from medialake.llm.common import reach_workers, words_of
from medialake.llm.simhash import shingles

_FACTOR = 0x9E3779B97F4A7C15
_SMALLEST = 2  # the first class holds items of up to so many shingles
_AT_ONCE = 1 << 18  # shingles of documents that are searched together


def n_values(share: float, miss: float) -> int:
    """MinHash values to compare, for a containment of `share` at a class's worst bounds."""
    jaccard = share / 2 / (1.5 + (1 - share) / 2)
    return math.ceil(math.log(miss) / math.log(1 - jaccard))


class WordHashes(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(words: list[bytes], size: int, known: WordHashes) -> np.ndarray:
    """A 64-bit hash of every shingle, in order."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out *= np.uint64(_FACTOR)
        out += h[k : len(h) - size + 1 + k]
    return out ^ (out >> np.uint64(32))


def _valued(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash function of the MinHash family, on shingle hashes; 32 bits."""
    m = (h ^ np.uint64((k * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    m ^= m >> np.uint64(31)
    m *= np.uint64(0x94D049BB133111EB)
    return (m >> np.uint64(32)).astype(np.uint32)


class Items:
    """The index over one block of items: for each class and hash function, the items' minima."""

    def __init__(self, rows: list[tuple], size: int, values: int, share: float):
        self.size, self.values = size, values
        self.ids = [r[0] for r in rows]
        words = [words_of(r[1]) for r in rows]
        runs = [shingles(w, size) for w in words]
        self.sets = [frozenset(x) for x in runs]
        by_class: dict[int, list[int]] = defaultdict(list)
        exact: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by words in a run: hashes and items
        for i, x in enumerate(runs):
            if not x:
                continue
            top = max(_SMALLEST, 1 << (len(x) - 1).bit_length())
            if len(words[i]) < size:
                exact[len(words[i])].append((int(shingle_hashes(words[i], size, WordHashes())[0]), i))
            elif 2 * len(self.sets[i]) < top:
                # Of the distinct shingles, one more than may be missing.
                keys = np.unique(shingle_hashes(words[i], size, WordHashes()))
                exact[size] += [(int(k), i) for k in keys[: len(keys) - math.ceil(share * len(keys)) + 1]]
            else:
                by_class[top].append(i)
        self.short = [x[0] if x and len(w) < size else b"" for x, w in zip(runs, words, strict=True)]
        self.exact = {}
        for n, found in exact.items():
            found.sort()
            self.exact[n] = (np.array([h for h, _ in found], np.uint64), np.array([i for _, i in found]))
        self.classes = []
        for top, members in sorted(by_class.items()):
            hashes = [shingle_hashes(words[i], size, WordHashes()) for i in members]
            tables = []
            for k in range(values):
                least = np.array([_valued(h, k).min() for h in hashes], np.uint32)
                order = np.argsort(least, kind="stable")
                seen = np.zeros(1 << 16, bool)
                seen[least >> np.uint32(16)] = True
                tables.append((least[order], np.array(members)[order], seen))
            self.classes.append((top, tables))

    def looked_up(self, texts: list[list[bytes]], hashes: list[np.ndarray], known: WordHashes) -> set[tuple[int, int]]:
        """(document, item) wherever a document has a run of words that an item is looked up by."""
        found: set[tuple[int, int]] = set()
        for n, (keys, items) in self.exact.items():
            for doc, words in enumerate(texts):
                if len(words) < n:
                    continue
                h = hashes[doc] if n == self.size else shingle_hashes(words, n, known)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                for k in np.unique(h[keys[at] == h]):
                    lo, hi = (np.searchsorted(keys, k, side) for side in ("left", "right"))
                    found.update((doc, i) for i in items[lo:hi].tolist())
        return found

    def candidates(self, hashes: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) wherever a window agrees with an item in some MinHash value.

        `hashes` has the shingles of several documents one after another, `starts` where each
        begins. A window over a border counts for all its documents.
        """
        found: set[tuple[int, int]] = set()
        if not len(hashes) or not self.classes:
            return found
        for k in range(self.values):
            at = self.classes[0][0] // 2
            v = _valued(hashes, k)
            blocks = np.minimum.reduceat(v, np.arange(0, len(v), at))
            for top, tables in self.classes:
                while at < top // 2:  # blocks of twice the length, from pairs of blocks
                    blocks = np.minimum.reduceat(blocks, np.arange(0, len(blocks), 2))
                    at *= 2
                # A window is three blocks of half the class's upper bound; at the end, fewer.
                least = blocks.copy()
                np.minimum(least[:-1], blocks[1:], out=least[:-1])
                np.minimum(least[:-2], blocks[2:], out=least[:-2])
                values, members, seen = tables[k]
                windows = np.flatnonzero(seen[least >> np.uint32(16)])
                if not len(windows):
                    continue
                lo, hi = (np.searchsorted(values, least[windows], side) for side in ("left", "right"))
                real = hi > lo
                first = np.searchsorted(starts, windows[real] * at, "right") - 1
                last = np.searchsorted(starts, windows[real] * at + 3 * at - 1, "right") - 1
                for a, b, d, e in set(zip(*(x.tolist() for x in (lo[real], hi[real], first, last)), strict=True)):
                    found.update((doc, i) for doc in range(d, e + 1) for i in members[a:b].tolist())
        return found

    def contained(self, texts: list[list[bytes]], share: float, known: WordHashes) -> Iterator[tuple]:
        """(text, item id, shingles, shared shingles) for the items that each list of words holds."""
        hashes = [shingle_hashes(w, self.size, known) for w in texts]
        starts = np.cumsum([0, *map(len, hashes)])[:-1]
        by_text = defaultdict(list)
        if hashes:
            near = self.candidates(np.concatenate(hashes), starts) | self.looked_up(texts, hashes, known)
            for doc, i in near:
                by_text[doc].append(i)
        for doc, found in sorted(by_text.items()):
            whole, row = set(shingles(texts[doc], self.size)), b" " + b" ".join(texts[doc]) + b" "
            best: dict = {}
            for i in sorted(found):
                n, shared = len(self.sets[i]), len(self.sets[i] & whole)
                if self.short[i]:
                    shared = int(b" " + self.short[i] + b" " in row)
                if shared >= share * n:
                    best[self.ids[i]] = max(best.get(self.ids[i], (0, 0, 0)), (shared / n, n, shared))
            for item, (_, n, shared) in best.items():
                yield doc, item, n, shared


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    size: int = 5,
    share: float = 0.8,
    miss: float = 1e-6,
    block: int = 20_000,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """`doc_id`, `item_id`, `n_shingles`, `n_shared`, `containment`: the items found in documents.

    A row says that at least `share` of the item's distinct shingles of `size` words are in the
    document. A pair of a document and an item that holds escapes with a probability of `miss`.
    """
    values = n_values(share, miss)
    asked = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = [f.schema[0].dataType.simpleString() for f in (narrow, asked)]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_shingles long, n_shared long, containment double"
    item_type = to_arrow_type(asked.schema["item_id"].dataType)
    parts = [_search(narrow, rows, size, values, share, schema, item_type) for rows in _blocks(asked, block)]
    out = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:  # texts of one item_id may be in several blocks
        best = F.max_by(F.struct("n_shingles", "n_shared", "containment"), "containment").alias("b")
        out = out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")
    return out


def without_items(
    docs: DataFrame,
    items: DataFrame,
    size: int = 5,
    share: float = 0.8,
    miss: float = 1e-6,
    block: int = 20_000,
    item_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of `docs` whose text holds none of the items, as they are; nothing is shuffled."""
    reach_workers(docs.sparkSession)
    values = n_values(share, miss)
    for rows in _blocks(items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")), block):
        docs = docs.mapInArrow(_filter(docs, rows, docs.columns.index(text_col), size, values, share), docs.schema)
    return docs


def _filter(docs: DataFrame, rows: list[tuple], at: int, size: int, values: int, share: float) -> Callable:
    shipped = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = Items(shipped.value, size, values, share), WordHashes()
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[n for n, *_ in _found(index, batch.column(at), share, known)]] = False
            yield batch.filter(pa.array(clean))

    return run


def _found(index: Items, texts: pa.Array, share: float, known: WordHashes) -> Iterator[tuple]:
    """(row, item id, shingles, shared shingles) over a batch, some texts at a time."""
    rows, held, n_words = [], [], 0
    for n, t in enumerate(texts):
        if words := words_of(t.as_py()):
            rows.append(n)
            held.append(words)
            n_words += len(words)
        if held and (n_words >= _AT_ONCE or n == len(texts) - 1):
            for i, item, m, s in index.contained(held, share, known):
                yield rows[i], item, m, s
            rows, held, n_words = [], [], 0


def _blocks(asked: DataFrame, block: int) -> Iterator[list[tuple]]:
    """The items in parts by a hash, each of `block` rows at most but for chance."""
    n = asked.count()
    # Blocks are half full on average, so that one over the bound is very unlikely.
    n_blocks = math.ceil(n / block * 2) if n > block else 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    for b in range(n_blocks):
        yield [tuple(r) for r in asked.where(part == b).collect()]


def _search(
    narrow: DataFrame, rows: list[tuple], size: int, values: int, share: float, schema: str, item_type: pa.DataType
) -> DataFrame:
    shipped = narrow.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = Items(shipped.value, size, values, share), WordHashes()
        for batch in batches:
            ids = batch.column(0)
            out = [
                (ids[n].as_py(), item, m, s, s / m) for n, item, m, s in _found(index, batch.column(1), share, known)
            ]
            types = [batch.schema.field(0).type, item_type, pa.int64(), pa.int64(), pa.float64()]
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

    return narrow.mapInArrow(run, schema)
