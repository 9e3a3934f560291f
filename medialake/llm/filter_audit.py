"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

Words are counted in a sparse document-term matrix. Tasks cut blocks of documents into words, code
them within the block and keep rows of (code, count). The distinct words of all blocks get numbers in
one global dictionary, dealt over tasks by ranges of the words' hashes, and each block's codes are
replaced by these numbers: the blocks are then CSR shards of one matrix (`document_terms`). A document's row sum is its number of words, its nonzero
entries are its distinct words; these decide filters A and B. Filters C and D are read off the text's
bytes while it is cut, E compares hashes of whole texts.

A document is then five bits, and documents alike in part, bits and labels are counted together. All
orders are worked out from these counts, so their number doesn't touch the documents again.

Special cases: a null text is empty; a document without words has a row without entries and fails A
alone. A null part is the empty string. Rows that share a doc_id are documents of their own, and none
of them is smaller than another. A null doc_id is neither smaller nor larger than any other, so such a
row never fails E nor makes another fail, and it has no labels. Of several label rows for one id any
one counts. An empty table gives no rows. Texts and words are told apart by 128-bit hashes. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import saved, text_blocks
from medialake.plans.skew import join_lookup

FILTERS = "ABCDE"
_MARKS = np.frombuffer(b"#$%&*|", np.uint8)
_BLOCK = 3 << 20  # bytes of text in a block
_BUCKET = 1 << 18  # words of all blocks that are numbered together
_ROW = "struct<doc_id:{id},part:string,mark:binary,upper:boolean,marked:boolean>"


def _text_flags(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which texts fail C and D, from all texts' bytes one after another."""

    def per_text(hit: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))[offsets])

    points = per_text((raw & 0xC0) != 0x80)  # bytes that begin a code point
    upper = per_text((raw >= 65) & (raw <= 90))
    table = np.zeros(256, bool)
    table[_MARKS] = True
    return 100 * upper > 2 * points, per_text(table[raw]) > 0


def _cut_block(block: pa.Table) -> pa.RecordBatch:
    """One block of (doc_id, part, text) as a row: its documents, its words, and its CSR arrays."""
    ids, parts, texts = (c.combine_chunks() for c in block.columns)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(texts)
    words, row = lists.values, np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(words), 0)  # outer white space makes empty ends
    coded = words.filter(full).dictionary_encode()
    # Codes in the order of the words' hashes, so that a range of hashes is a range of codes.
    hashes = _word_hashes(coded.dictionary)
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    row = row[full.to_numpy(zero_copy_only=False)].astype(np.int64)
    entry, counts = np.unique(row << 32 | rank[coded.indices.to_numpy()], return_counts=True)
    indptr = np.searchsorted(entry, np.arange(len(texts) + 1, dtype=np.int64) << 32)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    upper, marked = _text_flags(raw, offsets - offsets[0])
    data = memoryview(raw)
    ends = (offsets - offsets[0]).tolist()
    marks = [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    columns = [ids, parts, pa.array(marks, pa.binary()), pa.array(upper), pa.array(marked)]
    rows = pa.StructArray.from_arrays(columns, ["doc_id", "part", "mark", "upper", "marked"])
    one = [
        pa.array([uuid.uuid4().int >> 65]),
        pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
        pa.array([hashes[order].tobytes()], pa.binary()),
        pa.array([len(order)]),
        pa.array([pack_csr(indptr, entry & 0xFFFFFFFF, counts)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(one, ["shard", "rows", "words", "n_words", "matrix"])


def _word_hashes(words: pa.Array) -> np.ndarray:
    """Two 64-bit hashes of each word."""
    raw = b"".join(map(xxhash.xxh3_128_digest, words.to_pylist()))
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def pack_csr(indptr: np.ndarray, columns: np.ndarray, counts: np.ndarray) -> bytes:
    """The arrays of one CSR shard as compressed bytes; columns of a row are kept as steps."""
    steps = np.diff(columns, prepend=0).astype("<i8")
    raw = indptr.astype("<i8").tobytes() + counts.astype("<i4").tobytes() + steps.tobytes()
    return np.array([len(indptr), len(columns)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_csr(matrix: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`indptr`, `columns` and `counts` of a shard."""
    n, m = np.frombuffer(matrix, "<i8", 2).tolist()
    raw = pa.decompress(matrix[16:], 8 * n + 12 * m, codec="zstd", asbytes=True)
    steps = np.frombuffer(raw, "<i8", m, 8 * n + 4 * m)
    return np.frombuffer(raw, "<i8", n), np.cumsum(steps), np.frombuffer(raw, "<i4", m, 8 * n)


def _packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as compressed steps."""
    steps = np.diff(numbers, prepend=0).astype("<i8").tobytes()
    return np.array([len(numbers)], "<i8").tobytes() + pa.compress(steps, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    n = int(np.frombuffer(packed, "<i8", 1)[0])
    return np.cumsum(np.frombuffer(pa.decompress(packed[8:], 8 * n, codec="zstd", asbytes=True), "<i8"))


def dictionary_numbers(blocks: DataFrame) -> DataFrame:
    """`shard`, `bucket`, `numbers`: the global number of every block's words, in the order of their hashes.

    Hashes are cut in as many even ranges as make about a quarter million words of all blocks each, and go
    packed by (block, range). A word's number is its range and its place among the range's distinct words.
    """
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, -(-total // _BUCKET))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, words in zip(*batch.columns, strict=True):
                hashes = np.frombuffer(words.as_buffer(), np.uint64).reshape(-1, 2)
                bucket = ((hashes[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                edges = np.flatnonzero(np.diff(bucket, prepend=-1))
                parts = [x.tobytes() for x in np.split(hashes, edges[1:])] if len(edges) else []
                columns = [pa.array(bucket[edges]), pa.array([shard.as_py()] * len(edges), pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "shard", "words"])

    def number(key: tuple[pa.Scalar], group: pa.Table) -> pa.Table:
        parts = group.column("words").to_pylist()
        hashes = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)
        order = np.lexsort((hashes[:, 1], hashes[:, 0]))
        new = np.concatenate(([False], (np.diff(hashes[order], axis=0) != 0).any(1)))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) + (key[0].as_py() << 32)
        edges = np.cumsum([0, *map(len, parts)]) // 16
        packed = [_packed(place[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        columns = [group.column("shard").combine_chunks(), group.column("bucket").combine_chunks(), pa.array(packed, pa.binary())]
        return pa.Table.from_arrays(columns, ["shard", "bucket", "numbers"])

    dealt = blocks.select("shard", "words").mapInArrow(deal, "bucket long, shard long, words binary")
    return dealt.groupBy("bucket").applyInArrow(number, "shard long, bucket long, numbers binary")


def document_terms(docs: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sparse document-term matrix of `docs` in CSR shards, a shard a row.

    `shard`, `rows` (its documents: `doc_id`, `part`, `mark` of the text, and whether it fails C and D)
    and `matrix`, which `unpack_csr` reads; its columns are numbers of the global dictionary.
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(part, F.lit("")).alias("part"), F.col(text_col).alias("text")
    )
    row = _ROW.format(id=narrow.schema["doc_id"].dataType.simpleString())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 2, _BLOCK):
            yield _cut_block(block)

    schema = f"shard long, rows array<{row}>, words binary, n_words long, matrix binary"
    blocks = saved(narrow.mapInArrow(cut, schema), "term-blocks")
    coded = dictionary_numbers(blocks).groupBy("shard").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "numbers"))).alias("coded")
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for matrix, parts in zip(batch.column(2), batch.column(3), strict=True):
                indptr, columns, counts = unpack_csr(matrix.as_py())
                if len(columns):
                    # Numbers ascend with the codes, so rows stay in order.
                    columns = np.concatenate([_unpacked(p) for p in parts.values.field(1).to_pylist()])[columns]
                out.append(pack_csr(indptr, columns, counts))
            columns = [*batch.columns[:2], pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "rows", "matrix"])

    met = blocks.select("shard", "rows", "matrix").join(coded.select("shard", "coded"), "shard", "left")
    return met.mapInArrow(number, f"shard long, rows array<{row}>, matrix binary")


def term_totals(shards: DataFrame) -> DataFrame:
    """Every document of the shards with `n_words` (its row sum) and `n_distinct` (its entries)."""
    id_type = shards.schema["rows"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in zip(*batch.columns, strict=True):
                indptr, _, counts = unpack_csr(matrix.as_py())
                sums = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
                columns = [*rows.values.flatten(), pa.array(np.diff(sums[indptr])), pa.array(np.diff(indptr))]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "part", "mark", "upper", "marked", "n_words", "n_distinct"]
    schema = f"doc_id {id_type}, part string, mark binary, upper boolean, marked boolean, n_words long, n_distinct long"
    return shards.select("rows", "matrix").mapInArrow(run, schema)


def failed_filters(docs: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `part` and `fails` of every document: bit k is set if it fails filter k of A to E."""
    held = saved(term_totals(document_terms(docs, part, id_col, text_col)), "term-totals")
    # Only texts with more than one id, so that the lookup is small; written apart, its hot rows are split.
    ids = held.where("doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    first = saved(ids.where("least < most").select("mark", "least"), "copied-texts")
    tests = [
        F.col("n_words") < 200,
        100 * F.col("n_distinct") < 50 * F.col("n_words"),
        F.col("upper"),
        F.col("marked"),
        F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)),
    ]
    fails = sum((t.cast("int") * (1 << k) for k, t in enumerate(tests)), F.lit(0))
    return held.join(first, "mark", "left").select("doc_id", "part", fails.alias("fails"))


def filter_audit(
    docs: DataFrame, labels: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """For every part, order of the five filters and step: what the step's filter removes there.

    `part`, `filter_order`, `step`, and as long: `kept`, `removed`, `redundant`, `unique_fails`,
    `good_lost`, `toxic_lost`, `shapley` (the filter's removed documents summed over all orders).
    """
    # The lookup copies every label, which the engine's estimate of its size leaves out: without the hint
    # it broadcasts the copies of a labels file that is under its limit only as it lies there, packed.
    known = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    ).hint("merge")
    failed = failed_filters(docs, part, id_col, text_col)
    counted = (
        join_lookup(failed, known, ["doc_id"])
        .groupBy("part", "fails")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.coalesce("good", F.lit(0))).alias("good"),
            F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
        )
    )
    # From here on rows are at most 32 a part: 120 orders of 5 steps each for every one of them.
    grid = [("".join(o), k + 1, 1 << FILTERS.index(o[k]), sum(1 << FILTERS.index(x) for x in o[:k])) for o in permutations(FILTERS) for k in range(len(o))]
    names = ["filter_order", "step", "bit", "earlier"]
    steps = F.explode(F.arrays_zip(*[F.lit(list(c)).alias(n) for n, c in zip(names, zip(*grid, strict=True), strict=True)]))
    placed = counted.withColumn("at", steps).select("*", *[F.col("at")[n].alias(n) for n in names])
    fails, hit = F.col("fails"), F.col("fails").bitwiseAND(F.col("bit")) != 0
    gone = fails.bitwiseAND(F.col("earlier")) != 0
    # A document that fails m filters is removed by each of them in one of m orders.
    share = F.lit(math.factorial(len(FILTERS))) / F.greatest(F.bit_count("fails"), F.lit(1))

    def total(value, when):
        return F.sum(F.when(when, value).otherwise(0)).cast("long")

    return placed.groupBy("part", "filter_order", "step").agg(
        total(F.col("n"), ~hit & ~gone).alias("kept"),
        total(F.col("n"), hit & ~gone).alias("removed"),
        total(F.col("n"), hit & gone).alias("redundant"),
        total(F.col("n"), fails == F.col("bit")).alias("unique_fails"),
        total(F.col("good"), hit & ~gone).alias("good_lost"),
        total(F.col("toxic"), hit & ~gone).alias("toxic_lost"),
        total(F.col("n") * share.cast("long"), hit).alias("shapley"),
    )
