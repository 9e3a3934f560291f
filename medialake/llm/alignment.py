"""Cross-tokenizer alignment: which ids of two tokenizers stand for the same bytes, over a whole corpus.

Both tokenizers encode a blank and the text. Byte offsets where tokens of both end cut the tokens into
groups, and every A token of a group is linked with every B token of it.

Pairs of ids are counted through inverted bitmaps. Within a block of documents every pair has a
compressed bitmap of the documents that hold it: bits where it is dense, gaps of a byte where it is
sparse. Multiplicity planes go with it: plane k has a bit for each set bit of the pair's bitmap, bit k
of the pair's links in that document. Tasks make bitmaps for some megabytes of text at a time and
OR-merge them into the block's, whose documents no other block has; so a pair's documents are the sum
of its bitmaps' popcounts. Only these counts are shuffled by pair. The scores go back to the blocks,
where bitmaps and planes are read as postings and give every document its sums.

Neither tokenizer lets a token cross from a word into a single blank behind it, so texts are cut there
and each distinct chunk is encoded once; other blanks stay inside their chunk.

Special cases: a null or empty text has no tokens and zeros; neither has one whose tokens of A or B
don't spell the blank and the text. Rows are documents of their own, also if they share an id or a
text. A chunk without blanks may be as long as a text; of a long group only its distinct ids are
paired. Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import saved, text_blocks

_BLOCK = 8 << 20  # bytes of text in a block
_PART = 2 << 20  # bytes of text whose bitmaps are made at once
_DOCS = 1 << 16  # documents in a block at most
_CACHED = 100_000  # chunks that a worker remembers
_LEARNED = 8192  # chunks encoded at once
_LISTED = 4096  # links of a group that are listed one by one
_HASHED = 100_000  # chunks hashed at once


def _byte_alphabet() -> dict[str, int]:
    """How byte-level vocabularies write bytes: visible characters stand for themselves, the others
    follow from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Side:
    """One tokenizer: encodes chunks, and knows the bytes and the decimal name of every id."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.names = np.array([str(i) for i in range(len(spelled))], object)

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, each behind a blank, one after another, and each chunk's number of ids."""
        lists = self.lists(chunks)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for ids in lists for i in ids), np.int64, int(n.sum())), n

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids.tolist()))


class ByteLevel(_Side):
    """A byte-level tokenizer of the tokenizers library; special tokens' strings are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        at, vocabulary = _byte_alphabet(), self.tokenizer.get_vocab()
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            spelled[i] = bytes(at[c] for c in token) if all(c in at for c in token) else token.encode()
        super().__init__(spelled)

    def lists(self, chunks: list[str]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)
        return [e.ids for e in found]


class Pieces(_Side):
    """A SentencePiece model, which adds the blank itself and falls back to bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes over a word's end: texts can't be cut at blanks")
        super().__init__(
            [
                bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in enumerate(pieces)
            ]
        )

    def lists(self, chunks: list[str]) -> list[list[int]]:
        return self.model.encode(chunks, num_threads=1)


def _edges(n: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(n, dtype=np.int64)))


def _places(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... n[i] of them, for every i."""
    done = np.cumsum(n)
    return np.repeat(start - done + n, n) + np.arange(done[-1] if len(n) else 0)


class Aligner:
    """Chunks and their links, remembered: for every chunk its token, group and link counts, its
    groups in writing, and its id pairs with their number of links."""

    def __init__(self, a: _Side, b: _Side):
        self.a, self.b = a, b
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.said: list[bytes] = []
        self.counts = np.zeros((0, 5), np.int64)  # tokens of A and B, groups, links; 1 if spelled right
        self.edges = np.zeros(1, np.int64)
        self.pairs, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, chunks: list[str]) -> None:
        counts, sizes, pairs, links = [self.counts], [], [self.pairs], [self.links]
        for at in range(0, len(chunks), _LEARNED):
            part = self._learned(chunks[at : at + _LEARNED])
            for held, new in zip((counts, sizes, pairs, links), part, strict=True):
                held.append(new)
        if chunks:
            self.at.update(zip(chunks, range(len(self.at), len(self.at) + len(chunks)), strict=True))
            self.counts, self.pairs, self.links = map(np.concatenate, (counts, pairs, links))
            self.edges = np.concatenate((self.edges, self.edges[-1] + np.cumsum(np.concatenate(sizes))))

    def _learned(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some new chunks: counts, numbers of pairs, pairs and their links."""
        a, b = self.a, self.b
        ids_a, n_a = a.encode(chunks)
        ids_b, n_b = b.encode(chunks)
        size = np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks)) + 1
        good = self._spelled(chunks, ids_a, n_a, ids_b, n_b, size)
        ids_a, n_a = ids_a[np.repeat(good, n_a)], n_a * good
        ids_b, n_b = ids_b[np.repeat(good, n_b)], n_b * good
        # All good chunks are one string of bytes here; every chunk's end is an end of both.
        end_a, end_b = np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        owner = np.repeat(np.arange(len(chunks)), good * 1)[np.searchsorted(np.cumsum(size[good]), ends)] if len(ends) else ends
        counts = np.zeros((len(chunks), 5), np.int64)
        counts[:, 0], counts[:, 1], counts[:, 4] = n_a, n_b, good
        np.add.at(counts[:, 2], owner, 1)
        np.add.at(counts[:, 3], owner, in_a * in_b)
        # Groups in writing: the tokens of a group's A side, then of its B side, each with what follows it.
        said = np.empty(len(ids_a) + len(ids_b), object)
        last_a, last_b = np.isin(end_a, ends), np.isin(end_b, ends)
        first_b = _edges(in_b)
        said[np.arange(len(ids_a)) + first_b[group_a]] = a.names[ids_a] + np.where(last_a, "|", ",").astype(object)
        past_a = np.cumsum(in_a)
        said[np.arange(len(ids_b)) + past_a[group_b]] = b.names[ids_b] + np.where(last_b, ";", ",").astype(object)
        cut = _edges(n_a + n_b).tolist()
        said = said.tolist()
        self.said += ["".join(said[x:y]).encode() for x, y in zip(cut, cut[1:], strict=False)]
        # Links: listed one by one in small groups, as distinct ids with their counts in large ones.
        first_a = _edges(in_a)
        small = in_a * in_b <= _LISTED
        token = np.flatnonzero(small[group_a])
        g = group_a[token]
        other = _places(first_b[g], in_b[g])
        pair = [np.repeat(ids_a[token], in_b[g]) << 32 | ids_b[other]]
        chunk, links = [np.repeat(owner[g], in_b[g])], [np.ones(len(other), np.int64)]
        for k in np.flatnonzero(~small).tolist():
            x, n_x = np.unique(ids_a[first_a[k] : first_a[k + 1]], return_counts=True)
            y, n_y = np.unique(ids_b[first_b[k] : first_b[k + 1]], return_counts=True)
            pair.append((x[:, None] << 32 | y).ravel())
            links.append((n_x[:, None] * n_y).ravel())
            chunk.append(np.full(len(x) * len(y), owner[k]))
        pair, chunk, links = map(np.concatenate, (pair, chunk, links))
        pair, chunk, links = _summed(pair, chunk, links, by_second=True)
        return counts, np.bincount(chunk, minlength=len(chunks)), pair, links

    def _spelled(self, chunks, ids_a, n_a, ids_b, n_b, size) -> np.ndarray:
        """Which chunks both tokenizers spell right."""
        whole = "".join(" " + c for c in chunks).encode()
        spelled_a, spelled_b = self.a.bytes_of(ids_a), self.b.bytes_of(ids_b)
        if spelled_a == spelled_b == whole:
            return np.ones(len(chunks), bool)
        edges = [_edges(size)]
        for ids, n, side in ((ids_a, n_a, self.a), (ids_b, n_b, self.b)):
            edges.append(_edges(side.size[ids])[_edges(n)])
        cut = [[t[x:y] for x, y in zip(e.tolist(), e[1:].tolist(), strict=False)] for t, e in zip((whole, spelled_a, spelled_b), edges, strict=True)]
        return np.array([x == y == z for x, y, z in zip(*cut, strict=True)])

    def chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of every chunk of some texts, and each text's first place among them (and the end)."""
        lists = pc.split_pattern(texts, " ")
        first = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        # A cut needs a blank alone between two characters that are no white space.
        opens = np.array([bool(w[:1].strip()) for w in words], bool)
        closes = np.array([bool(w[-1:].strip()) for w in words], bool)
        cut = np.ones(len(code), bool)
        cut[1:] = opens[code[1:]] & closes[code[:-1]]
        cut[first[:-1]] = True
        start = np.flatnonzero(cut)
        n = np.diff(np.append(start, len(code)))
        glued = np.flatnonzero(n > 1)
        chunk = code[start].astype(np.int64)
        single = np.zeros(len(words), bool)
        single[chunk[n == 1]] = True
        chunk[glued] = len(words) + np.arange(len(glued))
        joined = [" ".join([words[c] for c in code[s : s + k].tolist()]) for s, k in zip(start[glued].tolist(), n[glued].tolist(), strict=True)]
        if len(self.at) > _CACHED:
            self.forget()
        used = [w for w, s in zip(words, single.tolist(), strict=True) if s] + joined
        self.learn([w for w in dict.fromkeys(used) if w not in self.at])
        get = self.at.get
        numbers = [get(w, -1) if s else -1 for w, s in zip(words, single.tolist(), strict=True)]
        numbers = np.array([*numbers, *map(get, joined)], np.int64)
        return numbers[chunk], np.searchsorted(start, first)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts: counts (tokens of A and B, groups, links), the hash of their groups, and by
        (pair, text) the pairs, the texts' numbers and the numbers of links."""
        chunk, first = self.chunked(texts)
        n = np.diff(first)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(texts)), n)
        bad = empty | (np.bincount(row, self.counts[chunk, 4] == 0, len(texts)) > 0)
        hashes = [
            "" if b else self._hash(chunk[x:y]) for b, x, y in zip(bad.tolist(), first.tolist(), first[1:].tolist(), strict=False)
        ]
        chunk, row = chunk[~bad[row]], row[~bad[row]]
        edges = np.searchsorted(row, np.arange(len(texts) + 1))
        counts = np.stack([np.diff(_edges(self.counts[chunk, k])[edges]) for k in range(4)], 1)
        entry, times = np.unique(row << 32 | chunk, return_counts=True)
        row, chunk = entry >> 32, entry & 0xFFFFFFFF
        n_pairs = np.diff(self.edges)[chunk]
        at = _places(self.edges[chunk], n_pairs)
        pair, text, links = _summed(self.pairs[at], np.repeat(row, n_pairs), self.links[at] * np.repeat(times, n_pairs))
        return counts, hashes, pair, text, links

    def _hash(self, chunk: np.ndarray) -> str:
        h = hashlib.sha256()
        for x in range(0, len(chunk), _HASHED):
            part = b"".join(map(self.said.__getitem__, chunk[x : x + _HASHED].tolist()))
            h.update(part[:-1] if x + _HASHED >= len(chunk) else part)
        return h.hexdigest()


def _summed(pair: np.ndarray, other: np.ndarray, links: np.ndarray, by_second: bool = False):
    """Links added up by (pair, other), in ascending order of these or, `by_second`, of (other, pair)."""
    order = np.lexsort((pair, other) if by_second else (other, pair))
    pair, other, links = pair[order], other[order], links[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(pair) != 0) | (np.diff(other) != 0)))) if len(pair) else order
    return pair[new], other[new], np.add.reduceat(links, new) if len(new) else links


# Postings of a block -----------------------------------------------------------------------------


def pack_postings(pair: np.ndarray, doc: np.ndarray, links: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Bitmaps and planes of postings in order of (pair, doc): the pairs, their popcounts, and the
    rest as compressed bytes."""
    first = np.flatnonzero(np.concatenate(([True], np.diff(pair) != 0))) if len(pair) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(pair)))
    width = (n_docs + 7) // 8
    dense = size > width  # a gap takes a byte
    owner = np.repeat(np.arange(len(first)), size)
    in_dense = dense[owner]
    bits = np.zeros((int(dense.sum()), width), np.uint8)
    rank = np.cumsum(dense) - 1
    place = doc[in_dense]
    np.bitwise_or.at(bits, (rank[owner[in_dense]], place >> 3), (1 << (place & 7)).astype(np.uint8))
    before = np.concatenate(([-1], doc[:-1]))
    before[first] = -1
    gap = (doc - before - 1)[~in_dense]
    runs = gap // 255 + 1  # a byte of 255 goes on with the next
    gaps = np.full(int(runs.sum()), 255, np.uint8)
    gaps[np.cumsum(runs) - 1] = gap % 255
    n_planes = int(links.max(initial=0)).bit_length()
    planes = [np.packbits((links >> k & 1).astype(bool)) for k in range(n_planes)]
    parts = [np.packbits(dense), size[~dense].astype("<u4").view(np.uint8), gaps, bits.ravel(), *planes]
    raw = b"".join(p.tobytes() for p in parts)
    head = np.array([len(first), n_docs, len(raw), len(gaps), n_planes], "<i8").tobytes()
    return pair[first], size, head + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_postings(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The popcount of every pair's bitmap, and the documents and links of all postings in order."""
    n_pairs, n_docs, n_raw, n_gaps, n_planes = np.frombuffer(packed, "<i8", 5).tolist()
    raw = np.frombuffer(pa.decompress(packed[40:], n_raw, codec="zstd", asbytes=True), np.uint8)
    width, at = (n_docs + 7) // 8, (n_pairs + 7) // 8
    dense = np.unpackbits(raw[:at], count=n_pairs).astype(bool)
    n_sparse, n_dense = int((~dense).sum()), int(dense.sum())
    sparse_size = raw[at : at + 4 * n_sparse].copy().view("<u4").astype(np.int64)
    at += 4 * n_sparse
    gaps = raw[at : at + n_gaps]
    at += n_gaps
    bits = raw[at : at + n_dense * width].reshape(n_dense, width)
    at += n_dense * width
    size = np.zeros(n_pairs, np.int64)
    size[~dense] = sparse_size
    size[dense] = np.bitwise_count(bits).sum(1, dtype=np.int64)
    doc = np.zeros(int(size.sum()), np.int64)
    in_dense = np.repeat(dense, size)
    doc[in_dense] = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))[1]
    # Within a pair the documents are the running sums of gap + 1, less 1.
    whole = np.cumsum(gaps, dtype=np.int64)[gaps != 255]
    step = whole + np.arange(1, len(whole) + 1)
    base = np.concatenate(([0], step))[np.cumsum(sparse_size) - sparse_size]
    doc[~in_dense] = step - np.repeat(base, sparse_size) - 1
    n_bytes = (len(doc) + 7) // 8
    links = np.zeros(len(doc), np.int64)
    for k in range(n_planes):
        links += np.unpackbits(raw[at : at + n_bytes], count=len(doc)).astype(np.int64) << k
        at += n_bytes
    return size, doc, links


@cache
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One a worker process, so that what it remembers serves all the worker's tasks."""
    return Aligner(ByteLevel(path_a), Pieces(path_b))


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def inverted_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents with their inverted bitmaps, a block a row: `block`, `rows` (`doc_id`, counts,
    hash of the groups), `pairs` (id of A << 32 | id of B, ascending), their popcounts `held`, and
    `postings`, which `unpack_postings` reads."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    row = f"struct<doc_id:{narrow.schema['doc_id'].dataType.simpleString()},n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for block in text_blocks(batches, 1, _BLOCK, _DOCS):
            counts, hashes, keys, links, done = [], [], [], [], 0
            for part in text_blocks(iter(block.to_batches()), 1, _PART):
                texts = pc.fill_null(part.column(1).combine_chunks(), "").cast(pa.large_string())
                n, sha, pair, text, m = aligner.encode(texts)
                counts.append(n)
                hashes += sha
                keys.append((pair, text + done))
                links.append(m)
                done += len(texts)
            pair, doc = (np.concatenate([k[i] for k in keys]) for i in range(2))
            links = np.concatenate(links)
            order = np.argsort(pair, kind="stable")  # documents of later parts are greater
            pairs, held, packed = pack_postings(pair[order], doc[order], links[order], done)
            columns = [block.column(0).combine_chunks(), *map(pa.array, np.concatenate(counts).T), pa.array(hashes, pa.string())]
            rows = pa.StructArray.from_arrays(columns, ["doc_id", *_COUNTS, "groups_sha256"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().hex]),
                    pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                    pa.array([pairs], pa.list_(pa.int64())),
                    pa.array([held.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([packed], pa.binary()),
                ],
                ["block", "rows", "pairs", "held", "postings"],
            )

    return narrow.mapInArrow(run, f"block string, rows array<{row}>, pairs array<long>, held array<int>, postings binary")


def pair_scores(blocks: DataFrame) -> DataFrame:
    """`pair`, `count` (documents that hold it linked) and `is_best` (the highest count of its id of A)."""
    held = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("x.pairs", "x.held")
    counts = held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("count"))
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    return counts.join(best, "a").select("pair", "count", (F.col("count") == F.col("best")).alias("is_best"))


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document `doc_id`, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `groups_sha256`."""
    blocks = saved(inverted_blocks(docs, path_a, path_b, id_col, text_col), "inverted-blocks")
    scores = saved(pair_scores(blocks), "pair-scores")
    # A frequent pair is in every block: both sides are read from tables, so hot pairs are split.
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    scored = (
        asked.join(scores, "pair")
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("at", "count", "is_best"))).alias("x"))
        .select("block", F.col("x.count").alias("counts"), F.col("x.is_best").alias("best"))
    )
    id_type = blocks.schema["rows"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, postings, counts, best = (batch.column(k).slice(i, 1) for k in range(4))
                doc_id, n_a, n_b, n_groups, n_links, sha = rows.flatten().flatten()
                size, doc, links = unpack_postings(postings[0].as_py())
                counts = np.repeat(counts.flatten().to_numpy(), size)
                best = np.repeat(best.flatten().to_numpy(zero_copy_only=False).astype(bool), size)
                n_best, count_sum = np.zeros(len(doc_id), np.int64), np.zeros(len(doc_id), np.int64)
                np.add.at(n_best, doc[best], links[best])
                np.add.at(count_sum, doc, links * counts)
                columns = [doc_id, n_a, n_b, n_groups, n_links, pa.array(n_best), pa.array(count_sum), sha]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    longs = ", ".join(f"{c} long" for c in [*_COUNTS, "n_best", "count_sum"])
    met = blocks.select("block", "rows", "postings").join(scored, "block", "left")
    return met.select("rows", "postings", "counts", "best").mapInArrow(run, f"doc_id {id_type}, {longs}, groups_sha256 string")
