"""Token-ID output: raw ids in shard files, found by key through a minimal perfect hash.

Documents are dealt to shards by ranges of their id and written in ascending order. A shard is two
files. `<shard>.ids` has nothing but ids, two or four bytes each, little-endian, every document's ids
followed by the end id. `<shard>.idx` maps document keys to places: a header of five 64-bit numbers
(format mark, documents, bytes of an id, ids, levels), the 64-bit word count of each level, the levels
of the perfect hash, and by slot the 32-bit fingerprints, the 64-bit starts and the 64-bit lengths.

Files go under the shared folder through its own file system, each first under a name of its own and
then moved, so a task that runs twice leaves the same files. Tasks hold a bounded piece of payload;
of a shard they hold the index, some 28 bytes a document.

Special cases: a null text is empty and has the end id alone. A null id sorts first. Rows that share
an id are told apart by their turn among them, in the order of their texts. An empty table makes no
file and no row. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.llm.common import byte_ranges, saved
from medialake.llm.perfect_hash import PerfectHash, fingerprints, key_hashes
from medialake.session import scratch_path

_MARK = 0x31584449  # names the format and its version
_PIECE = 8 << 20  # bytes of payload held at once
_TOGETHER = 8 << 20  # bytes of texts encoded together
_CACHED = 900_000  # encoded words that a worker remembers
_BLANK = "Ġ"  # how a byte-level vocabulary writes a blank

# A blank before another white space or at the end: a tokenizer may join such runs.
_LOOSE = re.compile(r" (?:\s|\Z)")


class Encoder:
    """Whole texts to ids, by a byte-level tokenizer of the tokenizers library.

    Such a tokenizer never lets a token cross from before a blank to after it where the blank stands
    alone between two other characters. So texts are cut there, and the library encodes each
    distinct piece once; texts with other blanks are encoded whole. New pieces go to the library in
    one text and are told apart by the tokens that begin with a blank, of which each has one.

    With `plain`, the content of a special token is text like any other. Without, ids are those of the
    library's default: added tokens are found in the text first, so texts that hold one are encoded whole.
    """

    def __init__(self, path: str, plain: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain and t.special)]
        # Tokens may match normalized text, whose case can differ.
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(_BLANK)]] = True
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces with a blank before each."""
        for at in range(0, len(pieces), 2000):
            part = pieces[at : at + 2000]
            ids = np.frombuffer(self._ids([" " + " ".join(part)])[0], self.kind)
            edges = np.append(np.flatnonzero(self.begins[ids]), len(ids)) * self.kind.itemsize
            if len(edges) == len(part) + 1:
                raw, edges = ids.tobytes(), edges.tolist()
                self.known.update(zip(part, map(raw.__getitem__, map(slice, edges, edges[1:])), strict=True))
            else:
                self.known.update(zip(part, self._ids([" " + x for x in part]), strict=True))

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, an end id behind each, and the texts' lengths in ids."""
        if len(self.known) > _CACHED:
            self.known.clear()
        # A text's head, up to its first blank, has no blank before it. Loose texts are all head.
        added = self.added.search if self.added else lambda t: None
        loose = [bool(_LOOSE.search(t) or added(t)) for t in texts]
        heads = [t if whole else t.partition(" ")[0] for t, whole in zip(texts, loose, strict=True)]
        cut = pa.array(["" if whole else t for t, whole in zip(texts, loose, strict=True)], pa.large_string())
        lists = pc.split_pattern(cut, " ")
        first = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        words, piece = coded.dictionary.to_pylist(), coded.indices.to_numpy().copy()
        rest = np.ones(len(piece), bool)
        rest[first[:-1]] = False
        asked = np.zeros(len(words), bool)
        asked[piece[rest]] = True
        get = self.known.get
        found = [get(w, b"") if use else b"" for w, use in zip(words, asked.tolist(), strict=True)]
        if new := [w for w, v in zip(words, found, strict=True) if not v and w]:
            self._learn([w for w in new if w not in self.known])
            found = [v or get(w, b"") for w, v in zip(words, found, strict=True)]
        # All encoded pieces, the heads and the end in one table; then the texts as places of it.
        table = [*found, *self._ids(heads), np.array([end], self.kind).tobytes()]
        ids = np.frombuffer(b"".join(table), self.kind)
        size = np.fromiter(map(len, table), np.int64, len(table)) // self.kind.itemsize
        start = np.cumsum(size) - size
        piece[first[:-1]] = len(words) + np.arange(len(texts), dtype=np.int32)
        piece = np.insert(piece, first[1:], len(table) - 1)
        sizes = size[piece]
        done = np.cumsum(sizes)
        out = ids[np.repeat(start[piece] - done + sizes, sizes) + np.arange(done[-1] if len(done) else 0)]
        ends = done[first[1:] + np.arange(len(texts))]
        return out, np.diff(ends, prepend=0)


@cache
def _encoder(path: str) -> Encoder:
    """One a worker process, so that what it remembers serves all the worker's tasks."""
    return Encoder(path, plain=False)


def _turns(keys: np.ndarray, is_null: np.ndarray, before: tuple) -> tuple[np.ndarray, tuple]:
    """The turn of each of some sorted keys among its equals; `before` is the last (key, null, turn)."""
    turn = np.zeros(len(keys), np.int64)
    last, null, n = before
    for i, (k, is_none) in enumerate(zip(keys.tolist(), is_null.tolist(), strict=True)):
        n = n + 1 if (k, is_none) == (last, null) else 0
        last, null, turn[i] = k, is_none, n
    return turn, (last, null, n)


def _keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    is_null = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), is_null


class _Moved:
    """A file written under a name of its own and moved to its place when complete."""

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.own)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.own, self.path)


class _Shard:
    """The writer of one shard's two files."""

    def __init__(self, folder: str, shard: int, width: int):
        self.shard, self.name, self.width = shard, f"{folder}/{shard:08d}", width
        self.ids = _Moved(f"{self.name}.ids")
        self.hashes, self.lengths, self.before = [], [], (0, False, -1)

    def add(self, column: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        keys, is_null = _keys(column)
        turn, self.before = _turns(keys, is_null, self.before)
        self.hashes.append(key_hashes(keys, is_null, turn))
        self.lengths.append(lengths)
        self.ids.out.write(ids.tobytes())

    def close(self) -> tuple[int, int, int]:
        self.ids.close()
        h = np.concatenate(self.hashes)
        length = np.concatenate(self.lengths).astype("<u8")
        start = np.cumsum(length) - length
        index = PerfectHash.build(h)
        order = np.argsort(index.slots(h))
        out = _Moved(f"{self.name}.idx")
        head = [_MARK, len(h), self.width, int(length.sum()), len(index.levels), *map(len, index.levels)]
        for part in (np.array(head, "<u8"), *index.levels, fingerprints(h)[order], start[order], length[order]):
            out.out.write(part.tobytes())
        out.close()
        return self.shard, len(h), int(length.sum())


class ShardReader:
    """Keyed access to one shard."""

    def __init__(self, folder: str, shard: int):
        fs, path = pafs.FileSystem.from_uri(f"{folder}/{shard:08d}")
        with fs.open_input_file(f"{path}.idx") as f:
            raw = f.read()
        mark, n, width, self.n_ids, n_levels = np.frombuffer(raw, "<u8", 5).tolist()
        if mark != _MARK:
            raise ValueError(f"{path}.idx is no index file")
        at, levels = 8 * (5 + n_levels), []
        for size in np.frombuffer(raw, "<u8", n_levels, 40).tolist():
            levels.append(np.frombuffer(raw, "<u8", size, at))
            at += 8 * size
        self.index = PerfectHash(levels)
        self.prints = np.frombuffer(raw, "<u4", n, at)
        self.start = np.frombuffer(raw[at + 4 * n :], "<u8", n).astype(np.int64)
        self.length = np.frombuffer(raw[at + 12 * n :], "<u8", n).astype(np.int64)
        self.kind, self.payload = np.dtype(f"<u{width}"), fs.open_input_file(f"{path}.ids")
        self.held, self.held_at = b"", 0

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length in ids of every key; an unknown key is an error."""
        slot = self.index.slots(h)
        if (slot < 0).any() or (self.prints[slot] != fingerprints(h)).any():
            raise KeyError("a key is not in this shard")
        return self.start[slot], self.length[slot]

    def ids(self, start: int, length: int) -> np.ndarray:
        """Ids at a place; places that follow one another share reads."""
        width = self.kind.itemsize
        a, n = start * width, length * width
        if not (self.held_at <= a and a + n <= self.held_at + len(self.held)):
            self.held_at, self.held = a, self.payload.read_at(max(n, _PIECE), a)
        return np.frombuffer(self.held, self.kind, length, a - self.held_at)


def _shard_of(key: Column, bounds: list[int]) -> Column:
    """The number of bounds that a key has reached; 0 for null."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    reached = F.aggregate(
        F.lit(steps), F.lit(0), lambda at, s: at + F.when(F.get(table, at + s - 1) <= key, s).otherwise(0)
    )
    return F.coalesce(F.when(key.isNull(), 0).otherwise(reached), F.lit(0))


class TokenFiles:
    """Where a corpus's shards are: `folder`, the id `bounds` of the shards, and their `manifest`."""

    def __init__(self, folder: str, bounds: list[int], manifest: DataFrame):
        self.folder, self.bounds, self.manifest = folder, bounds, manifest


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    end: int = 0,
    rows_per_shard: int = 10_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> TokenFiles:
    """Encode whole texts and write the shards; the manifest has `shard`, `n_docs`, `n_ids`, `base`.

    `base` is the number of ids in all shards before. Shards hold about `rows_per_shard` documents.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n = narrow.count()
    n_shards = max(1, -(-n // rows_per_shard))
    shares = [k / n_shards for k in range(1, n_shards)]
    cut = narrow.select(F.percentile_approx("doc_id", shares, 100 * n_shards)).first()[0] if shares else []
    bounds = sorted(set(cut or []))
    folder = scratch_path(docs.sparkSession, "token-ids")
    dealt = (
        narrow.withColumn("shard", _shard_of(F.col("doc_id"), bounds))
        .repartitionById(len(bounds) + 1, F.col("shard"))
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, done = _encoder(tokenizer), None, []
        for batch in batches:
            numbers = batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(edges, edges[1:], strict=False):
                if shard and shard.shard != numbers[a]:
                    done.append(shard.close())
                    shard = None
                shard = shard or _Shard(folder, int(numbers[a]), encoder.kind.itemsize)
                for at, to in byte_ranges(batch.column(1), a, b, _TOGETHER):
                    part = batch.slice(at, to - at)
                    shard.add(part.column(0), *encoder.encode(part.column(1).to_pylist(), end))
        if shard:
            done.append(shard.close())
        columns = list(zip(*done, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "n_docs", "n_ids"])

    written = saved(dealt.mapInArrow(write, "shard long, n_docs long, n_ids long"), "token-shards")
    before = F.sum("n_ids").over(Window.orderBy("shard"))
    return TokenFiles(folder, bounds, written.withColumn("base", before - F.col("n_ids")))


def read_tokens(files: TokenFiles, keys: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Look every key up and read its ids: `doc_id`, `start`, `n_tokens`, `ids_crc32` and maybe `ids`.

    `start` counts all ids before the document, `ids_crc32` is over the ids as 32-bit numbers.
    """
    folder = files.folder
    dealt = (
        keys.select(F.col(id_col).cast("long").alias("doc_id"))
        .withColumn("shard", _shard_of(F.col("doc_id"), files.bounds).cast("long"))
        .join(files.manifest.select("shard", "base"), "shard")
        .select("doc_id", "shard", "base")
        .repartitionById(len(files.bounds) + 1, F.col("shard").cast("int"))
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first())
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at, before = None, None, (0, False, -1)
        for batch in batches:
            numbers = batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                if at != numbers[a]:
                    at, before = numbers[a], (0, False, -1)
                    reader = ShardReader(folder, int(at))
                values, is_null = _keys(part.column(0))
                turn, before = _turns(values, is_null, before)
                start, length = reader.places(key_hashes(values, is_null, turn))
                ids = [reader.ids(s, n) for s, n in zip(start.tolist(), length.tolist(), strict=True)]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                columns = [part.column(0), pa.array(start + part.column(2).to_numpy()), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return dealt.mapInArrow(read, schema)
