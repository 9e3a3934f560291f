"""SentencePiece sampling: forward filtering and backward sampling over the lattice of pieces.

A text's segmentations into pieces have weights, the product of their pieces' weights. Forward
filtering sums the weights of all ways to reach each character; backward sampling then draws a piece
from the end on, by its share of the sum at its end. The draws come from a generator keyed by the
row's key, so a row is segmented alike wherever and whenever it is encoded.

No piece of the model goes on over a word into the blanks behind it, so the lattice falls apart at
these places and each chunk (blanks and the word behind them, or a line feed) takes one number of 32
bits from the generator: every draw uses the part of the number that the draw before left over. A
chunk too long for that takes a number for every draw, from a generator keyed by its number.

A piece's weight is 1 / (its place in the model's order of merges + 2), to the power `sharpness`.
Characters that are no piece are spelled in byte pieces. So are literal U+2581 characters, which
otherwise stand for blanks, and no blank is added in front: decoding gives every text back unchanged.

Special cases: a null text is empty and has no piece. A null key is a key of its own. Rows with equal
keys and texts are segmented alike. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import byte_ranges, reach_workers

_BLANK = "▁"
_CHUNK = re.compile(r" *[^ \n]+|\n| +")
_FREQUENT = 6  # a chunk met so often gets its segmentations listed
_LISTED = 48  # segmentations of a chunk that are listed at most
_CACHED = 60_000  # chunks with listed segmentations
_SHORT = 24  # chunks of up to so many characters are sampled many at once
_TOGETHER = 6 << 20  # bytes of texts segmented together
_SPELLED = 1e-5  # weight of a character in byte pieces, its only way


class _Pieces:
    """Pieces of a model by a hash of their characters, for many lookups at once."""

    _FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, found: dict[str, tuple[int, float]]):
        hashes = {p: int(self.hashed(np.array([list(map(ord, p))], np.uint64))[-1][0]) for p in found}
        if len(set(hashes.values())) < len(hashes):
            raise ValueError("two pieces have one hash")
        self.hashes = np.array([*hashes.values(), 0], np.uint64)
        self.ids = np.array([*(found[p][0] for p in hashes), -1], np.int32)
        self.weights = np.array([*(found[p][1] for p in hashes), 0.0])
        none = len(hashes)
        # Two tables of places; a piece that finds its place in the first one taken goes to the second.
        self.tables = [np.full(1 << 20, none, np.int32) for _ in range(2)]
        for i, h in enumerate(hashes.values()):
            spot = [t for t in (0, 1) if self.tables[t][self._place(h, t)] == none]
            if not spot:
                raise ValueError("no place for a piece")
            self.tables[spot[0]][self._place(h, spot[0])] = i

    @staticmethod
    def _place(h, table: int):
        return (h >> (44 if table == 0 else 20)) & ((1 << 20) - 1)

    @classmethod
    def hashed(cls, chars: np.ndarray) -> list[np.ndarray]:
        """Hashes of the first one, two, ... characters of each row."""
        out, h = [], np.full(len(chars), 0x27D4EB2F165667C5, np.uint64)
        for k in range(chars.shape[1]):
            h = (h ^ chars[:, k]) * cls._FACTOR
            h = h ^ (h >> np.uint64(32))
            out.append(h)
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of the piece with each hash; the last number, of weight 0, for none."""
        i = self.tables[0][(h >> np.uint64(44)).astype(np.int64)]
        odd = np.flatnonzero(self.hashes[i] != h)
        if len(odd):
            second = self.tables[1][((h[odd] >> np.uint64(20)) & np.uint64((1 << 20) - 1)).astype(np.int64)]
            i[odd] = np.where(self.hashes[second] == h[odd], second, len(self.hashes) - 1)
        return i


class Lattice:
    """The pieces of a model, and sampling of segmentations.

    Frequent chunks with few segmentations have them listed, each with its share of [0, 1). Other
    short chunks are sampled many at once, those with spelled characters one by one. All three do
    the same additions in the same order, so which one serves makes no difference.
    """

    def __init__(self, path: str, sharpness: float = 1.0):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        if n > 1 << 16:
            raise ValueError("ids must fit in two bytes")
        texts: dict[str, int] = {}
        self.raw: list[bytes] = [b""] * n  # what a piece decodes to
        self.byte = [0] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if piece.lstrip(_BLANK).find(_BLANK) >= 0 or "\n" in piece:
                    raise ValueError(f"piece {piece!r} crosses words")
                texts[piece.replace(_BLANK, " ")] = i
                self.raw[i] = piece.replace(_BLANK, " ").encode()
        order = sorted(texts, key=lambda p: (-model.get_score(texts[p]), texts[p]))
        self.longest = max(map(len, texts))
        self.pieces = {p: (texts[p], (place + 2.0) ** -sharpness) for place, p in enumerate(order)}
        self.begun = {p[:k] for p in order for k in range(1, len(p))}
        self.many = _Pieces(self.pieces)
        self.coded = [i.to_bytes(2, "little") for i in range(n)]
        self.met: dict[str, int] = {}
        # Listed chunks by number; bounds hold the number and a share's start in 32 bits each.
        self.listed: dict[str, int] = {}
        self.bounds, self.paths = np.zeros(0, np.uint64), np.zeros(0, object)

    # One chunk at a time.

    def _arrivals(self, chunk: str) -> list[list[tuple[float, int, bytes]]]:
        """For each place of a chunk, the pieces that end there: weight of all ways, start, id."""
        n, longest, get, coded = len(chunk), self.longest, self.pieces.get, self.coded
        ends: list[list] = [[] for _ in range(n + 1)]
        way = 1.0
        for i in range(n):
            if i:
                way = _added(ends[i])
                if way < 1e-100:  # only ratios count, so all that is still open is raised alike
                    for j in range(i + 1, min(n, i + longest) + 1):
                        ends[j] = [(e[0] * 1e100, e[1], e[2]) for e in ends[j]]
                    way *= 1e100
            whole = False
            for j in range(i + 1, min(n, i + longest) + 1):
                found = get(part := chunk[i:j])
                if found:
                    ends[j].append((way * found[1], i, coded[found[0]]))
                    whole = whole or j == i + 1
                elif part not in self.begun:
                    break
            if not whole:  # no piece for this character alone
                spelled = b"".join(coded[self.byte[b]] for b in chunk[i].encode("utf-8", "surrogatepass"))
                ends[i + 1].append((way * _SPELLED, i, spelled))
        return ends

    @staticmethod
    def _parts(arrivals: list[tuple], low: float, high: float) -> Iterator[tuple[float, float, int, bytes]]:
        """The share of [low, high) of each piece that ends at one place."""
        total, run, a = _added(arrivals), 0.0, low
        for weight, start, ids in arrivals:
            run += weight
            b = min(high, low + (high - low) * (run / total))
            yield a, b, start, ids
            a = b

    def sampled(self, chunk: str, u: float) -> bytes:
        ends, at, low, high, out = self._arrivals(chunk), len(chunk), 0.0, 1.0, []
        while at:
            for a, b, start, ids in self._parts(ends[at], low, high):  # noqa: B007
                if u < b:
                    break
            out.append(ids)
            at, low, high = start, a, b
        return b"".join(reversed(out))

    def sampled_long(self, chunk: str, number: int) -> bytes:
        ends, at, out = self._arrivals(chunk), len(chunk), []
        random = np.random.Generator(np.random.Philox(key=number)).random(len(chunk))
        while at:
            for _, b, start, ids in self._parts(ends[at], 0.0, 1.0):  # noqa: B007
                if random[at - 1] < b:
                    break
            out.append(ids)
            at = start
        return b"".join(reversed(out))

    def _listing(self, chunk: str) -> tuple[list[float], list[bytes]] | None:
        """All segmentations in the order in which `sampled` tells them apart, if they are few."""
        ends = self._arrivals(chunk)
        ways = [1] + [0] * len(chunk)
        for at in range(1, len(chunk) + 1):
            ways[at] = sum(ways[e[1]] for e in ends[at])
        if ways[-1] > _LISTED:
            return None
        bounds, paths = [], []
        open_ = [(0.0, 1.0, len(chunk), b"")]
        while open_:
            low, high, at, tail = open_.pop()
            if at:
                parts = list(self._parts(ends[at], low, high))
                open_.extend((a, b, start, ids + tail) for a, b, start, ids in reversed(parts) if a < b)
            else:
                bounds.append(low)
                paths.append(tail)
        return bounds, paths

    # Many chunks of one length at once.

    def sampled_many(self, chunks: list[str], which: np.ndarray, u: np.ndarray) -> list[bytes]:
        """A segmentation of chunks[which[k]] for each u[k]; all chunks have the same length."""
        n, m = len(chunks[0]), len(chunks)
        chars = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").reshape(m, n).astype(np.uint64)
        found = {}  # (start, end): the piece of each chunk there
        for i in range(n):
            for k, h in enumerate(self.many.hashed(chars[:, i : i + self.longest])):
                found[i, i + k + 1] = self.many.find(h)
        none = len(self.many.hashes) - 1
        spelled = np.zeros(m, bool)
        for i in range(n):
            spelled |= found[i, i + 1] == none
        ways = [np.ones(m)] + [np.zeros(m) for _ in range(n)]
        weight = {}
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                weight[i, j] = ways[i] * self.many.weights[found[i, j]]
                ways[j] = ways[j] + weight[i, j]
        # From the end on: all draws that stand at a place choose among the pieces that end there.
        at = np.full(len(which), n)
        low, high = np.zeros(len(which)), np.ones(len(which))
        out = np.full((len(which), n), -1, np.int32)
        for j in range(n, 0, -1):
            rows = np.flatnonzero(at == j)
            if not len(rows):
                continue
            chunk, draw, a0, b0 = which[rows], u[rows], low[rows], high[rows]
            total, run, a = ways[j][chunk], np.zeros(len(rows)), a0.copy()
            open_ = np.ones(len(rows), bool)
            for i in range(max(0, j - self.longest), j):
                w = weight[i, j][chunk]
                if not w.any():
                    continue
                run = run + w
                with np.errstate(invalid="ignore"):  # chunks with spelled characters, see below
                    b = np.minimum(b0, a0 + (b0 - a0) * (run / total))
                # The last piece takes what rounding may leave, as its share ends where all end.
                here = open_ & (w > 0)
                low[rows[here]], high[rows[here]], at[rows[here]] = a[here], b[here], i
                out[rows[here], :j] = -1
                out[rows[here], i] = self.many.ids[found[i, j][chunk[here]]]
                open_ &= ~(here & (draw < b))
                a = b
        raw = out[out >= 0].astype("<u2").tobytes()
        edges = (2 * np.concatenate(([0], np.cumsum((out >= 0).sum(1))))).tolist()
        made = [raw[x:y] for x, y in zip(edges, edges[1:], strict=False)]
        if spelled.any():
            for k in np.flatnonzero(spelled[which]).tolist():
                made[k] = self.sampled(chunks[which[k]], float(u[k]))
        return made

    def encode(self, texts: list[str], keys: list[str]) -> list[np.ndarray]:
        """A sampled segmentation of each text, the same for the same text and key."""
        chunks, edges, numbers = [], [0], []
        for text, key in zip(texts, keys, strict=True):
            chunks += _CHUNK.findall(text)
            edges.append(len(chunks))
            random = np.random.Generator(np.random.Philox(key=xxhash.xxh3_64_intdigest(key)))
            numbers.append(random.integers(0, 1 << 32, edges[-1] - edges[-2], np.uint64))
        number = np.concatenate(numbers) if numbers else np.zeros(0, np.uint64)
        out = np.empty(len(chunks), object)
        code = np.fromiter(map(self.listed.get, chunks, repeat(-1)), np.int64, len(chunks))
        known = np.flatnonzero(code >= 0)
        shared = (code[known].astype(np.uint64) << np.uint64(32)) | number[known]
        out[known] = self.paths[np.searchsorted(self.bounds, shared, "right") - 1]
        waiting: dict[int, list[int]] = {}
        for k in np.flatnonzero(code < 0).tolist():
            waiting.setdefault(len(chunks[k]), []).append(k)
        new: list[tuple[str, int]] = []
        for size, at in waiting.items():
            if size > _SHORT:
                for k in at:
                    out[k] = self.sampled_long(chunks[k], int(number[k]))
                continue
            place: dict[str, int] = {}
            which = np.array([place.setdefault(chunks[k], len(place)) for k in at])
            made = self.sampled_many(list(place), which, number[at] / 2.0**32)
            for k, ids in zip(at, made, strict=True):
                out[k] = ids
            new += zip(place, np.bincount(which).tolist(), strict=True)
        self._count(new)
        parts = out.tolist()
        return [np.frombuffer(b"".join(parts[a:b]), "<u2") for a, b in zip(edges, edges[1:], strict=False)]

    def _count(self, chunks: list[tuple[str, int]]) -> None:
        """Count chunks that had no listing, and list those that have become frequent."""
        met = self.met
        if len(met) > 4 * _CACHED:
            met.clear()
        bounds, paths = [], []
        for chunk, n in chunks:
            met[chunk] = n = met.get(chunk, 0) + n
            if n >= _FREQUENT and len(self.listed) < _CACHED:
                if listing := self._listing(chunk):
                    base = len(self.listed) << 32
                    bounds += [base + math.ceil(x * 2.0**32) for x in listing[0]]
                    paths += listing[1]
                    self.listed[chunk] = len(self.listed)
                met[chunk] = -(1 << 60)  # tried once
        if bounds:
            self.bounds = np.concatenate((self.bounds, np.array(bounds, np.uint64)))
            self.paths = np.concatenate((self.paths, np.array(paths, object)))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")


def _added(arrivals: list[tuple]) -> float:
    """Weights added from the first on, each sum rounded, as arrays are added."""
    total = 0.0
    for e in arrivals:
        total += e[0]
    return total


@cache
def _lattice(path: str, sharpness: float) -> Lattice:
    """One a worker process, so that its listings serve all the worker's tasks."""
    return Lattice(path, sharpness)


def sampled_pieces(
    docs: DataFrame,
    model: str,
    seed: int = 0,
    sharpness: float = 1.0,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`docs` with `n_pieces`, `ids_crc32` (of the ids as 32-bit numbers), `decoded_sha256` of what
    the ids decode to, `lossless` (whether that is the text) and, if asked for, the `ids`.

    Input columns named like an added one are replaced.
    """
    reach_workers(docs.sparkSession)
    added = {"n_pieces": "long", "ids_crc32": "long", "decoded_sha256": "string", "lossless": "boolean"}
    if with_ids:
        added["ids"] = "array<int>"
    rest = docs.drop(*[c for c in added if c in docs.columns])
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model, sharpness)
        for whole in batches:
            for at, to in byte_ranges(whole.column(names.index(text_col)), 0, whole.num_rows, _TOGETHER):
                batch = whole.slice(at, to - at)
                keys, texts = (batch.column(names.index(c)).to_pylist() for c in (id_col, text_col))
                texts = [t or "" for t in texts]
                out: list[list] = [[] for _ in added]
                for text, ids in zip(texts, lattice.encode(texts, [f"{seed}:{k}" for k in keys]), strict=True):
                    decoded = lattice.decode(ids)
                    digest = hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()
                    row = (len(ids), zlib.crc32(ids.astype("<u4").tobytes()), digest, decoded == text, ids.astype(np.int32))
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
                types = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32())]
                made = [pa.array(c, t) for c, t in zip(out, types, strict=False)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, *added])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema] + [f"{n} {t}" for n, t in added.items()])
    return rest.mapInArrow(run, schema)
