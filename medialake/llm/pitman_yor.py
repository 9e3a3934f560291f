"""LM scoring with a hierarchical Pitman-Yor model of words.

Every context is a restaurant of its own: the word before, known by a hash of 32 bits, or only its last
`context_bytes` bytes. All share one parent, the restaurant of the words without context, whose base
is uniform over the words seen and one unknown word. A word's tables in the contexts are its customers
in the parent.

Seating is sampled by Gibbs sweeps. A sweep reseats the customers of every word in every restaurant,
one after another, each at an old table or a new one by its probability given those already seated
and the parent as the last sweep left it; then the parent is reseated from the new tables. Beyond
16 customers of a word they are reseated in steps of an eighth of those seated, each step one
binomial draw. Predictive probabilities are averaged over the sweeps kept.

How the work is dealt: documents are packed into blocks, each with its distinct (word, context) pairs
and its tokens as numbers of these pairs. Pairs go to buckets by a hash of the word, one row for each
block and bucket. So a bucket has all contexts of its words, whatever their share of the text, and a
word is there once for each block. What buckets share are the totals of each context: a first pass over
the buckets sends each bucket's share to parts, by ranges of contexts, where shares are added up; the
sums go back to the buckets that asked, and a second pass keeps them fixed while it samples. The few
totals of the whole model travel with them. Then each block gets the probabilities of its pairs back.

Special cases: a null text is empty and has the end token alone. A null id belongs to the training
documents. Rows that share an id are separate rows. An empty table gives no row. Input columns other
than id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import dealt, words_of

_START = 32  # the context of a first word: a blank, which no word ends in
_BLOCK_SIZE = 8 << 20  # characters
_DOCS = -1  # the bucket of a block's documents
_CONTEXT = 2**32 - 1  # the bits of a pair that are its context


def held_out(doc_id: int | None) -> bool:
    """Every seventh document or so, by its id, is kept from training."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and bytes behind their lengths, compressed."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], "<u8").tobytes()
    return zstandard.ZstdCompressor(1).compress(head + b"".join(parts))


def _unpacked(raw: bytes) -> list[memoryview]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(raw))
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    edges = np.cumsum(np.frombuffer(raw, "<u8", n, 8)).tolist()
    at = 8 * (n + 1)
    return [raw[at + a : at + b] for a, b in zip([0, *edges], edges, strict=False)]


def _planes(x: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, which pack better than the numbers do."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(raw: memoryview, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _steps(x: np.ndarray) -> bytes:
    """Rising numbers of 32 bits, or runs of such, by their differences."""
    return _planes(np.diff(x.astype("<u4"), prepend=np.zeros(1, "<u4")))


def _from_steps(raw: memoryview) -> np.ndarray:
    return np.cumsum(_numbers(raw, "<u4"), dtype=np.uint32)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and the place of each number among them."""
    order = np.argsort(x, kind="stable")
    x = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    place = np.empty(len(x), "<u4")
    place[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return x[new], place


class _Words(dict):
    """Numbers of words by first sight, and the context that each makes. The end token is number 0."""

    def __init__(self, context_bytes: int):
        super().__init__()
        self.context_bytes, self.contexts = context_bytes, []
        self[b""]  # noqa: B018

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.contexts.append(self.context_of(word) if word else _START)
        return n

    def context_of(self, word: bytes) -> int:
        return int.from_bytes(word[-self.context_bytes :]) if self.context_bytes else xxhash.xxh32_intdigest(word)


class _Block:
    def __init__(self, context_bytes: int):
        self.words = _Words(context_bytes)
        self.ids, self.null, self.tokens, self.size = [], [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = words_of(text)
        self.ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.tokens.append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))
        self.size += len(text or "")

    def rows(self, n_buckets: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, payload) of the documents and of the pairs of each bucket."""
        n_tokens = np.array([len(t) + 1 for t in self.tokens])
        last = np.cumsum(n_tokens) - 1
        word = np.zeros(int(last[-1]) + 1, np.int64)
        inner = np.ones(len(word), bool)
        inner[last] = False
        word[inner] = np.concatenate(self.tokens)
        self.tokens.clear()
        made = np.array(self.words.contexts, np.int64)
        before = np.empty(len(word), np.int64)
        before[1:] = made[word[:-1]]
        before[0], before[last[:-1] + 1] = _START, _START
        # Words are numbered anew in the order of their buckets, pairs in the order of their words.
        names = list(self.words)
        self.words.clear()
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % n_buckets for w in names), np.int64, len(names))
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        word = rank[word]
        word <<= 32
        word |= before
        del before, inner
        pair, token = _distinct(word)
        del word
        out = np.array([held_out(None if none else i) for i, none in zip(self.ids, self.null, strict=True)])
        count = np.bincount(token[~np.repeat(out, n_tokens)], minlength=len(pair))
        yield _DOCS, _packed(
            np.array(self.ids, "<i8"), np.array(self.null), out, n_tokens.astype("<u4"), _planes(token)
        )
        del token
        of_word, context = pair >> 32, (pair & _CONTEXT).astype("<u4")
        per_word = np.bincount(of_word, minlength=len(names)).astype("<u4")
        edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        pair_edges = np.cumsum(np.append(0, per_word.astype(np.int64)))[edges]
        for b in range(n_buckets):
            x, y, p, q = edges[b], edges[b + 1], pair_edges[b], pair_edges[b + 1]
            if x < y:
                text = b" ".join(names[i] for i in order[x:y].tolist())
                yield b, _packed(text, per_word[x:y], _steps(context[p:q]), count[p:q].astype("<u4"))


def blocks(docs: DataFrame, n_buckets: int, context_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """`block`, `bucket`, `payload`: the documents of each block, and its pairs by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, block = TaskContext.get().partitionId(), 0, _Block(context_bytes)

        def done() -> pa.RecordBatch:
            bucket, payload = zip(*block.rows(n_buckets), strict=True)
            name = pa.array([f"{part}-{n}"] * len(bucket))
            return pa.RecordBatch.from_arrays([name, pa.array(bucket, pa.int32()), pa.array(payload)], ["block", "bucket", "payload"])

        for batch in batches:
            for d, t in zip(*batch.columns, strict=True):
                block.add(d.as_py(), t.as_py())
                if block.size >= _BLOCK_SIZE:
                    yield done()
                    n, block = n + 1, _Block(context_bytes)
        if block.ids:
            yield done()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "block string, bucket int, payload binary")


class _Bucket:
    """The pairs of one bucket, from all blocks."""

    def __init__(self, payloads: list[bytes]):
        number: dict[bytes, int] = {}
        pairs, counts = [], []
        for raw in payloads:
            text, per_word, context, count = _unpacked(raw)
            per_word = np.frombuffer(per_word, "<u4")
            names = bytes(text).split(b" ")
            words = np.fromiter((number.setdefault(w, len(number)) for w in names), np.int64, len(names))
            pair = np.repeat(words << 32, per_word)
            pair |= _from_steps(context)
            pairs.append(pair)
            counts.append(np.frombuffer(bytes(count), "<u4"))
        edges = np.cumsum([len(x) for x in pairs])[:-1]
        joined = np.concatenate(pairs)
        del pairs[:], pair
        self.pair, at = _distinct(joined)
        del joined
        self.placed = np.split(at, edges)  # for each payload: the places of its pairs
        # Sums of whole numbers far below 2 ** 53, so the order of the blocks makes no difference.
        self.count = np.bincount(at, np.concatenate(counts), len(self.pair)).astype(np.int64)
        self.word, self.context = self.pair >> 32, self.pair & _CONTEXT
        self.n_words = len(number)
        self.word_count = np.bincount(self.word, self.count, self.n_words).astype(np.int64)
        self.names = list(number)

    def numbered(self) -> np.ndarray:
        """The bucket's contexts in order; from now on they are known by their places there."""
        found, self.context = _distinct(self.context)
        del self.pair
        return found


def seated(random: np.random.Generator, customers: np.ndarray, new: np.ndarray, discount: float) -> np.ndarray:
    """Tables of each word, for its customers and the mass of a new table; no customer, no table."""
    tables = np.minimum(customers, 1)
    open_ = np.flatnonzero(customers > 1)
    n = 1
    while len(open_):
        step = max(1, n // 8)
        t, mass = tables[open_], new[open_]
        chance = mass / (mass + n - discount * t)
        if step == 1:
            tables[open_] = t + (random.random(len(open_)) < chance)
        else:
            tables[open_] = t + random.binomial(np.minimum(step, customers[open_] - n), chance)
        n += step
        open_ = open_[customers[open_] > n]
    return tables


class Totals:
    """What buckets share: by context customers and tables, the parent's, training tokens and words."""

    def __init__(self, customers, tables, parent: tuple[float, float], tokens: float, words: float, discounts, strength: float):
        self.customers, self.tables, self.parent = customers, tables, parent
        self.tokens, self.words, self.discounts, self.strength = tokens, words, discounts, strength

    @staticmethod
    def discount(once: float, twice: float) -> float:
        """The usual estimate from how many pairs were seen once and twice."""
        return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def _sweeps(bucket: _Bucket, totals: Totals, n: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gibbs sweeps; after each, the tables of pairs and of words and the words' parent probabilities."""
    # Words come in no fixed order, so draws are made in the order of the words themselves.
    order = sorted(range(bucket.n_words), key=bucket.names.__getitem__)
    rank = np.empty(bucket.n_words, np.int64)
    rank[order] = np.arange(bucket.n_words)
    sorted_pairs = np.lexsort((bucket.context, rank[bucket.word]))
    word, context, count = rank[bucket.word][sorted_pairs], bucket.context[sorted_pairs], bucket.count[sorted_pairs]
    random = np.random.Generator(np.random.Philox(key=seed))
    theta, (low, high) = totals.strength, totals.discounts
    new_mass = theta + high * totals.tables[context]
    parent_new = (theta + low * totals.parent[1]) / (totals.words + 1)
    p = np.full(bucket.n_words, 1 / (totals.words + 1))
    for _ in range(n):
        tables = seated(random, count, new_mass * p[word], high)
        customers = np.bincount(word, tables, bucket.n_words).astype(np.int64)
        parent_tables = seated(random, customers, np.full(bucket.n_words, parent_new), low)
        p = (customers - low * parent_tables + parent_new) / (theta + totals.parent[0])
        back = np.empty(len(tables), np.int64)
        back[sorted_pairs] = tables
        yield back, parent_tables[rank], p[rank]


def _sums(
    bucket: _Bucket, n_buckets: int, n_contexts: int, strength: float, burn_in: int, seed: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's share of the totals, sampled with its own share of the corpus taken for the rest.

    By context: customers and tables. Then, for the model: tokens and words, the parent's customers and
    tables, the pairs with one customer and with two, the parent's words with one and with two.
    """
    own = np.bincount(bucket.context, bucket.count, n_contexts)
    n_words = int((bucket.word_count > 0).sum())
    seen = bucket.count > 0
    once, twice = int((bucket.count == 1).sum()), int((bucket.count == 2).sum())
    kinds = np.bincount(bucket.word[seen], minlength=bucket.n_words)  # contexts of each word
    once_1, twice_1 = int((kinds == 1).sum()), int((kinds == 2).sum())
    totals = Totals(
        own * n_buckets,
        np.bincount(bucket.context[seen], minlength=n_contexts) * float(n_buckets),
        (float(seen.sum()) * n_buckets, n_words * n_buckets),
        float(bucket.count.sum()) * n_buckets,
        n_words * n_buckets,
        (Totals.discount(once_1, twice_1), Totals.discount(once, twice)),
        strength,
    )
    for tables, parent_tables, _ in _sweeps(bucket, totals, burn_in, seed):  # noqa: B007
        pass
    by_context = np.bincount(bucket.context, tables, n_contexts)
    model = [bucket.count.sum(), n_words, tables.sum(), parent_tables.sum(), once, twice, once_1, twice_1]
    return own.astype("<u8"), by_context.astype("<u8"), np.array(model, "<i8")


def _added(shares: list[bytes]) -> list[bytes]:
    """For each bucket's share of a part of the contexts: the totals of its contexts and of the model."""
    got = [_unpacked(x) for x in shares]
    contexts = [_from_steps(x[0]) for x in got]
    found, at = np.unique(np.concatenate(contexts), return_inverse=True)
    # Sums of whole numbers far below 2 ** 53, so the order of the buckets makes no difference.
    sums = [np.bincount(at, np.concatenate([_numbers(x[k], "<u8") for x in got]), len(found)).astype("<u8") for k in (1, 2)]
    model = np.sum([np.frombuffer(x[3], "<i8") for x in got], axis=0).astype("<i8")
    edges = np.cumsum([0, *map(len, contexts)])
    return [_packed(*[_planes(x[at[a:b]]) for x in sums], model) for a, b in zip(edges, edges[1:], strict=False)]


def _answers(bucket: _Bucket, totals: Totals, burn_in: int, samples: int, seed: int) -> list[bytes]:
    """For each payload: the training count of each of its words' pairs, log10 probabilities, and the
    training tokens and words."""
    theta, (_, high) = totals.strength, totals.discounts
    reached = theta + totals.customers[bucket.context]
    mean = np.zeros(len(bucket.count))
    for k, (tables, _, p) in enumerate(_sweeps(bucket, totals, burn_in + samples, seed)):
        if k >= burn_in:
            share = bucket.count - high * tables + (theta + high * totals.tables[bucket.context]) * p[bucket.word]
            mean += share / reached
    logs = np.log10(mean / samples)
    out = []
    for at in bucket.placed:
        counts = bucket.word_count[bucket.word[at]].astype("<u8")
        out.append(_packed(_planes(counts), _planes(logs[at].astype("<f4")), np.array([totals.tokens, totals.words], "<i8")))
    return out


def scored(
    docs: DataFrame,
    context_bytes: int = 0,
    burn_in: int = 3,
    samples: int = 4,
    strength: float = 1.0,
    seed: int = 6,
    bucket_bytes: int = 8 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score`.

    `score` is the model's log10 probability of the text, `base_score` that of add-one counts; a
    token is known if it was seen in training. There is a bucket for each `bucket_bytes` of text.
    Contexts are whole words, or their last one or two bytes where `context_bytes` says so.
    """
    if context_bytes not in (0, 1, 2):
        raise ValueError("contexts are whole words, one byte or two")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_buckets = max(8, math.ceil(size / bucket_bytes))
    n_parts = 1 if context_bytes else n_buckets // 2
    # The documents' blocks are stored dealt by their names, so their answers come to them.
    n_files = max(8, n_buckets // 2)
    packed = dealt(blocks(docs, n_buckets, context_bytes, id_col, text_col), "lm-blocks", n_files, "block")
    pairs = packed.where(F.col("bucket") >= 0)

    def first(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = _Bucket(rows.column("payload").to_pylist())
        known = bucket.numbered()
        own, tables, model = _sums(bucket, n_buckets, len(known), strength, burn_in, seed + (key[0].as_py() << 32))
        edges = np.searchsorted(known, [-(-(q << 32) // n_parts) for q in range(n_parts + 1)])
        # Each part gets the bucket's share of the model's totals, also if it has none of its contexts.
        shares = [
            _packed(_steps(known[a:b]), _planes(own[a:b]), _planes(tables[a:b]), model)
            for a, b in zip(edges, edges[1:], strict=False)
        ]
        bucket_of = pa.array([key[0].as_py()] * n_parts, pa.int32())
        return pa.table({"part": pa.array(range(n_parts), pa.int32()), "bucket": bucket_of, "share": pa.array(shares, pa.binary())})

    def added(key: tuple, rows: pa.Table) -> pa.Table:  # noqa: ARG001
        sums = _added(rows.column("share").to_pylist())
        return pa.table({"part": rows.column("part"), "bucket": rows.column("bucket"), "share": pa.array(sums, pa.binary())})

    kind = "part int, bucket int, share binary"
    sums = pairs.groupBy("bucket").applyInArrow(first, kind).groupBy("part").applyInArrow(added, kind)

    def second(key: tuple, rows: pa.Table, shares: pa.Table) -> pa.Table:
        bucket = _Bucket(rows.column("payload").to_pylist())
        bucket.numbered()
        got = [_unpacked(x) for x in shares.sort_by("part").column("share").to_pylist()]
        customers, tables = (np.concatenate([_numbers(x[k], "<u8") for x in got]).astype(float) for k in (0, 1))
        tokens, words, *parent, once, twice, once_1, twice_1 = np.frombuffer(got[0][2], "<i8").tolist()
        discounts = (Totals.discount(once_1, twice_1), Totals.discount(once, twice))
        totals = Totals(customers, tables, tuple(parent), tokens, words, discounts, strength)
        answers = _answers(bucket, totals, burn_in, samples, seed + (key[0].as_py() << 32) + (1 << 62))
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "answer": pa.array(answers, pa.binary())})

    both = pairs.groupBy("bucket").cogroup(sums.groupBy("bucket"))
    answers = both.applyInArrow(second, "block string, bucket int, answer binary")
    by_block = answers.repartition(n_files, "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "answer"))).alias("answers"))
    whole = packed.where(F.col("bucket") == _DOCS).join(by_block, "block").select("payload", "answers.answer")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, parts in zip(*batch.columns, strict=True):
                ids, null, out, n_tokens, token = _unpacked(payload.as_py())
                got = [_unpacked(p.as_py()) for p in parts]
                count = np.concatenate([_numbers(x[0], "<u8") for x in got]).astype(float)
                logs = np.concatenate([_numbers(x[1], "<f4") for x in got]).astype(float)
                n_train, n_words = np.frombuffer(got[0][2], "<i8").tolist()
                least = math.log10(n_train + n_words + 1)
                token, n_tokens = _numbers(token, "<u4"), np.frombuffer(n_tokens, "<u4").astype(np.int64)
                starts = np.cumsum(n_tokens) - n_tokens
                base = np.log10(count + 1) - least
                columns = [
                    pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(null, bool)),
                    pa.array(np.frombuffer(out, bool)),
                    pa.array(n_tokens),
                    pa.array(np.add.reduceat((count > 0)[token].astype(np.int64), starts)),
                    pa.array(np.full(len(n_tokens), n_train)),
                    pa.array(np.add.reduceat(base[token], starts)),
                    pa.array(np.add.reduceat(logs[token], starts)),
                ]
                names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return whole.mapInArrow(
        score,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def perplexity(scores: DataFrame) -> DataFrame:
    """`held_out`, `perplexity` and `base_perplexity` over the tokens of either part."""

    def of(c: str):
        return F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))

    return scores.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))
