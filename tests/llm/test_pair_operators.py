"""Tokenizer alignment, the n-gram Jaccard join and the filter audit against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from medialake.llm import alignment, filter_audit, jaccard_join
from tests.conftest import SMALL
from tests.llm import plain
from tests.llm.conftest import messy_rows, prose

ROWS = messy_rows()
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a  b \n\n c ", "\n x", "a▁b ok", "<|endoftext|> <s> <0x41> x", "日本語 テスト😀  foo\tbar  ",
       "a" * 5000, " lead", "trail ", "x y z　q  \x1c r", "\x00 a", "don't  we'll it's\n'll", "é ́ x", "ab " * 400]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def documents():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# 11 alignment

ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_query(spark, documents, libraries):
    got = {r.doc_id: tuple(r[c] for c in ALIGNED) for r in entry.queries()["op11_tokenizer_alignment"](spark, SMALL).collect()}
    want = plain.alignment([t for _, t in documents], *libraries)
    assert got == {d: w for (d, _), w in zip(documents, want, strict=True)}


def test_alignment_on_messy_rows(spark, messy, libraries, monkeypatch):
    """Many small blocks and parts, rows repeated, columns that clash."""
    monkeypatch.setattr(alignment, "_DOCS", 5)
    monkeypatch.setattr(alignment, "_PART", 64)
    got = alignment.aligned(messy, A, B)
    assert got.columns == ["doc_id", *ALIGNED]
    want = plain.alignment([t for _, t in ROWS], *libraries)
    assert Counter(map(tuple, got.collect())) == Counter((d, *w) for (d, _), w in zip(ROWS, want, strict=True))


def test_alignment_of_odd_texts(spark, libraries):
    rows = list(enumerate(ODD))
    want = plain.alignment(ODD, *libraries)
    assert sum(w[0] == 0 for w in want) == 3  # null, empty, and the one with a literal U+2581
    got = alignment.aligned(docs_of(spark, rows).repartition(3), A, B)
    assert sorted(map(tuple, got.collect())) == [(d, *w) for (d, _), w in zip(rows, want, strict=True)]


def test_alignment_of_long_groups(libraries, monkeypatch):
    """Groups are paired by distinct ids where they are long."""
    monkeypatch.setattr(alignment, "_LISTED", 2)
    texts = [t for t in ODD if t] + [prose(200, 3)]
    aligner = alignment.Aligner(alignment.ByteLevel(A), alignment.Pieces(B))
    counts, hashes, pair, text, links = aligner.encode(pa.array(texts, pa.large_string()))
    want = plain.alignment(texts, *libraries)
    assert [(*c, h) for c, h in zip(counts.tolist(), hashes, strict=True)] == [(*w[:4], w[6]) for w in want]
    assert np.bincount(text, links, len(texts)).tolist() == [w[3] for w in want]


def test_alignment_forgets(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "_CACHED", 10)
    aligner = alignment.Aligner(alignment.ByteLevel(A), alignment.Pieces(B))
    texts = [prose(80, k) for k in range(4)]
    want = plain.alignment(texts, *libraries)
    for t, w in zip(texts, want, strict=True):
        counts, hashes, *_ = aligner.encode(pa.array([t], pa.large_string()))
        assert (*counts[0].tolist(), hashes[0]) == (*w[:4], w[6])


@pytest.mark.parametrize("n_docs", [1, 7, 8, 300, 5000])
def test_postings_round_trip(n_docs):
    r = np.random.default_rng(n_docs)
    held = [np.sort(r.choice(n_docs, r.integers(1, n_docs + 1), replace=False)) for _ in range(20)]
    held += [np.array([n_docs - 1]), np.arange(n_docs)]
    pair = np.repeat(np.arange(len(held)) * 7 << 32, [len(h) for h in held])
    doc, links = np.concatenate(held), r.integers(1, 1 << 40, sum(map(len, held)))
    pairs, size, packed = alignment.pack_postings(pair, doc, links, n_docs)
    back = alignment.unpack_postings(packed)
    assert (pairs == np.unique(pair)).all() and (size == [len(h) for h in held]).all()
    assert all((x == y).all() for x, y in zip(back, (size, doc, links), strict=True))


def test_alignment_of_nothing(spark, no_rows):
    assert alignment.aligned(no_rows, A, B).count() == 0


# 12 Jaccard join


def edited(text, n, r):
    w = text.split()
    for k in r.sample(range(len(w)), n):
        w[k] = w[k] + "x"
    return " ".join(w)


def test_jaccard_query(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in entry.queries()["op12_signature_tree_join"](spark, SMALL).collect()}
    assert got == {d: w for (d, _), w in zip(documents, plain.similar_sets(documents), strict=True)}


def test_jaccard_on_messy_rows(spark, messy):
    got = jaccard_join.similar_documents(messy)
    assert Counter(map(tuple, got.collect())) == Counter((d, *w) for (d, _), w in zip(ROWS, plain.similar_sets(ROWS), strict=True))


def test_jaccard_groups_in_many_tiles(spark, monkeypatch):
    """Copies with few and with many edits, a passage in all texts, and sets of one to eight shingles."""
    monkeypatch.setattr(jaccard_join, "_TILE", 7)
    monkeypatch.setattr(jaccard_join, "_TILE_SHINGLES", 900)
    r, rows, shared = random.Random(5), [], prose(60, 99)
    for k in range(6):
        base = prose(140, k) + " " + shared
        rows += [edited(base, r.choice([0, 1, 2, 3, 5, 8]), r) for _ in range(9)]
    rows += [prose(r.randint(1, 10), k % 4) for k in range(20)]
    rows += ["A B c", "a b\tC", "x y", "X y", None, ""]
    rows = list(enumerate(rows))
    r.shuffle(rows)
    want = plain.similar_sets(rows)
    assert 10 < len({w[1] for w in want}) < 70
    got = jaccard_join.similar_documents(docs_of(spark, rows).repartition(4))
    assert sorted(map(tuple, got.collect())) == sorted((d, *w) for (d, _), w in zip(rows, want, strict=True))


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_walk_leaves_no_pair_in_reach(percent):
    r = np.random.default_rng(percent)
    pool = r.integers(0, 1 << 64, 400, dtype=np.uint64)
    sets = []
    for _ in range(60):
        base = r.choice(pool, r.integers(1, 120), replace=False)
        sets += [np.unique(np.append(base[: len(base) - r.integers(0, 1 + len(base) // 9)], r.choice(pool, r.integers(0, 4)))) for _ in range(3)]
    bitmaps, sizes = [jaccard_join.signature(s).tobytes() for s in sets], np.array(list(map(len, sets)))
    tree = jaccard_join.SignatureTree(jaccard_join._folded(bitmaps), sizes)
    left = {(i, j) for x, y in jaccard_join.walk(tree, None, percent) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert all(i < j for i, j in left)
    alike = {
        (i, j)
        for j in range(len(sets))
        for i in range(j)
        if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))
    }
    assert alike <= left and len(left) < len(sets) * (len(sets) - 1) / 2
    cut = len(sets) // 3
    halves = [jaccard_join.SignatureTree(jaccard_join._folded(bitmaps)[p], sizes[p]) for p in (slice(cut), slice(cut, None))]
    left = {(i, j + cut) for x, y in jaccard_join.walk(*halves, percent) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert {(i, j) for i, j in alike if i < cut <= j} <= left
    # With the shingles, the forest reaches exactly what the links reach.
    i, j = jaccard_join.joined(bitmaps, sizes, np.arange(len(sets)) < 0, percent, sets)
    assert plain.components(len(sets), zip(i, j, strict=True)) == plain.components(len(sets), alike)


@pytest.mark.parametrize("percent", [80, 90])
def test_prefix_holds_a_shared_hash(percent):
    """The least hashes of two sets at the very edge of reach have one in common."""
    for n in range(1, 200):
        need = -(-percent * n // 100)  # a set within this one, as small as reach allows
        for shared in (1, jaccard_join.least_shared(n, percent)):
            # If the other set lacks the least hashes, the prefix still holds `shared` of its own.
            assert 1 <= shared <= need
            assert min(jaccard_join.prefix_length(n, percent, shared), n) - (n - need) >= shared


def test_jaccard_of_nothing(spark, no_rows):
    assert jaccard_join.similar_documents(no_rows).count() == 0


# 13 filter audit


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_on_messy_rows(spark, messy, labels, monkeypatch):
    monkeypatch.setattr(filter_audit, "_BLOCK", 2000)
    part = F.when(F.col("doc_id") > 5, "late").when(F.col("doc_id") > 2, "")
    got = filter_audit.filter_audit(messy, labels, part)
    rows = [(d, "late" if d is not None and d > 5 else None, t) for d, t in ROWS]
    want = plain.filter_audit(rows, [tuple(r) for r in labels.collect()])
    found = got.select(*AUDIT).collect()
    assert len(found) == 2 * 600 and {tuple(r) for r in found} == want


def test_audit_of_a_hot_text(spark, labels):
    """A third of the rows is one text, another third one id and text; both labels and parts are null."""
    rows = [(k, "same text " * 120) for k in range(60)] + [(7, "A B #")] * 60 + [(k, prose(210 + k, k)) for k in range(60)]
    docs = docs_of(spark, rows).repartition(5)
    got = filter_audit.filter_audit(docs, labels, F.lit(None).cast("string"))
    want = plain.filter_audit([(d, None, t) for d, t in rows], [tuple(r) for r in labels.collect()])
    assert {tuple(r) for r in got.select(*AUDIT).collect()} == want


@pytest.mark.parametrize("bucket", [1 << 20, 50])
def test_csr_shards(spark, messy, monkeypatch, bucket):
    """Shards give back every document's counted words; one word has one number everywhere."""
    monkeypatch.setattr(filter_audit, "_BUCKET", bucket)
    shards = filter_audit.document_terms(messy.repartition(4), F.lit("p")).collect()
    rows, columns, counts = [], [], []
    for s in shards:
        indptr, column, count = filter_audit.unpack_csr(s.matrix)
        for k, r in enumerate(s.rows):
            rows.append(r.doc_id)
            columns.append(column[indptr[k] : indptr[k + 1]].tolist())
            counts.append(count[indptr[k] : indptr[k + 1]].tolist())
    assert all(c == sorted(set(c)) for c in columns)
    words = [Counter(plain.WORD.findall(t or "")) for _, t in ROWS]
    want = Counter((d, tuple(sorted(w.values()))) for (d, _), w in zip(ROWS, words, strict=True))
    assert Counter((d, tuple(sorted(c))) for d, c in zip(rows, counts, strict=True)) == want
    assert len({c for row in columns for c in row}) == len(set().union(*words))
    numbers = {}
    for d, c in zip(rows, columns, strict=True):
        numbers.setdefault(d, set()).update(c)
    of = {d: {w for (e, _), c in zip(ROWS, words, strict=True) if e == d for w in c} for d in (7, 8)}
    assert len(numbers[7] & numbers[8]) == len(of[7] & of[8]) > 100


def test_audit_does_not_broadcast_copies_of_labels(spark, tmp_path):
    """However small the file of labels is; the lookup has sixteen rows for each of its rows."""
    docs = docs_of(spark, [(k, f"a b {k}") for k in range(50)])
    path = str(tmp_path / "labels")
    spark.range(50).selectExpr("id as doc_id", "1 as quality", "0 as toxic").write.parquet(path)
    out = filter_audit.filter_audit(docs, spark.read.parquet(path), F.lit("x"))
    out.collect()
    joins = re.findall(r"(\w+Join)(?:\(skew=true\))? \[doc_id#", out._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}


def test_audit_of_nothing(spark, no_rows, labels):
    assert filter_audit.filter_audit(no_rows, labels, F.lit("x")).count() == 0
    none = labels.where("false")
    docs = docs_of(spark, [(1, "a b"), (None, None)])
    got = {tuple(r) for r in filter_audit.filter_audit(docs, none, F.lit("x")).select(*AUDIT).collect()}
    assert got == plain.filter_audit([(1, "x", "a b"), (None, "x", None)], [])
