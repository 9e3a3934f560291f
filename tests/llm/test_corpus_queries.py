"""The registered corpus queries over whole small tables, and the pipeline against a plain version."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from medialake.llm import queries, simhash
from tests.conftest import SMALL
from tests.llm import plain
from tools.check import duck
from tools.check import rows as multiset

NATIVE = ["op1_secret_ownership", "op4_histogram_sort_sharding", "op5_quality_rules"]


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}


def result(spark, name):
    return {r.doc_id: r for r in entry.queries()[name](spark, SMALL).collect()}


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    df = entry.queries()[name](spark, SMALL)
    cur = duck(SMALL).execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert multiset(df.columns, [tuple(r) for r in df.collect()]) == multiset(columns, cur.fetchall())


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, name):
    df = entry.queries()[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if w in plan]


def test_op2(spark, texts):
    got = result(spark, "op2_suffix_dedup")
    for (d, _), w in zip(texts.items(), plain.uncovered(texts.values(), 400), strict=True):
        assert tuple(got[d])[1:] == (*w[:3], plain.sha(w[3]))


def test_op3(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, start = result(spark, "op3_token_files"), 0
    for d in sorted(texts):
        ids = np.array([*library.encode(texts[d], add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got[d]) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op4(spark, texts):
    got = result(spark, "op4_histogram_sort_sharding")
    slots, sizes = defaultdict(list), Counter()
    for d, t in texts.items():
        r, raw = got[d], t.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    longest = max(len(t.encode()) + 1 for t in texts.values())
    assert sorted(slots) == list(range(16)) and max(sizes.values()) - min(sizes.values()) <= 2 * longest


def test_op5(spark, texts):
    got = result(spark, "op5_quality_rules")
    for d, t in texts.items():
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain.base_counts(t)
    labels = pq.read_table(f"{SMALL}/labels.parquet").to_pylist()
    good = [r["doc_id"] for r in labels if r["quality"] == 1 and not got[r["doc_id"]].base_failed]
    assert all(got[d].kept for d in good)


def test_op6(spark, texts):
    got = result(spark, "op6_pitman_yor_scores")
    words = {d: [*plain.words(t), ""] for d, t in texts.items()}
    counts = Counter(w for d, ws in words.items() if not plain.held_out(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in words.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (plain.held_out(d), len(ws), n)
        assert r.n_known == sum(counts[w] > 0 for w in ws)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_op7(spark, texts):
    got = result(spark, "op7_sentencepiece_sampling")
    assert all(r.lossless and r.decoded_sha256 == plain.sha(texts[d]) for d, r in got.items())


def test_op9(spark, texts):
    got, ids = result(spark, "op9_simhash_near_dedup"), list(texts)
    fps = [plain.simhash(texts[d], 3) for d in ids]
    n = len(ids)
    group = plain.components(n, [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = [min(ids[i] for i in range(n) if group[i] == g) for g in range(n) if g in group]
    least = dict(zip([g for g in range(n) if g in group], least, strict=True))
    for i, d in enumerate(ids):
        assert tuple(got[d]) == (d, f"{fps[i]:016x}", least[group[i]])


def items_in(texts):
    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()}
    asked = {i: set(plain.runs(plain.words(q), 5)) for i, q in items.items()}
    out = Counter()
    for d, t in texts.items():
        whole = set(plain.runs(plain.words(t), 5))
        for i, q in asked.items():
            n = len(q & whole)
            if q and n >= 0.8 * len(q):
                out[(d, i, len(q), n)] += 1
    return out


def test_op10(spark, texts):
    got = entry.queries()["op10_benchmark_decontamination"](spark, SMALL).collect()
    want = items_in(texts)
    assert want and Counter(tuple(r)[:4] for r in got) == want


def run_stage(spark, docs, k):
    return corpus_pipeline.STAGES[k][1](spark, docs, SMALL)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_pipeline(spark, texts):
    """Every stage against a plain version of what it does to its predecessor's rows."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns

    kept = run_stage(spark, docs, 0)
    judged = result(spark, "op5_quality_rules")
    assert kept.columns == columns
    assert Counter(rows_of(kept)) == Counter((d, t) for d, t in texts.items() if judged[d].kept)

    lines = run_stage(spark, kept, 1)
    before = rows_of(kept)
    want = plain.dedup_lines(before)
    assert lines.columns == columns
    assert Counter(rows_of(lines)) == Counter((d, w[0]) for (d, _), w in zip(before, want, strict=True))
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    single = run_stage(spark, lines, 2)
    before = rows_of(lines)
    sets = [set(plain.runs(plain.words(t), 5)) for _, t in before]
    n = len(before)
    near = [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = plain.components(n, near)
    least = {}
    for g, r in zip(group, before, strict=True):
        least[g] = min(least.get(g, r), r)
    assert near and single.columns == columns
    assert Counter(rows_of(single)) == Counter(least.values())

    clean = run_stage(spark, single, 3)
    before = dict(rows_of(single))
    found = {d for d, *_ in items_in(before)}
    assert clean.columns == columns
    assert Counter(rows_of(clean)) == Counter((d, t) for d, t in before.items() if d not in found)

    last = run_stage(spark, clean, 4)
    assert [r.doc_id for r in last.where("lossless").orderBy("doc_id").collect()] == sorted(dict(rows_of(clean)))
    whole = {r.doc_id: tuple(r.ids) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert whole == {r.doc_id: tuple(r.ids) for r in last.collect()}


def test_near_copies_of_high_similarity_go(spark):
    """Of texts with four fifths of their shingles in common, one stays; unrelated ones all stay."""
    from tests.llm.conftest import prose

    rows = []
    for k in range(20):
        w = prose(500, 900 + k, 2000).split()
        rows.append((10 * k, " ".join(w)))
        for j in range(1, 4):
            v = list(w)
            for i in range(8):
                v[(i * 61 + j * 7) % 500] = f"other{j}"
            rows.append((10 * k + j, " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, SMALL)
    assert sorted(r.doc_id for r in kept.collect()) == [10 * k for k in range(20)]


def test_stages_on_messy_rows_and_none(spark, messy, no_rows):
    for docs in (messy, no_rows):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SMALL)
            assert out.count() <= docs.count()
            assert k == 4 or out.columns == columns
            out2 = stage(spark, docs.where("false"), SMALL)
            assert out2.count() == 0


def test_line_stage_on_messy_rows(spark, messy):
    """Value by value; a line that five messy rows share goes from all but the largest id."""
    from tests.llm.conftest import messy_rows

    line = "a line of more than forty characters that is shared"
    rows = [*messy_rows(), *[(d, f"{line}\nown {d}") for d in (20, 21, 22, 23, None)], *[(24, line)] * 8]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.line_dedup_stage(spark, docs, SMALL)
    want = Counter((d, x[0]) for (d, _), x in zip(rows, plain.dedup_lines(rows), strict=True))
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == want


def test_pages_of_one_template_stay(spark):
    """Pages that share a half to three quarters of their shingles in line are no near copies."""
    from tests.llm.conftest import prose

    rows = []
    for g, shared in enumerate((200, 225, 250, 257)):  # of 300 words; similarities 0.49 to 0.74
        template = prose(shared, 7000 + g, 3000)
        for k in range(150):
            rows.append((1000 * g + k, template + " " + prose(300 - shared, 8000 + 1000 * g + k, 3000)))
    sets = [set(plain.runs(plain.words(t), 5)) for _, t in rows]
    near = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in ((0, 1), (150, 151), (300, 301), (450, 451))]
    assert 0.45 < min(near) and 0.7 < max(near) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, SMALL)
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, _ in rows]


@pytest.mark.parametrize("chunk", [2048, 3])
def test_exact_links_match_all_pairs(spark, monkeypatch, chunk):
    """Texts link at a similarity of 0.8 and not below, whatever the chunks; equal fingerprints don't."""
    from tests.llm.conftest import prose

    monkeypatch.setattr(simhash, "_CHUNK_ROWS", chunk)
    w = prose(400, 77, 3000).split()
    rows = [(k, " ".join(w[: 400 - 9 * k] + prose(9 * k, 600 + k, 3000).split())) for k in range(30)]
    rows += [(100, "0 " * 300 + prose(9, 1)), (101, "0 " * 300 + prose(9, 2)), (102, ""), (103, " "), (104, None)]
    sets = [set(plain.runs(plain.words(t), 5)) for _, t in rows]
    n = len(rows)
    near = [
        (i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    ]
    group = plain.components(n, near)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs, 5, 60, 4, 8, share=0.8)
    assert {r.doc_id: r.component_id for r in got.collect()} == {d: rows[g][0] for (d, _), g in zip(rows, group, strict=True)}


def test_near_dedup_stage_drops_exactly_similar_texts(spark, texts):
    """The stage over the small table, by the exact similarity of all pairs."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sorted(texts.items())
    sets = [set(plain.runs(plain.words(t), 5)) for _, t in rows]
    n = len(rows)
    near = [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = plain.components(n, near)
    kept = run_stage(spark, docs, 2)
    assert near and Counter(rows_of(kept)) == Counter(rows[g] for g in set(group))


def test_op4_digests_are_of_written_shards(spark, texts):
    """Every text is in a shard's folder, in slot order, and the query reads it from there."""
    out = entry.queries()["op4_histogram_sort_sharding"](spark, SMALL)
    files = [f.removeprefix("file://") for f in out.inputFiles()]
    assert files and all("/shard=" in f for f in files)
    want, held = {r.doc_id: (r.shard, r.slot) for r in out.collect()}, {}
    for f in files:
        rows = pq.ParquetFile(f).read().to_pylist()
        assert [r["slot"] for r in rows] == sorted(r["slot"] for r in rows)
        for r in rows:
            held[r["doc_id"]] = r["text"]
            assert want[r["doc_id"]] == (int(f.split("/shard=")[1].split("/")[0]), r["slot"])
    assert held == texts
