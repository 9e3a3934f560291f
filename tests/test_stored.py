"""Stored tables, the trigram table, range digests and kept statistics."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from medialake.operators import changes, digests, stats, trigrams, upkeep
from medialake.plans import stored_queries
from medialake.plans.registry import QUERIES
from medialake.sources.stored import PART, StoredTable, hashed, range_width, ranged
from tests.conftest import SMALL

NOW = "2001-12-01 00:00:00"


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet") if p.is_file()}


def bag(df):
    return Counter(map(tuple, df.collect()))


def opened(df):
    """Number and bytes of the files that a scan without a shuffle opens."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(k).metrics() for k in range(leaves.size())]
    return tuple(sum(m.apply(name).value() for m in scans) for name in ("numFiles", "filesSize"))


# Stored tables


@pytest.fixture
def projects(spark):
    rows = [(k, f"p{k}", "draft" if k % 3 else "active") for k in range(200)] + [(None, "none", "draft")]
    return spark.createDataFrame(rows, "project_id long, name string, status string").withColumn(
        "updated_at", F.lit("2001-01-01").cast("timestamp_ntz")
    )


def test_patch_leaves_other_files_alone(spark, projects, tmp_path):
    path = str(tmp_path / "t")
    table = StoredTable.create(projects, path, "project_id", hashed("project_id", 32))
    assert bag(table.read()) == bag(projects)
    before = files(path)
    patches = spark.createDataFrame([(5, "new"), (77, None), (9999, "unknown")], "project_id long, name string")

    def apply(rows, p):
        return changes.patch(rows, p, "project_id", NOW)

    touched = table.change(patches, apply)
    after = files(path)
    assert 0 < len(touched) <= 3
    stays = {f for f in before if int(f.split("/")[0].removeprefix(f"{PART}=")) not in touched}
    assert stays <= after and len(stays) > 20 and not (before - stays) & after
    assert bag(table.read()) == bag(apply(projects, patches))
    assert table.change(patches.filter("false"), apply) == [] and files(path) == after


def test_upsert_and_emptied_partitions(spark, projects, tmp_path):
    path = str(tmp_path / "t")
    table = StoredTable.create(projects, path, "project_id", ranged("project_id", 50))
    rows = spark.createDataFrame([(k, "fresh") for k in (3, 450, 451)], "project_id long, name string")
    upsert = lambda t, p: changes.upsert(t, p, "project_id", {"name": None, "status": "new"}, NOW)
    assert table.change(rows, upsert) == [0, 9]
    want = upsert(projects, rows)
    assert bag(table.read()) == bag(want)
    gone = want.filter("project_id between 50 and 99 or project_id is null").select("project_id")
    table.change(gone.filter("project_id is not null"), lambda t, d: changes.cascade_delete(t, d, "project_id"))
    assert bag(table.read()) == bag(want.filter("project_id not between 50 and 99 or project_id is null"))
    assert not any(f.startswith(f"{PART}=1/") for f in files(path))
    assert table.parts_of(gone) == [-(1 << 62), 1]
    assert table.read([9]).count() == 2 and opened(table.read([9]))[0] == 1 < opened(table.read())[0]


# Trigrams

TEXTS = ["The Ringing bell", "ringing", "RING", "ri", "", None, "öä ringing 😀 fin", "ring ring ring", "a\nb ing", "%_ing\\", "gnir"]


@pytest.fixture
def captions(spark):
    r = random.Random(3)
    words = ["ring", "Bell", "öl", "x", "photo", "inging", "ngi"]
    rows = list(enumerate(TEXTS)) + [(k, " ".join(r.choices(words, k=4))) for k in range(100, 400)]
    rows = [(k, t, None if k % 5 else "Other ring") for k, t in rows] + [(None, "ring", "ring")]
    return spark.createDataFrame(rows, "id long, title string, note string")


@pytest.mark.parametrize("block", [1 << 15, 8])
def test_search_is_the_scan(captions, tmp_path, monkeypatch, block):
    """Also where a run is in many blocks."""
    monkeypatch.setattr(trigrams, "BLOCK", block)
    index = trigrams.TrigramIndex.build(captions, "id", ["title", "note"], str(tmp_path / "i"), width=50, parts=8)
    if block == 8:
        assert index.runs.read().filter("gram = 'ing' and field = 'title'").count() > 20
    rows = [r for r in captions.collect() if r.id is not None]
    for typed in ["", "r", "ri", "rin", "RINGING", "g r", "😀 fi", "öÄ ", "%_i", "ing\\", "zzz", "ringingx", "Other R"]:
        for fields in (["title"], ["title", "note"]):
            low = typed.lower()
            want = sorted(r.id for r in rows if any((r[f] or "").lower().find(low) >= 0 and r[f] is not None for f in fields))
            assert sorted(r.id for r in index.search(typed, fields).collect()) == want, typed
    assert index.candidates("ri") is None


def test_search_reads_less(spark, captions, tmp_path):
    rare = captions.withColumn("title", F.when(F.col("id") == 320, "quartz").otherwise(F.col("title")))
    index = trigrams.TrigramIndex.build(rare, "id", ["title"], str(tmp_path / "i"), width=50, parts=16)
    assert [r.id for r in index.search("Quart").collect()] == [320]

    found = index.candidates("Quart")
    assert opened(index.rows.read(index.rows.parts_of(found)))[1] < opened(index.rows.read())[1] / 4
    asked = spark.createDataFrame([("qua",), ("uar",), ("art",)], "gram string")
    assert opened(index.runs.read(index.runs.parts_of(asked)))[1] < opened(index.runs.read())[1] / 2


# Digests


def versions(spark):
    """Two tables over many ranges: repeated rows, a hot key, nulls, and few places that differ."""
    a = [(k, f"v{k % 7}", k * 1.5) for k in range(3000)] + [(40, "hot", 1.0)] * 500 + [(None, None, None)] * 3
    a += [(-5, None, 2.0), (10**15, "far", None)]
    b = list(a)
    b.remove((40, "hot", 1.0))  # one copy less
    b.append((2001, f"v{2001 % 7}", 2001 * 1.5))  # one copy more
    b.remove((77, "v0", 77 * 1.5))
    b[b.index((1500, "v2", 2250.0))] = (1500, None, 2250.0)
    b.append((10**15 + 1, "new", None))
    schema = "id long, name string, value double"
    return spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)


def test_compare_by_digests(spark, tmp_path):
    a, b = versions(spark)
    tables = [StoredTable.create(x, str(tmp_path / n), "id", ranged("id", 100)) for n, x in (("a", a), ("b", b))]
    want = {(40, "changed", 501, 500), (2001, "changed", 1, 2), (77, "removed", 1, 0), (1500, "changed", 1, 1), (10**15 + 1, "added", 0, 1)}
    assert {tuple(r) for r in digests.changed_keys(a, b, "id").collect()} == want
    assert {tuple(r) for r in digests.changed_in_tables(*tables).collect()} == want
    trees = [digests.kept_tree(t, str(tmp_path / f"tree{k}")) for k, t in enumerate(tables)]
    ranges = {r.range for r in digests.differing_ranges(*trees).collect()}
    assert ranges == {0, 15, 20, 10**13}
    assert opened(tables[0].read(sorted(ranges)))[0] == 4 < opened(tables[0].read())[0]
    assert digests.differing_ranges(trees[0], trees[0]).count() == 0


def test_digests_of_touched_ranges(spark, tmp_path):
    """After a change only the touched leaves are summed again."""
    a, _ = versions(spark)
    table = StoredTable.create(a, str(tmp_path / "a"), "id", ranged("id", 100))
    old = digests.leaf_digests(table).collect()
    gone = spark.createDataFrame([(250,), (251,)], "id long")
    touched = table.change(gone, lambda rows, d: changes.cascade_delete(rows, d, "id"))
    fresh = {r.range: tuple(r) for r in old if r.range not in touched}
    fresh |= {r.range: tuple(r) for r in digests.leaf_digests(table, touched).collect()}
    assert touched == [2] and fresh == {r.range: tuple(r) for r in digests.leaf_digests(table).collect()}


# Kept statistics

PHOTO = "project_id long, photo_id long, status string, updated_at timestamp_ntz, tags array<string>"


def test_kept_statistics_follow_changes(spark, tmp_path):
    from datetime import datetime

    r = random.Random(1)

    def photo(k):
        tags = r.choice([None, [], *[r.choices("abcde", k=3)] * 4])
        day = r.choice([None, datetime(2020, 1, r.randint(1, 28))])
        return (r.choice([1, 1, 1, 2, 3, 4, None]), k, r.choice(["raw", "processed", "exported", "published", None]), day, tags)

    now = {k: photo(k) for k in range(120)}
    projects = spark.createDataFrame([(k,) for k in range(1, 7)], "project_id long")
    frame = lambda rows: spark.createDataFrame(list(rows), PHOTO)
    start = upkeep.photo_deltas(frame(now.values()).withColumn("sign", F.lit(1)))
    kept = StoredTable.create(start, str(tmp_path / "kept"), "project_id", hashed("project_id", 4))
    for turn in range(2):
        changed = r.sample(sorted(now), 40)
        before, after = [now[k] for k in changed], {}
        for k in changed:
            if r.random() < 0.6:
                after[k] = photo(k)
        if turn:  # a project is emptied and new photos come in
            extra = [k for k in now if now[k][0] == 3 and k not in changed]
            before += [now[k] for k in extra]
            changed += extra
            after |= {k: photo(k) for k in range(500, 520)}
        now = {k: v for k, v in now.items() if k not in changed} | after
        upkeep.update_stored(kept, upkeep.photo_deltas(upkeep.signed(frame(before), frame(after.values()))))
        state = frame(now.values())
        got = upkeep.kept_project_stats(projects, kept.read(), NOW)
        want = stats.project_stats(projects, state, NOW)
        assert bag(got.select(*want.columns)) == bag(want)
        assert bag(kept.read()) == bag(upkeep.photo_deltas(state.withColumn("sign", F.lit(1))))


def test_ranges_follow_the_keys(spark):
    few, many = spark.range(100), spark.range(-5, 10_000_000, 999)
    assert range_width(few, "id", 4096, 256) == range_width(few.filter("false"), "id", 4096, 256) == 4096
    width = range_width(many, "id", 4096, 256)
    assert width > 4096 and 250 <= many.select(ranged("id", width)).distinct().count() <= 257


def test_count_drift_keeps_few_partitions(spark, tmp_path, monkeypatch):
    places = iter(range(100))
    monkeypatch.setattr(stored_queries, "scratch_path", lambda _, name: str(tmp_path / f"{name}-{next(places)}"))
    monkeypatch.setattr(stored_queries, "range_width", lambda rows, key, least, parts: range_width(rows, key, 16, 8))
    assert QUERIES["count_drift"](spark, SMALL).count() > 0
    for table in tmp_path.glob("counts-*"):
        assert 0 < len(list(table.glob("_part=*"))) <= 9


def test_grams_are_cut_by_one_pattern(spark):
    texts = ["", "ab", "abc", "Abcabc", "a\nb\r\n", "x😀😀y😀z", "ÉÉÉ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", trigrams.grams(F.col("t")).alias("g"))
    for r in df.collect():
        low = r.t.lower() if r.t is not None else ""
        want = list(dict.fromkeys(low[i : i + 3] for i in range(len(low) - 2)))
        assert r.g == (None if r.t is None else want)
    assert "arrays_zip" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_change_set_is_summed_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upkeep, "scratch_path", lambda _, name: str(tmp_path / name), raising=False)
    rows = [(p, "raw", "2000-01-01 00:00:00", ["a"], 1) for p in range(4)]
    photos = spark.createDataFrame(rows, "project_id long, status string, updated_at string, tags array<string>, sign int")
    kept = StoredTable.create(upkeep.photo_deltas(photos), str(tmp_path / "kept"), "project_id", hashed("project_id", 2))
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    change = photos.limit(1).coalesce(1).mapInArrow(seen, photos.schema)
    upkeep.update_stored(kept, upkeep.photo_deltas(change))
    assert runs.value == 1
    assert kept.read().filter("project_id = 0 and kind = 'count'").first().total_photos == 2
