"""Numbering and joins when single keys are large, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from medialake.plans.ordering import sequenced
from medialake.plans.registry import QUERIES
from medialake.plans.skew import SALTS, join_lookup
from tests.conftest import SMALL


def data(n, seed):
    """A third of all rows under one key, a second large key, a null key, and many small ones."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        r = rng.random()
        key = "hot" if r < 0.34 else "warm" if r < 0.5 else None if r < 0.6 else f"k{rng.randrange(40)}"
        out.append((key, rng.randrange(5), f"{i:05d}", None if i % 7 == 0 else float(i)))
    rng.shuffle(out)
    return out


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    out = {}
    for members in groups.values():
        members.sort(key=lambda r: (r[1], r[2]))
        for i, r in enumerate(members):
            out[r[2]] = (i + 1, members[i - 1][3] if i else None)
    return out


@pytest.mark.parametrize("prefix", ["day", "day div 2", "null"])
def test_sequenced(spark, prefix):
    rows = data(1500, 3)
    df = spark.createDataFrame(rows, "key string, day int, id string, v double").repartition(6)
    got = sequenced(df, ["key"], ["day", "id"], F.expr(prefix), lag=["v"])
    assert got.columns == ["key", "day", "id", "v", "seq", "prev_v"]
    assert {r["id"]: (r["seq"], r["prev_v"]) for r in got.collect()} == expected(rows)


def test_sequenced_cuts_a_hot_key_into_tasks(spark):
    df = spark.range(20000).select(F.lit("x").alias("key"), F.col("id"))
    got = sequenced(df, ["key"], ["id"], F.expr("id div 500"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_task = got.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per_task) > 1 and max(r["count"] for r in per_task) < 20000
    assert got.filter("seq <> id + 1").isEmpty()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_lookup(spark, how):
    rows = spark.createDataFrame(data(800, 5), "key string, day int, id string, v double")
    keys = ["hot"] + [f"k{i}" for i in range(0, 40, 2)]
    lookup = spark.createDataFrame([(k, len(k) * 10) for k in keys], "key string, w int")
    got = join_lookup(rows, lookup, ["key"], how)
    want = rows.join(lookup, "key", how)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_join_lookup_deals_out_a_hot_key(spark):
    for key in ("x", None):
        rows = spark.range(4000).select(F.lit(key).cast("string").alias("key"), "id")
        salts = rows.select(F.pmod(F.xxhash64("key", "id"), F.lit(SALTS)).alias("s")).groupBy("s").count().collect()
        assert len(salts) == SALTS and max(r["count"] for r in salts) < 2 * 4000 / SALTS


def test_building_a_query_starts_no_job(spark):
    """Only round trips over files, streams and stored tables run anything before their result is asked for."""
    tracker = spark.sparkContext.statusTracker()
    for name, build in QUERIES.items():
        if any(w in build.source for w in ("stream_queries", "file_queries", "stored_queries")):
            continue
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        build(spark, SMALL)
        assert not tracker.getJobIdsForGroup(f"build-{name}"), name
    spark.sparkContext.setJobGroup("rest", "rest")


def test_sequenced_shuffles_rows_once(spark):
    """The runs are read from the rows' shuffle, and what is looked up by key comes with them."""
    rows = data(300, 4) + [(None, 1, "none", 0.0)]
    df = spark.createDataFrame(rows, "key string, day int, id string, v double").repartition(6)
    names = spark.createDataFrame([("hot", "Hot"), ("k2", "Two")], "key string, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sequenced(df, ["key"], ["day", "id"], F.col("day"), lookup=names)
        found = {r["id"]: (r["seq"], r["name"]) for r in got.collect()}
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    known = {"hot": "Hot", "k2": "Two"}
    want = expected(rows)
    assert found == {r[2]: (want[r[2]][0], known.get(r[0])) for r in rows}
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning(_group" in x]
    assert len([x for x in shuffles if "ReusedExchange" in x]) == 1 and len(shuffles) == 3
