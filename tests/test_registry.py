"""Every registered query against its SQL twin on the smallest data, and the shape of all plans."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry
from medialake.plans.registry import ORACLES, QUERIES
from tests.conftest import SMALL
from tools.check import duck
from tools.check import rows as multiset


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    got = multiset(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == multiset(columns, cur.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"]


@pytest.mark.parametrize(
    "name", sorted(QUERIES)
)
def test_plan_has_no_pairs_and_no_python(spark, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in FORBIDDEN if w in plan]


def test_nothing_is_broadcast_without_a_size(spark):
    """With size-based broadcasting off, no query forces one: hints appear only for hot keys."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("project_stats", "output_names", "tenant_matrix", "preset_match", "orphans"):
            df = QUERIES[name](spark, SMALL)
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString(), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(spark):
    df = QUERIES["photos_of_project"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_orderkey,7)" in plan
    assert "l_extendedprice" not in plan


def test_entry(spark):
    df = entry.entry(spark)
    assert "total_photos" in df.columns and df.count() > 0


def counts(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    scans = sum(plan.count(f"Relation [{c}") for c in ("l_orderkey", "conv_id", "o_orderkey", "event_id"))
    return scans, plan.count("Join ")


@pytest.mark.parametrize(
    ("name", "scans", "joins"),
    [("orphans", 4, 2), ("rollback", 4, 3), ("batch_tag", 1, 1), ("batch_preset", 1, 0), ("missed_checks", 2, 1)],
)
def test_plans_read_no_more_than_they_need(spark, name, scans, joins):
    got = counts(spark, name)
    assert got[0] <= scans and got[1] <= joins, got


def test_entry_works_without_the_corpus_package():
    code = (
        "import sys; sys.modules['medialake.llm'] = None; import __spark_entry__ as e; "
        "assert set(e.queries()) == set(e.QUERIES) and set(e.oracle_sql()) == set(e.ORACLES)"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
