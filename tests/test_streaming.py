"""Streams against their batch twins, and restarts."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from medialake.operators import health
from medialake.sources import logs
from medialake.streaming import monitors
from medialake.streaming.retention import KeptHistory
from medialake.streaming.runner import event_stream, run_available, run_parts
from tests.conftest import SMALL


def limit_of(lake, minutes):
    latest = lake.events().agg(F.date_trunc("MILLISECOND", F.max("ts").cast("timestamp"))).first()[0]
    return F.lit(latest) - F.make_dt_interval(mins=F.lit(minutes))


def test_sessions_equal_batch(spark, lake, rows):
    stream = event_stream(spark, SMALL).select("user_id", "ts")
    got = run_available(monitors.idle_sessions(stream, "user_id", 30), "t-sessions")
    batch = health.idle_sessions(lake.events().withColumn("ts", F.col("ts").cast("timestamp")), "user_id", 30)
    batch = batch.filter(F.col("closed") <= limit_of(lake, 10))
    assert rows(got, "user_id", "opened", "closed", "events") == rows(batch, "user_id", "opened", "closed", "events")


def test_buckets_equal_batch(spark, lake, rows):
    checks = event_stream(spark, SMALL).select(F.col("ts").alias("check_time"), F.col("event_type").alias("check_type"))
    got = run_available(monitors.check_buckets(checks), "t-buckets")
    batch = health.check_buckets(lake.health().withColumn("check_time", F.col("check_time").cast("timestamp")))
    batch = batch.filter(F.col("bucket") + F.make_dt_interval(secs=F.lit(300)) <= limit_of(lake, 10))
    assert rows(got, "check_type", "bucket", "checks") == rows(batch, "check_type", "bucket", "checks")


def test_stream_of_a_table_folder(spark, lake, tmp_path):
    lake.raw("events").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = run_available(event_stream(spark, str(tmp_path)).select("event_id"), "t-folder")
    assert got.count() == lake.events().count() == got.distinct().count()


def parts(spark, lake, folder, n):
    """The events as several files in time order."""
    events = lake.raw("events")
    for i in range(n):
        (events.filter(F.col("event_id") % n == i).coalesce(1).write.mode("append").parquet(folder))


def test_latest_states_over_many_batches(spark, lake, tmp_path, rows):
    folder = str(tmp_path / "events")
    parts(spark, lake, folder, 4)
    kind = F.col("event_type")
    state = F.when(kind == "purchase", "completed").otherwise("pending")

    def shape(df):
        return df.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("item"), state.alias("status"))

    stream = shape(spark.readStream.schema(lake.raw("events").schema).option("maxFilesPerTrigger", 1).parquet(folder))
    got = monitors.run_latest_states(stream, "item", ["ts", "event_id"], "t-states")
    batch = shape(lake.events()).groupBy("item").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"),
        F.count_if(F.col("status") == "completed").alias("completions"),
    )
    assert rows(got, "item", "status", "completions") == rows(batch, "item", "status", "completions")


def stored_monitors():
    """Each stored monitor over the events, by name."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "fail").otherwise("success").alias("status")
    done = F.when(kind == "purchase", "completed").otherwise("pending").alias("status")

    def checks(df):
        return df.select(F.col("ts").alias("check_time"), kind.alias("check_type"), status, F.col("value").cast("int").alias("response_time_ms"))

    def audited(df):
        return df.select("event_id", "ts", kind.alias("op"), F.lit("k").alias("key"), F.lit("u").alias("user"), F.lit("c").alias("client"))

    return {
        "health_windows": lambda df: monitors.run_health_windows(checks(df)),
        "check_buckets": lambda df: monitors.run_check_buckets(checks(df)),
        "idle_sessions": lambda df: monitors.run_idle_sessions(df, "user_id", 600),
        "debounced": lambda df: monitors.run_debounced(df, "user_id", "props", "event_id", 60_000),
        "audit_alerts": lambda df: monitors.run_audit_alerts(audited(df), "(error|click)", "event_id"),
        "syncs_per_day": lambda df: monitors.run_syncs_per_day(df.select("ts", "user_id", done), "user_id"),
        "latest_states": lambda df: monitors.run_latest_states(df.select("event_id", "ts", "user_id", done), "user_id", ["ts", "event_id"]),
    }


STORED = ["health_windows", "check_buckets", "idle_sessions", "debounced", "audit_alerts", "syncs_per_day", "latest_states"]


@pytest.mark.parametrize("name", STORED)
@pytest.mark.parametrize("every", [2, 32])
def test_many_batches_give_what_one_batch_gives(spark, lake, tmp_path, rows, monkeypatch, name, every):
    """Four files with interleaved times, one a batch, against one batch with all of them."""
    monkeypatch.setattr(monitors, "COMPACT_EVERY", every)
    folder = str(tmp_path / "events")
    parts(spark, lake, folder, 5)

    def stream(files):
        reader = spark.readStream.schema(lake.raw("events").schema).option("maxFilesPerTrigger", files)
        return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))

    run = stored_monitors()[name]
    many, one = rows(run(stream(1))), rows(run(stream(100)))
    assert many == one and many


def test_stored_monitors_of_nothing(spark, lake, tmp_path):
    lake.raw("events").limit(0).write.parquet(str(tmp_path / "none"))
    for run in stored_monitors().values():
        stream = spark.readStream.schema(lake.raw("events").schema).parquet(str(tmp_path / "none"))
        assert run(stream.withColumn("ts", F.col("ts").cast("timestamp"))).isEmpty()


def test_stored_sessions_equal_the_whole_batch(spark, lake, rows):
    stream = event_stream(spark, SMALL).select("user_id", "ts")
    got = monitors.run_idle_sessions(stream, "user_id", 600)
    batch = health.idle_sessions(lake.events().withColumn("ts", F.col("ts").cast("timestamp")), "user_id", 600)
    assert rows(got, "user_id", "opened", "closed", "events") == rows(batch, "user_id", "opened", "closed", "events")


def test_written_states_grow_with_the_input(spark, lake, tmp_path, monkeypatch):
    """Without merging, each batch writes only its own items."""
    folder = str(tmp_path / "events")
    parts(spark, lake, folder, 5)
    written = []
    from medialake.streaming import runner

    real = runner.run_parts

    def watched(stream, name, part, merge=None, every=0):
        def counted(rows):
            out = part(rows)
            if not rows.isStreaming:
                written.append(out.count())
            return out

        return real(stream, name, counted, merge, every)

    monkeypatch.setattr(monitors, "run_parts", watched)
    stream = spark.readStream.schema(lake.raw("events").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    states = stream.select("event_id", "ts", "user_id", F.lit("completed").alias("status"))
    got = monitors.run_latest_states(states, "user_id", ["ts", "event_id"])
    assert sum(written) <= lake.events().count() and got.agg(F.sum("completions")).first()[0] == lake.events().count()


def test_alerts_once_although_delivered_twice(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    line = "2024-01-01T00:00:0{0}+00:00|{1}|k{0}|ann|local\n"
    text = line.format(1, "revoke") + line.format(2, "STORE") + line.format(3, "emergency") + "2024-01-01T00:00:04+00:00|STORE|k4|root|local\n"
    (src / "a.log").write_text(text)
    shutil.copy(src / "a.log", src / "b.log")
    stream = logs.stream_audit(spark, str(src)).withColumn("id", F.concat("ts", "key"))
    got = run_available(monitors.audit_alerts(stream, "(revoke|emergency|root)", "id"), "t-alerts")
    assert sorted(r["key"] for r in got.collect()) == ["k1", "k3", "k4"]
    stored = monitors.run_audit_alerts(stream, "(revoke|emergency|root)", "id")
    assert sorted(r["key"] for r in stored.collect()) == ["k1", "k3", "k4"]


def test_debounce_keeps_the_last_edit(spark, tmp_path):
    rows_ = [("n", i, f"2024-01-01 00:00:00.{ms:03d}", v) for i, ms, v in ((1, 0, "a"), (2, 300, "ab"), (4, 850, "abc"), (3, 850, "tie"))]
    rows_ += [("n", 5, "2024-01-01 00:00:02.000", "later"), ("n", 6, "2024-01-01 00:05:00.000", "open")]
    df = spark.createDataFrame(rows_, "item string, n long, ts string, value string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    got = run_available(monitors.debounced(stream, "item", "value", "n"), "t-notes")
    assert sorted(r["value"] for r in got.collect()) == ["abc", "later"]
    stored = monitors.run_debounced(stream, "item", "value", "n", name="t-stored-notes")
    assert sorted(r["value"] for r in stored.collect()) == ["abc", "later", "open"]


@pytest.mark.parametrize("gap", [1, 7, 60])
@pytest.mark.parametrize("stretch", [1, 4, 4096])
def test_batch_sessions_of_a_hot_key(spark, monkeypatch, gap, stretch):
    """Runs over slots and stretches equal the session windows of the engine."""
    monkeypatch.setattr(health, "STRETCH", stretch)
    rng = random.Random(gap)
    data = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", rng.randrange(4000) / 4) for _ in range(900)]
    df = spark.createDataFrame(data, "k string, s double").select(
        "k", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts")
    )
    got = health.idle_sessions(df, "k", gap)
    want = df.groupBy("k", F.session_window("ts", f"{gap} seconds").alias("w")).agg(F.count("*").alias("events"))
    a = sorted(tuple(r) for r in got.select("k", "opened", "closed", "events").collect())
    b = sorted(tuple(r) for r in want.select("k", "w.start", "w.end", "events").collect())
    assert a == b


def test_a_later_run_continues(spark, tmp_path):
    """With a folder of its own a stream goes on where it stopped, also if nothing new came in."""
    folder, root = str(tmp_path / "in"), str(tmp_path / "root")

    def put(a, b):
        spark.range(a, b).coalesce(1).write.mode("append").parquet(folder)

    def total(run_root):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)
        sums = lambda df: df.groupBy((F.col("id") % 3).alias("k")).agg(F.sum("id").alias("s"), F.count("id").alias("n"))
        merge = lambda df: df.groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        out = run_parts(stream, "t-again", sums, merge, 2, root=run_root)
        return out.agg(F.sum("s"), F.sum("n")).first()

    put(0, 10)
    put(10, 30)
    put(30, 31)
    assert tuple(total(root)) == (sum(range(31)), 31)
    assert tuple(total(root)) == (sum(range(31)), 31)
    put(31, 50)
    assert tuple(total(root)) == (sum(range(50)), 50) == tuple(total(None))


def test_kept_history_forgets_and_stays_forgotten(spark, tmp_path):
    schema = "id long, t timestamp_ntz"
    history = KeptHistory(spark, str(tmp_path / "h"), schema, "t", 2)
    assert history.read().count() == 0 and history.first_day() == "0001-01-01"

    def batch(*days):
        rows = [(d, f"2024-01-{d:02d} 12:00:00" if d else None) for d in days]
        return spark.createDataFrame(rows, "id long, t string").select("id", F.col("t").cast("timestamp_ntz").alias("t"))

    def held():
        return sorted(r.id for r in history.read().collect())

    first = batch(1, 2, 2, 3, 0)
    history.add(first, 0)
    assert held() == [1, 2, 2, 3]
    history.add(batch(1, 5, 3), 1)  # the first day is given up, also as brought by this batch
    assert held() == [3, 3, 5] and history.first_day() == "2024-01-03"
    for _ in range(2):  # a batch that runs again neither doubles rows nor brings a day back
        history.add(first, 0)
        assert held() == [3, 3, 5]
    history.add(batch(), 2)
    history.add(batch(4, 4), 3)
    assert held() == [3, 3, 4, 4, 5] and history.first_day() == "2024-01-03"
    days = {p.name for p in (tmp_path / "h" / "rows").glob("batch=*/check_date=*")}
    assert days == {f"check_date=2024-01-0{d}" for d in (3, 4, 5)}
