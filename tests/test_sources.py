"""Readers and writers on files of our own."""

import json
import os

import pytest
from pyspark.sql import functions as F

from medialake.operators import changes, health
from medialake.plans import file_queries, stream_queries
from medialake.plans.registry import QUERIES
from medialake.session import drop_scratch, scratch_path, scratch_root
from medialake.sources import configs, documents, logs, schemas, sinks, tables


def write(path, text):
    path.write_text(text)
    return str(path)


def test_gallery_documents(spark, tmp_path, rows):
    items = [
        (f"{i:03d}", "p1" if i < 7 else "p2", f"f{i}", "synced", 0.5, i % 2 == 0, False, ["a", "b"] if i else [])
        for i in range(10)
    ]
    df = spark.createDataFrame(
        items,
        """id string, project_id string, filename string, uploaded_state string,
        upload_progress double, processed boolean, favorite boolean, tags array<string>""",
    )
    path = str(tmp_path / "docs")
    documents.save_gallery(df, path, chunk=3)
    texts = [json.loads(r[0]) for r in spark.read.text(path).collect()]
    sizes = [(k, len(v)) for d in texts for k, v in d.items()]
    assert sum(n for k, n in sizes if k == "p1") == 7 and sum(n for k, n in sizes if k == "p2") == 3
    assert len(sizes) > 2 and all(len(d) == 1 for d in texts)
    back = documents.load_gallery(spark, path)
    assert rows(back, *df.columns) == rows(df)
    large = spark.range(4000).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 > 0, "hot").alias("project_id"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema[2:]],
    ).fillna({"project_id": "other"})
    docs = documents.to_gallery_documents(large, chunk=100)
    sizes = [len(v) for r in docs.collect() for v in json.loads(r[0]).values()]
    assert sum(sizes) == 4000 and max(sizes) <= 100


def test_gallery_document_of_a_client(spark):
    text = '{"p1":[{"id":"1","filename":"x","favorite":true,"extra":1},{"id":"2"}],"p2":[]}'
    got = documents.read_gallery_documents(spark.createDataFrame([(text,), ("oops",)], "value string"))
    assert sorted((r["project_id"], r["id"], r["favorite"]) for r in got.collect()) == [("p1", "1", True), ("p1", "2", None)]


def test_audit_lines_of_all_ages(spark, tmp_path):
    write(tmp_path / "audit.log", '2024-01-01T10:00:00+00:00|STORE|k1|ann|local\n2024-01-02T10:00:00+02:00|RETRIEVE|k "1|bob\n2024-01-03T00:00:00+00:00|STORE|k2|ann|{"m":1}\nbroken\n')
    got = logs.read_audit(spark, str(tmp_path / "audit.log")).collect()
    assert [(r["op"], r["key"], r["user"], r["client"]) for r in got] == [
        ("STORE", "k1", "ann", "local"), ("RETRIEVE", 'k "1', "bob", None), ("STORE", "k2", "ann", '{"m":1}'), (None, None, None, None),
    ]
    assert str(got[1]["ts"]) == "2024-01-02 08:00:00" and got[3]["ts"] is None


def test_ca_audit(spark, tmp_path):
    path = write(tmp_path / "ca.log", "2024-01-01T10:00:00+00:00 | root | revoke | cert 7 | late\n")
    r = logs.read_ca_audit(spark, path).first()
    assert (r["user"], r["op"], r["key"]) == ("root", "revoke", "cert 7 | late")


def test_service_log(spark, tmp_path):
    path = write(tmp_path / "s.log", "\x1b[0;32m[2024-01-01 10:00:00]\x1b[0m started\n\x1b[0;31m[ERROR]\x1b[0m no disk\n[WARN] hot\nfree text\n[other] x\n")
    got = [(r["level"], r["message"]) for r in logs.read_service_log(spark, path).collect()]
    assert got == [("LOG", "started"), ("ERROR", "no disk"), ("WARN", "hot"), (None, "free text"), (None, "[other] x")]


def test_config_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    write(tmp_path / "c" / "one.conf", 'loose="a"\n# [skip]\n[net]\n  ip = \'10.0.0.1\'\n#ip=x\n\n[ftp]\nuser=one\nuser = "two" \n bad line\n[net] # again\nmask=255\n9x=1\n')
    write(tmp_path / "c" / "two.conf", "[ftp]\r\nuser=w\r\n")
    df = configs.parse_config(configs.read_texts(spark, str(tmp_path / "c")))
    got = {(os.path.basename(r["source"]), r["key"]): r["value"] for r in df.collect()}
    assert got == {
        ("one.conf", "loose"): "a", ("one.conf", "net_ip"): "10.0.0.1", ("one.conf", "net_mask"): "255",
        ("one.conf", "ftp_user"): 'two" ', ("two.conf", "ftp_user"): "w",
    }


def test_key_files(spark, tmp_path):
    path = write(tmp_path / "k.meta", "type: secret\ncreated: 2024-01-01T00:00:00+00:00\ncreator: ann: b\nchecksum: ff\n")
    r = configs.parse_key_metadata(configs.read_texts(spark, path)).first()
    assert (r["key_type"], str(r["created_at"]), r["creator"], r["checksum"]) == ("secret", "2024-01-01 00:00:00", "ann: b", "ff")


def test_nested_photos_prune_columns(spark, tmp_path):
    photo = {"id": "1", "projectId": "p", "tags": ["x"], "status": "raw", "createdAt": "2024-01-01T00:00:00Z",
             "metadata": {"camera": "c", "settings": {"iso": 100, "shutterSpeed": "1/60"}}}
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.json", json.dumps(photo) + "\n")
    df = tables.photo_files(spark, str(tmp_path / "in"))
    df.write.parquet(str(tmp_path / "pq"))
    flat = tables.flatten_photos(tables.photo_files(spark, str(tmp_path / "pq"), "parquet"))
    r = flat.first()
    assert (r["photo_id"], r["iso"], r["location"], str(r["created_at"])) == ("1", 100, None, "2024-01-01 00:00:00")
    plan = flat.select("iso")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<metadata:struct<settings:struct<iso:int>>>" in plan


def test_tenant_table_defaults(spark, tmp_path):
    path = str(tmp_path / "orgs")
    spark.sql("SELECT '1' id, 'A' name, 'a' slug, CAST(NULL AS STRING) description, CAST(NULL AS BOOLEAN) is_active, current_timestamp() created_at, current_timestamp() updated_at").write.parquet(path)
    df = tables.tenant_table(spark, path, schemas.ORGANIZATIONS)
    assert df.first()["is_active"] is True
    assert "organizationName" in tables.rename_columns(df, {"name": "organizationName"}).columns


def test_health_history(spark, tmp_path):
    path = str(tmp_path / "h")
    for day in ("2024-01-01", "2024-01-15", "2024-02-10"):
        sinks.append_health(health.log_check(spark, "db", "success", f"{day} 10:00:00", '{"a":1}', 5), path)
    df = sinks.read_health(spark, path)
    assert df.count() == 3
    plan = df.filter("check_date = DATE'2024-01-15'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(check_date" in plan
    assert changes.drop_old_days(spark, path, 30, "2024-02-14 00:00:00") == ["check_date=2024-01-01"]
    assert sinks.read_health(spark, path).count() == 2


def test_json_rows_keep_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert sinks.as_json(df).first()[0] == '{"a":1,"b":null}'


def test_bucketed_tables_join_without_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = spark.range(100).withColumnRenamed("id", "k"), spark.range(50).withColumnRenamed("id", "k")
        sinks.write_bucketed(a, "bucketed_a", ["k"], 4)
        sinks.write_bucketed(b, "bucketed_b", ["k"], 4)
        joined = spark.table("bucketed_a").join(spark.table("bucketed_b"), "k")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 50
    finally:
        spark.sql("DROP TABLE IF EXISTS bucketed_a")
        spark.sql("DROP TABLE IF EXISTS bucketed_b")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


class Named:
    """A session whose cluster names the shared folder."""

    def __init__(self, spark, folder):
        self.conf = {"spark.checkpoint.dir": folder}
        self.sparkContext = spark.sparkContext
        self._jvm, self._jsc = spark._jvm, spark._jsc


def test_scratch_folder_is_the_one_named(spark, tmp_path):
    named = Named(spark, str(tmp_path))
    assert scratch_root(named) == str(tmp_path)
    path = scratch_path(named, "x")
    assert path.startswith(str(tmp_path)) and path != scratch_path(named, "x")
    spark.range(3).write.parquet(path)
    other = tmp_path / "medialake" / "another-application"
    other.mkdir()
    drop_scratch(named)
    assert not os.path.exists(path) and other.exists()
    with pytest.raises(ValueError):
        scratch_root(Unnamed("spark://host:7077"))


class Unnamed:
    """A session that names no shared folder."""

    def __init__(self, master):
        self.conf, self.sparkContext, self.master = {}, self, master

    def getConf(self):
        return {}

    def getCheckpointDir(self):
        return None


def test_bundles_hold_whole_files(spark, tmp_path, rows):
    path = str(tmp_path / "b")
    texts = [(1, "a=1\r\n\nb=2\n"), (2, ""), (3, None), (4, "é x\x1e\x00y"), (None, "n")]
    df = spark.createDataFrame(texts, "source long, text string")
    configs.write_bundles(df, path)
    assert rows(configs.read_bundles(spark, path)) == sorted(texts, key=repr)


@pytest.mark.parametrize("name", ["environment_fleet", "key_metadata_scan", "masked_settings", "config_fleet", "device_config_scan"])
def test_sources_share_files(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(file_queries, "scratch_path", lambda _, folder: str(tmp_path / folder))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    (folder,) = tmp_path.iterdir()
    assert not [f for f in folder.iterdir() if f.is_dir()]


def test_photo_files_are_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_queries, "scratch_path", lambda _, folder: str(tmp_path / folder))
    assert QUERIES["photo_file_scan"](spark, "/root/testdata/sf0.001").count() > 0
    files = [f.name for f in (tmp_path / "photo-files").iterdir() if f.name.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)


def test_gallery_files_are_compressed_and_bounded(spark, tmp_path, rows):
    items = spark.range(4).selectExpr(
        "cast(id as string) id", "'p' || id project_id", "'f' filename", "'synced' uploaded_state",
        "0.5D upload_progress", "true processed", "false favorite", "array('a') tags",
    )
    documents.save_gallery(items.coalesce(1), str(tmp_path / "g"), chunk=500_000)
    files = [f.name for f in (tmp_path / "g").iterdir() if f.name.startswith("part-")]
    assert len(files) >= 2 and all(f.endswith(".txt.gz") for f in files)
    assert rows(documents.load_gallery(spark, str(tmp_path / "g")), "id", "project_id") == [(str(i), f"p{i}") for i in range(4)]
