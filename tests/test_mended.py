"""Cases that once gave wrong answers."""

import pytest
from pyspark.sql import functions as F

from medialake import catalogs as C
from medialake.functions import tags as T
from medialake.functions import text
from medialake.operators import changes, naming, presets, quality
from medialake.sources import configs

EXIF = "photo_id string, preset_id long, iso int, hour int, location string, camera string, aperture double, shutter double"


def test_confidence_of_photos_without_a_known_preset(spark):
    photos = spark.createDataFrame(
        [("a", None, 100, 12, "studio", "x", 1.4, 0.01), ("b", 9, 100, 12, "studio", "x", 1.4, 0.01)], EXIF
    )
    looks = spark.createDataFrame([(1, "Portrait Pro", "")], "preset_id long, name string, description string")
    got = {r.photo_id: r.confidence for r in presets.applied_confidence(photos, looks).collect()}
    assert got == {"a": 0, "b": 0}


def test_aperture_of_zero_is_unknown(spark):
    photos = spark.createDataFrame([(f"p{a}", 1, 900, 12, "studio", "x", a, 0.01) for a in (0.0, 1.4, None)], EXIF)
    met = {r.photo_id: r.met for r in presets.with_met_rules(photos).collect()}
    assert met["pNone"] == met["p0.0"] == 0 and met["p1.4"] == 1 << 8


def test_photos_of_unknown_projects_are_named(spark):
    photos = spark.createDataFrame([("a", 1, "2024-01-01"), ("b", 2, "2024-01-02")], "photo_id string, project_id long, d string")
    photos = photos.select("photo_id", "project_id", F.col("d").cast("timestamp").alias("created_at"))
    projects = spark.createDataFrame([(1, "Ring", 5)], "project_id long, name string, s int")
    got = {r.photo_id: r.output_name for r in naming.output_names(photos, projects, "{project}_{counter}", F.col("s")).collect()}
    assert set(got) == {"a", "b"} and "Ring_0005" in got["a"] and "_0001" in got["b"]


@pytest.mark.parametrize("raw", ["\tpromo\n", " promo ", "﻿promo", "　promo "])
def test_outer_white_space_of_any_kind_is_cut(spark, raw):
    df = spark.createDataFrame([(["promo"], raw)], "tags array<string>, raw string")
    got = df.select(T.add_tag(F.col("tags"), F.col("raw")).alias("t"), T.csv_tags(F.concat("raw", F.lit(",x"))).alias("c")).first()
    assert got.t == ["promo"] and got.c == ["promo", "x"]


def test_lines_that_mention_a_secret_are_hidden(spark):
    df = spark.createDataFrame(
        [("PGRST_DB_URI", "postgres://u:SECRET@db"), ("DB_PASSWORD", "x"), ("NAME", "lake"), ("EMPTY", None)], "k string, v string"
    )
    got = [r[0] for r in df.select(text.mask_secret("k", "v")).collect()]
    assert got == [C.HIDDEN, C.HIDDEN, "lake", None]


def test_lines_replaced_later_are_checked(spark):
    body = "\n".join([f"{k}=CHANGE_THIS\n{k}=\n{k}=good" for k in C.REQUIRED_SERVER_KEYS])
    texts = spark.createDataFrame([("s", body)], "source string, text string")
    sources = texts.select("source", F.lit(True).alias("production"))
    got = quality.environment_problems(configs.env_lines(texts), sources).first()
    assert (got.errors, got.warnings, got.valid) == (1, len(C.REQUIRED_SERVER_KEYS), False)
    assert {r.value for r in configs.parse_env(texts).collect()} == {"good"}


def test_a_column_without_default_is_an_error(spark):
    now = spark.createDataFrame([(1, "t", 1)], "project_id long, watermark_text string, updated_at long")
    with pytest.raises(ValueError, match="watermark_text"):
        changes.upsert(now, now.select("project_id"), "project_id", C.AUTOMATION_DEFAULTS, "2024-01-01")


def test_rollback_of_known_and_unknown_versions(spark):
    log = spark.createDataFrame([(k, v, float(10 * k + v)) for k in (1, 2, 3) for v in (1, 2, 3)], "k int, version int, s double")
    asked = spark.createDataFrame([(1, 2), (2, 3), (3, 9)], "k int, target int")
    out = presets.rollback(log, asked, "k", "s").where("note is not null").collect()
    assert [(r.k, r.version, r.s, r.note) for r in out] == [(1, 4, 12.0, "Rolled back to version 2")]
