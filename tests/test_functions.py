"""Column expressions against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from medialake import catalogs as C
from medialake.functions import devices, numbers, tags, text, times


def one(spark, expr, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")]
    return spark.range(1).select(*cols).select(expr.alias("r")).first()["r"]


def column(spark, kind, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def wide_tag(number, mask=0xDEADBEEF):
    """The tag from integers of any width, folded to signed 64 bits after every step."""

    def fold(x):
        x &= (1 << 64) - 1
        return x - (1 << 64) if x >> 63 else x

    h = 0
    for ch in number:
        h = fold(h * 31 + ord(ch))
        for step in (
            lambda x: x ^ fold(x << 13),
            lambda x: x ^ (x >> 17),
            lambda x: x + fold(x << 5),
            lambda x: x ^ (x >> 3),
        ):
            h = fold(step(h))
        h &= 0xFFFFFFFF
    for shift, factor in ((15, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = fold((h ^ (h >> shift)) * factor)
    n = abs(math.fmod(h & mask, 1 << 31))
    n, out = int(n), ""
    while n:
        n, d = divmod(n, 36)
        out = C.TAG_ALPHABET[d] + out
    return out or "a"


def test_device_tag_known_values(spark):
    known = {"00000001": "y9hnkl", "00000002": "yadg09", "00000003": "uawc9a", "00000004": "0dpvlp"}
    assert column(spark, "string", list(known), devices.device_tag) == list(known.values())


def test_device_tag_many_numbers(spark):
    rng = random.Random(5)
    numbers_ = [f"{rng.randrange(10**8):08d}" for _ in range(3000)] + ["99999999", "00000000"]
    assert column(spark, "string", numbers_, devices.device_tag) == [wide_tag(n) for n in numbers_]


def test_device_tag_other_mask_and_bad_numbers(spark):
    got = column(spark, "string", ["00000003", "12", "abcdefgh"], lambda c: devices.device_tag(c, 0x12345678))
    assert got == [wide_tag("00000003", 0x12345678), None, None]
    with pytest.raises(ValueError):
        devices.device_tag(F.lit("00000001"), 1 << 40)


def test_round_half_up(spark):
    values = [-2.5, -1.5, -0.4, 0.5, 1.5, 2.4999]
    assert column(spark, "double", values, numbers.round_half_up) == [-2, -1, 0, 1, 2, 2]


def test_zero_pad_keeps_long_numbers(spark):
    assert column(spark, "bigint", [1, 999, 12345], text.zero_pad) == ["0001", "0999", "12345"]


def test_contains_ci_takes_wildcards_literally(spark):
    got = column(spark, "string", ["50% off", "500 off", None], lambda c: text.contains_ci(c, "0%"))
    assert got == [True, False, False]


def test_any_contains_ci(spark):
    lists = [["Night", "harbour"], [], None, ["ight\x01har"], [None, "RIGHT"], ["t", "h"]]
    assert column(spark, "array<string>", lists, lambda c: text.any_contains_ci(c, "IGHT")) == [
        True, False, False, True, True, False,
    ]
    assert column(spark, "array<string>", lists, lambda c: text.any_contains_ci(c, "t\x01h")) == [
        False, False, False, True, False, False,
    ]
    assert column(spark, "array<string>", lists[:2], lambda c: text.any_contains_ci(c, "")) == [True, False]


def test_capitalise_first(spark):
    assert column(spark, "string", ["rAW file", ""], text.capitalise_first) == ["RAW file", ""]


def test_full_name(spark):
    df = spark.createDataFrame([("Ada", None), (None, "Byron"), ("Ada", "Byron"), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(text.full_name("a", "b")).collect()]
    assert got == ["Ada", "Byron", "Ada Byron", ""]


def test_email(spark):
    values = ["a@b.c", "a b@c.d", "a@b", "@b.c", "a@b.c.d"]
    assert column(spark, "string", values, text.email_is_valid) == [True, False, False, False, True]


def test_file_name(spark):
    values = ["http://h/a/b.jpg?w=1", "b.jpg", "http://h/a/", "http://h/?x"]
    assert column(spark, "string", values, text.file_name) == ["b.jpg", "b.jpg", "DSC_0001", "DSC_0001"]


def test_render_name_replaces_in_order(spark):
    got = one(
        spark,
        text.render_name(
            "{project}-{date}-{tag}-{counter}-{original}-{counter}",
            F.lit("P {date}"),
            F.lit("2024-01-02"),
            F.lit(7),
        ),
    )
    assert got == "P 2024-01-02-2024-01-02-general-0007-DSC_0123-0007.jpg"


def test_preset_display_names(spark):
    values = [None, "", "  ", "none", "AM - darkicy", "AMF1 - PADDOCK", "AMF1 - GRIME", "AMF1 - AMF1 - GRIME", "x"]
    want = ["None", "None", "None", "None", "Dark Icy", "Paddock", "GRIME", "Grime", "x"]
    assert column(spark, "string", values, text.preset_display_name) == want


def test_format_labels(spark):
    values = [None, [], ["1x1"], ["4x5"], ["1x1", "16x9"]]
    want = ["9:16 Portrait", "9:16 Portrait", "1:1 Square", "9:16 Portrait", "2 formats selected"]
    assert column(spark, "array<string>", values, text.formats_label) == want


def test_masking(spark):
    df = spark.createDataFrame([("DB_PASSWORD", "x"), ("JWT_SECRET", "y"), ("PORT", "1")], "k string, v string")
    assert [r[0] for r in df.select(text.mask_secret("k", "v")).collect()] == [C.HIDDEN, C.HIDDEN, "1"]


def test_exposure_texts(spark):
    assert column(spark, "string", ["1/1000", "30s", "1/2s", "0.5", "auto"], numbers.parse_shutter) == [
        0.001, 30.0, 0.5, 0.5, None,
    ]
    assert column(spark, "string", ["f/2.8", "f/4", "wide"], numbers.parse_aperture) == [2.8, 4.0, None]
    assert column(spark, "string", ["24.5 MB", "512 KB", "2 GB", "?"], numbers.parse_size_mb) == [
        24.5, 0.5, 2048.0, None,
    ]


def test_bands_and_sliders(spark):
    got = column(spark, "double", [80.0, 81.0, 61.0, 60.0], lambda c: numbers.storage_band(c, F.lit(100)))
    assert got == ["warning", "error", "warning", "success"]
    assert column(spark, "double", [89.0, 90.0], numbers.disk_band) == ["OK", "High"]
    assert column(spark, "double", [-100.0, 0.0, 100.0], numbers.slider_percent) == [0.0, 50.0, 100.0]
    assert one(spark, numbers.storage_band(F.lit(1), F.lit(0))) == "success"


def test_sync_state_and_label(spark):
    cases = [
        (None, None, "synced", "Synced"),
        ("error", 1.0, "synced", "Synced"),
        ("error", 0.2, "error", "Error"),
        ("uploading", 0.455, "uploading", "46%"),
        ("queued", 0.0, "queued", "Queued"),
        ("paused", None, "paused", "Paused"),
        ("odd", 0.1, "synced", "Synced"),
    ]
    df = spark.createDataFrame([(s, p) for s, p, _, _ in cases], "s string, p double")
    df = df.withColumn("state", numbers.sync_state(F.col("s"), F.col("p")))
    got = [tuple(r) for r in df.select("state", numbers.progress_label(F.col("state"), F.col("p"))).collect()]
    assert got == [(s, label) for _, _, s, label in cases]


def test_time_labels(spark):
    as_of = "2024-03-10 12:00:00"
    stamps = ["2024-03-10 11:59:59", "2024-03-10 11:59:00", "2024-03-10 11:00:00", "2024-03-09 12:00:00", "2024-01-05 00:00:00"]

    def run(f):
        return column(spark, "string", stamps, lambda c: f(c.cast("timestamp_ntz"), as_of))

    assert run(times.time_ago) == ["1s ago", "1m ago", "1h ago", "1d ago", "65d ago"]
    assert run(times.time_ago_minutes) == ["Just now", "1m ago", "1h ago", "3/9/2024", "1/5/2024"]
    assert run(times.time_ago_hours) == ["Just now", "Just now", "1h ago", "3/9/2024", "1/5/2024"]


def test_elapsed_rounds_down_for_the_future(spark):
    got = one(spark, times.elapsed_seconds(F.lit("2024-01-01 00:00:00.5").cast("timestamp_ntz"), "2024-01-01 00:00:00"))
    assert got == -1


def test_local_hour(spark):
    ts = F.lit("2024-01-01 02:30:00").cast("timestamp_ntz")
    assert one(spark, times.local_hour(ts)) == 2
    assert one(spark, times.local_hour(ts, "America/New_York")) == 21


def test_tag_lists(spark):
    base = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, tags.add_tag(base, " c ")) == ["a", "b", "c"]
    assert one(spark, tags.add_tag(base, " a ")) == ["a", "b"]
    assert one(spark, tags.add_tag(base, "  ")) == ["a", "b"]
    assert one(spark, tags.remove_tag(base, "a")) == ["b"]
    assert one(spark, tags.toggle(base, "a")) == ["b"]
    assert one(spark, tags.toggle(base, "c")) == ["a", "b", "c"]
    assert one(spark, tags.merge_tags(base, F.array(F.lit("B"), F.lit("C")))) == ["a", "b", "c"]
    assert one(spark, tags.csv_tags(F.lit(""))) == []
    assert one(spark, tags.csv_tags(F.lit(" x, ,y ,"))) == ["x", "y"]


def test_no_python_udf_in_the_package():
    from pathlib import Path

    for path in Path("medialake").rglob("*.py"):
        assert not re.search(r"\budf\(|pandas_udf|applyInPandas|mapInPandas|\.rdd\b", path.read_text()), path
