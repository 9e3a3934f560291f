"""Edge cases of the operators on small rows of our own."""

import random

from pyspark.sql import functions as F

from medialake import catalogs as C
from medialake.operators import (
    audit,
    changes,
    filters,
    health,
    presets,
    quality,
    search,
    stats,
    tagging,
    tenancy,
)

PHOTOS = """photo_id string, project_id int, title string, description string, tags array<string>,
    status string, created_at timestamp_ntz, updated_at timestamp_ntz"""


def photos(spark):
    rows = [
        ("a", 1, "Night Harbour", None, ["Harbour", "night"], "published", "2024-01-03", "2024-01-09"),
        ("b", 1, "Bridge", "harbour bridge", ["steel", "night"], "raw", "2024-01-02", "2024-01-02"),
        ("c", 2, "Field", "open land", [], "exported", "2024-01-01", "2024-01-05"),
        ("d", 2, "100% wool", None, None, None, "2024-01-04", "2024-01-04"),
        ("e", 9, "Lost", "no parent", ["night"], "processed", "2024-01-05", "2024-01-05"),
    ]
    df = spark.createDataFrame(rows, PHOTOS.replace("timestamp_ntz", "string"))
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})


def projects(spark):
    return spark.createDataFrame([(1, "One"), (2, "two"), (3, "Three")], "project_id int, name string")


def ids(df):
    return [r[0] for r in df.select("photo_id").collect()]


def test_photo_search(spark):
    p = photos(spark)
    assert ids(search.photo_search(p, "HARBOUR")) == ["a", "b"]
    assert ids(search.photo_search(p, "0%")) == ["d"]
    assert ids(search.photo_search(p)) == ["e", "d", "a", "b", "c"]
    assert ids(search.photo_search(p, tags=["night", "none"], status="raw")) == ["b"]
    assert ids(search.photo_search(p, start="2024-01-02", end="2024-01-04")) == ["d", "a", "b"]
    assert ids(search.photo_search(p, project_id=2)) == ["d", "c"]


def test_faceted_search_and_orders(spark):
    rows = [
        ("1", "Peak", ["snow"], "IMG_1", "Canon", "Alps", "Vivid", "2024-02-01"),
        ("2", "Lake", ["snow", "blue"], "IMG_2", None, None, None, "2024-02-03"),
        ("3", "Peak two", ["rock"], "IMG_3", "canon mini", "Andes", "Moody", "2023-02-02"),
    ]
    df = spark.createDataFrame(
        rows,
        """photo_id string, title string, tags array<string>, original string, camera string,
        location string, preset_name string, created_at string""",
    ).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    find = search.faceted_search
    assert find(df, "").count() == 0
    assert sorted(ids(find(df, "img"))) == ["1", "2", "3"]
    assert sorted(ids(find(df, "img", [("camera", "CANON"), ("date", "2024")]))) == ["1"]
    assert sorted(ids(find(df, "img", [("preset", "o")]))) == ["3"]
    assert sorted(ids(find(df, "img", [("unknown", "zzz")]))) == ["1", "2", "3"]
    assert ids(search.sort_results(df, "camera")) == ["2", "1", "3"]
    assert ids(search.sort_results(df, "preset")) == ["2", "3", "1"]
    assert ids(search.sort_results(df, "time")) == ["2", "1", "3"]
    assert ids(search.sort_results(df)) == ["1", "2", "3"]
    got = [tuple(r) for r in search.autocomplete(df, "an").collect()]
    assert got == [("canon mini", 2), ("Canon", 2), ("Andes", 3)]
    assert search.autocomplete(df, "a").count() == 0
    assert [r[0] for r in search.autocomplete(df, "o", 5).collect()] == []


def test_project_orders(spark):
    df = spark.createDataFrame(
        [(1, "beta", 3, "2024-01-02"), (2, "Alpha", None, "2024-01-03"), (3, "alpha", 9, "2024-01-01")],
        "project_id int, name string, photo_count int, updated_at string",
    )

    def order(sort, q=""):
        return [r[0] for r in search.project_list(df, q, sort).collect()]

    assert order("recent") == [2, 1, 3]
    assert order("oldest") == [3, 1, 2]
    assert order("imgs_desc") == [3, 1, 2]
    assert order("imgs_asc") == [2, 1, 3]
    assert order("alpha") == [3, 2, 1]
    assert order("recent", "ALPHA") == [2, 3]


def test_filters(spark):
    items = spark.createDataFrame(
        [(1, "A.jpg", ["x"], True, False), (2, "b.jpg", None, False, True), (3, "c.jpg", ["jpgx"], True, True)],
        "id int, filename string, tags array<string>, processed boolean, favorite boolean",
    )

    def pick(*a):
        return sorted(r[0] for r in filters.gallery_filter(items, *a).select("id").collect())

    assert pick() == [1, 2, 3]
    assert pick("favorites") == [2, 3]
    assert pick("processed", "X") == [1, 3]
    assert pick("unprocessed", "  ") == [2]
    p = spark.createDataFrame(
        [(1, 7, True), (2, 7, False), (3, 8, False), (4, 8, True)],
        "preset_id int, owner_id int, is_public boolean",
    )

    def seen(**k):
        return sorted(r[0] for r in filters.visible_presets(p, **k).select("preset_id").collect())

    assert seen() == [1, 2, 3, 4]
    assert seen(user_id=7) == [1, 2, 4]
    assert seen(user_id=7, public_only=True) == [1, 4]
    assert filters.lookup(p, "preset_id", 99).count() == 0
    assert filters.by_key(p, "owner_id", None).count() == 4
    assert filters.rest_query(p, {"owner_id": 8}, ["preset_id"], limit=5, key="preset_id").columns == ["preset_id"]


def test_rest_page_cap(spark):
    df = spark.range(3000)
    assert filters.rest_query(df, key="id").count() == C.PAGE_CAP
    assert filters.rest_query(df, limit=5000, key="id").count() == C.PAGE_CAP
    assert filters.rest_query(df, limit=7, key="id").agg(F.max("id")).first()[0] == 6


def test_project_stats(spark):
    got = {
        r["project_id"]: tuple(r)[1:]
        for r in stats.project_stats(projects(spark), photos(spark), "2024-02-01 00:00:00").collect()
    }
    day = {k: str(v[5])[:10] for k, v in got.items()}
    assert {k: v[:5] for k, v in got.items()} == {1: (2, 1, 1, 1, 3), 2: (2, 2, 1, 0, 0), 3: (0, 0, 0, 0, 0)}
    assert day == {1: "2024-01-09", 2: "2024-01-05", 3: "2024-02-01"}


def test_stats_invariants(lake):
    df = stats.project_stats(lake.projects(), lake.tagged_photos(), "2001-12-01")
    bad = df.filter(
        "published_photos > exported_photos OR exported_photos > processed_photos OR processed_photos > total_photos"
    )
    assert bad.isEmpty()
    assert df.agg(F.sum("total_photos")).first()[0] == lake.photos().count()


def test_facets(spark):
    f = spark.createDataFrame(
        [(1, "raw", "synced", 5), (1, "published", None, None), (2, "exported", "error", 5), (3, "raw", "synced", 5)],
        "camera_id int, status string, upload_status string, preset_id int",
    )
    c = spark.createDataFrame([(1, "Twin"), (2, "Twin"), (4, "Idle")], "camera_id int, camera_name string")
    got = sorted(tuple(r) for r in stats.facet_counts(f, c).collect())
    fixed = {"synced": 2, "unsynced": 2, "published": 1, "edited": 2, "unedited": 2, "preset-applied": 3}
    assert got == sorted([*fixed.items(), ("Twin", 2), ("Twin", 1)])
    none = sorted(tuple(r) for r in stats.facet_counts(f.limit(0), c).collect())
    assert none == sorted((n, 0) for n in fixed)


def test_empty_queue_has_no_mean(spark):
    empty = spark.createDataFrame([], "status string, progress double")
    row = stats.queue_summary(empty).first()
    assert (row["items"], row["mean_progress"], row["shown_progress"], row["done_ratio"]) == (0, None, None, None)
    row = stats.queue_summary(spark.createDataFrame([("completed", 100.0), ("completed", 99.0)], "status string, progress double")).first()
    assert row["all_completed"] and not row["any_syncing"] and row["shown_progress"] == 100


def test_hit_ratio_without_reads(spark):
    df = spark.createDataFrame([(0, 0)], "h bigint, r bigint")
    assert stats.hit_ratio(df, F.col("h"), F.col("r")).first()["hit_ratio"] is None


def test_visibility_against_sets(spark):
    rng = random.Random(2)
    members = {(u, o): rng.choice(C.MEMBER_ROLES) for u in range(8) for o in range(5) if rng.random() < 0.5}
    m = spark.createDataFrame([(u, o, r) for (u, o), r in members.items()], "user_id int, org_id int, role string")
    p = spark.createDataFrame([(i, i % 5, "active") for i in range(20)], "project_id int, org_id int, status string")
    for user in range(9):
        mine = {o for (u, o) in members if u == user}
        admin = {o for (u, o), r in members.items() if u == user and r == "admin"}
        seen = {r[0] for r in tenancy.visible_rows(p, m, user).select("project_id").collect()}
        assert seen == {i for i in range(20) if i % 5 in mine}
        edit = {r[0] for r in tenancy.admin_rows(p, m, user).select("project_id").collect()}
        assert edit == {i for i in range(20) if i % 5 in admin}
        rows_ = {(r[0], r[1]) for r in tenancy.visible_memberships(m, user).select("user_id", "org_id").collect()}
        assert rows_ == {(u, o) for (u, o) in members if u == user or o in admin}


def rule_names(shot):
    """Rules a photo meets, written out independently."""
    place = (shot["location"] or "").lower()
    cam = (shot["camera"] or "").lower()
    h, iso, sh, ap = shot["hour"], shot["iso"], shot["shutter"], shot["aperture"]

    def has(*words):
        return any(w in place for w in words)

    out = []
    if has("pit", "track", "race") and (iso > 800 or 6 <= h <= 18):
        out.append("Track Day")
    if (h < 6 or h > 20) and (sh < 1 / 60 or iso > 1600):
        out.append("Night Shooter")
    if has("studio", "portrait", "headshot") and ap is not None and ap < 2.8:
        out.append("Portrait Pro")
    if has("mountain", "forest", "beach", "park") and 6 <= h <= 18:
        out.append("Landscape Master")
    if has("city", "urban", "street", "building") and 8 <= h <= 20:
        out.append("Urban Edge")
    if iso <= 400 or "film" in cam or "analog" in cam:
        out.append("Vintage Film")
    if (16 <= h <= 19 or 5 <= h <= 8) and has("beach", "mountain", "park"):
        out.append("Sunset Glow")
    if has("street", "architecture", "portrait") and 10 <= h <= 16:
        out.append("Aston Mono")
    return out


SHOT = """photo_id string, preset_id int, iso int, hour int, location string, camera string,
    aperture double, shutter double"""


def shots(n=400):
    rng = random.Random(9)
    places = ["Pit Lane", "Race track", "Old STREET", "Portrait studio", "Beach park", "forest", "Hall", None]
    return [
        dict(
            photo_id=f"p{i}",
            preset_id=rng.randrange(6),
            iso=rng.choice([100, 400, 401, 800, 801, 1600, 1601]),
            hour=rng.randrange(24),
            location=rng.choice(places),
            camera=rng.choice(["Canon", "Analog One", None]),
            aperture=rng.choice([1.4, 2.8, None]),
            shutter=rng.choice([1 / 60, 1 / 61, 0.5]),
        )
        for i in range(n)
    ]


LOOKS = [
    (0, "my URBAN EDGE look", "x"),
    (1, "plain", "soft"),
    (2, "vintage film", "x"),
    (3, "plain", "Natural landscape photography, bright"),
    (4, "Vintage Film two", "Monochrome with rich blacks"),
    (5, "track day", "x"),
]


def test_rules_against_plain_python(spark):
    data = shots()
    df = spark.createDataFrame([tuple(s.values()) for s in data], SHOT)
    looks = spark.createDataFrame(LOOKS, "preset_id int, name string, description string")
    rank = {n: p for p, n, _ in C.PRESET_RULES}
    words = {n: d.lower() for _, n, d in C.PRESET_RULES}

    def serves(look, rule):
        return rule.lower() in look[1].lower() or words[rule] in look[2].lower()

    got = {r["photo_id"]: r for r in presets.preset_match(df, looks).collect()}
    sure = {r["photo_id"]: r["confidence"] for r in presets.applied_confidence(df, looks).collect()}
    for s in data:
        met = rule_names(s)
        best = next(
            ((r, look[0]) for r in met for look in LOOKS if serves(look, r)), (None, None)
        )
        g = got[s["photo_id"]]
        assert (g["rules_met"], g["rule"], g["matched_preset_id"]) == (len(met), *best), s
        assert g["confidence"] == (rank[best[0]] * 10 if best[0] else 0)
        own = [rank[r] * 10 for r in met if serves(LOOKS[s["preset_id"]], r)]
        assert sure[s["photo_id"]] == max(own, default=0)


def test_no_presets_at_all(spark):
    df = spark.createDataFrame([tuple(s.values()) for s in shots(5)], SHOT)
    none = spark.createDataFrame([], "preset_id int, name string, description string")
    got = presets.preset_match(df, none).collect()
    assert len(got) == 5 and all(r["matched_preset_id"] is None and r["confidence"] == 0 for r in got)


def test_suggestions_against_plain_python(spark):
    cases = [("a", "son", None, 12), ("b", "canon", "Mountain", 8), ("c", None, "", 16), ("d", "x", "urb", None)]
    df = spark.createDataFrame(cases, "photo_id string, camera string, location string, hour int")
    got = {r["photo_id"]: r for r in tagging.suggestions(df).collect()}
    for pid, cam, place, hour in cases:
        scored = []
        for seq, name, base, cat in C.TAG_SUGGESTIONS:
            score = base
            if cat == "camera" and cam and cam.lower() in name:
                score += 0.2
            if cat == "location" and place and place.lower() in name:
                score += 0.15
            if name == "golden-hour" and hour is not None and (hour >= 16 or hour <= 8):
                score += 0.25
            scored.append((-score, seq, name))
        assert got[pid]["names"] == [n for _, _, n in sorted(scored)]
        assert got[pid]["confidences"] == [-s for s, _, _ in sorted(scored)]
        rows_ = tagging.suggestion_rows(df.filter(F.col("photo_id") == pid), "N", "location").collect()
        want = [(i + 1, n) for i, (_, _, n) in enumerate(sorted(scored)) if n in ("mountains", "urban")]
        assert sorted((r["rank"], r["name"]) for r in rows_) == want


def test_tag_candidates_exclude_own_tags(spark):
    p = photos(spark)
    usage = tagging.tag_usage(p)
    got = {r["photo_id"]: r["candidates"] for r in tagging.tag_candidates(p.na.fill("x"), usage, "T", 2).collect()}
    assert got["a"] == ["steel"] and got["b"] == [] and got["c"] == ["night", "steel"]
    assert all(r["candidates"] == [] for r in tagging.tag_candidates(p, usage, "  ").collect())


def test_patch_and_unknown_keys(spark):
    cur = spark.createDataFrame([(1, "a", "x", "2020-01-01"), (2, "b", None, "2020-01-01")], "id int, n string, d string, updated_at string")
    patches = spark.createDataFrame([(1, None, "y"), (9, "z", "z")], "id int, n string, d string")
    got = {r["id"]: tuple(r)[1:] for r in changes.patch(cur, patches, "id", "2024-01-01").collect()}
    assert got == {1: ("a", "y", "2024-01-01"), 2: ("b", None, "2020-01-01")}
    assert [r["id"] for r in changes.unknown_keys(cur, patches, "id").collect()] == [9]


def test_upsert_replace_insert(spark):
    cur = spark.createDataFrame([(1, "r", 5, "old")], "project_id int, file_rule string, counter_start int, updated_at string")
    new = spark.createDataFrame([(1, 8), (2, None)], "project_id int, counter_start int")
    got = sorted(tuple(r) for r in changes.upsert(cur, new, "project_id", C.AUTOMATION_DEFAULTS, "now").collect())
    assert got == [(1, "r", 8, "now"), (2, C.AUTOMATION_DEFAULTS["file_rule"], 1, "now")]
    seeded = changes.insert_absent(cur, cur.withColumn("file_rule", F.lit("other")), ["project_id"])
    assert [tuple(r) for r in seeded.collect()] == [(1, "r", 5, "old")]
    row = spark.createDataFrame([(1, "q", 3)], "project_id int, file_rule string, counter_start int")
    assert [tuple(r) for r in changes.replace_rows(cur, row, "project_id", "now").collect()] == [(1, "q", 3, "now")]


def test_batch_actions(spark):
    rows_ = spark.createDataFrame([("a", 1, ["t"], ["1x1"]), ("b", 2, ["u"], [])], "photo_id string, preset_id int, tags array<string>, export_formats array<string>")
    chosen = spark.createDataFrame([("a",), ("a",)], "photo_id string")

    def run(action, value=None):
        return sorted(tuple(r) for r in changes.batch_action(rows_, chosen, "photo_id", action, value).collect())

    assert run("preset", F.lit(9)) == [("a", 9, ["t"], ["1x1"]), ("b", 2, ["u"], [])]
    assert run("tag", F.lit("n"))[0][2] == ["t", "n"]
    assert run("export", F.lit("16x9"))[0][3] == ["1x1", "16x9"]
    assert run("delete") == [("b", 2, ["u"], [])]


def test_semi_and_anti_cover_everything(lake):
    gone = lake.projects().filter("status = 'draft'")
    kept = changes.cascade_delete(lake.photos(), gone, "project_id").count()
    lost = lake.photos().join(gone, "project_id", "left_semi").count()
    assert kept + lost == lake.photos().count() and kept and lost


def test_changed_rows_sees_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id int, v string")
    b = spark.createDataFrame([(1, ""), (2, "x"), (4, "z")], "id int, v string")
    got = {r["id"]: r["change"] for r in changes.changed_rows(a, b, "id").collect()}
    assert got == {1: "changed", 3: "removed", 4: "added"}
    assert changes.changed_rows(a, a, "id").isEmpty()


def test_rollback_rules(spark):
    log = spark.createDataFrame([("p", 1, 1.0), ("p", 2, 2.0), ("p", 3, 3.0), ("q", 1, 9.0)], "id string, version bigint, s double")
    want = spark.createDataFrame([("p", 1), ("q", 7)], "id string, target bigint")
    got = presets.rollback(log, want, "id", "s")
    extra = [tuple(r) for r in got.filter("note IS NOT NULL").collect()]
    assert extra == [("p", 4, 1.0, "Rolled back to version 1")] and got.count() == 5
    same = presets.rollback(log, spark.createDataFrame([("p", 3)], "id string, target bigint"), "id", "s")
    assert same.count() == 4


def test_versions_keep_history(spark):
    kind = "array<struct<id:string,version:int,created_at:string,settings:double,changes:array<string>>>"
    one = spark.createDataFrame(
        [("p", 2, "d1", 5.0, [("p_v1", 1, "d0", 4.0, [])]), ("q", 1, "d1", 1.0, None)],
        f"preset_id string, version int, last_edited string, settings double, previous_versions {kind}",
    )
    new = spark.createDataFrame([("p", 6.0)], "preset_id string, new_settings double")
    got = {r["preset_id"]: r for r in presets.add_versions(one, new, "d2").collect()}
    assert got["p"]["version"] == 3 and got["p"]["last_edited"] == "d2"
    assert [(h["id"], h["settings"], h["created_at"]) for h in got["p"]["previous_versions"]] == [("p_v1", 4.0, "d0"), ("p_v2", 5.0, "d1")]
    assert got["q"]["version"] == 1 and got["q"]["previous_versions"] is None


def test_edit_diff_leaves_missing_values_out(spark):
    edits = spark.createDataFrame([(1, 1, {"a": 1.0, "b": None}), (1, 2, {"a": 3.0, "b": 2.0}), (1, 3, {"b": 5.0})], "id int, n int, adjustments map<string,double>")
    got = [(r["n"], r["adjustments"], r["diff"]) for r in presets.edit_diff(edits, "id", "n").orderBy("n").collect()]
    assert got == [(1, {"a": 1.0}, {"a": 1.0}), (2, {"a": 3.0, "b": 2.0}, {"a": 2.0, "b": 2.0}), (3, {"b": 5.0}, {"b": 3.0})]


def test_default_preset_of_a_deleted_preset(spark):
    d = spark.createDataFrame([(1, 10), (2, 99)], "project_id int, preset_id int")
    p = spark.createDataFrame([(10, "A")], "preset_id int, name string")
    got = sorted(tuple(r) for r in presets.default_presets(projects(spark), d, p).collect())
    assert got == [(1, 10, "A"), (2, None, None), (3, None, None)]
    left, defaults = presets.delete_preset(p, d, p)
    assert left.isEmpty() and [r["project_id"] for r in defaults.collect()] == [2]


def test_duplicate_preset_resets(spark):
    p = spark.createDataFrame([(1, "A", 4, 7, True, True, "d")], "preset_id int, name string, version int, applied_count int, is_active boolean, shared boolean, created_at string")
    copy = presets.duplicate_preset(p, 1, 2, "now").filter("preset_id = 2").first()
    assert tuple(copy) == (2, "A (Copy)", 1, 0, False, False, "now")
    assert presets.duplicate_preset(p, 5, 2, "now").count() == 1


def test_orphans_and_reconciliation(spark):
    p = projects(spark).withColumns({"status": F.lit("active"), "cover_slot": F.when(F.col("project_id") < 3, F.col("project_id") * 10)})
    f = photos(spark).withColumn("slot", F.col("project_id") * 10)
    got = sorted((r["rule"], r["id"]) for r in quality.orphans(p, f).collect())
    assert got == [("photo without project", "e"), ("project without photos", "3")]
    stored = spark.createDataFrame([(1, 2), (2, 5), (3, 0)], "project_id int, stored_count int")
    counted = stats.photo_counts(photos(spark)).withColumnRenamed("photo_count", "actual_count")
    got = sorted((r["project_id"], r["delta"], r["matches"]) for r in stats.reconcile(stored, counted, "project_id").collect())
    assert got == [(1, 0, True), (2, 3, False), (3, 0, True)]


def test_low_quality_gate_and_defaults(spark):
    f = spark.createDataFrame([("a", 1, 1999, 50.0), ("b", 2, 1999, 50.0), ("c", 3, 1999, 5.0), ("d", 1, 2000, 0.0)], "photo_id string, project_id int, long_edge int, exposure_quality double")
    s = spark.createDataFrame([(2, None, None, False), (3, 100, 10, True)], "project_id int, min_long_edge_px int, min_exposure_quality int, auto_flag_low_quality boolean")
    got = {r["photo_id"]: r["low_quality"] for r in quality.low_quality(f, s).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False}


def test_expiry_bands(spark):
    df = spark.createDataFrame([(-1,), (0,), (7,), (8,), (15,), (30,), (31,)], "d int")
    got = [r[0] for r in df.select(audit.expiry_band(F.col("d"))).collect()]
    assert got == ["expired", "within 7 days", "within 7 days", "within 15 days", "within 15 days", "within 30 days", "valid"]


def test_retention_limit_is_kept(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2023-12-31 23:59:59",), (None,)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert changes.retain(df, "t", 30, "2024-01-31 00:00:00").count() == 2
    assert changes.expired_count(df, "t", 30, "2024-01-31 00:00:00").first()[0] == 1


def test_missed_buckets(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:01:00"), ("a", "2024-01-01 00:16:00"), ("b", "2024-01-01 00:00:00")], "check_type string, t string")
    df = df.select("check_type", F.col("t").cast("timestamp_ntz").alias("check_time"), F.lit("success").alias("status"))
    got = sorted((r[0], str(r[1])) for r in health.missed_buckets(df).collect())
    assert got == [("a", "2024-01-01 00:05:00"), ("a", "2024-01-01 00:10:00")]


def test_settings_problems(spark):
    kv = spark.createDataFrame(
        [("s1", k, "v") for k in C.REQUIRED_SERVER_KEYS] + [("s2", "POSTGRES_DB", ""), ("s2", "X", "CHANGE_THIS")],
        "source string, key string, value string",
    )
    src = spark.createDataFrame([("s1", True), ("s2", True), ("s3", False)], "source string, production boolean")
    got = {r["source"]: tuple(r)[1:] for r in quality.environment_problems(kv, src).collect()}
    assert got == {"s1": (0, 0, True), "s2": (5, 1, False), "s3": (5, 0, False)}
    dev = spark.createDataFrame([("d", "ftp_user", ""), ("d", "ftp_root", "/r")], "source string, key string, value string")
    got = quality.device_problems(dev, spark.createDataFrame([("d",), ("e",)], "source string"))
    assert {r["source"]: r["warnings"] for r in got.collect()} == {"d": 3, "e": 4}


def test_tag_candidates_over_many_blocks(spark, monkeypatch):
    """Photos with more tags than a block has ranks, repeated photos, no tags and no match."""
    monkeypatch.setattr(tagging, "_RANKS", 4)
    names = [f"tag{k:02d}" for k in range(30)] + ["other"]
    usage = spark.createDataFrame([(n, 1 + i % 3) for i, n in enumerate(names)], "tag string, usage long")
    ranked = sorted((n for n in names if "tag" in n), key=lambda n: (-(1 + names.index(n) % 3), n))
    held = [("a", []), ("b", None), ("c", ranked[:3]), ("d", ranked[:17] + ["x"]), ("d", ranked[:17] + ["x"]), ("e", ranked), ("f", ranked[5:9])]
    photos = spark.createDataFrame(held, "photo_id string, tags array<string>")
    got = tagging.tag_candidates(photos, usage, "TAG", 5).collect()
    want = [(p, [n for n in ranked if n not in (t or [])][:5]) for p, t in held]
    assert sorted(map(tuple, got)) == sorted(want)
    none = tagging.tag_candidates(photos, usage, "zzz", 5).collect()
    assert sorted(map(tuple, none)) == sorted((p, []) for p, _ in held)
