"""Registered queries: rule jobs, naming, export, devices, data quality and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake import catalogs as C
from medialake.bindings import EVENTS_AS_OF
from medialake.functions import numbers, text, times
from medialake.functions.tags import csv_tags
from medialake.operators import devices, filters, naming, quality, stats, tagging
from medialake.operators import presets as P
from medialake.plans.registry import query

RULES = """
    WITH e AS (
        SELECT *, lower(location) AS loc FROM exif),
    met AS (
        SELECT photo_id, preset_id, p.priority, p.rule FROM e,
        (SELECT unnest([
            CASE WHEN (loc LIKE '%pit%' OR loc LIKE '%track%' OR loc LIKE '%race%')
                      AND (iso > 800 OR hour BETWEEN 6 AND 18)
                 THEN {'priority': 10, 'rule': 'Track Day'} END,
            CASE WHEN (hour < 6 OR hour > 20)
                      AND (shutter < CAST(1 AS DOUBLE) / CAST(60 AS DOUBLE) OR iso > 1600)
                 THEN {'priority': 9, 'rule': 'Night Shooter'} END,
            CASE WHEN (loc LIKE '%studio%' OR loc LIKE '%portrait%' OR loc LIKE '%headshot%')
                      AND aperture < CAST(2.8 AS DOUBLE)
                 THEN {'priority': 8, 'rule': 'Portrait Pro'} END,
            CASE WHEN (loc LIKE '%mountain%' OR loc LIKE '%forest%' OR loc LIKE '%beach%' OR loc LIKE '%park%')
                      AND hour BETWEEN 6 AND 18
                 THEN {'priority': 7, 'rule': 'Landscape Master'} END,
            CASE WHEN (loc LIKE '%city%' OR loc LIKE '%urban%' OR loc LIKE '%street%' OR loc LIKE '%building%')
                      AND hour BETWEEN 8 AND 20
                 THEN {'priority': 6, 'rule': 'Urban Edge'} END,
            CASE WHEN iso <= 400 OR camera LIKE '%film%' OR camera LIKE '%analog%'
                 THEN {'priority': 5, 'rule': 'Vintage Film'} END,
            CASE WHEN (hour BETWEEN 16 AND 19 OR hour BETWEEN 5 AND 8)
                      AND (loc LIKE '%beach%' OR loc LIKE '%mountain%' OR loc LIKE '%park%')
                 THEN {'priority': 4, 'rule': 'Sunset Glow'} END,
            CASE WHEN (loc LIKE '%street%' OR loc LIKE '%architecture%' OR loc LIKE '%portrait%')
                      AND hour BETWEEN 10 AND 16
                 THEN {'priority': 3, 'rule': 'Aston Mono'} END]) AS p)
        WHERE p IS NOT NULL),
    texts AS (
        SELECT * FROM (VALUES
            ('Track Day', 'high contrast, vibrant racing shots'),
            ('Night Shooter', 'optimized for low-light night photography'),
            ('Portrait Pro', 'professional portrait enhancement'),
            ('Landscape Master', 'natural landscape photography'),
            ('Urban Edge', 'sharp, modern city photography'),
            ('Vintage Film', 'classic film look with natural tones'),
            ('Sunset Glow', 'warm, golden hour aesthetics'),
            ('Aston Mono', 'monochrome with rich blacks')) t(rule, words)),
    served AS (
        SELECT rule, preset_id FROM presets, texts
        WHERE contains(lower(name), lower(rule)) OR contains(lower(description), words))
    """


@query(
    "rule_presets",
    RULES
    + """
    SELECT rule, min(preset_id) AS preset_id FROM served GROUP BY 1
    """,
    "exif presets",
)
def rule_presets(lake):
    return P.rule_presets(lake.presets()).select("rule", "preset_id")


@query(
    "preset_match",
    RULES
    + """
    , one AS (SELECT rule, min(preset_id) AS found FROM served GROUP BY 1),
    best AS (
        SELECT photo_id, arg_max(met.rule, priority) AS rule, arg_max(found, priority) AS found,
               max(priority) AS priority
        FROM met JOIN one ON one.rule = met.rule GROUP BY 1),
    n AS (SELECT photo_id, count(*) AS n FROM met GROUP BY 1)
    SELECT exif.photo_id, CAST(coalesce(n, 0) AS INTEGER) AS rules_met, rule, found AS matched_preset_id,
           CAST(coalesce(priority, 0) * 10 AS INTEGER) AS confidence
    FROM exif LEFT JOIN best ON best.photo_id = exif.photo_id LEFT JOIN n ON n.photo_id = exif.photo_id
    """,
    "exif presets",
)
def preset_match(lake):
    return P.preset_match(lake.exif(), lake.presets())


@query(
    "preset_confidence",
    RULES
    + """
    , best AS (
        SELECT photo_id, max(priority) AS priority
        FROM met JOIN served ON served.rule = met.rule AND served.preset_id = met.preset_id GROUP BY 1)
    SELECT exif.photo_id, preset_id, CAST(coalesce(priority, 0) * 10 AS INTEGER) AS confidence
    FROM exif LEFT JOIN best ON best.photo_id = exif.photo_id
    """,
    "exif presets",
)
def preset_confidence(lake):
    return P.applied_confidence(lake.exif(), lake.presets())


SUGGEST = """
    WITH base AS (
        SELECT * FROM (VALUES
            (1, 'mountains', 0.95, 'location'), (2, 'forest', 0.87, 'location'), (3, 'urban', 0.76, 'location'),
            (4, 'coast', 0.68, 'location'), (5, 'landscape', 0.92, 'subject'), (6, 'architecture', 0.81, 'subject'),
            (7, 'portrait', 0.45, 'subject'), (8, 'street', 0.72, 'subject'), (9, 'vivid', 0.88, 'style'),
            (10, 'moody', 0.79, 'style'), (11, 'minimal', 0.65, 'style'), (12, 'dramatic', 0.71, 'style'),
            (13, 'canon', 0.82, 'camera'), (14, 'sony', 0.68, 'camera'), (15, 'nikon', 0.59, 'camera'),
            (16, 'golden-hour', 0.91, 'time'), (17, 'blue-hour', 0.74, 'time'), (18, 'midday', 0.45, 'time')
        ) t(seq, name, conf, category)),
    places AS (
        SELECT photo_id, hour, camera,
               CASE WHEN location LIKE 'Mountain%' THEN 'Mountain' WHEN location LIKE 'City%' THEN 'urban'
                    ELSE location END AS location
        FROM exif),
    scored AS (
        SELECT photo_id, seq, name, category,
               CASE WHEN category = 'camera' AND contains(name, camera)
                    THEN CAST(conf AS DOUBLE) + CAST(0.2 AS DOUBLE)
                    WHEN category = 'location' AND contains(name, lower(location))
                    THEN CAST(conf AS DOUBLE) + CAST(0.15 AS DOUBLE)
                    WHEN name = 'golden-hour' AND (hour >= 16 OR hour <= 8)
                    THEN CAST(conf AS DOUBLE) + CAST(0.25 AS DOUBLE)
                    ELSE CAST(conf AS DOUBLE) END AS confidence
        FROM places, base)
    """


def _suggestion_assets(lake):
    """Locations shortened to words that suggestion names can contain."""
    place = (
        F.when(F.startswith("location", F.lit("Mountain")), "Mountain")
        .when(F.startswith("location", F.lit("City")), "urban")
        .otherwise(F.col("location"))
    )
    return lake.exif().select("photo_id", "hour", "camera", place.alias("location"))


@query(
    "tag_suggestions",
    SUGGEST
    + """
    SELECT photo_id, string_agg(name, ',' ORDER BY confidence DESC, seq) AS ranked,
           max(confidence) AS best_confidence
    FROM scored GROUP BY 1
    """,
    "exif",
)
def tag_suggestions(lake):
    ranked = tagging.suggestions(_suggestion_assets(lake))
    return ranked.select(
        "photo_id",
        F.array_join("names", ",").alias("ranked"),
        F.get("confidences", F.lit(0)).alias("best_confidence"),
    )


@query(
    "suggestion_search",
    SUGGEST
    + """
    , r AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY confidence DESC, seq) AS rank FROM scored)
    SELECT photo_id, CAST(rank AS INTEGER) AS rank, name, confidence FROM r
    WHERE category = 'camera' AND contains(name, 'on')
    """,
    "exif",
)
def suggestion_search(lake):
    rows = tagging.suggestion_rows(_suggestion_assets(lake), "ON", "camera")
    return rows.select("photo_id", "rank", "name", "confidence")


@query(
    "output_names",
    """
    WITH n AS (
        SELECT f.photo_id, f.project_id, f.original, f.created_at, f.tags, p.name,
               row_number() OVER (PARTITION BY f.project_id ORDER BY f.created_at, f.photo_id)
                 + coalesce(1 + p.project_id % 20000, 1) - 1 AS counter
        FROM (SELECT * REPLACE (CASE WHEN preset_id % 97 = 0 THEN -project_id - 1 ELSE project_id END AS project_id)
              FROM tagged_photos) f
             LEFT JOIN projects p ON p.project_id = f.project_id)
    SELECT photo_id, project_id,
           coalesce(name, '') || '_' || strftime(created_at, '%Y-%m-%d') || '_' || tags[1] || '_'
             || CASE WHEN counter < 10000 THEN lpad(CAST(counter AS VARCHAR), 4, '0') ELSE CAST(counter AS VARCHAR) END
             || '_' || original || '.jpg' AS output_name
    FROM n
    """,
    "tagged_photos projects",
)
def output_names(lake):
    strayed = F.when(F.col("preset_id") % 97 == 0, -F.col("project_id") - 1).otherwise(F.col("project_id"))
    return naming.output_names(
        lake.tagged_photos().withColumn("project_id", strayed),
        lake.projects(),
        "{project}_{date}_{tag}_{counter}_{original}",
        start=F.lit(1) + F.col("project_id") % 20000,
    )


@query(
    "export_plan",
    """
    WITH p AS (
        SELECT photo_id, CASE status WHEN 'published' THEN 'web' WHEN 'exported' THEN 'print'
                                     WHEN 'processed' THEN 'social' ELSE 'archive' END AS profile,
               unnest(export_formats) AS format_id
        FROM photos)
    SELECT profile, format_id, replace(format_id, 'x', ':') AS ratio,
           CASE profile WHEN 'print' THEN 'TIFF' WHEN 'archive' THEN 'PNG' ELSE 'JPEG' END AS format,
           CASE profile WHEN 'web' THEN '1080p' WHEN 'social' THEN '2K' ELSE 'Original' END AS resolution,
           CAST(CASE profile WHEN 'web' THEN 80 WHEN 'social' THEN 85 ELSE 100 END AS INTEGER) AS quality,
           count(*) AS files
    FROM p GROUP BY ALL
    """,
    "photos",
)
def export_plan(lake):
    profile = (
        F.when(F.col("status") == "published", "web")
        .when(F.col("status") == "exported", "print")
        .when(F.col("status") == "processed", "social")
        .otherwise("archive")
    )
    return naming.export_totals(naming.export_plan(lake.photos(), profile))


# The hash in plain wide integers: products of up to 96 bits are formed whole and then cut to
# signed 64 bits, one digit per step.
_STEPS = "".join(
    f""",
    a{i} AS (SELECT number, h * 31 + ascii(substr(number, {i}, 1)) AS h FROM s{i - 1}),
    b{i} AS (SELECT number, xor(h, h << 13) AS h FROM a{i}),
    c{i} AS (SELECT number, xor(h, h >> 17) AS h FROM b{i}),
    d{i} AS (SELECT number, h + (h << 5) AS h FROM c{i}),
    s{i} AS (SELECT number, xor(h, h >> 3) & CAST(4294967295 AS HUGEINT) AS h FROM d{i})"""
    for i in range(1, 9)
)
_SIGNED = """CAST(CASE WHEN h % CAST(18446744073709551616 AS HUGEINT) >= CAST(9223372036854775808 AS HUGEINT)
    THEN h % CAST(18446744073709551616 AS HUGEINT) - CAST(18446744073709551616 AS HUGEINT)
    ELSE h % CAST(18446744073709551616 AS HUGEINT) END AS HUGEINT)"""
TAGS = f"""
    WITH s0 AS (
        SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS number, CAST(0 AS HUGEINT) AS h FROM customer){_STEPS},
    f1 AS (SELECT number, xor(h, h >> 15) AS h FROM s8),
    f2 AS (SELECT number, h * CAST(2246822507 AS HUGEINT) AS h FROM f1),
    f3 AS (SELECT number, {_SIGNED} AS h FROM f2),
    f4 AS (SELECT number, xor(h, CAST(floor_div AS HUGEINT)) AS h FROM (
        SELECT number, h, CASE WHEN h >= 0 THEN h // 8192 ELSE -((-h + 8191) // 8192) END AS floor_div FROM f3)),
    f5 AS (SELECT number, h * CAST(3266489909 AS HUGEINT) AS h FROM f4),
    f6 AS (SELECT number, CASE WHEN h % CAST(18446744073709551616 AS HUGEINT) < 0
                               THEN h % CAST(18446744073709551616 AS HUGEINT) + CAST(18446744073709551616 AS HUGEINT)
                               ELSE h % CAST(18446744073709551616 AS HUGEINT) END AS h FROM f5),
    f7 AS (SELECT number, xor(h, h // 65536) & CAST(3735928559 AS HUGEINT) AS h FROM f6),
    f8 AS (SELECT number, h % CAST(2147483648 AS HUGEINT) AS h FROM f7),
    tagged AS (
        SELECT number, ltrim(array_to_string(list_transform([60466176, 1679616, 46656, 1296, 36, 1],
               lambda p: substr('abcdefghijklmnopqrstuvwxyz0123456789',
                                CAST((h // p) % 36 AS INTEGER) + 1, 1)), ''), 'a') AS tail, h
        FROM f8),
    named AS (SELECT number, CASE WHEN h = 0 THEN 'a' ELSE tail END AS tag FROM tagged)
    """


def _devices(lake):
    number = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    return devices.assign_tags(lake.raw("customer").select(number.alias("number")))


@query("device_tags", TAGS + "SELECT number, tag FROM named")
def device_tags(lake):
    return _devices(lake)


@query(
    "device_tag_collisions",
    TAGS
    + """
    SELECT tag, count(DISTINCT number) AS devices, min(number) AS first_number, max(number) AS last_number
    FROM named GROUP BY 1 HAVING count(DISTINCT number) > 1
    """,
)
def device_tag_collisions(lake):
    return devices.tag_collisions(_devices(lake))


@query(
    "orphans",
    """
    WITH p AS (
        SELECT * REPLACE (CASE WHEN preset_id % 97 = 0 THEN -project_id - 1 ELSE project_id END AS project_id)
        FROM photos)
    SELECT 'photo without project' AS rule, 'photo' AS entity, photo_id AS id,
           CAST(project_id AS VARCHAR) AS detail
    FROM p WHERE project_id NOT IN (SELECT project_id FROM projects)
    UNION ALL
    SELECT 'project without photos', 'project', CAST(project_id AS VARCHAR), status
    FROM projects WHERE project_id NOT IN (SELECT project_id FROM p)
    UNION ALL
    SELECT 'cover photo missing', 'project', CAST(project_id AS VARCHAR), CAST(cover_slot AS VARCHAR)
    FROM projects
    WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.project_id = projects.project_id AND slot = cover_slot)
    """,
    "projects photos",
)
def orphans(lake):
    """Every project and photo; about one photo in a hundred points at a project that is not there."""
    strayed = F.when(F.col("preset_id") % 97 == 0, -F.col("project_id") - 1).otherwise(F.col("project_id"))
    return quality.orphans(lake.projects(), lake.photos().withColumn("project_id", strayed))


@query(
    "quality_report",
    """
    WITH c AS (SELECT project_id, count(*) AS n FROM photos GROUP BY 1)
    SELECT 'stored count differs' AS rule, 'project' AS entity, count(*) AS violations
    FROM projects p LEFT JOIN c ON c.project_id = p.project_id WHERE stored_count <> coalesce(n, 0)
    UNION ALL
    SELECT 'email not valid', 'user', count(*) FROM users
    WHERE NOT regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')
    UNION ALL
    SELECT 'plan not allowed', 'user', count(*) FROM users WHERE plan NOT IN ('free', 'pro', 'enterprise')
    UNION ALL
    SELECT 'status not allowed', 'upload', count(*) FROM queue
    WHERE status NOT IN ('queued', 'uploading', 'paused', 'error', 'synced')
    UNION ALL
    SELECT 'project without photos', 'project', count(*) FROM projects
    WHERE project_id NOT IN (SELECT project_id FROM photos)
    UNION ALL
    SELECT 'cover photo missing', 'project', count(*) FROM projects
    WHERE cover_slot NOT IN (SELECT slot FROM photos)
    """,
    "projects photos users queue",
)
def quality_report(lake):
    projects, photos = lake.projects(), lake.photos()
    counted = stats.photo_counts(photos).withColumnRenamed("photo_count", "actual_count")
    frames = [
        quality.count_violations(
            stats.reconcile(projects, counted, "project_id"), "project", "project_id"
        ),
        quality.invalid_emails(lake.users()),
        quality.enum_violations(projects, "project", "project_id", "status", C.PROJECT_STATUSES),
        quality.enum_violations(photos, "photo", "photo_id", "status", C.PHOTO_STATUSES),
        quality.enum_violations(photos, "photo", "photo_id", "upload_status", C.UPLOAD_STATUSES),
        quality.enum_violations(lake.queue(), "upload", "event_id", "status", C.UPLOAD_STATUSES),
        quality.enum_violations(lake.memberships(), "membership", "user_id", "role", C.MEMBER_ROLES),
        quality.enum_violations(lake.users(), "user", "user_id", "plan", C.PLANS),
        quality.orphans(projects, photos),
    ]
    found = quality.union_all(frames)
    return found.groupBy("rule", "entity").agg(F.count(F.lit(1)).alias("violations"))


@query(
    "duplicate_emails",
    """
    SELECT lower(trim(email)) AS email, count(*) AS users FROM users GROUP BY 1 HAVING count(*) > 1
    """,
    "users",
)
def duplicate_emails(lake):
    return quality.duplicate_emails(lake.users())


@query(
    "low_quality",
    """
    WITH s AS (
        SELECT project_id, CAST(1000 + project_id % 3000 AS INTEGER) AS px,
               CASE WHEN project_id % 3 = 0 THEN 40 END AS ex, project_id % 5 <> 0 AS gate
        FROM projects WHERE project_id % 2 = 0)
    SELECT photo_id, e.project_id, long_edge, exposure_quality
    FROM exif e LEFT JOIN s ON s.project_id = e.project_id
    WHERE coalesce(gate, true) AND (long_edge < coalesce(px, 2000) OR exposure_quality < coalesce(ex, 0))
    """,
    "projects exif",
)
def low_quality(lake):
    own = lake.projects().filter("project_id % 2 = 0").select(
        "project_id",
        (F.lit(1000) + F.col("project_id") % 3000).cast("int").alias("min_long_edge_px"),
        F.when(F.col("project_id") % 3 == 0, 40).alias("min_exposure_quality"),
        (F.col("project_id") % 5 != 0).alias("auto_flag_low_quality"),
    )
    return quality.low_quality(lake.exif(), own).filter("low_quality").drop("low_quality")


@query(
    "duplicate_captions",
    """
    SELECT sha256(text) AS checksum, count(*) AS copies, min(doc_id) AS first_id
    FROM documents GROUP BY 1 HAVING count(*) > 1
    """,
)
def duplicate_captions(lake):
    return quality.duplicate_assets(lake.raw("documents"), "doc_id", "text")


@query(
    "time_labels",
    """
    WITH d AS (
        SELECT event_id, ts, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) // 1000000 AS s FROM events)
    SELECT event_id,
           CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || 's ago' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ago'
                WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago'
                ELSE CAST(s // 86400 AS VARCHAR) || 'd ago' END AS short,
           CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ago'
                WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago'
                ELSE strftime(ts, '%-m/%-d/%Y') END AS minutes,
           CASE WHEN s < 3600 THEN 'Just now' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago'
                ELSE strftime(ts, '%-m/%-d/%Y') END AS hours
    FROM d
    """,
)
def time_labels(lake):
    ts = F.col("ts")
    return lake.events().select(
        "event_id",
        times.time_ago(ts, EVENTS_AS_OF).alias("short"),
        times.time_ago_minutes(ts, EVENTS_AS_OF).alias("minutes"),
        times.time_ago_hours(ts, EVENTS_AS_OF).alias("hours"),
    )


@query(
    "hours_of_day",
    """
    SELECT CAST(extract(hour FROM ts - INTERVAL 5 HOURS) AS INTEGER) AS local_hour, count(*) AS events
    FROM events GROUP BY 1
    """,
)
def hours_of_day(lake):
    hour = times.local_hour(F.col("ts"), "-05:00")
    return lake.events().groupBy(hour.alias("local_hour")).agg(F.count(F.lit(1)).alias("events"))


@query(
    "storage_bands",
    """
    WITH w AS (
        SELECT user_id, count(photo_id) * 25 AS used FROM projects p
        LEFT JOIN photos f ON f.project_id = p.project_id GROUP BY 1)
    SELECT user_id, used, CASE WHEN used * CAST(100 AS DOUBLE) / 1500 > 80 THEN 'error'
                               WHEN used * CAST(100 AS DOUBLE) / 1500 > 60 THEN 'warning' ELSE 'success' END AS band,
           CASE WHEN used * CAST(100 AS DOUBLE) / 1500 < 90 THEN 'OK' ELSE 'High' END AS disk
    FROM w
    """,
    "projects photos",
)
def storage_bands(lake):
    counted = lake.projects().join(stats.photo_counts(lake.photos()), "project_id", "left")
    used = counted.groupBy("user_id").agg(
        (F.sum(F.coalesce("photo_count", F.lit(0))) * C.MB_PER_PHOTO).alias("used")
    )
    total = F.lit(1500)
    return used.select(
        "user_id",
        "used",
        numbers.storage_band(F.col("used"), total).alias("band"),
        numbers.disk_band(F.col("used") * F.lit(100.0) / total).alias("disk"),
    )


@query(
    "slider_percents",
    """
    SELECT part.p_partkey AS preset_id, (p_size - 25 - CAST(-100 AS DOUBLE)) * 100 / 200 AS percent FROM part
    """,
)
def slider_percents(lake):
    value = (F.col("p_size") - 25).cast("double")
    return lake.raw("part").select(
        F.col("p_partkey").alias("preset_id"), numbers.slider_percent(value).alias("percent")
    )


@query(
    "display_names",
    """
    WITH p AS (
        SELECT p_partkey AS preset_id, CASE p_partkey % 8 WHEN 0 THEN 'none' WHEN 1 THEN '  '
               WHEN 2 THEN 'AMF1 - PADDOCK' WHEN 3 THEN 'AM - darkicy' WHEN 4 THEN 'AMF1 - GRIME'
               WHEN 5 THEN 'AMF1 - AMF1 - GRIME' WHEN 6 THEN 'AM - ' || p_name END AS stored
        FROM part)
    SELECT preset_id, CASE WHEN stored IS NULL OR trim(stored) = '' OR stored = 'none' THEN 'None'
                           WHEN stored = 'AMF1 - PADDOCK' THEN 'Paddock' WHEN stored = 'AM - darkicy' THEN 'Dark Icy'
                           WHEN stored = 'AMF1 - GRIME' THEN 'GRIME' WHEN stored = 'AMF1 - AMF1 - GRIME' THEN 'Grime'
                           ELSE substr(stored, 6) END AS shown
    FROM p
    """,
)
def display_names(lake):
    stored = F.get(
        F.array(
            F.lit("none"),
            F.lit("  "),
            F.lit("AMF1 - PADDOCK"),
            F.lit("AM - darkicy"),
            F.lit("AMF1 - GRIME"),
            F.lit("AMF1 - AMF1 - GRIME"),
            F.concat(F.lit("AM - "), F.col("p_name")),
            F.lit(None),
        ),
        (F.col("p_partkey") % 8).cast("int"),
    )
    return lake.raw("part").select(
        F.col("p_partkey").alias("preset_id"), text.preset_display_name(stored).alias("shown")
    )


@query(
    "exposure_values",
    """
    SELECT photo_id, CASE WHEN l % 3 = 0 THEN CAST(1 AS DOUBLE) / (q * 20) WHEN l % 3 = 1 THEN CAST(q AS DOUBLE) END AS seconds,
           CASE WHEN l % 4 <> 0 THEN CAST(CAST(l AS VARCHAR) || '.' || CAST(q % 10 AS VARCHAR) AS DOUBLE) END AS f_number,
           CASE l % 4 WHEN 0 THEN q / CAST(1024 AS DOUBLE) WHEN 1 THEN q * CAST(1024 AS DOUBLE)
                      WHEN 2 THEN CAST(q AS DOUBLE) END AS mb
    FROM (SELECT photo_id, CAST(slot % 10 AS INTEGER) AS l, (iso - 100) // 100 AS q
          FROM photos JOIN (SELECT photo_id, iso FROM exif) USING (photo_id))
    """,
    "photos exif",
)
def exposure_values(lake):
    line = lake.raw("lineitem")
    q = F.col("l_quantity").cast("int")
    n = F.col("l_linenumber")
    s = q.cast("string")
    shutter = (
        F.when(n % 3 == 0, F.concat(F.lit("1/"), (q * 20).cast("string")))
        .when(n % 3 == 1, F.concat(s, F.lit("s")))
        .otherwise("auto")
    )
    aperture = F.when(
        n % 4 != 0, F.concat(F.lit("f/"), n.cast("string"), F.lit("."), (q % 10).cast("string"))
    ).otherwise("wide")
    size = F.concat(
        s,
        F.when(n % 4 == 0, " KB").when(n % 4 == 1, " GB").when(n % 4 == 2, " MB").otherwise(" bits"),
    )
    return line.select(
        lake._photo_id().alias("photo_id"),
        numbers.parse_shutter(shutter).alias("seconds"),
        numbers.parse_aperture(aperture).alias("f_number"),
        numbers.parse_size_mb(size).alias("mb"),
    )


@query(
    "format_labels",
    """
    SELECT photo_id, CASE preset_id % 7 WHEN 0 THEN 'None' WHEN 1 THEN 'Black & White' WHEN 2 THEN 'Grain + Flares'
                          WHEN 3 THEN 'Cinematic' WHEN 4 THEN 'Vintage' WHEN 5 THEN 'Clean' ELSE 'None' END AS preset,
           CASE WHEN len(export_formats) = 1 THEN '16:9 Landscape'
                          ELSE CAST(len(export_formats) AS VARCHAR) || ' formats selected' END AS label,
           CASE camera_id % 4 WHEN 0 THEN 'Canon R5' WHEN 1 THEN 'Nikon Z6 II' WHEN 2 THEN 'Peter''s Sony A7iv'
                ELSE 'Camera' END AS camera
    FROM photos
    """,
    "photos",
)
def format_labels(lake):
    ids = F.array(F.lit("canon-r5"), F.lit("nikon-z6ii"), F.lit("sony-a7iv"), F.lit("other"))
    camera = F.get(ids, (F.col("camera_id") % 4).cast("int"))
    names = F.array(*[F.lit(x) for x in ("none", "bw", "grain", "cinematic", "vintage", "clean", "else")])
    preset = F.get(names, (F.col("preset_id") % 7).cast("int"))
    return lake.photos().select(
        "photo_id",
        text.label_map(preset, C.PRESET_LABELS, C.PRESET_DEFAULT).alias("preset"),
        text.formats_label("export_formats").alias("label"),
        text.label_map(camera, C.CAMERA_LABELS, C.CAMERA_DEFAULT).alias("camera"),
    )


@query(
    "default_tag_lists",
    """
    SELECT user_id, array_to_string(CASE WHEN user_id % 3 = 0 THEN CAST([] AS VARCHAR[])
           ELSE [name, coalesce(plan, 'x')] END, '|') AS tag_text,
           CASE WHEN user_id % 3 = 0 THEN 0 ELSE 2 END AS n
    FROM users
    """,
    "users",
)
def default_tag_lists(lake):
    raw = F.when(F.col("user_id") % 3 == 0, "").otherwise(
        F.concat(F.lit(" "), F.col("name"), F.lit(", ,"), F.coalesce("plan", F.lit("x")), F.lit(" ,"))
    )
    tags = csv_tags(raw)
    return lake.users().select(
        "user_id", F.array_join(tags, "|").alias("tag_text"), F.size(tags).alias("n")
    )


@query(
    "page_file_names",
    """
    WITH p AS (SELECT page_id, string_split(string_split(url, '/')[-1], '?')[1] AS bare FROM pages)
    SELECT page_id, CASE WHEN bare = '' THEN 'DSC_0001' ELSE bare END AS file_name FROM p
    """,
)
def page_file_names(lake):
    return lake.raw("pages").select("page_id", text.file_name("url").alias("file_name"))


@query(
    "status_words",
    """
    SELECT project_id, upper(substr(name, 1, 1)) || substr(name, 2) AS title,
           upper(substr(status, 1, 1)) || substr(status, 2) AS status_word
    FROM (SELECT project_id, lower(substr(name, 1, 1)) || substr(name, 2) || ' RAW' AS name, status FROM projects)
    """,
    "projects",
)
def status_words(lake):
    raw = F.concat(F.lower(F.left("name", F.lit(1))), F.substr("name", F.lit(2)), F.lit(" RAW"))
    return lake.projects().select(
        "project_id",
        text.capitalise_first(raw).alias("title"),
        text.capitalise_first("status").alias("status_word"),
    )
