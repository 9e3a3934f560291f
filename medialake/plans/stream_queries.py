"""Registered queries: file round trips and streams over the events.

The streams process what is there, in any number of batches, and return all of it; their SQL twins
are plain aggregates over the whole table. Files and parts go to the shared folder of the session.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake import catalogs as C
from medialake.operators import audit
from medialake.plans.registry import query
from medialake.session import scratch_path
from medialake.sources import documents, logs, sinks, tables
from medialake.streaming import monitors
from medialake.streaming.retention import KeptHistory
from medialake.streaming.runner import event_stream


def _naive(*columns: str):
    return {c: F.col(c).cast("timestamp_ntz") for c in columns}


@query(
    "gallery_round_trip",
    """
    SELECT photo_id AS id, CAST(project_id AS VARCHAR) AS project_id, title AS filename,
           status <> 'raw' AS processed, array_to_string(tags, ' ') AS tag_text
    FROM tagged_photos
    """,
    "tagged_photos",
)
def gallery_round_trip(lake):
    items = lake.tagged_photos().select(
        F.col("photo_id").alias("id"),
        "project_id",
        F.col("title").alias("filename"),
        F.lit("synced").alias("uploaded_state"),
        "upload_progress",
        (F.col("status") != "raw").alias("processed"),
        F.lit(False).alias("favorite"),
        "tags",
    )
    path = scratch_path(lake.spark, "gallery")
    documents.save_gallery(items, path, chunk=50, keys=lake.photos().select("project_id"))
    back = documents.load_gallery(lake.spark, path)
    return back.select(
        "id", "project_id", "filename", "processed", F.array_join("tags", " ").alias("tag_text")
    )


@query(
    "photo_file_scan",
    """
    SELECT photo_id, CAST(project_id AS VARCHAR) AS project_id, status, iso, camera, location,
           CASE WHEN project_id % 3 <> 0 THEN upload_progress END AS upload_progress, created_at
    FROM photos JOIN (SELECT photo_id, iso, camera, location FROM exif) USING (photo_id)
    """,
    "photos exif",
)
def photo_file_scan(lake):
    iso_time = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    nested = lake.shots().select(
        F.col("photo_id").alias("id"),
        F.col("project_id").cast("string").alias("projectId"),
        "status",
        F.struct(
            "camera",
            F.struct("iso").alias("settings"),
            F.struct(F.col("location").alias("name")).alias("location"),
        ).alias("metadata"),
        iso_time.alias("createdAt"),
        F.when(F.col("project_id") % 3 != 0, F.col("upload_progress")).alias("uploadProgress"),
    )
    path = scratch_path(lake.spark, "photo-files")
    # Nested JSON repeats its names in every row. A compressed file is read by one task, so it is bounded.
    nested.write.option("compression", "gzip").option("maxRecordsPerFile", 500_000).json(path)
    flat = tables.flatten_photos(tables.photo_files(lake.spark, path))
    return flat.select(
        "photo_id", "project_id", "status", "iso", "camera", "location", "upload_progress",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


@query(
    "audit_log_scan",
    """
    SELECT op, key, "user", client, count(*) AS lines, min(date_trunc('second', ts)) AS first_seen
    FROM audit GROUP BY ALL
    """,
    "audit",
)
def audit_log_scan(lake):
    fields = [F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.col("op"), F.col("key"), F.col("user")]
    line = F.concat_ws("|", *fields, F.col("client"))
    path = scratch_path(lake.spark, "audit")
    lake.audit().select(line.alias("value")).write.text(path)
    return (
        logs.read_audit(lake.spark, path)
        .groupBy("op", "key", "user", "client")
        .agg(F.count(F.lit(1)).alias("lines"), F.min("ts").cast("timestamp_ntz").alias("first_seen"))
    )


@query(
    "service_log_scan",
    """
    SELECT CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARN' WHEN 'view' THEN 'INFO'
                           WHEN 'signup' THEN 'LOG' END AS level,
           CASE WHEN event_type = 'signup' THEN strftime(ts, '%Y-%m-%d') END AS day, count(*) AS lines,
           min(CASE WHEN event_type = 'purchase' THEN 'plain ' ELSE '' END || 'user ' || CAST(user_id AS VARCHAR)) AS first_message
    FROM events GROUP BY 1, 2
    """,
)
def service_log_scan(lake):
    kind = F.col("event_type")
    message = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = (
        F.when(kind == "error", F.concat(F.lit("\x1b[0;31m[ERROR]\x1b[0m "), message))
        .when(kind == "click", F.concat(F.lit("\x1b[1;33m[WARN]\x1b[0m "), message))
        .when(kind == "view", F.concat(F.lit("[INFO] "), message))
        .when(kind == "signup", F.concat(F.lit("\x1b[0;32m["), stamp, F.lit("]\x1b[0m "), message))
        .otherwise(F.concat(F.lit("plain "), message))
    )
    path = scratch_path(lake.spark, "service-log")
    lake.events().select(line.alias("value")).write.text(path)
    read = logs.read_service_log(lake.spark, path)
    return read.groupBy("level", F.to_date("ts").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("lines"), F.min("message").alias("first_message")
    )


@query(
    "health_history_append",
    """
    SELECT strftime(check_time, '%Y-%m-%d') AS day, check_type, status, count(*) AS checks,
           CAST(sum(response_time_ms) AS BIGINT) AS total_ms
    FROM health GROUP BY 1, 2, 3
    """,
    "health",
)
def health_history_append(lake):
    path = scratch_path(lake.spark, "health")
    checks = lake.health().withColumn("check_time", F.col("check_time").cast("timestamp")).drop("event_id")
    for failed in (True, False):
        part = checks.filter((F.col("status") == "fail") == F.lit(failed))
        sinks.append_health(part, path)
    return (
        sinks.read_health(lake.spark, path)
        .groupBy(F.col("check_date").cast("string").alias("day"), "check_type", "status")
        .agg(
            F.count(F.lit(1)).alias("checks"),
            F.sum(F.col("response_time_ms").cast("long")).alias("total_ms"),
        )
    )


@query(
    "json_rows",
    """
    SELECT project_id, '{"project_id":' || CAST(project_id AS VARCHAR) || ',"name":"' || name || '","status":'
           || CASE WHEN status = 'draft' THEN 'null' ELSE '"' || status || '"' END || '}' AS report
    FROM projects
    """,
    "projects",
)
def json_rows(lake):
    rows = lake.projects().select(
        "project_id", "name", F.when(F.col("status") != "draft", F.col("status")).alias("status")
    )
    text = sinks.as_json(rows)
    return text.select(F.get_json_object("report", "$.project_id").cast("long").alias("project_id"), "report")


def _checks(lake):
    kind = F.col("event_type")
    return event_stream(lake.spark, lake.folder).select(
        F.col("ts").alias("check_time"),
        kind.alias("check_type"),
        F.when(kind == "error", "fail").otherwise("success").alias("status"),
        F.col("value").cast("int").alias("response_time_ms"),
    )


def _queue(lake):
    kind = F.col("event_type")
    state = (
        F.when(kind == "signup", "pending")
        .when(kind.isin("view", "click"), "syncing")
        .when(kind == "purchase", "completed")
        .otherwise("failed")
    )
    return event_stream(lake.spark, lake.folder).select(
        "event_id",
        "ts",
        F.col("user_id").alias("item_id"),
        state.alias("status"),
        F.get_json_object("props", "$.k").cast("double").alias("progress"),
    )


@query(
    "health_24h",
    """
    WITH w AS (
        SELECT check_type, status, response_time_ms,
               unnest(generate_series(date_trunc('hour', check_time) - INTERVAL 23 HOURS,
                                      date_trunc('hour', check_time), INTERVAL 1 HOUR)) AS start
        FROM health)
    SELECT check_type, start, start + INTERVAL 24 HOURS AS "end", count(*) AS checks,
           count(*) FILTER (status = 'fail') AS failures, CAST(sum(response_time_ms) AS BIGINT) AS total_ms
    FROM w GROUP BY 1, 2
    """,
    "health",
)
def health_24h(lake):
    return monitors.run_health_windows(_checks(lake)).withColumns(_naive("start", "end"))


@query(
    "check_buckets_stream",
    """
    SELECT check_type, time_bucket(INTERVAL 300 SECONDS, check_time, TIMESTAMP '1970-01-01') AS bucket,
           count(*) AS checks
    FROM health GROUP BY 1, 2
    """,
    "health",
)
def check_buckets_stream(lake):
    return monitors.run_check_buckets(_checks(lake)).withColumns(_naive("bucket"))


SESSIONS = """
    WITH s AS (
        SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL {gap} THEN 0 ELSE 1 END AS new
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM s)
    """


@query(
    "idle_sessions",
    SESSIONS.format(gap="600 SECONDS")
    + """
    SELECT user_id, min(ts) AS opened, max(ts) + INTERVAL 600 SECONDS AS closed, count(*) AS events
    FROM g GROUP BY user_id, n
    """,
)
def idle_sessions(lake):
    events = event_stream(lake.spark, lake.folder).select("user_id", "ts")
    closed = monitors.run_idle_sessions(events, "user_id", C.FTP_IDLE_SECONDS)
    return closed.withColumns(_naive("opened", "closed"))


@query(
    "notes_debounced",
    SESSIONS.format(gap="600 MILLISECONDS")
    + """
    SELECT user_id, max(ts) AS saved_at, arg_max(props, (ts, event_id)) AS props
    FROM g GROUP BY user_id, n
    """,
)
def notes_debounced(lake):
    edits = event_stream(lake.spark, lake.folder).select("user_id", "event_id", "ts", "props")
    saved = monitors.run_debounced(edits, "user_id", "props", "event_id")
    return saved.withColumns(_naive("saved_at"))


@query(
    "latest_state_stream",
    """
    SELECT item_id, arg_max(status, (ts, event_id)) AS status, arg_max(progress, (ts, event_id)) AS progress,
           max(ts) AS ts, count(*) FILTER (status = 'completed') AS completions
    FROM queue GROUP BY 1
    """,
    "queue",
)
def latest_state_stream(lake):
    states = monitors.run_latest_states(_queue(lake), "item_id", ["ts", "event_id"])
    return states.drop("event_id").withColumns(_naive("ts"))


@query(
    "audit_alerts",
    """
    SELECT event_id, ts, op, key FROM audit
    WHERE regexp_matches(op || ' | ' || key || ' | ' || "user" || coalesce(' | ' || client, ''), '(DELETE|FAIL|user7)')
    """,
    "audit",
)
def audit_alerts(lake):
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    op = (
        F.when(kind == "signup", "STORE")
        .when(kind == "view", "RETRIEVE")
        .when(kind == "purchase", "ROTATE")
        .when(kind == "click", "DELETE")
        .otherwise("FAIL")
    )
    lines = event_stream(lake.spark, lake.folder).select(
        "event_id",
        "ts",
        op.alias("op"),
        F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("key"),
        F.concat(F.lit("user"), (k % 10).cast("string")).alias("user"),
        F.when(k % 4 != 0, F.concat(F.lit("host"), (k % 3).cast("string"))).alias("client"),
    )
    found = monitors.run_audit_alerts(lines, "(DELETE|FAIL|user7)", "event_id")
    return found.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "op", "key")


@query(
    "audit_alerts_batch",
    """
    SELECT event_id, ts, op, key FROM audit
    WHERE regexp_matches(op || ' | ' || key || ' | ' || "user" || coalesce(' | ' || client, ''), '(DELETE|FAIL|user7)')
    """,
    "audit",
)
def audit_alerts_batch(lake):
    return audit.alerts(lake.audit(), "(DELETE|FAIL|user7)").select("event_id", "ts", "op", "key")


@query(
    "syncs_24h",
    """
    WITH w AS (
        SELECT item_id, unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR,
                                               date_trunc('hour', ts) + INTERVAL 24 HOURS, INTERVAL 1 HOUR)) AS until
        FROM queue WHERE status = 'completed')
    SELECT item_id, until, count(*) AS syncs FROM w GROUP BY 1, 2
    """,
    "queue",
)
def syncs_24h(lake):
    return monitors.run_syncs_per_day(_queue(lake), "item_id").withColumns(_naive("until"))


@query(
    "history_kept_streaming",
    """
    SELECT event_id, check_time, check_type, status FROM health
    WHERE CAST(check_time AS DATE) >= (SELECT max(CAST(check_time AS DATE)) FROM health) - INTERVAL 10 DAYS
    """,
    "health",
)
def history_kept_streaming(lake):
    """Checks as a stream of several files in no order of time, into a history that keeps ten days; then
    every batch once more, as after a lost checkpoint."""
    checks = lake.health().select("event_id", "check_time", "check_type", "status")
    root = scratch_path(lake.spark, "kept-history")
    checks.repartition(3, "event_id").write.parquet(f"{root}/arriving")
    schema = "event_id bigint, check_time timestamp_ntz, check_type string, status string"
    stream = lake.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/arriving")
    history = KeptHistory(lake.spark, root, schema, "check_time", 10)
    history.run(stream, "first")
    return history.run(stream, "again")
