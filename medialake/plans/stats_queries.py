"""Registered queries: statistics, queues, health and audit reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.bindings import EVENTS_AS_OF, ORDERS_AS_OF
from medialake.functions.numbers import round_half_up
from medialake.operators import audit, health, stats, tagging
from medialake.operators import presets as P
from medialake.operators.filters import not_revoked
from medialake.plans.registry import query


# Every table of the lake, in the order in which the report lists them.
TABLES = [
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem",
    "nation", "orders", "pages", "part", "region", "supplier",
]
TABLE_COUNTS = (
    "'{' || " + " || ',' || ".join(f"'\"{t}\":' || (SELECT count(*) FROM {t})" for t in TABLES) + " || '}'"
)


def _tables(lake):
    return {t: lake.raw(t) for t in TABLES}


@query(
    "project_stats",
    """
    WITH c AS (
        SELECT project_id, count(*) AS n, count(*) FILTER (status <> 'raw') AS pr,
               count(*) FILTER (status IN ('exported', 'published')) AS ex, count(*) FILTER (status = 'published') AS pu,
               max(updated_at) AS last
        FROM tagged_photos GROUP BY 1),
    t AS (
        SELECT project_id, count(DISTINCT tag) AS tags
        FROM (SELECT project_id, unnest(tags) AS tag FROM tagged_photos) GROUP BY 1)
    SELECT p.project_id, coalesce(n, 0) AS total_photos, coalesce(pr, 0) AS processed_photos,
           coalesce(ex, 0) AS exported_photos, coalesce(pu, 0) AS published_photos,
           coalesce(tags, 0) AS total_tags, coalesce(last, TIMESTAMP '2001-12-01') AS last_activity
    FROM projects p LEFT JOIN c ON c.project_id = p.project_id LEFT JOIN t ON t.project_id = p.project_id
    """,
    "projects tagged_photos",
)
def project_stats(lake):
    return stats.project_stats(
        lake.projects(), lake.photos(), ORDERS_AS_OF, tagged=lake.tagged_photos()
    )


@query(
    "user_stats",
    """
    WITH w AS (
        SELECT user_id, count(DISTINCT p.project_id) AS np, count(photo_id) AS nf
        FROM projects p LEFT JOIN photos f ON f.project_id = p.project_id GROUP BY 1),
    r AS (SELECT owner_id, count(*) AS n FROM presets GROUP BY 1),
    k AS (SELECT owner_id, count(*) AS n FROM cameras GROUP BY 1)
    SELECT u.user_id, coalesce(np, 0) AS total_projects, coalesce(nf, 0) AS total_photos,
           coalesce(r.n, 0) AS total_presets, coalesce(k.n, 0) AS total_cameras,
           coalesce(nf, 0) * 25 AS storage_mb, coalesce(plan, 'free') AS plan
    FROM users u LEFT JOIN w ON w.user_id = u.user_id LEFT JOIN r ON r.owner_id = u.user_id
    LEFT JOIN k ON k.owner_id = u.user_id
    """,
    "users projects photos presets cameras",
)
def user_stats(lake):
    return stats.user_stats(
        lake.users(), lake.projects(), lake.photos(), lake.presets(), lake.cameras()
    )


@query(
    "quick_stats",
    """
    SELECT count(*) AS projects, count(*) FILTER (status = 'active') AS active_projects,
           (SELECT count(*) FROM organizations) AS organizations
    FROM projects
    """,
    "projects organizations",
)
def quick_stats(lake):
    return stats.quick_stats(lake.projects(), lake.organizations())


@query(
    "projects_per_org",
    """
    SELECT o.org_id, o.org_name, count(p.project_id) AS projects
    FROM organizations o LEFT JOIN tenant_projects p ON p.org_id = o.org_id GROUP BY 1, 2
    """,
    "organizations tenant_projects",
)
def projects_per_org(lake):
    return stats.projects_per_org(lake.organizations(), lake.tenant_projects())


@query(
    "queue_summary",
    """
    SELECT item_id, count(*) AS items, count(*) FILTER (status = 'pending') AS pending,
           count(*) FILTER (status = 'syncing') AS syncing, count(*) FILTER (status = 'failed') AS failed,
           avg(progress) AS mean_progress,
           CAST(floor(avg(progress) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS shown_progress,
           bool_and(status = 'completed') AS all_completed, bool_or(status = 'syncing') AS any_syncing,
           CAST(count(*) FILTER (status = 'completed') AS DOUBLE) / count(*) AS done_ratio
    FROM queue GROUP BY 1
    """,
    "queue",
)
def queue_summary(lake):
    return stats.queue_summary(lake.queue(), ["item_id"])


@query(
    "collaborators_online",
    """
    SELECT org_id, count(*) FILTER (is_active) AS online, count(*) AS collaborators,
           bool_or(is_active) AS any_online
    FROM memberships JOIN users USING (user_id) GROUP BY 1
    """,
    "memberships users",
)
def collaborators_online(lake):
    online = lake.users().select("user_id", F.col("is_active").alias("is_online"))
    return stats.presence(lake.memberships().join(online, "user_id"), ["org_id"])


@query(
    "table_counts_json",
    """
    SELECT """
    + TABLE_COUNTS
    + """ AS table_counts
    """,
)
def table_counts_json(lake):
    return stats.table_counts(_tables(lake))


@query(
    "hit_ratio",
    """
    SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(100 - k) AS BIGINT) AS hits,
           CAST(sum(k) AS BIGINT) AS reads,
           round(sum(100 - k) * CAST(100 AS DOUBLE) / (sum(100 - k) + sum(k)), 2) AS hit_ratio
    FROM ev GROUP BY 1
    """,
    "ev",
)
def hit_ratio(lake):
    events = lake.events().withColumn("day", F.to_date("ts").cast("string"))
    return stats.hit_ratio(events, F.lit(100) - F.col("k"), F.col("k"), ["day"])


@query(
    "slow_ops",
    """
    SELECT user_id, count(*) FILTER (event_type <> 'view') AS active,
           count(*) FILTER (event_type <> 'view' AND value > 1) AS slow
    FROM events GROUP BY 1
    """,
)
def slow_ops(lake):
    return stats.slow_ops(lake.events(), F.col("event_type") != "view", F.col("value"), ["user_id"])


@query(
    "check_pass_ratio",
    """
    SELECT CAST(date_trunc('hour', check_time) AS TIMESTAMP) AS run, count(*) FILTER (status = 'success') AS passed,
           count(*) AS checks, bool_and(status = 'success') AS all_passed
    FROM health GROUP BY 1
    """,
    "health",
)
def check_pass_ratio(lake):
    return stats.pass_ratio(lake.health().withColumn("run", F.date_trunc("HOUR", "check_time").cast("timestamp_ntz")), "run")


@query(
    "preset_usage",
    """
    SELECT p.preset_id, p.name, count(f.photo_id) AS applied_count
    FROM presets p LEFT JOIN photos f ON f.preset_id = p.preset_id GROUP BY 1, 2
    """,
    "presets photos",
)
def preset_usage(lake):
    return P.preset_usage(lake.presets(), lake.photos())


@query(
    "facet_counts",
    """
    WITH s AS (SELECT *, coalesce(upload_status = 'synced', false) AS synced FROM photos)
    SELECT 'synced' AS facet, count(*) FILTER (synced) AS photos FROM s
    UNION ALL SELECT 'unsynced', count(*) FILTER (NOT synced) FROM s
    UNION ALL SELECT 'published', count(*) FILTER (status = 'published') FROM s
    UNION ALL SELECT 'edited', count(*) FILTER (status <> 'raw') FROM s
    UNION ALL SELECT 'unedited', count(*) FILTER (status = 'raw') FROM s
    UNION ALL SELECT 'preset-applied', count(preset_id) FROM s
    UNION ALL SELECT camera_name, count(*) FROM photos JOIN cameras USING (camera_id) GROUP BY 1
    """,
    "photos cameras",
)
def facet_counts(lake):
    return stats.facet_counts(lake.photos(), lake.cameras())


@query(
    "project_panel",
    """
    WITH c AS (
        SELECT project_id, count(*) AS n, count(*) FILTER (status = 'published') AS pu, count(*) FILTER (status = 'raw') AS un
        FROM photos GROUP BY 1)
    SELECT p.project_id, p.name AS title, coalesce(n, 0) AS photo_count, coalesce(pu, 0) AS published_count,
           coalesce(un, 0) AS unedited_count, r.name AS preset_name, k.camera_name AS camera
    FROM projects p LEFT JOIN c ON c.project_id = p.project_id
    LEFT JOIN presets r ON r.preset_id = p.default_preset_id LEFT JOIN cameras k ON k.camera_id = p.camera_id
    """,
    "projects photos presets cameras",
)
def project_panel(lake):
    return stats.project_panel(lake.projects(), lake.photos(), lake.presets(), lake.cameras())


@query(
    "count_reconciliation",
    """
    WITH c AS (SELECT project_id, count(*) AS n FROM photos GROUP BY 1)
    SELECT p.project_id, stored_count, coalesce(n, 0) AS actual_count, stored_count - coalesce(n, 0) AS delta,
           stored_count = coalesce(n, 0) AS matches
    FROM projects p LEFT JOIN c ON c.project_id = p.project_id
    """,
    "projects photos",
)
def count_reconciliation(lake):
    counted = stats.photo_counts(lake.photos()).withColumnRenamed("photo_count", "actual_count")
    return stats.reconcile(lake.projects(), counted, "project_id")


@query(
    "tag_reconciliation",
    """
    WITH u AS (SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct(tags)) AS tag FROM tagged_photos) GROUP BY 1),
    s AS (SELECT lower(p_type) AS tag, count(*) AS stored_count FROM part GROUP BY 1)
    SELECT tag, stored_count, coalesce(n, 0) AS actual_count, stored_count - coalesce(n, 0) AS delta,
           stored_count = coalesce(n, 0) AS matches
    FROM s LEFT JOIN u USING (tag)
    """,
    "tagged_photos",
)
def tag_reconciliation(lake):
    """Stored usage of the type tags, one for each preset of the type, against real usage on photos."""
    stored = lake.raw("part").groupBy(F.lower("p_type").alias("tag")).agg(F.count(F.lit(1)).alias("stored_count"))
    used = tagging.tag_usage(lake.tagged_photos()).withColumnRenamed("usage", "actual_count")
    return stats.reconcile(stored, used, "tag")


@query(
    "audit_daily_metrics",
    """
    SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (op = 'STORE') AS issued, count(*) FILTER (op = 'ROTATE') AS renewals,
           round(count(*) FILTER (op = 'ROTATE' AND succeeded) * CAST(100 AS DOUBLE) / nullif(count(*) FILTER (op = 'ROTATE'), 0), 2)
             AS renewal_success_rate,
           count(*) FILTER (op = 'DELETE') AS revoked, count(*) FILTER (op = 'FAIL') AS failed_attempts
    FROM audit GROUP BY 1
    """,
    "audit",
)
def audit_daily_metrics(lake):
    return audit.daily_metrics(lake.audit()).withColumn("day", F.col("day").cast("string"))


@query(
    "key_lifetimes",
    """
    WITH i AS (SELECT key, min(ts) FILTER (op = 'STORE') AS issued_at FROM audit GROUP BY 1),
    r AS (SELECT a.key, min(a.ts) AS revoked_at FROM audit a JOIN i ON i.key = a.key
          WHERE a.op = 'DELETE' AND a.ts >= i.issued_at GROUP BY 1)
    SELECT i.key, issued_at, revoked_at,
           (epoch_us(revoked_at) - epoch_us(issued_at)) // 1000000 AS seconds_to_revocation
    FROM i LEFT JOIN r ON r.key = i.key
    """,
    "audit",
)
def key_lifetimes(lake):
    return audit.key_lifetimes(lake.audit())


@query(
    "key_states",
    """
    SELECT key, arg_max(op, (ts, event_id)) AS last_op, max(ts) AS changed_at,
           count(*) FILTER (op = 'ROTATE') AS rotations, arg_max(op, (ts, event_id)) = 'DELETE' AS revoked
    FROM audit WHERE op IN ('STORE', 'ROTATE', 'DELETE') GROUP BY 1
    """,
    "audit",
)
def key_states(lake):
    return audit.key_states(lake.audit(), ["ts", "event_id"])


@query(
    "expiry_report",
    """
    WITH c AS (
        SELECT CASE WHEN user_id % 3 = 0 THEN 'host' ELSE 'user' END AS kind, CAST(ts AS DATE) AS d
        FROM events WHERE event_type = 'signup'),
    l AS (
        SELECT kind, CAST(date_diff('day', DATE '2024-04-10',
                     CAST(d + CASE kind WHEN 'host' THEN 365 ELSE 90 END AS DATE)) AS INTEGER) AS days_left
        FROM c)
    SELECT kind, CASE WHEN days_left < 0 THEN 'expired' WHEN days_left <= 7 THEN 'within 7 days'
                      WHEN days_left <= 15 THEN 'within 15 days' WHEN days_left <= 30 THEN 'within 30 days'
                      ELSE 'valid' END AS band,
           count(*) AS certificates, min(days_left) AS soonest_days
    FROM l GROUP BY 1, 2
    """,
)
def expiry_report(lake):
    issued = lake.events().filter("event_type = 'signup'").select(
        F.when(F.col("user_id") % 3 == 0, "host").otherwise("user").alias("kind"),
        F.col("ts").alias("issued_at"),
    )
    return audit.expiry_report(issued, "2024-04-10")


@query(
    "recent_checks",
    """
    SELECT event_id, check_time, check_type, status, response_time_ms FROM health
    WHERE check_time > TIMESTAMP '2024-01-31' - INTERVAL 24 HOURS ORDER BY check_time DESC, event_id
    """,
    "health",
)
def recent_checks(lake):
    seen = health.recent_checks(lake.health(), EVENTS_AS_OF)
    return seen.select("event_id", "check_time", "check_type", "status", "response_time_ms")


@query(
    "health_report",
    """
    SELECT '{"status":"healthy","timestamp":"2024-01-31 00:00:00","database":"healthy","uptime":'
           || CAST((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(min(check_time))) // 1000000 AS VARCHAR)
           || ',"table_counts":' || """
    + TABLE_COUNTS
    + """ || ',"version":"1.0.0"}' AS report
    FROM health
    """,
    "health",
)
def health_report(lake):
    return health.health_report(lake.health(), stats.table_counts(_tables(lake)), EVENTS_AS_OF)


@query(
    "performance_report",
    """
    SELECT '{"active_connections":' || CAST(count(*) FILTER (event_type <> 'view') AS VARCHAR) || ',"cache_hit_ratio":'
           || CAST(round(sum(100 - k) * CAST(100 AS DOUBLE) / (sum(100 - k) + sum(k)), 2) AS VARCHAR)
           || ',"slow_queries":' || CAST(count(*) FILTER (event_type <> 'view' AND value > 1) AS VARCHAR)
           || ',"timestamp":"2024-01-31 00:00:00"}' AS report
    FROM ev
    """,
    "ev",
)
def performance_report(lake):
    return health.performance_report(
        lake.events(),
        active=F.col("event_type") != "view",
        seconds=F.col("value"),
        hits=F.lit(100) - F.col("k"),
        reads=F.col("k"),
        as_of=EVENTS_AS_OF,
    )


@query(
    "key_lifetime_summary",
    """
    WITH i AS (SELECT key, min(ts) FILTER (op = 'STORE') AS issued_at FROM audit GROUP BY 1),
    r AS (SELECT a.key, min(a.ts) AS revoked_at FROM audit a JOIN i ON i.key = a.key
          WHERE a.op = 'DELETE' AND a.ts >= i.issued_at GROUP BY 1),
    s AS (SELECT issued_at, revoked_at, (epoch_us(revoked_at) - epoch_us(issued_at)) // 1000000 AS s
          FROM i LEFT JOIN r ON r.key = i.key)
    SELECT count(issued_at) AS issued, count(revoked_at) AS revoked,
           CAST(sum(s) AS DOUBLE) / count(s) AS mean_seconds, min(s) AS shortest_seconds FROM s
    """,
    "audit",
)
def key_lifetime_summary(lake):
    return audit.lifetime_summary(audit.key_lifetimes(lake.audit()))


@query(
    "live_keys",
    """
    SELECT key AS key_id, rotations FROM (
        SELECT key, arg_max(op, (ts, event_id)) AS last_op, count(*) FILTER (op = 'ROTATE') AS rotations
        FROM audit WHERE op IN ('STORE', 'ROTATE', 'DELETE') GROUP BY 1)
    WHERE last_op <> 'DELETE'
    """,
    "audit",
)
def live_keys(lake):
    states = audit.key_states(lake.audit(), ["ts", "event_id"]).withColumnRenamed("key", "key_id")
    return not_revoked(states).select("key_id", "rotations")


@query(
    "check_buckets",
    """
    SELECT check_type, time_bucket(INTERVAL 300 SECONDS, check_time, TIMESTAMP '1970-01-01') AS bucket,
           count(*) AS checks, count(*) FILTER (status = 'fail') AS failures
    FROM health GROUP BY 1, 2
    """,
    "health",
)
def check_buckets(lake):
    return health.check_buckets(lake.health())


@query(
    "missed_checks",
    """
    WITH b AS (
        SELECT DISTINCT check_type, time_bucket(INTERVAL 300 SECONDS, check_time, TIMESTAMP '1970-01-01') AS bucket
        FROM health),
    e AS (
        SELECT check_type, unnest(generate_series(min(bucket), max(bucket), INTERVAL 300 SECONDS)) AS bucket
        FROM b GROUP BY 1)
    SELECT * FROM e ANTI JOIN b USING (check_type, bucket)
    """,
    "health",
)
def missed_checks(lake):
    return health.missed_buckets(lake.health())


@query(
    "syncs_last_day",
    """
    SELECT item_id, count(*) AS syncs FROM queue
    WHERE status = 'completed' AND ts > TIMESTAMP '2024-01-31' - INTERVAL 24 HOURS GROUP BY 1
    """,
    "queue",
)
def syncs_last_day(lake):
    return health.syncs_last_day(lake.queue(), EVENTS_AS_OF, "item_id")


@query(
    "latest_per_item",
    """
    SELECT item_id, arg_max(status, (ts, event_id)) AS status, arg_max(progress, (ts, event_id)) AS progress,
           max(ts) AS at, count(*) FILTER (status = 'completed') AS completions
    FROM queue GROUP BY 1
    """,
    "queue",
)
def latest_per_item(lake):
    return health.latest_states(lake.queue(), "item_id", ["ts", "event_id"])


@query(
    "idle_sessions_batch",
    """
    WITH s AS (
        SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 600 SECONDS THEN 0 ELSE 1 END AS new
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM s)
    SELECT user_id, min(ts) AS opened, max(ts) AS last_active, max(ts) + INTERVAL 600 SECONDS AS closed,
           count(*) AS events
    FROM g GROUP BY user_id, n
    """,
)
def idle_sessions_batch(lake):
    return health.idle_sessions(lake.events(), "user_id", 600)


@query(
    "rounded_progress",
    """
    SELECT event_type, CAST(floor(avg(k) - CAST(50 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS shifted
    FROM ev GROUP BY 1
    """,
    "ev",
)
def rounded_progress(lake):
    shifted = round_half_up(F.avg("k") - F.lit(50.0)).alias("shifted")
    return lake.events().groupBy("event_type").agg(shifted)
