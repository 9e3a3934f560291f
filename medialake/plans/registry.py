"""Registry of queries: a builder over the lake, and where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from medialake.bindings import Lake
from medialake.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The domain frames in SQL, in an order in which later ones may use earlier ones.
FRAMES = {
    "users": """
        SELECT c_custkey AS user_id, c_name AS name,
               CASE WHEN c_mktsegment <> 'BUILDING' THEN lower(c_mktsegment) END AS plan,
               CASE WHEN c_custkey % 7 = 0 THEN 'no mail'
                    ELSE 'User' || CAST(c_custkey % 1000 AS VARCHAR) END || '@example.org' AS email,
               c_acctbal > 0 AS is_active
        FROM customer""",
    "organizations": """
        SELECT n_nationkey AS org_id, n_name AS org_name, lower(n_name) AS slug FROM nation""",
    "memberships": """
        SELECT c_custkey AS user_id, unnest([c_nationkey, (c_nationkey + 1) % 25]) AS org_id,
               CASE WHEN c_custkey % 10 = 0 THEN 'admin' WHEN c_custkey % 10 <= 6 THEN 'member'
                    ELSE 'viewer' END AS role
        FROM customer""",
    "projects": """
        SELECT o_orderkey AS project_id,
               'Shoot ' || lower(substr(o_orderpriority, 3)) || ' ' || CAST(o_orderkey AS VARCHAR) AS name,
               o_custkey AS user_id,
               CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'archived' ELSE 'draft' END AS status,
               o_orderdate AS updated_at,
               CAST(trunc(o_totalprice / 100000) AS BIGINT) AS stored_count,
               o_orderkey % 2500 AS default_preset_id,
               o_custkey % 100 AS camera_id,
               o_orderkey * 10 + 1 AS cover_slot
        FROM orders""",
    "tenant_projects": """
        SELECT p.*, c_nationkey AS org_id FROM projects p JOIN customer ON c_custkey = p.user_id""",
    "photos": """
        SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                   CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                   strftime(l_shipdate, '%Y-%m-%d')) AS photo_id,
               l_orderkey AS project_id, l_orderkey * 10 + l_linenumber AS slot,
               l_suppkey AS camera_id, l_partkey AS preset_id,
               CASE WHEN l_returnflag = 'A' THEN 'published' WHEN l_returnflag = 'R' THEN 'exported'
                    WHEN l_linestatus = 'F' THEN 'processed' ELSE 'raw' END AS status,
               l_shipdate AS created_at, l_shipdate AS updated_at,
               l_discount * CAST(10 AS DOUBLE) AS upload_progress,
               CASE l_linenumber % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'uploading' WHEN 2 THEN 'paused'
                    WHEN 3 THEN 'error' WHEN 4 THEN 'synced' END AS upload_status,
               'DSC_' || printf('%04d', l_linenumber * 100 + CAST(l_quantity AS INTEGER)) AS original,
               list_slice(['16x9', '1x1', '9x16'], 1, 1 + l_linenumber % 3) AS export_formats
        FROM lineitem""",
    "tagged_photos": """
        SELECT photos.*, p_name AS title, p_brand AS description,
               list_append(string_split(p_name, ' '), lower(p_type)) AS tags
        FROM photos JOIN part ON p_partkey = preset_id""",
    "search_assets": """
        SELECT photos.*, p_name AS title, list_append(string_split(p_name, ' '), lower(p_type)) AS tags,
               CASE WHEN p_size % 4 <> 3 THEN p_brand END AS preset_name,
               CASE WHEN camera_id % 5 <> 4 THEN ['canon', 'sony', 'nikon', 'film'][camera_id % 4 + 1] END AS camera,
               CASE WHEN camera_id % 7 <> 6 THEN ['Race track', 'Portrait studio', 'Mountain park',
                    'City street', 'Beach', 'Warehouse'][camera_id % 6 + 1] END AS location
        FROM photos JOIN part ON p_partkey = preset_id""",
    "exif": """
        SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                   CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                   strftime(l_shipdate, '%Y-%m-%d')) AS photo_id,
               l_orderkey AS project_id, l_partkey AS preset_id,
               CAST(100 + l_quantity * 100 AS INTEGER) AS iso, l_partkey % 24 AS hour,
               ['Race track', 'Portrait studio', 'Mountain park', 'City street', 'Beach',
                'Warehouse'][l_suppkey % 6 + 1] AS location,
               ['canon', 'sony', 'nikon', 'film'][l_suppkey % 4 + 1] AS camera,
               CASE WHEN l_suppkey % 10 <> 9
                    THEN CAST(1.4 AS DOUBLE) + CAST(0.7 AS DOUBLE) * l_linenumber END AS aperture,
               CAST(1 AS DOUBLE) / (CAST(20 AS DOUBLE) * l_quantity) AS shutter,
               CAST(trunc(l_extendedprice / 20) AS INTEGER) AS long_edge,
               l_quantity * 2 AS exposure_quality
        FROM lineitem""",
    "presets": """
        SELECT p_partkey AS preset_id,
               concat_ws(' ', p_name, CASE p_size % 10 WHEN 0 THEN 'Night Shooter' WHEN 1 THEN 'Portrait Pro'
                    WHEN 2 THEN 'Landscape Master' WHEN 3 THEN 'urban edge' WHEN 4 THEN 'Vintage FILM' END) AS name,
               concat_ws(' ', p_brand, CASE WHEN p_size % 10 = 5 THEN 'monochrome with rich blacks' END) AS description,
               p_type AS category, p_partkey % 1500 AS owner_id, p_size % 2 = 0 AS is_public,
               p_size % 3 = 0 AS shared
        FROM part""",
    "cameras": """
        SELECT s_suppkey AS camera_id, s_suppkey AS owner_id, s_name AS camera_name FROM supplier""",
    "ev": """
        SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "health": """
        SELECT event_id, ts AS check_time, event_type AS check_type,
               CASE WHEN event_type = 'error' THEN 'fail' ELSE 'success' END AS status,
               props AS details, CAST(trunc(value) AS INTEGER) AS response_time_ms
        FROM ev""",
    "queue": """
        SELECT event_id, ts, user_id AS item_id,
               CASE WHEN event_type = 'signup' THEN 'pending' WHEN event_type IN ('view', 'click') THEN 'syncing'
                    WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS status,
               CAST(k AS DOUBLE) AS progress
        FROM ev""",
    "audit": """
        SELECT event_id, ts,
               CASE event_type WHEN 'signup' THEN 'STORE' WHEN 'view' THEN 'RETRIEVE'
                    WHEN 'purchase' THEN 'ROTATE' WHEN 'click' THEN 'DELETE' ELSE 'FAIL' END AS op,
               'key-' || CAST(user_id AS VARCHAR) AS key, 'user' || CAST(k % 10 AS VARCHAR) AS "user",
               CASE WHEN k % 4 <> 0 THEN 'host' || CAST(k % 3 AS VARCHAR) END AS client,
               k >= 20 AS succeeded
        FROM ev""",
    "captions": """
        SELECT doc_id, string_split(text, chr(10))[1] AS title, text AS description, lang, source
        FROM documents""",
    "edits": """
        SELECT conv_id AS item_id, turn, role AS action, CAST(length(text) % 21 AS DOUBLE) AS exposure,
               CASE WHEN turn % 3 <> 1 THEN CAST(length(text) % 7 AS DOUBLE) END AS contrast
        FROM conversations""",
}
NEEDS = {
    "tenant_projects": ["projects"],
    "tagged_photos": ["photos"],
    "search_assets": ["photos"],
    "health": ["ev"],
    "queue": ["ev"],
    "audit": ["ev"],
}


def with_frames(body: str, frames: str) -> str:
    """The SQL body preceded by the named domain frames."""
    wanted: set[str] = set()

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        wanted.add(name)

    for name in frames.split():
        need(name)
    parts = [f"{n} AS ({FRAMES[n].strip()})" for n in FRAMES if n in wanted]
    body = body.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None, frames: str = ""):
    """Register a builder ``Lake -> DataFrame`` under a name, with its SQL twin if there is one."""

    def register(build: Callable[[Lake], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Lake(tune(spark), folder))

        run.__name__ = name
        run.__doc__ = build.__doc__
        run.source = build.__module__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_frames(sql, frames)
        return build

    return register
