"""Explicit schemas of the domain tables and files."""

from __future__ import annotations

USERS = """id string, email string, password_hash string, first_name string, last_name string,
    is_active boolean, created_at timestamp, updated_at timestamp"""

ORGANIZATIONS = """id string, name string, slug string, description string, is_active boolean,
    created_at timestamp, updated_at timestamp"""

MEMBERSHIPS = "id string, user_id string, organization_id string, role string, created_at timestamp"

PROJECTS = """id string, name string, description string, organization_id string,
    is_active boolean, created_at timestamp, updated_at timestamp"""

PHOTOS = """id string, projectId string, uri string, title string, description string,
    tags array<string>,
    metadata struct<camera:string, lens:string,
        settings:struct<iso:int, shutterSpeed:string, aperture:string, focalLength:int>,
        location:struct<latitude:double, longitude:double, name:string>, timestamp:string>,
    status string, presetApplied string, exportFormats array<string>, publishedAt string,
    createdAt string, updatedAt string, uploadProgress double, uploadStatus string"""

GALLERY_FIELDS = {
    "id": "string",
    "filename": "string",
    "uploaded_state": "string",
    "upload_progress": "double",
    "processed": "boolean",
    "favorite": "boolean",
    "tags": "array<string>",
}
GALLERY_ITEM = ", ".join(f"{n}:{t}" for n, t in GALLERY_FIELDS.items())
GALLERY_DOCUMENT = f"map<string, array<struct<{GALLERY_ITEM}>>>"

HEALTH = """check_time timestamp, check_type string, status string, details string,
    response_time_ms int"""

AUDIT = "ts string, op string, key string, user string, client string"

# The driver's tables, as far as they are bound to domain frames.
TESTDATA = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": """c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,
        c_mktsegment string""",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": """p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,
        p_retailprice double""",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,
        value double, props string""",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}
