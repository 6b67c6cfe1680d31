"""Registered queries: scalar rules and formatters applied over derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as FX
from .. import schema as S
from ..functions import dtypes as DT
from ..functions import formatting as FM
from ..functions import kinds as K
from ..functions import names as N
from ..functions import properties as PR
from ..functions import uris as U
from ..operators import forms
from ..operators import requests as RQ
from .fixture_sql import with_fixtures
from .q_listing import format_bytes_sql
from .registry import query

MSG = S.NAME_FORMAT_MESSAGE.replace("'", "''")
SEG_RE = "[a-z][a-z0-9_]*"


def name_error_sql(n: str) -> str:
    segs = f"string_split({n}, '.')"
    bad = f"list_filter({segs}, lambda s: s = '' OR NOT regexp_full_match(s, '{SEG_RE}'))[1]"
    return (f"CASE WHEN {n} IS NULL OR {n} = '' THEN 'Name must not be empty.' "
            f"WHEN len({segs}) > 2 THEN 'Name ''' || {n} || ''' has too many dot-separated segments (max 2). {MSG}' "
            f"WHEN {bad} = '' THEN 'Name ''' || {n} || ''' has an empty segment. {MSG}' "
            f"WHEN {bad} IS NOT NULL THEN 'Name segment ''' || {bad} || ''' is invalid. {MSG}' END")


def name_code_sql(n: str) -> str:
    segs = f"string_split({n}, '.')"
    bad = f"list_filter({segs}, lambda s: s = '' OR NOT regexp_full_match(s, '{SEG_RE}'))[1]"
    return (f"CASE WHEN {n} IS NULL OR {n} = '' THEN 'empty' WHEN len({segs}) > 2 THEN 'too_many' "
            f"WHEN {bad} = '' THEN 'empty_segment' WHEN {bad} IS NOT NULL THEN 'bad_segment' END")


@query("valid_name", with_fixtures(
    f"SELECT seq, name, {name_code_sql('name')} AS error_code, {name_error_sql('name')} AS error_message FROM cat_candidates",
    "cat_candidates"))
def valid_name(spark, d):
    c = FX.candidates(spark, d)
    return c.select("seq", "name", N.name_error_code("name").alias("error_code"), N.name_error("name").alias("error_message"))


@query("base_name", with_fixtures(
    "SELECT seq, name, split_part(name, '.', 1) AS base FROM cat_candidates", "cat_candidates"))
def base_name(spark, d):
    return FX.candidates(spark, d).select("seq", "name", N.base_name("name").alias("base"))


NODE_RE = "(root_id|supervoxel_id|level[0-9]+_id)"


@query("valid_node_level", with_fixtures(
    f"SELECT asset_id, pos, tie, node_level, coalesce(regexp_full_match(node_level, '{NODE_RE}'), false) AS ok "
    "FROM cat_annotations", "cat_annotations"))
def valid_node_level(spark, d):
    a = FX.annotations(spark, d)
    return a.select("asset_id", "pos", "tie", "node_level", K.valid_node_level("node_level").alias("ok"))


KIND_ERROR_SQL = f"""CASE WHEN kind IS NULL THEN NULL
  WHEN kind = 'materialization' AND (target_table IS NULL OR target_column IS NULL) THEN 'Materialization kind requires target_table and target_column'
  WHEN kind = 'segmentation' AND NOT coalesce(regexp_full_match(node_level, '{NODE_RE}'), false)
    THEN 'Invalid node_level ''' || coalesce(node_level, '') || '''. Must be ''root_id'', ''supervoxel_id'', or ''level{{N}}_id'' (e.g., ''level2_id'').'
  WHEN kind = 'packed_point' AND resolution IS NOT NULL AND len(resolution) <> 3 THEN 'Packed point resolution must be a list of exactly 3 values [rx, ry, rz].'
  WHEN kind = 'split_point' AND NOT coalesce(axis IN ('x', 'y', 'z'), false) THEN 'Split point axis must be one of ''x'', ''y'', ''z''' END"""


@query("valid_kind", with_fixtures(
    f"SELECT asset_id, pos, tie, kind, {KIND_ERROR_SQL} AS kind_error FROM cat_annotations", "cat_annotations"))
def valid_kind(spark, d):
    a = FX.annotation_struct(FX.annotations(spark, d))
    return a.select("asset_id", "pos", "tie", F.col("annotation.kind.kind").alias("kind"),
                    K.kind_error(F.col("annotation.kind")).alias("kind_error"))


def request_errors_sql(table_format_required: bool = True) -> str:
    checks = [
        "CASE WHEN datastack IS NULL THEN 'datastack is required' END",
        name_error_sql("name"),
        "CASE WHEN uri IS NULL THEN 'uri is required' END",
        "CASE WHEN asset_type IS NULL THEN 'asset_type is required' END",
        "CASE WHEN is_managed IS NULL THEN 'is_managed is required' END",
        "CASE WHEN coalesce(revision, 0) < 0 THEN 'revision must be >= 0' END",
        "CASE WHEN coalesce(mutability, 'static') NOT IN ('static', 'mutable') THEN 'mutability must be one of: static, mutable' END",
        "CASE WHEN coalesce(maturity, 'stable') NOT IN ('stable', 'draft', 'deprecated') THEN 'maturity must be one of: stable, draft, deprecated' END",
        "CASE WHEN properties IS NOT NULL AND NOT CASE WHEN json_valid(properties) THEN json_type(properties) = 'OBJECT' ELSE false END "
        "THEN 'properties must be an object' END",
    ]
    if table_format_required:
        checks.append("CASE WHEN asset_type = 'table' AND format IS NULL THEN 'format is required for tables' END")
    return "list_filter([" + ", ".join(checks) + "], lambda x: x IS NOT NULL)"


@query("valid_request", with_fixtures(
    f"SELECT seq, CAST(len(e) AS INTEGER) AS n_errors, array_to_string(e, ' | ') AS errors "
    f"FROM (SELECT seq, {request_errors_sql()} AS e FROM cat_candidates)", "cat_candidates"))
def valid_request(spark, d):
    c = RQ.with_request_check(FX.candidates(spark, d), F.col("asset_type") == "table")
    return c.select("seq", F.size("request_errors").alias("n_errors"), F.array_join("request_errors", " | ").alias("errors"))


FORM_ROWS_SQL = """SELECT asset_id, idx, tie, max(value) FILTER (WHERE field = 'name') AS name,
  max(value) FILTER (WHERE field = 'desc') AS "desc", max(value) FILTER (WHERE field = 'kind') AS kind,
  max(value) FILTER (WHERE field = 'target_table') AS target_table, max(value) FILTER (WHERE field = 'target_column') AS target_column,
  max(value) FILTER (WHERE field = 'node_level') AS node_level, max(value) FILTER (WHERE field = 'custom_level') AS custom_level,
  max(value) FILTER (WHERE field = 'resolution') AS resolution, max(value) FILTER (WHERE field = 'axis') AS axis,
  max(value) FILTER (WHERE field = 'point_group') AS point_group
FROM cat_form_cells GROUP BY asset_id, idx, tie"""


def _form_sql(body: str) -> str:
    return with_fixtures(body, "cat_form_cells", form_rows=FORM_ROWS_SQL)


NODE_FROM_FORM_SQL = """CASE WHEN coalesce(lvl, '') <> '' AND lvl <> 'custom' THEN lvl END"""
LVL_SQL = "CASE WHEN trim(node_level) = 'custom' AND coalesce(trim(custom_level), '') <> '' THEN 'level' || trim(custom_level) || '_id' ELSE trim(node_level) END"


@query("node_level_from_form", _form_sql(
    f"SELECT asset_id, idx, tie, {NODE_FROM_FORM_SQL} AS node_level FROM (SELECT asset_id, idx, tie, {LVL_SQL} AS lvl FROM form_rows)"))
def node_level_from_form(spark, d):
    rows = forms.pivot_cells(FX.form_cells(spark, d))
    return rows.select("asset_id", "idx", "tie", K.node_level_from_form("node_level", "custom_level").alias("node_level"))


RES_PARTS_SQL = "list_filter(list_transform(string_split(coalesce(resolution, ''), ','), lambda x: trim(x)), lambda x: x <> '')"


@query("parse_resolution", _form_sql(
    f"SELECT asset_id, idx, tie, CASE WHEN len(p) = 3 THEN array_to_string(list_transform(p, lambda x: CAST(TRY_CAST(x AS DOUBLE) AS VARCHAR)), ',') END AS resolution, "
    f"len(list_filter(p, lambda x: TRY_CAST(x AS DOUBLE) IS NULL)) > 0 AS has_non_number "
    f"FROM (SELECT asset_id, idx, tie, {RES_PARTS_SQL} AS p FROM form_rows)"))
def parse_resolution(spark, d):
    rows = forms.pivot_cells(FX.form_cells(spark, d))
    res = K.parse_resolution("resolution")
    return rows.select("asset_id", "idx", "tie",
                       F.array_join(F.transform(res, lambda x: x.cast("string")), ",").alias("resolution"),
                       K.resolution_has_non_number("resolution").alias("has_non_number"))


@query("strip_bbox", with_fixtures(
    "SELECT datastack, object_type, object_name, pos, regexp_replace(f, '_bbox$', '') AS field FROM "
    "(SELECT datastack, object_type, object_name, CAST(generate_subscripts(fields, 1) - 1 AS INTEGER) AS pos, unnest(fields) AS f FROM cat_mat_objects)",
    "cat_mat_objects"))
def strip_bbox(spark, d):
    from ..operators.reference import strip_bbox as sb
    m = FX.mat_objects(spark, d)
    return m.select("datastack", "object_type", "object_name", F.posexplode("fields").alias("pos", "f")).select(
        "datastack", "object_type", "object_name", F.col("pos").cast("int").alias("pos"), sb("f").alias("field"))


def dtype_class_sql(x: str) -> str:
    alias = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DT.DTYPE_ALIASES.items())
    norm = f"CASE lower(trim({x})) {alias} ELSE lower(trim({x})) END"
    ints = ", ".join(f"'{t}'" for t in S.INTEGER_DTYPES)
    floats = ", ".join(f"'{t}'" for t in S.FLOAT_DTYPES)
    return f"CASE WHEN {norm} IN ({ints}) THEN 'integer' WHEN {norm} IN ({floats}) THEN 'float' ELSE 'other' END"


@query("dtype_class", with_fixtures(
    f"SELECT asset_id, pos, dtype, {dtype_class_sql('dtype')} AS dtype_class FROM cat_columns", "cat_columns"))
def dtype_class(spark, d):
    c = FX.asset_columns(spark, d)
    return c.select("asset_id", "pos", "dtype", DT.dtype_class("dtype").alias("dtype_class"))


@query("property_get", with_fixtures(
    "SELECT id, CASE WHEN json_valid(properties) THEN json_extract_string(properties, '$.source') END AS source, "
    "CASE WHEN json_valid(properties) THEN json_extract_string(properties, '$.source_table') END AS source_table, "
    "CASE WHEN json_valid(properties) THEN TRY_CAST(json_extract_string(properties, '$.mat_version') AS INTEGER) END AS mat_version, "
    "CASE WHEN json_valid(properties) THEN TRY_CAST(json_extract_string(properties, '$.nested.level') AS INTEGER) END AS nested_level "
    "FROM cat_assets", "cat_assets"))
def property_get(spark, d):
    a = FX.assets(spark, d, with_columns=False)
    return a.select("id", PR.property_get("properties", "source").alias("source"),
                    PR.property_get("properties", "source_table").alias("source_table"),
                    PR.property_get("properties", "mat_version", "int").alias("mat_version"),
                    PR.property_get("properties", "nested.level", "int").alias("nested_level"))


URI_RE = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):(//([^/?#]*))?([^?#]*)"
_ALL_URIS_SQL = ("SELECT 'asset' AS src, id AS ref, uri FROM cat_assets UNION ALL "
                 "SELECT 'page', CAST(page_id AS VARCHAR), url FROM pages UNION ALL "
                 "SELECT 'candidate', CAST(seq AS VARCHAR), uri FROM cat_candidates")


def _all_uris(spark, d):
    a = FX.assets(spark, d, with_columns=False).select(F.lit("asset").alias("src"), F.col("id").alias("ref"), "uri")
    p = FX.table(spark, d, "pages").select(F.lit("page").alias("src"), F.col("page_id").cast("string").alias("ref"), F.col("url").alias("uri"))
    c = FX.candidates(spark, d).select(F.lit("candidate").alias("src"), F.col("seq").cast("string").alias("ref"), "uri")
    return a.unionByName(p).unionByName(c)


@query("uri_scheme", with_fixtures(
    f"SELECT src, ref, lower(regexp_extract(uri, '{URI_RE}', 1)) AS scheme FROM ({_ALL_URIS_SQL})", "cat_assets", "cat_candidates"))
def uri_scheme(spark, d):
    return _all_uris(spark, d).select("src", "ref", U.uri_scheme("uri").alias("scheme"))


BUCKET_RE = "[a-z0-9][a-z0-9._-]{1,61}[a-z0-9]"
PREFIX_RE = "[a-zA-Z0-9/_\\-.=+]*"
GCS_SQL = f"""SELECT src, ref, bucket, prefix,
  CASE WHEN scheme <> 'gs' OR bucket = '' THEN 'Invalid GCS URI ''' || uri || ''': expected format gs://bucket[/prefix]'
    WHEN NOT regexp_full_match(bucket, '{BUCKET_RE}') THEN 'Invalid GCS bucket name: ''' || bucket || ''''
    WHEN prefix <> '' AND NOT regexp_full_match(prefix, '{PREFIX_RE}') THEN 'Invalid GCS prefix: ''' || prefix || '''' END AS error
FROM (SELECT src, ref, uri, lower(regexp_extract(uri, '{URI_RE}', 1)) AS scheme, regexp_extract(uri, '{URI_RE}', 3) AS bucket,
  regexp_replace(regexp_extract(uri, '{URI_RE}', 4), '^/+', '') AS prefix FROM ({_ALL_URIS_SQL}))"""


@query("parse_gcs_uri", with_fixtures(GCS_SQL, "cat_assets", "cat_candidates"))
def parse_gcs_uri(spark, d):
    u = _all_uris(spark, d)
    return u.select("src", "ref", U.gcs_bucket("uri").alias("bucket"), U.gcs_prefix("uri").alias("prefix"),
                    U.gcs_uri_error("uri").alias("error"))


@query("prefix_condition", with_fixtures(
    "SELECT src, ref, 'resource.name.startsWith(''projects/_/buckets/' || bucket || '/objects/' || prefix || ''')' AS condition "
    f"FROM ({GCS_SQL}) WHERE error IS NULL", "cat_assets", "cat_candidates"))
def prefix_condition(spark, d):
    u = _all_uris(spark, d)
    ok = u.where(U.gcs_uri_error("uri").isNull())
    return ok.select("src", "ref", U.prefix_condition(U.gcs_bucket("uri"), U.gcs_prefix("uri")).alias("condition"))


@query("format_number", """
SELECT 'customer' AS src, c_custkey AS ref, format('{:,.1f}', c_acctbal) AS grouped, printf('%.1f', c_acctbal) AS plain FROM customer
UNION ALL SELECT 'orders', o_orderkey, format('{:,.1f}', o_totalprice), printf('%.1f', o_totalprice) FROM orders
UNION ALL SELECT 'lineitem', l_orderkey * 10 + l_linenumber, format('{:,}', l_partkey * 1013), CAST(l_partkey * 1013 AS VARCHAR) FROM lineitem""")
def format_number(spark, d):
    c = FX.table(spark, d, "customer").select(F.lit("customer").alias("src"), F.col("c_custkey").alias("ref"),
                                              FM.format_number("c_acctbal", True, False).alias("grouped"),
                                              FM.format_number("c_acctbal", False, False).alias("plain"))
    o = FX.table(spark, d, "orders").select(F.lit("orders").alias("src"), F.col("o_orderkey").alias("ref"),
                                            FM.format_number("o_totalprice", True, False).alias("grouped"),
                                            FM.format_number("o_totalprice", False, False).alias("plain"))
    li = FX.table(spark, d, "lineitem")
    v = F.col("l_partkey") * 1013
    l_ = li.select(F.lit("lineitem").alias("src"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"),
                   FM.format_number(v, True, True).alias("grouped"), FM.format_number(v, False, True).alias("plain"))
    return c.unionByName(o).unionByName(l_)


_BYTES_INPUT_SQL = ("SELECT 'asset' AS src, id AS ref, CAST(n_bytes AS DOUBLE) AS v FROM cat_assets UNION ALL "
                    "SELECT 'customer', CAST(c_custkey AS VARCHAR), c_acctbal FROM customer UNION ALL "
                    "SELECT 'document', CAST(doc_id AS VARCHAR), CAST(n_chars * n_chars * 1021 AS DOUBLE) FROM documents")


def _bytes_input(spark, d):
    a = FX.assets(spark, d, with_columns=False).select(F.lit("asset").alias("src"), F.col("id").alias("ref"),
                                                        F.col("cached_metadata.n_bytes").cast("double").alias("v"))
    c = FX.table(spark, d, "customer").select(F.lit("customer").alias("src"), F.col("c_custkey").cast("string").alias("ref"),
                                              F.col("c_acctbal").alias("v"))
    doc = FX.table(spark, d, "documents").select(F.lit("document").alias("src"), F.col("doc_id").cast("string").alias("ref"),
                                                 (F.col("n_chars") * F.col("n_chars") * 1021).cast("double").alias("v"))
    return a.unionByName(c).unionByName(doc)


@query("format_bytes", with_fixtures(
    f"SELECT src, ref, {format_bytes_sql('v')} AS text FROM ({_BYTES_INPUT_SQL})", "cat_assets"))
def format_bytes(spark, d):
    return _bytes_input(spark, d).select("src", "ref", FM.format_bytes("v").alias("text"))


PREVIEW_SQL = ("CASE WHEN v IS NULL THEN NULL WHEN v >= 1073741824 THEN printf('%.1f', v / 1073741824.0) || ' GB' "
               "WHEN v >= 1048576 THEN printf('%.1f', v / 1048576.0) || ' MB' WHEN v >= 1024 THEN printf('%.1f', v / 1024.0) || ' KB' "
               "ELSE CAST(v AS VARCHAR) || ' B' END")


@query("format_bytes_preview", with_fixtures(
    f"SELECT src, ref, {PREVIEW_SQL} AS text FROM (SELECT src, ref, CAST(trunc(v) AS BIGINT) AS v FROM ({_BYTES_INPUT_SQL}))",
    "cat_assets"))
def format_bytes_preview(spark, d):
    x = _bytes_input(spark, d)
    return x.select("src", "ref", FM.format_bytes_preview(F.col("v").cast("bigint")).alias("text"))


def _decimal_sql(v: str) -> str:
    parts = [f"WHEN {v} IS NULL THEN '—'", f"WHEN {v} = 1.0 THEN '1 Byte'",
             f"WHEN {v} < 1000.0 THEN CAST(trunc({v}) AS BIGINT)::VARCHAR || ' Bytes'"]
    units = ["kB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB"]
    for i, u in enumerate(units):
        parts.append(f"WHEN {v} < 1e{3 * (i + 2)} THEN printf('%.1f', ({v} * 1000.0) / 1e{3 * (i + 2)}) || ' {u}'")
    parts.append(f"ELSE printf('%.1f', ({v} * 1000.0) / 1e27) || ' YB'")
    return "CASE " + " ".join(parts) + " END"


@query("format_bytes_decimal", with_fixtures(
    f"SELECT src, ref, {_decimal_sql('v')} AS text FROM ({_BYTES_INPUT_SQL})", "cat_assets"))
def format_bytes_decimal(spark, d):
    x = _bytes_input(spark, d)
    return x.select("src", "ref", FM.format_bytes_decimal("v").alias("text"))


@query("format_datetime", """
SELECT 'orders' AS src, o_orderkey AS ref, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS text FROM orders
UNION ALL SELECT 'events', event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events""")
def format_datetime(spark, d):
    o = FX.table(spark, d, "orders").select(F.lit("orders").alias("src"), F.col("o_orderkey").alias("ref"),
                                            FM.format_datetime("o_orderdate").alias("text"))
    e = FX.table(spark, d, "events").select(F.lit("events").alias("src"), F.col("event_id").alias("ref"),
                                            FM.format_datetime("ts").alias("text"))
    return o.unionByName(e)


@query("format_badge", with_fixtures(
    "SELECT id, coalesce(format, '—') AS format_badge, CASE WHEN is_managed THEN 'True' ELSE 'False' END AS managed_text, "
    "coalesce(access_group, '—') AS group_text FROM cat_assets", "cat_assets"))
def format_badge(spark, d):
    a = FX.assets(spark, d, with_columns=False)
    return a.select("id", FM.format_badge("format").alias("format_badge"),
                    FM.format_text("is_managed", is_bool=True).alias("managed_text"),
                    FM.format_text("access_group").alias("group_text"))


KIND_LABEL_SQL = """CASE WHEN kind IS NULL THEN NULL
  WHEN kind = 'materialization' THEN concat_ws('', 'mat → ', target_table, '.', target_column)
  WHEN kind = 'segmentation' THEN concat_ws('', 'seg ', node_level)
  WHEN kind = 'packed_point' THEN 'packed point' || CASE WHEN coalesce(len(resolution), 0) > 0
    THEN ' res=' || array_to_string(list_transform(resolution, lambda x: CAST(x AS VARCHAR)), '×') ELSE '' END
  WHEN kind = 'split_point' THEN 'split point ' || coalesce(axis, '')
    || CASE WHEN coalesce(point_group, '') <> '' THEN ' (' || point_group || ')' ELSE '' END
    || CASE WHEN coalesce(axis_resolution, 0.0) <> 0.0 THEN ' res=' || CAST(axis_resolution AS VARCHAR) ELSE '' END END"""


@query("kind_label", with_fixtures(f"SELECT asset_id, pos, tie, {KIND_LABEL_SQL} AS label FROM cat_annotations", "cat_annotations"))
def kind_label(spark, d):
    a = FX.annotation_struct(FX.annotations(spark, d))
    return a.select("asset_id", "pos", "tie", K.kind_label(F.col("annotation.kind")).alias("label"))


_TRIAGE_SQL = """CASE WHEN message IS NULL THEN NULL
  WHEN contains(lower(message), 'not found') OR contains(lower(message), 'no such') OR contains(lower(message), 'does not exist') THEN 'missing'
  WHEN contains(lower(message), 'permission') OR contains(lower(message), 'forbidden') OR contains(lower(message), 'access') THEN 'denied'
  ELSE 'unreadable' END"""


@query("triage_error", with_fixtures(f"""SELECT seq, message, triage, CASE triage
    WHEN 'missing' THEN 'URI unreachable — the path does not exist or is not accessible: ' || message
    WHEN 'denied' THEN 'URI unreachable — permission denied: ' || message
    WHEN 'unreadable' THEN 'Failed to read ' || format || ' data: ' || message END AS diagnosis
  FROM (SELECT *, {_TRIAGE_SQL} AS triage FROM cat_errors)""", "cat_errors"))
def triage_error(spark, d):
    """SCL-22 over the errors of previews, with the text shown for each."""
    e = FX.preview_errors(spark, d)
    return e.select("seq", "message", FM.triage_error("message").alias("triage"), FM.triage_message("message", "format").alias("diagnosis"))
