"""Registered queries: batch admission and registration pipelines.

Batch admission has a recursive-SQL oracle that runs the same greedy rounds;
the pipelines built on it are checked by rows and by tests against a
one-at-a-time loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as FX
from ..operators import admission as AD
from ..operators import registration as RG
from ..operators import views as V
from ..operators.requests import with_request_check
from ..sources import column_store as CS
from .fixture_sql import with_fixtures
from .q_changes import BYTES_SQL, ROWS_SQL
from .q_listing import flat, flat_cols
from .q_scalars import request_errors_sql
from .q_views import shown_lists
from .registry import query

NOW = FX.DEFAULT_NOW
LABEL_COLS = ["seq", "admission_status", "existing_id", "new_id"]


def _assets(spark, d):
    return FX.assets(spark, d, with_columns=False)


def _admission_sql(cand: str | None = None, fixtures: tuple = ("cat_assets", "cat_candidates"), extra: dict | None = None,
                   gate: str = "CASE WHEN c.bad THEN 'invalid_request' END", content: str = "NULL") -> str:
    """Labels of the sequential admission as recursive SQL: the same rounds, written with windows."""
    kkey = ("datastack || chr(1) || name || chr(1) || coalesce(CAST(mat_version AS VARCHAR), chr(0)) || chr(1) || "
            "CAST(revision AS VARCHAR)")
    body = """SELECT seq, admission_status, existing_id,
  CASE WHEN admission_status = 'created' THEN 'new-' || CAST(seq AS VARCHAR) END AS new_id FROM (
SELECT c.seq,
  CASE WHEN c.gate IS NOT NULL THEN c.gate
    WHEN c.dup_id IS NOT NULL OR k.seq < c.seq THEN 'duplicate'
    WHEN c.uri_dup_id IS NOT NULL OR u.seq < c.seq THEN 'duplicate_uri'
    WHEN c.content IS NOT NULL THEN c.content
    WHEN k.seq = c.seq THEN 'created' END AS admission_status,
  CASE WHEN c.gate IS NOT NULL THEN NULL WHEN c.dup_id IS NOT NULL THEN c.dup_id WHEN k.seq < c.seq THEN 'new-' || CAST(k.seq AS VARCHAR)
    WHEN c.uri_dup_id IS NOT NULL THEN c.uri_dup_id WHEN u.seq < c.seq THEN 'new-' || CAST(u.seq AS VARCHAR) END AS existing_id
FROM cand c LEFT JOIN acc k ON k.kkey = c.kkey LEFT JOIN acc u ON u.uri = c.uri)"""
    cand = cand or f"""SELECT x.seq, x.uri, {kkey} AS kkey, len({request_errors_sql()}) > 0 AS bad,
  (SELECT min(a.id) FROM cat_assets a WHERE a.datastack = x.datastack AND a.name = x.name AND a.revision = x.revision
     AND a.mat_version IS NOT DISTINCT FROM x.mat_version) AS dup_id,
  (SELECT min(a.id) FROM cat_assets a WHERE a.uri = x.uri) AS uri_dup_id
FROM cat_candidates x"""
    cand = f"SELECT *, {gate} AS gate, {content} AS content FROM ({cand}) c"
    rounds = """SELECT seq, kkey, uri, 'u' AS state FROM cand WHERE gate IS NULL AND content IS NULL AND dup_id IS NULL
  AND uri_dup_id IS NULL AND uri IS NOT NULL
UNION ALL
SELECT seq, kkey, uri, CASE WHEN acc THEN 'a' ELSE 'u' END FROM (
  SELECT *, max(CASE WHEN acc THEN 1 ELSE 0 END) OVER (PARTITION BY kkey) AS hk,
            max(CASE WHEN acc THEN 1 ELSE 0 END) OVER (PARTITION BY uri) AS hu FROM (
    SELECT seq, kkey, uri, seq = min(seq) OVER (PARTITION BY kkey) AND seq = min(seq) OVER (PARTITION BY uri) AS acc
    FROM r WHERE state = 'u'))
WHERE acc OR (hk = 0 AND hu = 0)"""
    ctes = dict(extra or {})
    ctes["cand"] = cand
    sql = with_fixtures(body, *fixtures, **ctes)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1).replace(
        "\nSELECT seq, admission_status,",
        f",\nr(seq, kkey, uri, state) AS ({rounds}\n),\nacc AS (SELECT DISTINCT seq, kkey, uri FROM r WHERE state = 'a')"
        "\nSELECT seq, admission_status,", 1)


@query("batch_admission", _admission_sql())
def batch_admission(spark, d):
    """WIN-02 alone: every well-formed candidate competes for its key and URI."""
    c = with_request_check(FX.candidates(spark, d), F.col("asset_type") == "table").withColumn(
        "gate_status", F.when(~F.col("request_valid"), F.lit("invalid_request"))).withColumn(
        "content_status", F.lit(None).cast("string"))
    labelled, _ = AD.admit(c, _assets(spark, d))
    return labelled.select(*LABEL_COLS)


def _register_assets(spark, d):
    return RG.register_assets(FX.candidates(spark, d), _assets(spark, d), FX.mat_objects(spark, d),
                              FX.storage_objects(spark, d), FX.permissions(spark, d), FX.users(spark, d), NOW)


def _register_tables(spark, d):
    return RG.register_tables(FX.candidates(spark, d), FX.annotations(spark, d), FX.extracted_metadata(spark, d),
                              FX.assets(spark, d), FX.mat_objects(spark, d), FX.storage_objects(spark, d),
                              FX.permissions(spark, d), FX.users(spark, d), NOW)


def _register_assets_sql() -> str:
    from .q_checks import CHECKS_SQL, FIXES

    kkey = ("datastack || chr(1) || name || chr(1) || coalesce(CAST(mat_version AS VARCHAR), chr(0)) || chr(1) || "
            "CAST(revision AS VARCHAR)")
    cand = f"""SELECT seq, uri, {kkey} AS kkey, len({request_errors_sql(False)}) > 0 AS bad, auth_passed AS allowed,
  dup_id, uri_dup_id,
  NOT coalesce(reservation_passed, true) OR NOT coalesce(reachable_passed, true) OR NOT coalesce(sniff_passed, true)
    OR NOT coalesce(matverify_passed, true) AS content_failed
FROM rep"""
    return _admission_sql(cand, FIXES, dict(CHECKS_SQL),
                          gate="CASE WHEN c.bad THEN 'invalid_request' WHEN NOT c.allowed THEN 'forbidden' END",
                          content="CASE WHEN c.content_failed THEN 'invalid' END")


REGISTER_SQL = _register_assets_sql()
NEW_ROWS_SQL = """SELECT 'new-' || CAST(c.seq AS VARCHAR) AS id, c.datastack, c.name, c.mat_version, coalesce(c.revision, 0) AS revision,
  c.uri, c.format, c.asset_type, c.user_id AS owner, coalesce(c.is_managed, false) AS is_managed,
  coalesce(c.mutability, 'static') AS mutability, coalesce(c.maturity, 'stable') AS maturity,
  CASE WHEN json_valid(c.properties) THEN c.properties ELSE '{}' END AS properties, c.access_group,
  TIMESTAMP '1999-01-01 00:00:00' AS created_at, c.expires_at, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS BIGINT) AS n_rows,
  CAST(NULL AS INTEGER) AS n_columns, CAST(NULL AS BIGINT) AS n_bytes, CAST(NULL AS TIMESTAMP) AS metadata_cached_at
FROM cat_candidates c WHERE c.seq IN (SELECT seq FROM labels WHERE admission_status = 'created')"""


def _snapshot_sql(select: str, register_sql: str | None = None, new_rows_sql: str | None = None) -> str:
    """``select`` over ``snap`` = store UNION ALL admitted rows (the admission labels as a CTE)."""
    from .q_listing import FLAT_COLS

    inner = (register_sql or REGISTER_SQL).replace("\nSELECT seq, admission_status, existing_id,", "\n, labels AS (SELECT seq, admission_status, existing_id,", 1)
    return inner + f"""),
snap AS (SELECT {FLAT_COLS} FROM cat_assets UNION ALL {new_rows_sql or NEW_ROWS_SQL})
{select}"""


@query("register_assets", REGISTER_SQL)
def register_assets(spark, d):
    return _register_assets(spark, d).labelled.select(*LABEL_COLS)


def _table_request_errors() -> str:
    """Request rules for a table registration: the asset type is always 'table', so format is required."""
    return request_errors_sql(True).replace("WHEN asset_type IS NULL", "WHEN false").replace(
        "WHEN asset_type = 'table' AND format IS NULL", "WHEN format IS NULL")


def _register_tables_sql(both: bool = False) -> str:
    """Labels of table registrations; with ``both``, of tables and other assets in one batch."""
    from .q_changes import dtype_sql
    from .q_checks import CHECKS_SQL, FIXES
    from .q_scalars import KIND_ERROR_SQL, dtype_class_sql

    kkey = ("datastack || chr(1) || name || chr(1) || coalesce(CAST(mat_version AS VARCHAR), chr(0)) || chr(1) || "
            "CAST(revision AS VARCHAR)")
    extra = dict(CHECKS_SQL)
    extra["ca"] = "SELECT * FROM cat_annotations WHERE asset_id IN (SELECT CAST(seq AS VARCHAR) FROM cat_candidates)"
    extra["malformed"] = f"SELECT DISTINCT asset_id FROM ca WHERE ({KIND_ERROR_SQL}) IS NOT NULL"
    extra["xcols"] = f"""SELECT uri, 'col_' || CAST(i AS VARCHAR) AS name, {dtype_sql("num", "actual_format")} AS dtype FROM (
  SELECT uri, num, actual_format, unnest(range(1, 2 + num % 6)) AS i FROM (
    SELECT uri, actual_format, CAST(regexp_extract(uri, '/([0-9]+)$', 1) AS BIGINT) AS num FROM cat_storage
    WHERE actual_format IN ('parquet', 'delta')))"""
    extra["pgdup"] = """SELECT DISTINCT asset_id FROM (
  SELECT asset_id, row_number() OVER (PARTITION BY asset_id, point_group, axis ORDER BY pos, tie) AS rn FROM ca
  WHERE kind = 'split_point' AND coalesce(point_group, '') <> '' AND coalesce(axis, '') <> '') WHERE rn > 1"""
    is_table = "coalesce(q.asset_type = 'table', false)" if both else "true"
    bad = f"CASE WHEN {is_table} THEN len({_table_request_errors()}) > 0 ELSE len({request_errors_sql(False)}) > 0 END"
    cand = f"""SELECT q.seq, q.uri, {kkey} AS kkey, {bad} AS bad, {is_table} AS is_t,
  CAST(q.seq AS VARCHAR) IN (SELECT asset_id FROM malformed) AS bad_kind, q.auth_passed AS allowed, q.dup_id, q.uri_dup_id,
  NOT coalesce(q.reservation_passed, true) OR NOT coalesce(q.reachable_passed, true) OR NOT coalesce(q.sniff_passed, true)
    OR NOT coalesce(q.matverify_passed, true) AS content_failed,
  EXISTS (SELECT 1 FROM ca a WHERE a.asset_id = CAST(q.seq AS VARCHAR) AND a.kind = 'materialization'
          AND coalesce(a.target_table, '') <> '' AND q.datastack IN (SELECT datastack FROM cat_mat_objects)
          AND NOT EXISTS (SELECT 1 FROM cat_mat_objects m WHERE m.object_type = 'table' AND m.is_current
                          AND m.datastack = q.datastack AND m.object_name = a.target_table)) AS kt,
  CAST(q.seq AS VARCHAR) IN (SELECT asset_id FROM pgdup) AS pg,
  lower(q.format) AS fmt,
  q.uri IN (SELECT uri FROM xcols) AS has_x,
  EXISTS (SELECT 1 FROM ca a JOIN xcols x ON x.uri = q.uri AND x.name = a.column_name
          WHERE a.asset_id = CAST(q.seq AS VARCHAR)
            AND ((a.kind = 'segmentation' AND {dtype_class_sql('x.dtype')} <> 'integer')
              OR (a.kind IN ('packed_point', 'split_point') AND {dtype_class_sql('x.dtype')} NOT IN ('integer', 'float')))) AS dt,
  (SELECT s.actual_format FROM cat_storage s WHERE s.uri = q.uri) AS actual
FROM rep q"""
    content = """CASE WHEN c.content_failed THEN 'invalid' WHEN NOT c.is_t THEN NULL WHEN c.kt THEN 'kind_invalid' WHEN c.pg THEN 'point_group_invalid'
  WHEN c.fmt NOT IN ('delta', 'parquet') THEN 'unsupported_format'
  WHEN NOT c.has_x OR coalesce(c.actual, '') <> c.fmt THEN 'extraction_failed' WHEN c.dt THEN 'dtype_invalid' END"""
    return _admission_sql(cand, FIXES + ("cat_annotations",), extra,
                          gate="CASE WHEN c.bad OR (c.is_t AND c.bad_kind) THEN 'invalid_request' WHEN NOT c.allowed THEN 'forbidden' END",
                          content=content)


REGISTER_TABLES_SQL = _register_tables_sql()
REGISTER_ALL_SQL = _register_tables_sql(both=True)
NEW_TABLE_ROWS_SQL = f"""SELECT 'new-' || CAST(c.seq AS VARCHAR) AS id, c.datastack, c.name, c.mat_version, coalesce(c.revision, 0) AS revision,
  c.uri, c.format, 'table' AS asset_type, c.user_id AS owner, coalesce(c.is_managed, false) AS is_managed,
  coalesce(c.mutability, 'static') AS mutability, coalesce(c.maturity, 'stable') AS maturity,
  CASE WHEN json_valid(c.properties) THEN c.properties ELSE '{{}}' END AS properties, c.access_group,
  TIMESTAMP '1999-01-01 00:00:00' AS created_at, c.expires_at, 'user' AS source,
  {ROWS_SQL} AS n_rows, CAST(1 + n.num % 6 AS INTEGER) AS n_columns, {BYTES_SQL} AS n_bytes,
  TIMESTAMP '1999-01-01 00:00:00' AS metadata_cached_at
FROM cat_candidates c JOIN (SELECT uri, CAST(regexp_extract(uri, '/([0-9]+)$', 1) AS BIGINT) AS num FROM cat_storage
  WHERE actual_format IN ('parquet', 'delta')) n ON n.uri = c.uri
WHERE c.seq IN (SELECT seq FROM labels WHERE admission_status = 'created')"""


@query("register_tables", REGISTER_TABLES_SQL)
def register_tables(spark, d):
    return _register_tables(spark, d).labelled.select(*LABEL_COLS)


@query("admit_assets", _snapshot_sql("SELECT * FROM snap"))
def admit_assets(spark, d):
    return flat(_register_assets(spark, d).snapshot)


@query("admit_tables", _snapshot_sql("SELECT * FROM snap", REGISTER_TABLES_SQL, NEW_TABLE_ROWS_SQL))
def admit_tables(spark, d):
    out = flat(_register_tables(spark, d).snapshot)
    measured = F.col("id").startswith("new-") & (F.lower("format") == "parquet")  # compared in pytest, as for refresh_metadata
    return out.withColumn("n_bytes", F.when(~F.coalesce(measured, F.lit(False)), F.col("n_bytes")))


@query("append_snapshot", _snapshot_sql("SELECT id, datastack, name, mat_version, revision, uri, asset_type, id LIKE 'new-%' AS appended FROM snap"))
def append_snapshot(spark, d):
    """SET-02: the store plus the rows accepted from the batch, row by row."""
    return _register_assets(spark, d).snapshot.select("id", "datastack", "name", "mat_version", "revision", "uri", "asset_type",
                                                      F.col("id").startswith("new-").alias("appended"))



def _registered_view_sql() -> str:
    from .q_scalars import KIND_LABEL_SQL

    last = """SELECT *, row_number() OVER (PARTITION BY asset_id, column_name ORDER BY pos DESC, tie DESC) AS rn FROM cat_annotations"""
    text = f"coalesce(a.description, '') || '|' || coalesce({KIND_LABEL_SQL}, '')"
    return _snapshot_sql(f"""SELECT s.*,
  coalesce((SELECT string_agg(x.name || '|' || x.dtype || '|' || {text}, ';' ORDER BY CAST(substr(x.name, 5) AS INTEGER))
    FROM xcols x LEFT JOIN ({last}) a ON a.rn = 1 AND 'new-' || a.asset_id = s.id AND a.column_name = x.name WHERE x.uri = s.uri), '') AS merged,
  coalesce((SELECT string_agg(a.column_name || '|' || {text}, ';' ORDER BY pos, tie) FROM cat_annotations a WHERE 'new-' || a.asset_id = s.id), '') AS annotations
FROM snap s WHERE s.id LIKE 'new-%'""", REGISTER_TABLES_SQL, NEW_TABLE_ROWS_SQL)


@query("registered_table_view", _registered_view_sql())
def registered_table_view(spark, d):
    """SNK-02 then PRJ-02: the tables a batch creates, their columns and annotations stored and read back merged."""
    done = _register_tables(spark, d)
    store = CS.ColumnStore.fresh(spark)
    store.add(done.created, done.annotations)
    rows = V.with_lists(done.created, store.merged(), store.annotations())
    out = shown_lists(rows, *flat_cols())
    return out.withColumn("n_bytes", F.when(F.lower("format") != "parquet", F.col("n_bytes")))
