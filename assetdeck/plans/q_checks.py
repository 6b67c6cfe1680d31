"""Registered queries: access, reference objects, registration checks and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as FX
from ..operators import access as AC
from ..operators import checks as CK
from ..operators import reference as RF
from ..sources import extract as EX
from .fixture_sql import NOW_SQL, with_fixtures
from .q_scalars import BUCKET_RE, PREFIX_RE, URI_RE, name_error_sql
from .registry import query

NOW = FX.DEFAULT_NOW


def _assets(spark, d):
    return FX.assets(spark, d, with_columns=False)


# --- access -----------------------------------------------------------------

PERM_SQL = """SELECT c.seq, c.user_id, c.datastack,
  coalesce(u.is_admin, false) OR EXISTS (SELECT 1 FROM cat_permissions p WHERE p.user_id = c.user_id
    AND p.resource = c.datastack AND p.permission IN ('edit', 'admin')) AS allowed
FROM cat_candidates c LEFT JOIN cat_users u ON u.user_id = c.user_id"""


def _allowed(spark, d):
    c = FX.candidates(spark, d)
    return AC.datastack_permission(c, FX.permissions(spark, d), FX.users(spark, d), wanted="edit")


@query("datastack_permission", with_fixtures(PERM_SQL, "cat_candidates", "cat_permissions", "cat_users"))
def datastack_permission(spark, d):
    return _allowed(spark, d).select("seq", "user_id", "datastack", "allowed")


@query("asset_view_access", with_fixtures(f"""SELECT r.request_id, r.user_id, r.asset_id, a.resource,
  CASE WHEN a.resource IS NULL OR a.expired THEN 'not_found'
    WHEN coalesce(u.is_admin, false)
      OR EXISTS (SELECT 1 FROM cat_permissions p WHERE p.user_id = r.user_id AND p.resource = a.resource AND p.permission IN ('view', 'admin'))
      OR EXISTS (SELECT 1 FROM cat_memberships m WHERE m.user_id = r.user_id AND m.group_name = a.resource) THEN 'ok'
    ELSE 'forbidden' END AS status
FROM cat_view_requests r
LEFT JOIN (SELECT id, coalesce(nullif(access_group, ''), datastack) AS resource, coalesce(expires_at < {NOW_SQL}, false) AS expired
           FROM cat_assets) a ON a.id = r.asset_id
LEFT JOIN cat_users u ON u.user_id = r.user_id""", "cat_assets", "cat_view_requests", "cat_permissions", "cat_memberships", "cat_users"))
def asset_view_access(spark, d):
    return AC.asset_view_access(FX.view_requests(spark, d), _assets(spark, d), FX.permissions(spark, d),
                                FX.memberships(spark, d), FX.users(spark, d), NOW)


@query("shares_group", with_fixtures("""SELECT c.seq AS request_id, c.user_id,
  coalesce(u.is_admin, false) OR EXISTS (SELECT 1 FROM cat_memberships m WHERE m.user_id = c.user_id
    AND m.group_name IN (c.access_group, 'grp' || CAST(c.seq % 5 AS VARCHAR))) AS shares
FROM cat_candidates c LEFT JOIN cat_users u ON u.user_id = c.user_id""",
                                     "cat_candidates", "cat_memberships", "cat_users"))
def shares_group(spark, d):
    c = FX.candidates(spark, d).select(
        F.col("seq").alias("request_id"), "user_id",
        F.array_compact(F.array("access_group", F.concat(F.lit("grp"), (F.col("seq") % 5).cast("string")))).alias("required_groups"))
    return AC.shares_group(c, FX.memberships(spark, d), FX.users(spark, d)).select("request_id", "user_id", "shares")


ACCESS_PLAN_SQL = f"""SELECT id, uri, format, is_managed,
  CASE WHEN err IS NULL THEN 'ok' WHEN expired THEN 'not_found' ELSE 'error' END AS status, err AS error,
  CASE WHEN err IS NULL AND is_managed THEN 'gcs' END AS storage_provider,
  CASE WHEN err IS NULL AND is_managed THEN 'Bearer' END AS token_type,
  CASE WHEN err IS NULL AND is_managed THEN bucket END AS bucket,
  CASE WHEN err IS NULL AND is_managed THEN prefix END AS prefix,
  CASE WHEN err IS NULL AND is_managed THEN 'resource.name.startsWith(''projects/_/buckets/' || bucket || '/objects/' || prefix || ''')' END AS condition
FROM (SELECT *, CASE WHEN expired THEN 'Asset not found' WHEN NOT is_managed THEN NULL
    WHEN scheme <> 'gs' THEN 'Unsupported storage scheme: ''' || scheme || ''''
    WHEN scheme <> 'gs' OR bucket = '' THEN 'Invalid GCS URI ''' || uri || ''': expected format gs://bucket[/prefix]'
    WHEN NOT regexp_full_match(bucket, '{BUCKET_RE}') THEN 'Invalid GCS bucket name: ''' || bucket || ''''
    WHEN prefix <> '' AND NOT regexp_full_match(prefix, '{PREFIX_RE}') THEN 'Invalid GCS prefix: ''' || prefix || '''' END AS err
  FROM (SELECT id, uri, format, is_managed, coalesce(expires_at < {NOW_SQL}, false) AS expired,
      lower(regexp_extract(uri, '{URI_RE}', 1)) AS scheme, regexp_extract(uri, '{URI_RE}', 3) AS bucket,
      regexp_replace(regexp_extract(uri, '{URI_RE}', 4), '^/+', '') AS prefix FROM cat_assets))"""


@query("access_plan", with_fixtures(ACCESS_PLAN_SQL, "cat_assets"))
def access_plan(spark, d):
    return AC.access_plan(_assets(spark, d), NOW)


# --- reference objects ------------------------------------------------------

@query("mat_tables_at", with_fixtures(
    "SELECT datastack, version, object_name FROM cat_mat_objects WHERE object_type = 'table' AND version = 903", "cat_mat_objects"))
def mat_tables_at(spark, d):
    return RF.mat_tables_at(FX.mat_objects(spark, d), version=903)


@query("mat_tables_current", with_fixtures(
    "SELECT DISTINCT datastack, object_name FROM cat_mat_objects WHERE object_type = 'table' AND is_current", "cat_mat_objects"))
def mat_tables_current(spark, d):
    return RF.mat_tables_current(FX.mat_objects(spark, d))


@query("mat_tables", with_fixtures(
    "SELECT DISTINCT datastack, object_name FROM cat_mat_objects WHERE object_type = 'table' AND version = 902", "cat_mat_objects"))
def mat_tables(spark, d):
    return RF.mat_objects_of(FX.mat_objects(spark, d), "table", version=902)


@query("mat_views", with_fixtures(
    "SELECT DISTINCT datastack, object_name FROM cat_mat_objects WHERE object_type = 'view' AND is_current", "cat_mat_objects"))
def mat_views(spark, d):
    return RF.mat_objects_of(FX.mat_objects(spark, d), "view")


TARGET_REQ_SQL = """SELECT DISTINCT s.datastack, a.target_table AS target_name, 'table' AS target_type, CAST(CASE WHEN a.pos % 2 = 1 THEN 900 + a.pos % 7 END AS INTEGER) AS version
FROM cat_annotations a JOIN cat_assets s ON s.id = a.asset_id WHERE a.kind = 'materialization'
UNION SELECT DISTINCT 'ds' || CAST(l_suppkey % 4 AS VARCHAR), lower(replace(r_name, ' ', '_')) || '_view', 'view', CAST(CASE WHEN l_linenumber % 2 = 1 THEN 900 + l_linenumber % 7 END AS INTEGER)
FROM lineitem JOIN region ON r_regionkey = l_suppkey % 5"""


def _target_requests(spark, d):
    a = FX.annotations(spark, d).where(F.col("kind") == "materialization")
    s = _assets(spark, d).select(F.col("id").alias("asset_id"), "datastack")
    version = lambda n: F.when(F.col(n) % 2 == 1, 900 + F.col(n) % 7).cast("int").alias("version")  # noqa: E731  NULL: the current one
    t = a.join(s, "asset_id").select("datastack", F.col("target_table").alias("target_name"), F.lit("table").alias("target_type"), version("pos"))
    li = FX.table(spark, d, "lineitem").select("l_suppkey", "l_linenumber")
    rg = FX.table(spark, d, "region")
    v = li.join(rg, F.col("r_regionkey") == F.col("l_suppkey") % 5).select(
        F.concat(F.lit("ds"), (F.col("l_suppkey") % 4).cast("string")).alias("datastack"),
        F.concat(F.lower(F.regexp_replace("r_name", " ", "_")), F.lit("_view")).alias("target_name"),
        F.lit("view").alias("target_type"), version("l_linenumber"))
    return t.unionByName(v).distinct()


@query("target_columns", with_fixtures(f"""SELECT r.datastack, r.target_name, r.target_type, r.version,
  CAST(generate_subscripts(m.fields, 1) - 1 AS INTEGER) AS pos, regexp_replace(unnest(m.fields), '_bbox$', '') AS column_name
FROM ({TARGET_REQ_SQL}) r JOIN cat_mat_objects m ON CASE WHEN r.version IS NULL THEN m.is_current ELSE m.version = r.version END AND m.datastack = r.datastack AND m.object_name = r.target_name
  AND m.object_type = CASE WHEN r.target_type = 'view' THEN 'view' ELSE 'table' END""", "cat_assets", "cat_annotations", "cat_mat_objects"))
def target_columns(spark, d):
    return RF.target_columns(FX.mat_objects(spark, d), _target_requests(spark, d))


@query("linkable_targets", with_fixtures("""SELECT datastack, version, name, target_type,
  CAST(row_number() OVER (PARTITION BY datastack, version ORDER BY name, target_type) AS INTEGER) AS rank
FROM (SELECT DISTINCT datastack, CAST(NULL AS INTEGER) AS version, object_name AS name, object_type AS target_type FROM cat_mat_objects WHERE is_current
      UNION SELECT DISTINCT datastack, version, object_name, object_type FROM cat_mat_objects WHERE version IN (902, 903))""", "cat_mat_objects"))
def linkable_targets(spark, d):
    """Current targets (version NULL) and those of two versions."""
    mat = FX.mat_objects(spark, d)
    t = [RF.linkable_targets(mat, version=v).withColumn("version", F.lit(v).cast("int")) for v in (None, 902, 903)]
    t = t[0].unionByName(t[1]).unionByName(t[2])
    # the reference data is per datastack and small; rank inside each datastack
    w = Window.partitionBy("datastack", "version").orderBy("name", "target_type")
    return t.withColumn("rank", F.row_number().over(w).cast("int"))


# --- uniqueness and content checks -------------------------------------------

CHECKS_SQL = {}
CHECKS_SQL["dup"] = """SELECT c.*, a.id AS dup_id FROM cat_candidates c LEFT JOIN cat_assets a
  ON a.datastack = c.datastack AND a.name = c.name AND a.revision = c.revision AND a.mat_version IS NOT DISTINCT FROM c.mat_version"""
CHECKS_SQL["uq"] = """SELECT d.*, a.id AS uri_dup_id,
  CASE WHEN d.dup_id IS NOT NULL THEN 'duplicate' WHEN a.id IS NOT NULL THEN 'duplicate_uri' ELSE 'ok' END AS unique_status
FROM dup d LEFT JOIN cat_assets a ON a.uri = d.uri"""
CHECKS_SQL["rsv"] = """SELECT u.*,
  NOT covered OR NOT (reserved AND NOT is_mat) AS reservation_passed,
  CASE WHEN NOT covered THEN 'name_reservation skipped: no reference data for datastack ''' || datastack || ''''
       WHEN reserved AND NOT is_mat THEN 'Name ''' || name || ''' is reserved for materialization. Use properties.source=''materialization'' with admin/service permission to register.' END
    AS reservation_message
FROM (SELECT q.*, datastack IN (SELECT datastack FROM cat_mat_objects) AS covered,
        EXISTS (SELECT 1 FROM cat_mat_objects m WHERE m.object_type = 'table' AND m.is_current AND m.datastack = q.datastack
                AND m.object_name = split_part(q.name, '.', 1)) AS reserved,
        coalesce(CASE WHEN json_valid(properties) THEN json_extract_string(properties, '$.source') END = 'materialization', false) AS is_mat,
        CASE WHEN json_valid(properties) THEN json_extract_string(properties, '$.source_table') END AS src_t,
        CASE WHEN json_valid(properties) THEN TRY_CAST(json_extract_string(properties, '$.mat_version') AS INTEGER) END AS src_v
      FROM uq q) u"""
CHECKS_SQL["reach"] = """SELECT r.*, s.uri IS NOT NULL AS reachable_passed,
  CASE WHEN s.uri IS NULL THEN 'URI does not exist: ' || r.uri END AS reachable_message, s.actual_format
FROM rsv r LEFT JOIN cat_storage s ON s.uri = r.uri"""
CHECKS_SQL["sniff"] = """SELECT r.*,
  format IS NULL OR lower(format) NOT IN ('parquet', 'delta') OR coalesce(actual_format = lower(format), false) AS sniff_passed,
  CASE WHEN format IS NULL THEN 'No format specified; skipping sniff'
       WHEN lower(format) NOT IN ('parquet', 'delta') THEN 'No sniffer registered for format ''' || format || ''''
       WHEN NOT coalesce(actual_format = lower(format), false)
         THEN CASE WHEN lower(format) = 'parquet' THEN 'Parquet' ELSE 'Delta' END || ' sniff failed: '
              || CASE WHEN actual_format IS NULL THEN 'path not found' ELSE 'not a ' || lower(format) || ' table' END END AS sniff_message
FROM reach r"""
CHECKS_SQL["mv"] = """SELECT r.*, CASE WHEN is_mat THEN mv_msg IS NULL END AS matverify_passed, mv_msg AS matverify_message
FROM (SELECT s.*, CASE WHEN NOT is_mat THEN NULL
    WHEN coalesce(src_t, '') = '' OR src_v IS NULL THEN 'properties.source_table and properties.mat_version are required when source=''materialization'''
    WHEN NOT covered THEN 'Failed to reach MaterializationEngine: no reference data for datastack ''' || datastack || ''''
    WHEN NOT EXISTS (SELECT 1 FROM cat_mat_objects m WHERE m.datastack = s.datastack AND m.version = s.src_v)
      THEN 'Version ' || CAST(src_v AS VARCHAR) || ' not found for datastack ''' || datastack || ''' in MaterializationEngine'
    WHEN NOT EXISTS (SELECT 1 FROM cat_mat_objects m WHERE m.object_type = 'table' AND m.datastack = s.datastack
                     AND m.version = s.src_v AND m.object_name = s.src_t)
      THEN 'Mat table ''' || src_t || ''' at version ' || CAST(src_v AS VARCHAR) || ' not found in MaterializationEngine' END AS mv_msg
  FROM sniff s) r"""
CHECKS_SQL["perm"] = PERM_SQL.replace("SELECT c.seq, c.user_id, c.datastack,", "SELECT c.seq,")
CHECKS_SQL["rep"] = """SELECT m.*, p.allowed AS auth_passed,
  CASE WHEN NOT p.allowed THEN 'Write permission required on datastack ''' || m.datastack || '''' END AS auth_message
FROM mv m JOIN perm p ON p.seq = m.seq"""

FIXES = ("cat_assets", "cat_candidates", "cat_mat_objects", "cat_storage", "cat_permissions", "cat_users")


def _checks_sql(body: str, upto: str) -> str:
    names = list(CHECKS_SQL)
    extra = {n: CHECKS_SQL[n] for n in names[: names.index(upto) + 1]}
    return with_fixtures(body, *FIXES, **extra)


def _cands(spark, d):
    return FX.candidates(spark, d)


@query("find_duplicate", _checks_sql("SELECT seq, dup_id FROM dup", "dup"))
def find_duplicate(spark, d):
    return CK.find_duplicate(_cands(spark, d), _assets(spark, d)).select("seq", "dup_id")


@query("find_by_uri", _checks_sql("SELECT seq, uri_dup_id FROM uq", "uq"))
def find_by_uri(spark, d):
    return CK.find_by_uri(_cands(spark, d), _assets(spark, d)).select("seq", "uri_dup_id")


@query("unique_both", _checks_sql("SELECT seq, dup_id, uri_dup_id, unique_status FROM uq", "uq"))
def unique_both(spark, d):
    return CK.unique_both(_cands(spark, d), _assets(spark, d)).select("seq", "dup_id", "uri_dup_id", "unique_status")


@query("name_reservation", _checks_sql("SELECT seq, reservation_passed, reservation_message FROM rsv", "rsv"))
def name_reservation(spark, d):
    return CK.name_reservation(_cands(spark, d), FX.mat_objects(spark, d)).select("seq", "reservation_passed", "reservation_message")


@query("mat_table_verify", _checks_sql("SELECT seq, matverify_passed, matverify_message FROM mv", "mv"))
def mat_table_verify(spark, d):
    return CK.mat_table_verify(_cands(spark, d), FX.mat_objects(spark, d)).select("seq", "matverify_passed", "matverify_message")


def _seen(spark, d):
    """What the readers see behind the candidates' URIs: folders listed, footers and logs read, now."""
    wanted = FX.located(spark, d).join(FX.candidates(spark, d).select("uri"), "uri", "left_semi")
    return EX.inventory(wanted)


@query("uri_exists", _checks_sql("SELECT seq, reachable_passed, reachable_message FROM reach", "reach"))
def uri_exists(spark, d):
    return CK.uri_reachable(_cands(spark, d), _seen(spark, d)).select("seq", "reachable_passed", "reachable_message")


def _sniffed(spark, d):
    return CK.format_sniff(CK.uri_reachable(_cands(spark, d), _seen(spark, d)))


@query("sniff_dispatch", _checks_sql("SELECT seq, sniff_passed, sniff_message FROM sniff", "sniff"))
def sniff_dispatch(spark, d):
    return _sniffed(spark, d).select("seq", "sniff_passed", "sniff_message")


@query("sniff_parquet", _checks_sql("SELECT seq, sniff_passed, sniff_message FROM sniff WHERE lower(format) = 'parquet'", "sniff"))
def sniff_parquet(spark, d):
    return _sniffed(spark, d).where(F.lower("format") == "parquet").select("seq", "sniff_passed", "sniff_message")


@query("sniff_delta", _checks_sql("SELECT seq, sniff_passed, sniff_message FROM sniff WHERE lower(format) = 'delta'", "sniff"))
def sniff_delta(spark, d):
    return _sniffed(spark, d).where(F.lower("format") == "delta").select("seq", "sniff_passed", "sniff_message")


CONTENT_COLS = ["seq", "reservation_passed", "reservation_message", "reachable_passed", "reachable_message",
                "sniff_passed", "sniff_message", "matverify_passed", "matverify_message"]


@query("content_checks", _checks_sql(f"SELECT {', '.join(CONTENT_COLS)} FROM mv", "mv"))
def content_checks(spark, d):
    return CK.content_checks(_cands(spark, d), FX.mat_objects(spark, d), FX.storage_objects(spark, d)).select(*CONTENT_COLS)


REPORT_COLS = ["seq", "auth_passed", "auth_message", "dup_passed", "dup_id", "uri_passed", "uri_message", "uri_dup_id"] + CONTENT_COLS[1:] + \
    ["failed", "rejected"]
_CHK = ["auth", "dup", "uri", "reservation", "reachable", "sniff", "matverify"]
REPORT_SQL = f"""SELECT seq, auth_passed, auth_message,
  CASE WHEN auth_passed THEN dup_id IS NULL END AS dup_passed, CASE WHEN auth_passed THEN dup_id END AS dup_id,
  CASE WHEN auth_passed THEN uri_dup_id IS NULL END AS uri_passed,
  CASE WHEN auth_passed AND uri_dup_id IS NOT NULL THEN 'URI is already registered to another asset' END AS uri_message,
  CASE WHEN auth_passed THEN uri_dup_id END AS uri_dup_id,
  {', '.join(f"CASE WHEN auth_passed THEN {c} END AS {c}" for c in CONTENT_COLS[1:])}
FROM rep"""
FAILED_SQL = f"""SELECT *, array_to_string(fl, ',') AS failed, len(fl) > 0 AS rejected FROM (
  SELECT *, list_filter([{', '.join(f"CASE WHEN {c}_passed = false THEN '{c}' END" for c in _CHK)}], lambda x: x IS NOT NULL) AS fl
  FROM ({REPORT_SQL}))"""


def _report(spark, d):
    c = _allowed(spark, d)
    return CK.validate_report(c, _assets(spark, d), FX.mat_objects(spark, d), FX.storage_objects(spark, d))


@query("validate_report", _checks_sql(f"SELECT {', '.join(REPORT_COLS)} FROM ({FAILED_SQL})", "rep"))
def validate_report(spark, d):
    return _report(spark, d).select(*REPORT_COLS)


@query("failed_checks", _checks_sql(f"SELECT seq, failed, rejected FROM ({FAILED_SQL})", "rep"))
def failed_checks(spark, d):
    return _report(spark, d).select("seq", "failed", "rejected")


def _name_requests(spark, d):
    return _cands(spark, d).select(F.col("seq").alias("request_id"), "datastack", "name", "mat_version", "revision")


@query("check_name", with_fixtures(f"""SELECT request_id, datastack, name, mat_version, revision, reason IS NULL AS available, reason,
  CASE WHEN fmt_err IS NOT NULL THEN fmt_err END AS message, CASE WHEN reason = 'duplicate' THEN dup_id END AS existing_id
FROM (SELECT *, CASE WHEN fmt_err IS NOT NULL THEN 'invalid_format' WHEN covered AND reserved THEN 'reserved'
    WHEN dup_id IS NOT NULL THEN 'duplicate' END AS reason
  FROM (SELECT c.seq AS request_id, c.datastack, c.name, c.mat_version, c.revision, {name_error_sql('c.name')} AS fmt_err,
      c.datastack IN (SELECT datastack FROM cat_mat_objects) AS covered,
      EXISTS (SELECT 1 FROM cat_mat_objects m WHERE m.object_type = 'table' AND m.is_current AND m.datastack = c.datastack
              AND m.object_name = split_part(c.name, '.', 1)) AS reserved, a.id AS dup_id
    FROM cat_candidates c LEFT JOIN cat_assets a ON a.datastack = c.datastack AND a.name = c.name AND a.revision = c.revision
      AND a.mat_version IS NOT DISTINCT FROM c.mat_version))""", "cat_assets", "cat_candidates", "cat_mat_objects"))
def check_name(spark, d):
    return CK.check_name(_name_requests(spark, d), _assets(spark, d), FX.mat_objects(spark, d))


@query("check_uri", with_fixtures("""SELECT c.seq AS request_id, c.uri, a.id IS NULL AS available,
  CASE WHEN a.id IS NOT NULL THEN 'duplicate_uri' END AS reason, a.id AS existing_id
FROM cat_candidates c LEFT JOIN cat_assets a ON a.uri = c.uri""", "cat_assets", "cat_candidates"))
def check_uri(spark, d):
    r = _cands(spark, d).select(F.col("seq").alias("request_id"), "uri")
    return CK.check_uri(r, _assets(spark, d))
