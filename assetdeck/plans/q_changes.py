"""Registered queries: row changes (patch, delete, annotation replacement, refresh)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as FX
from ..fixtures import DTYPE_CYCLE
from ..operators import changes as CH
from ..sources import extract as EX
from .fixture_sql import NOW_SQL, with_fixtures
from .q_annotations import DTYPE_SQL, GROUP_SQL, TARGET_SQL, flat_kind
from .q_listing import FLAT_COLS, LISTS_SQL, flat, whole
from .q_scalars import KIND_ERROR_SQL
from .registry import query

NOW = FX.DEFAULT_NOW


def _assets(spark, d):
    return FX.assets(spark, d, with_columns=False)


EDITORS = {"may_edit": "SELECT user_id, resource FROM cat_permissions WHERE permission IN ('edit', 'admin')",
           "admins": "SELECT user_id FROM cat_users WHERE is_admin"}

MAY_EDIT_SQL = "((r.user_id, a.datastack) IN (SELECT user_id, resource FROM may_edit) OR r.user_id IN (SELECT user_id FROM admins))"

#: Requests one by one: a request counts when no earlier one that counts has let the asset expire.
PATCH_CTES = EDITORS | {
    "pv": f"""SELECT p.*, CASE WHEN x.id IS NULL OR coalesce(x.expires_at < {NOW_SQL}, false) THEN 'not_found'
    WHEN (p.user_id, x.datastack) NOT IN (SELECT user_id, resource FROM may_edit) AND p.user_id NOT IN (SELECT user_id FROM admins) THEN 'forbidden'
    WHEN p.maturity_set AND (p.maturity IS NULL OR p.maturity NOT IN ('stable', 'draft', 'deprecated')) THEN 'invalid'
    ELSE 'updated' END AS st FROM cat_patches p LEFT JOIN cat_assets x ON x.id = p.id""",
    "ps": f"""SELECT p.* REPLACE (CASE WHEN EXISTS (SELECT 1 FROM pv q WHERE q.id = p.id AND q.request_id < p.request_id
      AND q.st = 'updated' AND q.expires_at_set AND q.expires_at < {NOW_SQL}) THEN 'not_found' ELSE p.st END AS st) FROM pv p""",
}


def _patched(field: str) -> str:
    last = f"(SELECT max(request_id) FROM ps WHERE ps.id = a.id AND st = 'updated' AND {field}_set)"
    return f"CASE WHEN {last} IS NULL THEN a.{field} ELSE (SELECT {field} FROM ps WHERE request_id = {last}) END AS {field}"


PATCH_SQL = f"""SELECT a.id, a.datastack, a.name, a.mat_version, a.revision, a.uri, a.format, a.asset_type, a.owner, a.is_managed,
  a.mutability, {_patched("maturity")}, a.properties, {_patched("access_group")}, a.created_at, {_patched("expires_at")},
  a.source, a.n_rows, a.n_columns, a.n_bytes, a.metadata_cached_at
FROM cat_assets a"""


@query("patch_assets", with_fixtures(PATCH_SQL, "cat_assets", "cat_patches", "cat_permissions", "cat_users", **PATCH_CTES))
def patch_assets(spark, d):
    out, _ = CH.patch_assets(_assets(spark, d), FX.patches(spark, d), NOW, permissions=FX.permissions(spark, d), users=FX.users(spark, d))
    return flat(out)


@query("patch_status", with_fixtures("SELECT id, request_id, st AS status FROM ps", "cat_assets", "cat_patches", "cat_permissions", "cat_users", **PATCH_CTES))
def patch_status(spark, d):
    return CH.patch_assets(_assets(spark, d), FX.patches(spark, d), NOW, permissions=FX.permissions(spark, d), users=FX.users(spark, d))[1]


#: The first permitted request for an id deletes it.
DELETE_CTES = EDITORS | {
    "dr": """SELECT r.*, a.datastack, (r.user_id, a.datastack) IN (SELECT user_id, resource FROM may_edit)
      OR r.user_id IN (SELECT user_id FROM admins) AS allowed
    FROM cat_deletes r LEFT JOIN cat_assets a ON a.id = r.id""",
    "df": "SELECT id, min(request_id) AS first FROM dr WHERE datastack IS NOT NULL AND allowed GROUP BY id",
}
_DELETES = ("cat_assets", "cat_deletes", "cat_permissions", "cat_users")


def _deleted(spark, d):
    return CH.delete_requests(_assets(spark, d), FX.delete_requests(spark, d), FX.permissions(spark, d), FX.users(spark, d))


@query("delete_assets", with_fixtures(f"SELECT {FLAT_COLS} FROM cat_assets WHERE id NOT IN (SELECT id FROM df)", *_DELETES, **DELETE_CTES))
def delete_assets(spark, d):
    return flat(_deleted(spark, d)[0])


@query("delete_status", with_fixtures(
    "SELECT id, request_id, CASE WHEN datastack IS NULL OR coalesce(request_id > first, false) THEN 'not_found' "
    "WHEN NOT allowed THEN 'forbidden' ELSE 'deleted' END AS status FROM dr LEFT JOIN df USING (id)", *_DELETES, **DELETE_CTES))
def delete_status(spark, d):
    return _deleted(spark, d)[1]


_NA = ("SELECT * FROM cat_annotations WHERE (tie // 100003) % 2 = 0 "
       "AND asset_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 5 = 0)")
REPLACE_SQL = f"""SELECT r.id,
  CASE WHEN r.id IN (SELECT asset_id FROM tm) THEN 'invalid_request'
    WHEN a.id IS NULL OR coalesce(a.expires_at < {NOW_SQL}, false) THEN 'not_found'
    WHEN a.asset_type <> 'table' THEN 'not_table'
    WHEN NOT {MAY_EDIT_SQL} THEN 'forbidden'
    WHEN r.id IN (SELECT asset_id FROM t1 UNION SELECT asset_id FROM t2 UNION SELECT asset_id FROM t3) THEN 'rejected'
    ELSE 'updated' END AS status,
  (SELECT count(*) FROM ta n WHERE n.asset_id = r.id) AS n_new
FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey AS user_id FROM orders WHERE o_orderkey % 5 = 0) r LEFT JOIN cat_assets a ON a.id = r.id"""


REPLACE_CTES = EDITORS | {
    "ta": _NA, "tm": f"SELECT asset_id FROM ta WHERE ({KIND_ERROR_SQL}) IS NOT NULL", "t1": TARGET_SQL,
    "t2": GROUP_SQL.replace("FROM cat_annotations", "FROM ta"), "t3": DTYPE_SQL.replace("FROM cat_annotations a", "FROM ta a"),
}


@query("replace_annotations", with_fixtures(
    REPLACE_SQL, "cat_assets", "cat_annotations", "cat_mat_objects", "cat_columns", "cat_permissions", "cat_users", **REPLACE_CTES))
def replace_annotations(spark, d):
    req, new = FX.annotation_updates(spark, d)
    assets = FX.assets(spark, d)
    _, st = CH.replace_annotations(assets, FX.annotations(spark, d), req, new, FX.mat_objects(spark, d), NOW,
                                   permissions=FX.permissions(spark, d), users=FX.users(spark, d))
    counts = new.groupBy(F.col("asset_id").alias("id")).agg(F.count(F.lit(1)).alias("n_new"))
    return st.join(counts, "id", "left").select("id", "status", F.coalesce("n_new", F.lit(0)).alias("n_new"))


_ANN = ("asset_id, pos, tie, column_name, description, kind, target_table, target_column, node_level, "
        "array_to_string(list_transform(resolution, lambda x: CAST(x AS VARCHAR)), ',') AS resolution, axis, point_group, axis_resolution")


@query("replaced_annotations", with_fixtures(
    f"SELECT {_ANN} FROM cat_annotations WHERE asset_id NOT IN (SELECT id FROM ok) "
    f"UNION ALL SELECT {_ANN} FROM ta WHERE asset_id IN (SELECT id FROM ok)",
    "cat_assets", "cat_annotations", "cat_mat_objects", "cat_columns", "cat_permissions", "cat_users", **REPLACE_CTES,
    ok=f"SELECT id FROM ({REPLACE_SQL}) WHERE status = 'updated'"))
def replaced_annotations(spark, d):
    """SNK-04: the annotation table after the replacements."""
    req, new = FX.annotation_updates(spark, d)
    out, _ = CH.replace_annotations(FX.assets(spark, d), FX.annotations(spark, d), req, new, FX.mat_objects(spark, d), NOW,
                                    permissions=FX.permissions(spark, d), users=FX.users(spark, d))
    return flat_kind(out)


def dtype_sql(number: str, kind: str) -> str:
    """The type of column ``i`` of stored table ``number``, as the reader of the format ``kind`` names it."""
    case = lambda names: "CASE (" + number + " + i) % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(names)) + " END"
    return f"CASE {kind} WHEN 'parquet' THEN {case(FX.PARQUET_DTYPES)} ELSE {case(DTYPE_CYCLE)} END"


#: Rows and bytes of stored table ``num``; the size of a Parquet file depends on its writer and is compared in pytest.
ROWS_SQL = f"7 * (num % {FX.MOUNTS}) + 3"
BYTES_SQL = f"CASE WHEN lower(format) = 'delta' THEN 1000 * (num % {FX.MOUNTS}) + 17 END"


def _refreshed(new: str, old: str, name: str) -> str:
    return f"CASE WHEN status = 'refreshed' THEN {new} ELSE {old} END AS {name}"


REFRESH_SQL = f"""SELECT id, {_refreshed(ROWS_SQL, "n_rows", "n_rows")},
  {_refreshed("CAST(1 + num % 6 AS INTEGER)", "n_columns", "n_columns")}, {_refreshed(BYTES_SQL, "n_bytes", "n_bytes")},
  {_refreshed(f"(SELECT string_agg('col_' || i || ':' || {dtype_sql('num', 'lower(format)')}, ',' ORDER BY i) FROM range(1, 7) AS r(i) WHERE i <= 1 + num % 6)", "column_list", "column_list")},
  {_refreshed("''", "partition_list", "partition_list")}, {_refreshed(NOW_SQL, "metadata_cached_at", "metadata_cached_at")}, status
FROM (SELECT a.*, CAST(regexp_extract(a.uri, '/([0-9]+)$', 1) AS BIGINT) AS num,
    CASE WHEN CAST(a.id AS BIGINT) % 7 <> 0 THEN NULL WHEN coalesce(a.expires_at < {NOW_SQL}, false) THEN 'not_found'
      WHEN a.asset_type <> 'table' THEN 'not_table'
      WHEN NOT {MAY_EDIT_SQL} THEN 'forbidden' WHEN a.format IS NULL THEN 'no_format'
      WHEN lower(a.format) NOT IN ('delta', 'parquet') THEN 'unsupported_format'
      WHEN NOT EXISTS (SELECT 1 FROM cat_storage s WHERE s.uri = a.uri AND s.actual_format = lower(a.format)) THEN 'extraction_failed'
      ELSE 'refreshed' END AS status
  FROM (SELECT *{LISTS_SQL} FROM cat_assets) a LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS rid, o_custkey AS user_id FROM orders) r ON r.rid = a.id)"""


@query("refresh_metadata", with_fixtures(REFRESH_SQL, "cat_assets", "cat_storage", "cat_columns", "cat_permissions", "cat_users", **EDITORS))
def refresh_metadata(spark, d):
    """SNK-05: the metadata of every asset after the refresh, read from stored tables, with the status of the requested ones."""
    assets, asked = FX.assets(spark, d), FX.refresh_requests(spark, d)
    located = CH.refreshable(assets, asked, NOW).join(FX.located(spark, d), "uri")
    out, st = CH.refresh_metadata(assets, asked, EX.extracted(located), NOW, FX.permissions(spark, d), FX.users(spark, d))
    rows = whole(out).select("id", "n_rows", "n_columns", "n_bytes", "column_list", "partition_list", "metadata_cached_at",
                             F.lower("format").alias("fmt")).join(st.drop("user_id"), "id", "left")
    measured = F.when((F.col("status") == "refreshed") & (F.col("fmt") == "parquet"), F.lit(None)).otherwise(F.col("n_bytes"))
    return rows.withColumn("n_bytes", measured).drop("fmt")
