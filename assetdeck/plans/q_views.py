"""Registered queries: asset / table / mixed views, dot paths, form normalisation, detail view."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as FX
from .. import schema as S
from ..functions import kinds as K
from ..functions import properties as PR
from ..operators import access as AC
from ..operators import display as D
from ..operators import listing as L
from ..operators import views as V
from ..operators.requests import registration_row as reg_row
from .fixture_sql import NOW_SQL, with_fixtures
from .q_annotations import LAST_SQL
from .q_checks import ACCESS_PLAN_SQL
from .q_listing import FLAT_COLS, LISTS_SQL, _called, _list_tables_sql, _stored, flat_cols
from .q_scalars import KIND_LABEL_SQL
from .registry import query

NOW = FX.DEFAULT_NOW
BASE = ", ".join(S.BASE_COLUMNS)


@query("asset_view", with_fixtures(f"SELECT {BASE} FROM cat_assets", "cat_assets"))
def asset_view(spark, d):
    return FX.assets(spark, d, with_columns=False).select(*S.BASE_COLUMNS)


#: Merged columns and annotations of each table as text, in order.
MERGED_TEXT_SQL = f"""SELECT c.asset_id, string_agg(c.name || '|' || c.dtype || '|' || coalesce(l.description, '') || '|' || coalesce({KIND_LABEL_SQL}, ''), ';' ORDER BY c.pos) AS merged
FROM cat_columns c LEFT JOIN ({LAST_SQL}) l ON c.asset_id = l.asset_id AND c.name = l.column_name GROUP BY c.asset_id"""
ANNOTATION_TEXT_SQL = f"""SELECT asset_id, string_agg(column_name || '|' || coalesce(description, '') || '|' || coalesce({KIND_LABEL_SQL}, ''), ';' ORDER BY pos, tie) AS annotations
FROM cat_annotations GROUP BY asset_id"""
VIEW_CTES = {"merged_text": MERGED_TEXT_SQL, "annotation_text": ANNOTATION_TEXT_SQL}
VIEW_FROM_SQL = f"""(SELECT {FLAT_COLS}{LISTS_SQL} FROM cat_assets) a
LEFT JOIN merged_text m ON m.asset_id = a.id LEFT JOIN annotation_text n ON n.asset_id = a.id"""
VIEW_TEXT_SQL = """CASE WHEN a.asset_type = 'table' THEN coalesce(m.merged, '') END AS merged,
  CASE WHEN a.asset_type = 'table' THEN coalesce(n.annotations, '') END AS annotations"""


def shown_lists(rows, *before):
    """The columns ``before`` and the nested arrays of a view as text."""
    label = lambda x: F.coalesce(K.kind_label(x["kind"]), F.lit(""))
    text = lambda c: F.coalesce(c, F.lit(""))
    merged = F.transform("merged", lambda x: F.concat_ws("|", x["name"], x["dtype"], text(x["description"]), label(x)))
    annotations = F.transform("annotations", lambda x: F.concat_ws("|", x["column_name"], text(x["description"]), label(x)))
    return rows.select(*before, F.array_join(merged, ";").alias("merged"), F.array_join(annotations, ";").alias("annotations"))


def shown(rows, *before):
    """Rows of a view as flat columns, nested arrays as text."""
    columns = F.transform("cached_metadata.columns", lambda c: F.concat_ws(":", c["name"], c["dtype"]))
    return shown_lists(rows, *before, *flat_cols(), F.array_join(columns, ",").alias("column_list"),
                       F.array_join("cached_metadata.partition_columns", ",").alias("partition_list"))


@query("table_view", with_fixtures(f"SELECT a.*, {VIEW_TEXT_SQL} FROM {VIEW_FROM_SQL} WHERE a.asset_type = 'table'",
                                   "cat_assets", "cat_columns", "cat_annotations", **VIEW_CTES))
def table_view(spark, d):
    return shown(V.table_view(FX.assets(spark, d), FX.annotations(spark, d)))


@query("mixed_view", with_fixtures(f"SELECT a.*, {VIEW_TEXT_SQL} FROM {VIEW_FROM_SQL}", "cat_assets", "cat_columns", "cat_annotations", **VIEW_CTES))
def mixed_view(spark, d):
    return shown(V.mixed_view(FX.assets(spark, d), FX.annotations(spark, d)))


@query("dot_path", with_fixtures(
    "SELECT id, n_rows AS cached_metadata_n_rows, "
    "CASE WHEN json_valid(properties) THEN json_extract_string(properties, '$.nested.level') END AS properties_nested_level, "
    "CASE WHEN json_valid(properties) THEN json_extract_string(properties, '$.source') END AS properties_source, "
    "CASE WHEN json_valid(properties) THEN json_extract_string(properties, '$.tag.x') END AS properties_tag_x "
    "FROM cat_assets", "cat_assets"))
def dot_path(spark, d):
    a = FX.assets(spark, d, with_columns=False)
    return a.select("id", D.dot_path("cached_metadata.n_rows").alias("cached_metadata_n_rows"),
                    PR.property_get("properties", "nested.level").alias("properties_nested_level"),
                    PR.property_get("properties", "source").alias("properties_source"),
                    # 'tag' is a string: a path through a non-object parent is NULL
                    PR.property_get("properties", "tag.x").alias("properties_tag_x"))


def _blank(c: str) -> str:
    return f"nullif(trim({c}), '')"


REG_ROW_SQL = f"""SELECT seq, {_blank('datastack')} AS n_datastack, {_blank('name')} AS n_name, {_blank('uri')} AS n_uri,
  coalesce({_blank('format')}, 'delta') AS n_format, TRY_CAST({_blank('mat_version')} AS INTEGER) AS n_mat_version,
  coalesce(TRY_CAST({_blank('revision')} AS INTEGER), 0) AS n_revision,
  coalesce({_blank('mutability')}, 'static') AS n_mutability, coalesce({_blank('maturity')}, 'stable') AS n_maturity,
  is_managed = 'true' AS n_is_managed, {_blank('access_group')} AS n_access_group,
  CASE WHEN trim(properties) <> '' AND json_valid(trim(properties)) THEN trim(properties) ELSE '{{}}' END AS n_properties,
  TRY_CAST({_blank('expires_at')} AS TIMESTAMP) AS n_expires_at,
  CASE WHEN {_blank('uri')} IS NULL OR {_blank('name')} IS NULL OR {_blank('datastack')} IS NULL THEN 'URI, name, and datastack are required.'
    WHEN {_blank('mat_version')} IS NOT NULL AND TRY_CAST({_blank('mat_version')} AS INTEGER) IS NULL THEN 'Mat version must be an integer.'
    WHEN {_blank('revision')} IS NOT NULL AND TRY_CAST({_blank('revision')} AS INTEGER) IS NULL THEN 'Revision must be an integer.'
    WHEN {_blank('expires_at')} IS NOT NULL AND TRY_CAST({_blank('expires_at')} AS TIMESTAMP) IS NULL THEN 'Expires at must be a timestamp.' END AS form_error
FROM cat_forms"""


@query("registration_row", with_fixtures(REG_ROW_SQL, "cat_forms"))
def registration_row(spark, d):
    r = reg_row(FX.registration_forms(spark, d))
    return r.select("seq", *[c for c in r.columns if c.startswith("n_")], "form_error")


#: The status of each view request (JON-10).
VIEW_STATUS_SQL = f"""SELECT r.request_id, r.user_id, r.asset_id,
  CASE WHEN a.id IS NULL OR coalesce(a.expires_at < {NOW_SQL}, false) THEN 'not_found'
    WHEN coalesce(u.is_admin, false)
      OR EXISTS (SELECT 1 FROM cat_permissions p WHERE p.user_id = r.user_id AND p.resource = coalesce(nullif(a.access_group, ''), a.datastack)
                 AND p.permission IN ('view', 'admin'))
      OR EXISTS (SELECT 1 FROM cat_memberships m WHERE m.user_id = r.user_id AND m.group_name = coalesce(nullif(a.access_group, ''), a.datastack))
      THEN 'ok' ELSE 'forbidden' END AS status
FROM cat_view_requests r LEFT JOIN cat_assets a ON a.id = r.asset_id LEFT JOIN cat_users u ON u.user_id = r.user_id"""
_VIEW_FIXES = ("cat_assets", "cat_columns", "cat_annotations", "cat_view_requests", "cat_users", "cat_permissions", "cat_memberships")


@query("asset_detail", with_fixtures(f"""SELECT s.request_id, s.user_id, s.asset_id, s.status, v.* FROM ({VIEW_STATUS_SQL}) s
LEFT JOIN (SELECT a.*, {VIEW_TEXT_SQL} FROM {VIEW_FROM_SQL}) v ON s.status = 'ok' AND v.id = s.asset_id""", *_VIEW_FIXES, **VIEW_CTES))
def asset_detail(spark, d):
    """PIP-09: every request with its status; granted ones with the asset's whole row, merged columns and kind labels."""
    rows = V.asset_detail(FX.view_requests(spark, d), FX.assets(spark, d), FX.annotations(spark, d), FX.permissions(spark, d),
                          FX.memberships(spark, d), FX.users(spark, d), NOW)
    return shown(rows, "request_id", "user_id", "asset_id", "status")


@query("access_response", with_fixtures(f"""SELECT s.request_id, s.user_id, s.asset_id, coalesce(p.status, s.status) AS status, p.* EXCLUDE (id, status)
FROM ({VIEW_STATUS_SQL}) s LEFT JOIN ({ACCESS_PLAN_SQL}) p ON s.status = 'ok' AND p.id = s.asset_id""",
                                        "cat_assets", "cat_view_requests", "cat_users", "cat_permissions", "cat_memberships"))
def access_response(spark, d):
    """PRJ-09 behind JON-10: how each caller would reach the asset asked for, or why not."""
    return AC.access_responses(FX.view_requests(spark, d), FX.assets(spark, d, with_columns=False), FX.permissions(spark, d),
                               FX.memberships(spark, d), FX.users(spark, d), NOW)


@query("list_tables", _list_tables_sql())
def list_tables(spark, d):
    """PIP-08: tables with merged columns and annotations, for a caller who may see them and one who may not."""
    tables = L.list_tables(_stored(spark, d), "ds1", NOW, source="user", maturity="stable")
    return _called(spark, d, shown(V.table_view(tables, FX.annotations(spark, d))), "ds1")
