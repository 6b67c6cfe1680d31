"""Registered queries: scans, predicates, sort/page, listing, explore view."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as FX
from ..operators import listing as L
from ..operators import predicates as P
from ..sources.store import stored_assets
from .fixture_sql import NOW_SQL, with_fixtures
from .registry import query

NOW = FX.DEFAULT_NOW

FLAT_COLS = ("id, datastack, name, mat_version, revision, uri, format, asset_type, owner, is_managed, mutability, "
             "maturity, properties, access_group, created_at, expires_at, source, n_rows, n_columns, n_bytes, metadata_cached_at")


def flat(df: DataFrame) -> DataFrame:
    """Asset rows with the metadata struct flattened to scalars."""
    return df.select(*flat_cols())


def _assets(spark, d):
    return FX.assets(spark, d, with_columns=False)


def _stored(spark, d):
    """Whole rows as stored (partitioned by datastack): filters prune partitions and reach the Parquet scan."""
    return stored_assets(spark, d, ["orders"], FX.assets_to_store)


def _sql(where: str, extra: str = "") -> str:
    return with_fixtures(f"SELECT {FLAT_COLS}{extra} FROM cat_assets WHERE {where}", "cat_assets")


#: Columns and partition columns of the metadata as text, for whole-row results.
LISTS_SQL = (", (SELECT string_agg(c.name || ':' || c.dtype, ',' ORDER BY c.pos) FROM cat_columns c WHERE c.asset_id = cat_assets.id) "
             "AS column_list, CASE WHEN asset_type = 'table' THEN CASE WHEN CAST(id AS BIGINT) % 4 = 1 THEN 'col_1' ELSE '' END END AS partition_list")


def whole(df: DataFrame) -> DataFrame:
    """Asset rows with every part of the metadata."""
    columns = F.transform("cached_metadata.columns", lambda c: F.concat_ws(":", c["name"], c["dtype"]))
    return df.select(*flat_cols(), F.array_join(columns, ",").alias("column_list"),
                     F.array_join("cached_metadata.partition_columns", ",").alias("partition_list"))


def _whole_sql(where: str) -> str:
    return with_fixtures(f"SELECT {FLAT_COLS}{LISTS_SQL} FROM cat_assets WHERE {where}", "cat_assets", "cat_columns")


@query("scan_assets", _whole_sql("true"))
def scan_assets(spark, d):
    return whole(_stored(spark, d))


@query("scan_tables", _whole_sql("asset_type = 'table'"))
def scan_tables(spark, d):
    return whole(_stored(spark, d).where(F.col("asset_type") == "table"))


# --- predicates -------------------------------------------------------------

@query("by_datastack", _sql("datastack = 'ds1'"))
def by_datastack(spark, d):
    return flat(_stored(spark, d).where(P.by_datastack("ds1")))


@query("not_expired", _sql(f"expires_at IS NULL OR expires_at > {NOW_SQL}"))
def not_expired(spark, d):
    return flat(_stored(spark, d).where(P.not_expired(NOW)))


@query("is_expired", _sql(f"expires_at < {NOW_SQL}"))
def is_expired(spark, d):
    return flat(_stored(spark, d).where(P.is_expired(NOW)))


@query("name_eq", _sql("name = 'tbl_42'"))
def name_eq(spark, d):
    return flat(_stored(spark, d).where(P.name_eq("tbl_42")))


@query("name_contains", _sql("name ILIKE '%L_4%'"))
def name_contains(spark, d):
    # '_' stays a wildcard: matches tbl_4.., tbl_14.. and "l" + any char + "4"
    return flat(_stored(spark, d).where(P.name_contains("L_4")))


@query("mat_version_eq", _sql("mat_version = 903"))
def mat_version_eq(spark, d):
    return flat(_stored(spark, d).where(P.eq("mat_version", 903)))


@query("revision_eq", _sql("revision = 3"))
def revision_eq(spark, d):
    return flat(_stored(spark, d).where(P.eq("revision", 3)))


@query("format_eq", _sql("format = 'delta'"))
def format_eq(spark, d):
    return flat(_stored(spark, d).where(P.eq("format", "delta")))


@query("asset_type_eq", _sql("asset_type = 'asset'"))
def asset_type_eq(spark, d):
    return flat(_stored(spark, d).where(P.eq("asset_type", "asset")))


@query("mutability_eq", _sql("mutability = 'mutable'"))
def mutability_eq(spark, d):
    return flat(_stored(spark, d).where(P.eq("mutability", "mutable")))


@query("maturity_eq", _sql("maturity = 'draft'"))
def maturity_eq(spark, d):
    return flat(_stored(spark, d).where(P.eq("maturity", "draft")))


@query("source_eq", _sql("source = 'materialization'"))
def source_eq(spark, d):
    return flat(_stored(spark, d).where(P.eq("source", "materialization")))


@query("compose_filters", _sql(
    f"datastack = 'ds2' AND (expires_at IS NULL OR expires_at > {NOW_SQL}) AND name ILIKE '%1%' "
    "AND format = 'delta' AND maturity = 'stable' AND mutability = 'static'"))
def compose_filters(spark, d):
    pred = P.compose_filters(datastack="ds2", now=NOW, name_contains="1", format="delta", maturity="stable",
                             mutability="static", mat_version=None)
    return flat(_stored(spark, d).where(pred))


_GET_IDS = "SELECT CAST(event_id * 3 AS VARCHAR) AS id FROM events WHERE event_id % 2 = 0"


@query("get_by_id", with_fixtures(
    f"SELECT {FLAT_COLS} FROM cat_assets WHERE id IN ({_GET_IDS}) AND NOT coalesce(expires_at < {NOW_SQL}, false)",
    "cat_assets"))
def get_by_id(spark, d):
    ids = FX.table(spark, d, "events").where("event_id % 2 = 0").selectExpr("CAST(event_id * 3 AS STRING) AS id")
    return flat(P.get_by_id(_stored(spark, d), ids, now=NOW))


# --- sort / page / total ----------------------------------------------------

def _page_sql(where: str, order: str, limit: int, offset: int, cols: str = FLAT_COLS) -> str:
    return with_fixtures(
        f"""SELECT * FROM (
  SELECT {cols}, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS page_pos,
    count(*) OVER () AS total
  FROM cat_assets WHERE {where}) t
WHERE page_pos > {offset} AND page_pos <= {offset + limit}""", "cat_assets")


_LIVE = f"(expires_at IS NULL OR expires_at > {NOW_SQL})"


@query("order_nulls_first", _page_sql(f"datastack = 'ds0' AND {_LIVE}", "mat_version DESC NULLS FIRST, id", 40, 0))
def order_nulls_first(spark, d):
    return flat_page(L.list_assets(_stored(spark, d), "ds0", NOW, limit=40, sort_by="mat_version", sort_order="desc"))


@query("sort_fallback", _page_sql(f"datastack = 'ds3' AND {_LIVE}", "name ASC NULLS FIRST, id", 30, 10))
def sort_fallback(spark, d):
    # a dotted display key is not a column: the listing sorts by name
    return flat_page(L.list_assets(_stored(spark, d), "ds3", NOW, limit=30, offset=10, sort_by="cached_metadata.n_rows"))


@query("page", _page_sql(f"datastack = 'ds1' AND {_LIVE}", "created_at ASC NULLS FIRST, id", 100, 250))
def page_(spark, d):
    return flat_page(L.list_assets(_stored(spark, d), "ds1", NOW, limit=100, offset=250, sort_by="created_at"))


_AFTER = ("TIMESTAMP '1998-03-01 00:00:00'", "4000")


@query("page_after", with_fixtures(f"""SELECT {FLAT_COLS}, created_at AS cursor_value, id AS cursor_id,
  (SELECT count(*) FROM cat_assets WHERE datastack = 'ds1' AND {_LIVE}) AS total FROM cat_assets
WHERE datastack = 'ds1' AND {_LIVE} AND (created_at < {_AFTER[0]} OR created_at = {_AFTER[0]} AND id > '{_AFTER[1]}')
ORDER BY created_at DESC NULLS FIRST, id LIMIT 100""", "cat_assets"))
def page_after(spark, d):
    """SRT-03 by key: the page after a given row costs the same wherever that row lies."""
    live = _stored(spark, d).where(P.compose_filters(datastack="ds1", now=NOW))
    rows = L.page_after(live, "created_at", "desc", 100, (dt.datetime(1998, 3, 1), _AFTER[1]))
    return rows.select(*flat_cols(), "cursor_value", "cursor_id", "total")


@query("total_count", with_fixtures(
    f"SELECT datastack, count(*) AS total FROM cat_assets WHERE {_LIVE} GROUP BY datastack", "cat_assets"))
def total_count(spark, d):
    a = _stored(spark, d).where(P.not_expired(NOW))
    return a.groupBy("datastack").agg(F.count(F.lit(1)).alias("total"))


def flat_cols():
    return [
        "id", "datastack", "name", "mat_version", "revision", "uri", "format", "asset_type", "owner", "is_managed",
        "mutability", "maturity", "properties", "access_group", "created_at", "expires_at", "source",
        F.col("cached_metadata.n_rows").alias("n_rows"), F.col("cached_metadata.n_columns").alias("n_columns"),
        F.col("cached_metadata.n_bytes").alias("n_bytes"), "metadata_cached_at",
    ]


def flat_page(df: DataFrame) -> DataFrame:
    return df.select(*flat_cols(), "page_pos", "total")


@query("list_assets", _page_sql(
    f"datastack = 'ds2' AND {_LIVE} AND format = 'delta' AND name ILIKE '%by_key%'", "revision ASC NULLS FIRST, id", 50, 5))
def list_assets(spark, d):
    return flat_page(L.list_assets(_stored(spark, d), "ds2", NOW, limit=50, offset=5, sort_by="revision",
                                   format="delta", name_contains="by_key"))


#: Callers of the listings below: an administrator, and somebody nobody knows.
CALLERS = (97, -1)


def _called_sql(rows: str) -> str:
    return f"SELECT CAST({CALLERS[0]} AS BIGINT) AS caller, 'ok' AS status, * FROM ({rows}) UNION ALL BY NAME SELECT CAST({CALLERS[1]} AS BIGINT) AS caller, 'forbidden' AS status"


def _called(spark, d, rows, datastack):
    return L.for_callers(rows, CALLERS, datastack, FX.permissions(spark, d), FX.users(spark, d))


@query("list_assets_as", with_fixtures(_called_sql(
    f"SELECT {FLAT_COLS} FROM cat_assets WHERE datastack = 'ds2' AND {_LIVE} AND format = 'delta' AND maturity = 'draft'"), "cat_assets"))
def list_assets_as(spark, d):
    """PIP-07 with its permission step: whole listing for one caller, forbidden for another."""
    return _called(spark, d, flat(L.list_assets(_stored(spark, d), "ds2", NOW, format="delta", maturity="draft")), "ds2")


def _list_tables_sql() -> str:
    from .q_views import VIEW_CTES, VIEW_FROM_SQL, VIEW_TEXT_SQL

    rows = (f"SELECT a.*, {VIEW_TEXT_SQL} FROM {VIEW_FROM_SQL} WHERE datastack = 'ds1' AND asset_type = 'table' AND {_LIVE} "
            "AND source = 'user' AND maturity = 'stable'")
    return with_fixtures(_called_sql(rows), "cat_assets", "cat_columns", "cat_annotations", **VIEW_CTES)


# --- explore view -----------------------------------------------------------

def _fmt_int_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '—' ELSE format('{{:,}}', {x}) END"


def format_bytes_sql(x: str) -> str:
    units = ["KB", "MB", "GB", "TB", "PB"]
    parts = [f"WHEN {x} IS NULL THEN '—'", f"WHEN abs({x}) < 1024 THEN CAST(trunc({x}) AS BIGINT)::VARCHAR || ' B'"]
    scale = 1
    for u in units:
        scale *= 1024
        parts.append(f"WHEN abs({x}) < {scale * 1024}.0 THEN printf('%.1f', {x} / {scale}.0) || ' {u}'")
    parts.append(f"ELSE printf('%.1f', {x} / {scale * 1024}.0) || ' EB'")
    return "CASE " + " ".join(parts) + " END"


EXPLORE_CELLS = (
    "name AS name, coalesce(CAST(mat_version AS VARCHAR), '—') AS mat_version, coalesce(format, '—') AS format, "
    f"maturity AS maturity, CASE WHEN asset_type = 'table' THEN {_fmt_int_sql('n_rows')} ELSE '—' END AS cached_metadata_n_rows, "
    "CASE WHEN asset_type = 'table' THEN coalesce(source, '—') ELSE '—' END AS source, asset_type AS asset_type, "
    "mutability AS mutability, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, "
    f"CASE WHEN asset_type = 'table' THEN {_fmt_int_sql('n_columns')} ELSE '—' END AS cached_metadata_n_columns, "
    f"CASE WHEN asset_type = 'table' THEN {format_bytes_sql('n_bytes')} ELSE '—' END AS cached_metadata_n_bytes, "
    "format('{:,}', revision) AS revision, CAST(owner AS VARCHAR) AS owner"
)


def _explore_sql(where: str, order: str, limit: int, offset: int) -> str:
    inner = _page_sql(where, order, limit, offset)
    return f"""SELECT id, page_pos, total, {EXPLORE_CELLS},
  {offset + 1} AS showing_from, CAST({offset} + count(*) OVER () AS INTEGER) AS showing_to,
  {offset // limit + 1} AS page_number, {str(offset > 0).lower()} AS has_prev, {offset + limit} < total AS has_next,
  CAST((total - 1) // {limit} + 1 AS BIGINT) AS page_count
FROM ({inner}) p"""


@query("explore_page", _explore_sql(f"datastack = 'ds1' AND {_LIVE} AND name ILIKE '%7%' AND maturity = 'stable'",
                                    "name ASC NULLS FIRST, id", 25, 50))
def explore_page(spark, d):
    return L.explore_page(_stored(spark, d), "ds1", NOW, limit=25, offset=50, name="7", maturity="stable", format="")


@query("display_view", with_fixtures(f"SELECT id, {EXPLORE_CELLS} FROM cat_assets", "cat_assets"))
def display_view(spark, d):
    from ..operators import display as D
    return D.display_view(_assets(spark, d))
