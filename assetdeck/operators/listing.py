"""Asset listing: filter, sort, page, total (SRT-01..05, AGG-01, PIP-07, PIP-08).

Plan shape for a page: the filters reach the Parquet scan; ``orderBy + offset
+ limit`` becomes ``TakeOrderedAndProject`` (each task keeps only its top
``offset + limit`` rows, no full sort, no shuffle of the data); the total is a
scalar subquery over the same filtered scan with a partial count per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from . import access as AC
from . import display as D
from .predicates import compose_filters


def sort_column(sort_by: str | None) -> str:
    """Allow-listed sort column; anything else (including dotted keys) falls back to ``name``."""
    return sort_by if sort_by in S.BASE_COLUMNS else "name"


def order_nulls_first(sort_by: str | None, sort_order: str = "asc") -> list[Column]:
    """Sort keys: the column with NULLs first in both directions, then ``id`` as tie-breaker."""
    c = F.col(sort_column(sort_by))
    if sort_order not in ("asc", "desc"):
        raise ValueError("sort_order must be 'asc' or 'desc'")
    key = c.desc_nulls_first() if sort_order == "desc" else c.asc_nulls_first()
    return [key, F.col("id").asc()]


def check_page_args(limit: int | None, offset: int, limit_max: int = S.LIST_LIMIT_MAX) -> None:
    if limit is not None and not 1 <= limit <= limit_max:
        raise ValueError(f"limit must be between 1 and {limit_max}")
    if offset < 0:
        raise ValueError("offset must be >= 0")


def total_count(filtered: DataFrame) -> Column:
    """AGG-01 as a scalar subquery column (no driver round trip)."""
    return filtered.agg(F.count(F.lit(1)).alias("total")).scalar()


def page(filtered: DataFrame, sort_by: str | None = "name", sort_order: str = "asc",
         limit: int | None = None, offset: int = 0, with_total: bool = True) -> DataFrame:
    """SRT-03: without ``limit`` the offset is ignored and all rows come back (sorted);
    with it, rows ``offset+1 .. offset+limit`` plus ``page_pos`` and ``total``."""
    check_page_args(limit, offset)
    keys = order_nulls_first(sort_by, sort_order)
    if limit is None:
        return filtered.orderBy(*keys)
    top = filtered.orderBy(*keys).offset(offset).limit(limit) if offset else filtered.orderBy(*keys).limit(limit)
    # at most ``limit`` (<= 1000) rows remain, so this window is a single small task
    out = top.withColumn("page_pos", (F.row_number().over(Window.orderBy(*keys)) + F.lit(offset)).cast("int"))
    if with_total:
        out = out.withColumn("total", total_count(filtered))
    return out


def after(sort_by: str | None, sort_order: str, value: Any, id_: str) -> Column:
    """Rows that come after the row with this sort value and id, in the order of ``order_nulls_first``.

    The first condition alone is a plain comparison that reaches the scan."""
    c = F.col(sort_column(sort_by))
    if sort_order not in ("asc", "desc"):
        raise ValueError("sort_order must be 'asc' or 'desc'")
    same_later = F.col("id") > F.lit(id_)
    if value is None:
        return c.isNotNull() | same_later
    v = F.lit(value)
    beyond, upto = (c < v, c <= v) if sort_order == "desc" else (c > v, c >= v)
    return upto & (beyond | same_later)


def page_after(filtered: DataFrame, sort_by: str | None = "name", sort_order: str = "asc", limit: int = S.EXPLORE_LIMIT_DEFAULT,
               cursor: tuple[Any, str] | None = None) -> DataFrame:
    """SRT-03 by key: the next ``limit`` rows after ``cursor`` (sort value and id of the last row seen; None: from the start).

    However deep the page lies, each task keeps ``limit`` rows only; ``total`` counts all of ``filtered``, ``cursor_value``
    and ``cursor_id`` of the last row are the next cursor."""
    check_page_args(limit, 0)
    rest = filtered if cursor is None else filtered.where(after(sort_by, sort_order, *cursor))
    top = rest.orderBy(*order_nulls_first(sort_by, sort_order)).limit(limit)
    return top.withColumn("cursor_value", F.col(sort_column(sort_by))).withColumn("cursor_id", F.col("id")).withColumn("total", total_count(filtered))


def for_callers(rows: DataFrame, user_ids: Sequence[int], datastack: str, permissions: DataFrame, users: DataFrame, wanted: str = "view") -> DataFrame:
    """``rows`` with ``caller`` and ``status`` ok for each caller who has ``wanted`` on the datastack; one row that says forbidden for each other.

    The rows are computed once, however many callers ask for them."""
    who = rows.sparkSession.createDataFrame([(u, datastack) for u in user_ids], "user_id long, datastack string")
    verdict = AC.datastack_permission(who, permissions, users, wanted).select(F.col("user_id").alias("caller"), "allowed")
    allowed = verdict.where("allowed").agg(F.collect_list("caller")).scalar()  # one row
    granted = rows.withColumn("_callers", allowed).select(F.explode("_callers").alias("caller"), F.lit("ok").alias("status"), *rows.columns)
    return granted.unionByName(verdict.where(~F.col("allowed")).select("caller", F.lit("forbidden").alias("status")), allowMissingColumns=True)


def for_caller(rows: DataFrame, user_id: int, datastack: str, permissions: DataFrame, users: DataFrame, wanted: str = "view") -> DataFrame:
    """``for_callers`` for one caller."""
    return for_callers(rows, [user_id], datastack, permissions, users, wanted)


def list_assets(assets: DataFrame, datastack: str, now, *, limit: int | None = None, offset: int = 0,
                sort_by: str = "name", sort_order: str = "asc", **filters: Any) -> DataFrame:
    """PIP-07: required datastack, hides expired, optional equality / contains filters."""
    filtered = assets.where(compose_filters(datastack=datastack, now=now, **filters))
    return page(filtered, sort_by, sort_order, limit, offset)


def list_tables(assets: DataFrame, datastack: str, now, **filters: Any) -> DataFrame:
    """PIP-08: tables only, equality filters (incl. ``source``), no sort, no paging."""
    if "name_contains" in filters:
        raise ValueError("list_tables has no name_contains filter")
    pred = compose_filters(datastack=datastack, now=now, **filters) & (F.col("asset_type") == "table")
    return assets.where(pred)


def explore_filters(**form: str) -> dict:
    """Explore-form rule: blank values mean 'no filter'; ``name`` becomes a contains filter."""
    out = {}
    for k, v in form.items():
        if v is None or v == "":
            continue
        if k == "name":
            out["name_contains"] = v
        elif k == "mat_version":
            out["mat_version"] = int(v)
        else:
            out[k] = v
    return out


def explore_page(assets: DataFrame, datastack: str, now, *, limit: int = S.EXPLORE_LIMIT_DEFAULT, offset: int = 0,
                 sort_by: str = "name", sort_order: str = "asc", paths: tuple = tuple(D.HEADINGS), **form: str) -> DataFrame:
    """SRT-05: filters + sort + page + total + page info + formatted cells, one plan."""
    check_page_args(limit, offset, S.EXPLORE_LIMIT_MAX)
    filtered = assets.where(compose_filters(datastack=datastack, now=now, **explore_filters(**form)))
    p = page(filtered, sort_by, sort_order, limit, offset)
    shown = D.display_view(p, paths, keep=("id", "page_pos", "total"))
    total = F.col("total")
    return shown.select(
        "*",
        F.lit(offset + 1).alias("showing_from"),
        # rows on this page = min(limit, total - offset): no extra pass over the page
        (F.lit(offset) + F.least(F.lit(limit).cast("bigint"), total - F.lit(offset))).cast("int").alias("showing_to"),
        F.lit(offset // limit + 1).alias("page_number"),
        ((total - 1) / F.lit(limit)).cast("bigint").alias("_pc"),
        F.lit(offset > 0).alias("has_prev"),
        (F.lit(offset + limit) < total).alias("has_next"),
    ).withColumn("page_count", (F.col("_pc") + 1).cast("bigint")).drop("_pc")
