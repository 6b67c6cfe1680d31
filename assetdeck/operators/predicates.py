"""Asset predicates (FLT-01 .. FLT-14).

Each function returns a ``Column``; ``compose_filters`` ANDs the ones whose
argument is given.  All of them are plain comparisons, so Catalyst pushes
them into the Parquet scan.
"""

from __future__ import annotations

import functools
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ts(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def by_datastack(datastack: str) -> Column:
    return F.col("datastack") == F.lit(datastack)


def not_expired(now) -> Column:
    """Listing rule: no expiry, or expiry strictly after ``now``."""
    return F.col("expires_at").isNull() | (F.col("expires_at") > _ts(now))


def is_expired(now) -> Column:
    """Point-lookup rule: expiry strictly before ``now`` (equal is still visible)."""
    return F.col("expires_at").isNotNull() & (F.col("expires_at") < _ts(now))


def name_eq(name: str) -> Column:
    return F.col("name") == F.lit(name)


def name_contains(fragment: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` in the fragment stay wildcards."""
    return F.col("name").ilike(f"%{fragment}%")


def eq(column: str, value: Any) -> Column:
    """Exact equality; NULL cells never match."""
    return F.col(column) == F.lit(value)


# keyword -> predicate builder, in the order the listing applies them
FILTERS = {
    "name": name_eq,
    "name_contains": name_contains,
    "mat_version": lambda v: eq("mat_version", v),
    "revision": lambda v: eq("revision", v),
    "format": lambda v: eq("format", v),
    "asset_type": lambda v: eq("asset_type", v),
    "source": lambda v: eq("source", v),
    "mutability": lambda v: eq("mutability", v),
    "maturity": lambda v: eq("maturity", v),
}


def compose_filters(datastack: str | None = None, now=None, **filters: Any) -> Column:
    """AND of the required datastack + expiry predicates and every non-NULL optional filter."""
    preds = []
    if datastack is not None:
        preds.append(by_datastack(datastack))
    if now is not None:
        preds.append(not_expired(now))
    for key, value in filters.items():
        if value is None:
            continue
        if key not in FILTERS:
            raise ValueError(f"unknown filter {key!r}; known: {sorted(FILTERS)}")
        preds.append(FILTERS[key](value))
    return functools.reduce(lambda a, b: a & b, preds, F.lit(True))


def get_by_id(assets: DataFrame, ids: DataFrame, now=None, check_expired: bool = True) -> DataFrame:
    """Assets whose id is in ``ids(id)``; expired ones are hidden unless ``check_expired`` is off."""
    hit = assets.join(ids.select("id").distinct(), "id", "left_semi")
    return hit.where(~is_expired(now)) if check_expired else hit
