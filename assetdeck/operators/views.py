"""Whole rows of assets and tables: merged columns and annotations nested in their order (PRJ-02, PRJ-03, PIP-09).

Merging runs in long form; only the finished rows of a table are gathered, into the one array its response holds, as
its discovered columns already are one array of its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import access as AC
from . import annotations as AN
from .joins import among


def _kind() -> Column:
    return F.when(F.col("kind").isNotNull(), F.struct(*AN.KIND_FIELDS)).alias("kind")


def nested_columns(merged: DataFrame) -> DataFrame:
    """``(asset_id, merged)``: merged columns (``annotations.merge_columns``) as one array in position order; none: no row."""
    item = F.struct("pos", "name", "dtype", "description", _kind())
    return merged.groupBy("asset_id").agg(F.array_sort(F.collect_list(item)).alias("merged"))


def nested_annotations(annotations: DataFrame) -> DataFrame:
    """``(asset_id, annotations)``: the annotations as submitted, orphans and earlier ones of a column included."""
    item = F.struct("pos", "tie", "column_name", "description", _kind())
    return annotations.groupBy("asset_id").agg(F.array_sort(F.collect_list(item)).alias("annotations"))


def mixed_view(assets: DataFrame, annotations: DataFrame) -> DataFrame:
    """PRJ-03: every asset; ``merged`` and ``annotations`` are arrays for tables (empty if they have none), NULL for others."""
    tables = assets.where(F.col("asset_type") == "table")
    mine = annotations.join(tables.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
    return with_lists(assets, AN.merge_columns(AN.explode_columns(tables), mine), mine)


def with_lists(assets: DataFrame, merged: DataFrame, annotations: DataFrame) -> DataFrame:
    """``assets`` with the arrays ``merged`` and ``annotations``, from merged columns and annotations in long form."""
    out = assets
    for part, column in ((nested_columns(merged), "merged"), (nested_annotations(annotations), "annotations")):
        out = out.join(part.withColumnRenamed("asset_id", "_id"), F.col("id") == F.col("_id"), "left").drop("_id")
        empty = F.array().cast(part.schema[column].dataType)
        out = out.withColumn(column, F.when(F.col("asset_type") == "table", F.coalesce(column, empty)))
    return out


def table_view(assets: DataFrame, annotations: DataFrame) -> DataFrame:
    """PRJ-02: the tables among the assets, as ``mixed_view`` shows them."""
    return mixed_view(assets.where(F.col("asset_type") == "table"), annotations)


def asset_detail(requests: DataFrame, assets: DataFrame, annotations: DataFrame, permissions: DataFrame, memberships: DataFrame,
                 users: DataFrame, now, auth_enabled: bool = True) -> DataFrame:
    """PIP-09: one row per request (``request_id, user_id, asset_id``): ``status`` and, where it is ok, the asset's whole row.

    Requests for what is missing or expired are not_found, those without view access forbidden; assets without
    columns have an empty list. Assets and annotations nobody may see are dropped before they are shuffled."""
    judged = AC.asset_view_access(requests, assets, permissions, memberships, users, now, auth_enabled)
    wanted = judged.where("status = 'ok'").select(F.col("asset_id").alias("id")).distinct()
    seen = among(assets, "id", wanted).join(wanted, "id", "left_semi")
    shown = mixed_view(seen, among(annotations, "asset_id", wanted))
    granted = F.when(F.col("status") == "ok", F.col("asset_id"))
    return judged.withColumn("_wanted", granted).join(shown, F.col("_wanted") == F.col("id"), "left").drop("_wanted", "resource")
