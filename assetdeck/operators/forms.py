"""Flat form cells -> annotation structs (PRJ-10).

A browser form posts one value per (row index, field).  The pivot is a
grouped aggregation keyed by (asset, index): map-side partial aggregation
keeps it cheap, and one key holds at most one form row's cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import node_level_from_form, parse_resolution, resolution_has_non_number

FORM_FIELDS = ["name", "desc", "kind", "target_table", "target_column", "node_level", "custom_level",
               "resolution", "axis", "point_group"]


def pivot_cells(cells: DataFrame) -> DataFrame:
    """``(asset_id, idx, tie, field, value)`` -> one row per form row with a column per field."""
    return cells.groupBy("asset_id", "idx", "tie").pivot("field", FORM_FIELDS).agg(F.first("value"))


def _blank_null(c):
    t = F.trim(F.col(c))
    return F.when(t != "", t)


def cells_to_annotations(cells: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Annotation per form row.

    materialization needs both targets; segmentation ``custom`` + N becomes
    ``levelN_id``; packed resolution must be exactly three numbers else NULL;
    split point needs an axis.  ``keep_empty=False`` (register form) drops rows
    with neither description nor kind; the edit form keeps them.
    A non-number in a resolution is flagged in ``form_error``.
    """
    rows = pivot_cells(cells)
    tag = _blank_null("kind")
    tt, tc = _blank_null("target_table"), _blank_null("target_column")
    level = node_level_from_form("node_level", "custom_level")
    packed_res = F.when(_blank_null("resolution").isNotNull(), parse_resolution("resolution"))
    axis = _blank_null("axis")
    split_res = _blank_null("resolution").try_cast("double")
    kind = (
        F.when((tag == "materialization") & tt.isNotNull() & tc.isNotNull(),
               F.struct(tag.alias("kind"), tt.alias("target_table"), tc.alias("target_column"),
                        *[F.lit(None).cast(t).alias(n) for n, t in (("node_level", "string"), ("resolution", "array<double>"),
                                                                   ("axis", "string"), ("point_group", "string"), ("axis_resolution", "double"))]))
        .when((tag == "segmentation") & level.isNotNull(),
              F.struct(tag.alias("kind"), F.lit(None).cast("string").alias("target_table"), F.lit(None).cast("string").alias("target_column"),
                       level.alias("node_level"), F.lit(None).cast("array<double>").alias("resolution"),
                       F.lit(None).cast("string").alias("axis"), F.lit(None).cast("string").alias("point_group"),
                       F.lit(None).cast("double").alias("axis_resolution")))
        .when(tag == "packed_point",
              F.struct(tag.alias("kind"), F.lit(None).cast("string").alias("target_table"), F.lit(None).cast("string").alias("target_column"),
                       F.lit(None).cast("string").alias("node_level"), packed_res.alias("resolution"),
                       F.lit(None).cast("string").alias("axis"), F.lit(None).cast("string").alias("point_group"),
                       F.lit(None).cast("double").alias("axis_resolution")))
        .when((tag == "split_point") & axis.isNotNull(),
              F.struct(tag.alias("kind"), F.lit(None).cast("string").alias("target_table"), F.lit(None).cast("string").alias("target_column"),
                       F.lit(None).cast("string").alias("node_level"), F.lit(None).cast("array<double>").alias("resolution"),
                       axis.alias("axis"), _blank_null("point_group").alias("point_group"), split_res.alias("axis_resolution")))
    )
    bad_number = (
        ((tag == "packed_point") & F.coalesce(resolution_has_non_number("resolution"), F.lit(False)))
        | ((tag == "split_point") & axis.isNotNull() & _blank_null("resolution").isNotNull() & split_res.isNull())
    )
    out = rows.select(
        "asset_id", "idx", "tie",
        F.col("name").alias("column_name"),
        _blank_null("desc").alias("description"),
        kind.alias("kind"),
        F.when(bad_number, F.lit("could not convert string to float")).alias("form_error"),
    )
    if not keep_empty:
        out = out.where(F.col("description").isNotNull() | F.col("kind").isNotNull())
    return out
