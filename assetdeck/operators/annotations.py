"""Column annotations: merge with discovered columns and the kind checks
(PRJ-08, WIN-03, JON-06, JON-07, JON-08, WIN-01, AGG-05).

Everything works on the long form: one row per (asset, column) and one row
per (asset, annotation) with submission order ``(pos, tie)``.  Per-group
"first"/"last" rules keep one row per task and group before the shuffle
(group-limited windows, or grouped aggregations joined back).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kinds as K
from ..functions.dtypes import dtype_class
from .joins import maybe_broadcast

KIND_FIELDS = ["kind", "target_table", "target_column", "node_level", "resolution", "axis", "point_group", "axis_resolution"]


def explode_columns(assets: DataFrame) -> DataFrame:
    """PRJ-08: one row per (asset, position, name, dtype); assets without metadata give none.

    ``posexplode_outer`` + a filter on the element keeps Catalyst from inferring a
    ``size(columns) > 0`` filter that would evaluate the metadata twice below the scan."""
    return assets.select("id", F.posexplode_outer("cached_metadata.columns").alias("p", "c")).where(
        F.col("c").isNotNull()).select(
        F.col("id").alias("asset_id"), (F.col("p") + 1).cast("int").alias("pos"),
        F.col("c.name").alias("name"), F.col("c.dtype").alias("dtype"))


def last_annotation_wins(ann: DataFrame) -> DataFrame:
    """WIN-03: per (asset, column_name) keep the annotation submitted last.

    Each task first keeps its own newest row per column, so a hot column is a row per task before the shuffle; the
    shuffle by (asset, column) is the one a join with the discovered columns needs as well."""
    newest = Window.partitionBy("asset_id", "column_name").orderBy(F.desc("pos"), F.desc("tie"))
    kept = ann.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1")
    return kept.select("asset_id", "column_name", "pos", "tie", "description", *KIND_FIELDS)


def merge_columns(columns: DataFrame, ann: DataFrame) -> DataFrame:
    """JON-06: discovered columns LEFT JOIN (deduplicated) annotations by name.

    Column order is kept (``pos``); orphan annotations are dropped; assets with
    no discovered columns contribute nothing.
    """
    last = last_annotation_wins(ann).drop("pos", "tie")
    return columns.join(last.withColumnRenamed("column_name", "name"), ["asset_id", "name"], "left").select(
        "asset_id", "pos", "name", "dtype", "description", *KIND_FIELDS)


def _with_datastack(ann: DataFrame, assets: DataFrame) -> DataFrame:
    return ann.join(assets.select(F.col("id").alias("asset_id"), "datastack"), "asset_id", "inner")


def kind_target_check(ann: DataFrame, assets: DataFrame, mat: DataFrame) -> DataFrame:
    """JON-07: every materialization annotation with a non-empty target table must
    name a current table of the asset's datastack.  Datastacks the reference data
    does not cover are skipped (pass).  One error row per offending annotation;
    the target column is not checked."""
    m = ann.where((F.col("kind") == "materialization") & (F.coalesce(F.col("target_table"), F.lit("")) != ""))
    if "datastack" not in m.columns:  # callers that already joined the asset rows skip a second join
        m = _with_datastack(m, assets)
    tables = maybe_broadcast(mat.where((F.col("object_type") == "table") & F.col("is_current"))
                             .select("datastack", F.col("object_name").alias("target_table")).distinct())
    covered = maybe_broadcast(mat.select("datastack").distinct())
    missing = m.join(covered, "datastack", "left_semi").join(tables, ["datastack", "target_table"], "left_anti")
    return missing.select(
        "asset_id", "pos", "tie", "column_name", F.lit("materialization").alias("kind"),
        F.concat(F.lit("Table '"), F.col("target_table"), F.lit("' not found in materialization service for datastack '"),
                 F.col("datastack"), F.lit("'")).alias("reason"))


def kind_dtype_check(ann: DataFrame, columns: DataFrame) -> DataFrame:
    """JON-08: segmentation needs an integer column, points a numeric one.
    Orphan annotations and assets without metadata are skipped (inner join)."""
    a = ann.where(F.col("kind").isin("segmentation", "packed_point", "split_point"))
    j = a.join(columns.select("asset_id", F.col("name").alias("column_name"), "dtype"), ["asset_id", "column_name"], "inner")
    cls = dtype_class("dtype")
    bad = ((F.col("kind") == "segmentation") & (cls != "integer")) | \
          (F.col("kind").isin("packed_point", "split_point") & ~cls.isin("integer", "float"))
    reason = F.when(
        F.col("kind") == "segmentation",
        F.concat(F.lit("Segmentation kind requires an integer column, but '"), F.col("column_name"),
                 F.lit("' has dtype '"), F.col("dtype"), F.lit("'")),
    ).otherwise(
        F.concat(F.lit("Point kind requires a numeric column (int or float), but '"), F.col("column_name"),
                 F.lit("' has dtype '"), F.col("dtype"), F.lit("'")))
    return j.where(bad).select("asset_id", "pos", "tie", "column_name", "kind", reason.alias("reason"))


def invalid_kinds(annotations: DataFrame) -> DataFrame:
    """Annotations (long form) whose kind is itself malformed (SCL-04); a request holding one is invalid.

    Without a kind nothing is wrong.  The struct is not nullable, so its fields are read as the plain columns they are."""
    kinds = annotations.where(F.col("kind").isNotNull())
    return kinds.withColumn("kind_error", K.kind_error(F.struct(*KIND_FIELDS))).where(F.col("kind_error").isNotNull())


def point_group_uniqueness(ann: DataFrame) -> DataFrame:
    """WIN-01: split points with a non-empty group and axis; the 2nd and later
    annotation per (asset, group, axis) is an error naming the first column."""
    sp = ann.where((F.col("kind") == "split_point") & (F.coalesce(F.col("point_group"), F.lit("")) != "")
                   & (F.coalesce(F.col("axis"), F.lit("")) != ""))
    key = ["asset_id", "point_group", "axis"]
    order = F.struct("pos", "tie")
    first = sp.groupBy(*key).agg(F.min(order).alias("first_ord"), F.min_by("column_name", order).alias("first_column"))
    j = sp.join(first, key, "inner").where(F.struct("pos", "tie") != F.col("first_ord"))
    return j.select(
        "asset_id", "pos", "tie", "column_name", F.lit("split_point").alias("kind"),
        F.concat(F.lit("Duplicate (point_group='"), F.col("point_group"), F.lit("', axis='"), F.col("axis"),
                 F.lit("'): already assigned to column '"), F.col("first_column"), F.lit("'")).alias("reason"))


def kind_errors_per_asset(target_errors: DataFrame, group_errors: DataFrame, dtype_errors: DataFrame) -> DataFrame:
    """AGG-05: error counts per asset and check; an asset passes when it has none.

    The long-form error rows are the error lists; this rolls them up with a
    partial aggregation instead of collecting lists into one task."""
    tagged = (target_errors.select("asset_id", F.lit("kind_targets").alias("check"))
              .unionByName(group_errors.select("asset_id", F.lit("point_groups").alias("check")))
              .unionByName(dtype_errors.select("asset_id", F.lit("dtypes").alias("check"))))
    return tagged.groupBy("asset_id").agg(
        F.count(F.when(F.col("check") == "kind_targets", 1)).alias("n_target_errors"),
        F.count(F.when(F.col("check") == "point_groups", 1)).alias("n_group_errors"),
        F.count(F.when(F.col("check") == "dtypes", 1)).alias("n_dtype_errors"),
        F.count(F.lit(1)).alias("n_errors"),
    )
