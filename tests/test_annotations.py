"""Merge and annotation checks on small hand-written inputs."""

from pyspark.sql import functions as F

from assetdeck import fixtures as FX
from assetdeck.functions import kinds as K
from assetdeck.operators import annotations as A
from conftest import SMALL

ANN = "asset_id string, pos int, tie long, column_name string, description string, kind string, target_table string, " \
      "target_column string, node_level string, resolution array<double>, axis string, point_group string, axis_resolution double"
COLS = "asset_id string, pos int, name string, dtype string"


def _ann(spark, rows):
    full = []
    for r in rows:
        d = dict(asset_id="t", pos=0, tie=0, column_name=None, description=None, kind=None, target_table=None,
                 target_column=None, node_level=None, resolution=None, axis=None, point_group=None, axis_resolution=None)
        d.update(r)
        full.append(tuple(d.values()))
    return spark.createDataFrame(full, ANN)


def test_merge_keeps_order_drops_orphans_last_wins(spark):
    cols = spark.createDataFrame([("t", 1, "a", "int64"), ("t", 2, "b", "string"), ("t", 3, "c", "float64")], COLS)
    ann = _ann(spark, [dict(pos=1, column_name="a", description="first"), dict(pos=2, column_name="zzz", description="orphan"),
                       dict(pos=3, column_name="a", description="second")])
    got = [(r["pos"], r["name"], r["description"]) for r in A.merge_columns(cols, ann).orderBy("pos").collect()]
    assert got == [(1, "a", "second"), (2, "b", None), (3, "c", None)]


def test_no_metadata_gives_no_columns(spark):
    cols = spark.createDataFrame([], COLS)
    ann = _ann(spark, [dict(column_name="a", description="x")])
    assert A.merge_columns(cols, ann).count() == 0


def test_dtype_check(spark):
    cols = spark.createDataFrame([("t", 1, "seg", "Int64"), ("t", 2, "pt", "string"), ("t", 3, "seg2", "float64"),
                                  ("t", 4, "ok", "double")], COLS)
    ann = _ann(spark, [dict(pos=1, column_name="seg", kind="segmentation", node_level="root_id"),
                       dict(pos=2, column_name="pt", kind="split_point", axis="x"),
                       dict(pos=3, column_name="seg2", kind="segmentation", node_level="root_id"),
                       dict(pos=4, column_name="ok", kind="packed_point"),
                       dict(pos=5, column_name="orphan", kind="segmentation")])
    bad = sorted(r["column_name"] for r in A.kind_dtype_check(ann, cols).collect())
    assert bad == ["pt", "seg2"]


def test_point_group_duplicates_name_first(spark):
    ann = _ann(spark, [dict(pos=1, column_name="x1", kind="split_point", axis="x", point_group="g"),
                       dict(pos=2, column_name="x2", kind="split_point", axis="x", point_group="g"),
                       dict(pos=3, column_name="y1", kind="split_point", axis="y", point_group="g"),
                       dict(pos=4, column_name="x3", kind="split_point", axis="x", point_group=None),
                       dict(pos=5, column_name="x4", kind="split_point", axis="x", point_group="h")])
    errs = A.point_group_uniqueness(ann).collect()
    assert [(r["column_name"], r["reason"]) for r in errs] == [
        ("x2", "Duplicate (point_group='g', axis='x'): already assigned to column 'x1'")]


def test_kind_targets(spark):
    assets = spark.createDataFrame([("t", "ds1"), ("u", "ds9")], "id string, datastack string")
    mat = spark.createDataFrame([("ds1", 1, "table", "synapses", True, ["id"])],
                                "datastack string, version int, object_type string, object_name string, is_current boolean, fields array<string>")
    ann = _ann(spark, [dict(pos=1, column_name="a", kind="materialization", target_table="synapses", target_column="id"),
                       dict(pos=2, column_name="b", kind="materialization", target_table="nope", target_column="id"),
                       dict(pos=3, column_name="c", kind="materialization", target_table="", target_column="id"),
                       dict(asset_id="u", pos=1, column_name="d", kind="materialization", target_table="nope", target_column="id")])
    errs = [(r["asset_id"], r["column_name"]) for r in A.kind_target_check(ann, assets, mat).collect()]
    assert errs == [("t", "b")]  # empty target skipped; uncovered datastack passes (fail-open)


def test_malformed_kinds_read_plain_columns(spark):
    ann = FX.annotations(spark, SMALL)
    bad = A.invalid_kinds(ann)
    # a nullable struct is built anew for every field that the rule reads
    assert "named_struct(" not in bad._jdf.queryExecution().optimizedPlan().toString()
    nullable = F.when(F.col("kind").isNotNull(), F.struct(*A.KIND_FIELDS))
    want = ann.withColumn("kind_error", K.kind_error(nullable)).where("kind_error IS NOT NULL")
    assert want.count() > 0 and bad.exceptAll(want).isEmpty() and want.exceptAll(bad).isEmpty()
    none = ann.limit(1).withColumn("kind", F.lit(None).cast("string"))
    assert A.invalid_kinds(none).isEmpty()
