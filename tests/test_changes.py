"""Row changes: several requests of one id take effect in request order."""

import datetime as dt

from pyspark.sql import functions as F

from assetdeck import fixtures as FX
from assetdeck.operators import changes as CH
from conftest import SMALL

PAST, FUTURE = dt.datetime(1990, 1, 1), dt.datetime(2030, 1, 1)
PATCH = ("request_id long, id string, maturity_set boolean, maturity string, access_group_set boolean, access_group string, "
         "expires_at_set boolean, expires_at timestamp")


def live_tables(spark, n):
    a = FX.assets(spark, SMALL).where("asset_type = 'table' AND expires_at IS NULL")
    return [r["id"] for r in a.orderBy("id").select("id").limit(n).collect()]


def test_patches_of_one_id_fold_per_field(spark):
    a, b = live_tables(spark, 2)
    rows = [
        (1, a, True, "deprecated", False, None, False, None),
        (2, a, False, None, True, "g1", False, None),
        (3, a, True, "bogus", True, "lost", False, None),
        (4, a, False, None, True, None, True, FUTURE),
        (5, b, False, None, True, "g2", True, PAST),
        (6, b, True, "draft", False, None, True, FUTURE),
        (7, "no such id", True, "draft", False, None, False, None),
    ]
    out, st = CH.patch_assets(FX.assets(spark, SMALL), spark.createDataFrame(rows, PATCH), FX.DEFAULT_NOW)
    assert {r["request_id"]: r["status"] for r in st.collect()} == {
        1: "updated", 2: "updated", 3: "invalid", 4: "updated", 5: "updated", 6: "not_found", 7: "not_found"}
    got = {r["id"]: r for r in out.where(F.col("id").isin(a, b)).collect()}
    assert (got[a]["maturity"], got[a]["access_group"], got[a]["expires_at"]) == ("deprecated", None, FUTURE)
    assert (got[b]["access_group"], got[b]["expires_at"]) == ("g2", PAST)


def test_last_valid_annotation_request_stays(spark):
    (a,) = live_tables(spark, 1)
    ann = FX.annotations(spark, SMALL)
    blank = ann.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in ann.schema.fields])

    def note(request, column, **kind):
        values = {"asset_id": F.lit(a), "pos": F.lit(1), "tie": F.lit(0), "column_name": F.lit(column)} | {k: F.lit(v) for k, v in kind.items()}
        return blank.withColumns({k: v.cast(ann.schema[k].dataType) for k, v in values.items()}).withColumn("n", F.lit(request).cast("long"))

    new = note(1, "first").unionByName(note(2, "second")).unionByName(note(3, "third", kind="segmentation", node_level="level_x"))
    req = spark.createDataFrame([(a, 1), (a, 2), (a, 3), ("no such id", 4)], "id string, n long")
    out, st = CH.replace_annotations(FX.assets(spark, SMALL), ann, req, new, FX.mat_objects(spark, SMALL), FX.DEFAULT_NOW, order="n")
    assert {r["n"]: r["status"] for r in st.collect()} == {1: "updated", 2: "updated", 3: "invalid_request", 4: "not_found"}
    assert [r["column_name"] for r in out.where(F.col("asset_id") == a).collect()] == ["second"]
    assert out.where(F.col("asset_id") != a).count() == ann.where(F.col("asset_id") != a).count()


def test_refresh_stores_partition_columns_once(spark):
    (a,) = live_tables(spark, 1)
    assets = FX.assets(spark, SMALL).withColumn("format", F.lit("parquet"))
    uri = assets.where(F.col("id") == a).first()["uri"]
    ex = spark.createDataFrame([(uri, 5, 50, [("c", "int64")], ["day"])] * 2,
                               "uri string, n_rows long, n_bytes long, columns array<struct<name string, dtype string>>, "
                               "partition_columns array<string>")
    out, st = CH.refresh_metadata(assets, spark.createDataFrame([(a,)], "id string"), ex, FX.DEFAULT_NOW)
    assert [r["status"] for r in st.collect()] == ["refreshed"]
    (row,) = out.where(F.col("id") == a).collect()
    assert (row["cached_metadata"]["n_rows"], row["cached_metadata"]["partition_columns"]) == (5, ["day"])


def test_deletes_need_edit_and_happen_once(spark):
    assets = spark.createDataFrame([("1", "ds"), ("2", "ds"), ("3", "other")], "id string, datastack string")
    req = spark.createDataFrame([(1, 8, "1"), (2, 7, "1"), (3, 7, "1"), (4, 9, "2"), (5, 7, "3"), (6, 7, "4")],
                                "request_id long, user_id long, id string")
    permissions = spark.createDataFrame([(7, "ds", "edit"), (8, "ds", "view")], "user_id long, resource string, permission string")
    users = spark.createDataFrame([(7, False), (8, False), (9, True)], "user_id long, is_admin boolean")
    left, st = CH.delete_requests(assets, req, permissions, users)
    assert [r["id"] for r in left.collect()] == ["3"]
    assert {r["request_id"]: r["status"] for r in st.collect()} == {
        1: "forbidden", 2: "deleted", 3: "not_found", 4: "deleted", 5: "forbidden", 6: "not_found"}
