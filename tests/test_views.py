"""Nested views, listings by key and by caller, access responses, versions of reference objects, request rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assetdeck import fixtures as FX
from assetdeck.operators import access as AC
from assetdeck.operators import checks as CK
from assetdeck.operators import listing as L
from assetdeck.operators import reference as RF
from assetdeck.operators import requests as RQ
from assetdeck.operators import views as V
from assetdeck.operators.predicates import compose_filters
from conftest import SMALL

NOW = FX.DEFAULT_NOW


def test_merged_columns_keep_their_order_and_the_last_annotation(spark):
    assets = FX.assets(spark, SMALL).where("id IN ('1', '2', '3', '4', '5', '6', '7', '32')")
    ann = FX.annotations(spark, SMALL)
    for r in V.table_view(assets, ann).collect():
        mine = sorted((a for a in ann.where(F.col("asset_id") == r["id"]).collect()), key=lambda a: (a["pos"], a["tie"]))
        last = {a["column_name"]: a for a in mine}
        columns = (r["cached_metadata"] or {"columns": None})["columns"] or []
        assert [c["name"] for c in r["merged"]] == [c["name"] for c in columns]
        assert [c["description"] for c in r["merged"]] == [last[c["name"]]["description"] if c["name"] in last else None for c in columns]
        assert [a["column_name"] for a in r["annotations"]] == [a["column_name"] for a in mine]


def test_other_assets_have_no_lists_and_bare_tables_empty_ones(spark):
    rows = V.mixed_view(FX.assets(spark, SMALL), FX.annotations(spark, SMALL).where("false")).collect()
    assert all((r["merged"] is None) == (r["asset_type"] != "table") for r in rows) and len(rows) == FX.assets(spark, SMALL).count()
    assert all(r["annotations"] == [] for r in rows if r["asset_type"] == "table")


def test_detail_answers_every_request(spark):
    assets = FX.assets(spark, SMALL).where("NOT coalesce(expires_at < TIMESTAMP '1999-01-01', false)").limit(3)
    a = assets.first()
    requests = spark.createDataFrame([(1, 97, a["id"]), (2, -5, a["id"]), (3, 97, "no such id"), (4, 97, None), (5, None, a["id"])],
                                     "request_id long, user_id long, asset_id string")
    none = FX.memberships(spark, SMALL).where("false")
    got = {r["request_id"]: r for r in V.asset_detail(requests, assets, FX.annotations(spark, SMALL), FX.permissions(spark, SMALL), none,
                                                      FX.users(spark, SMALL), NOW).collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "ok", 2: "forbidden", 3: "not_found", 4: "not_found", 5: "forbidden"}
    assert got[1]["id"] == a["id"] and all(got[k]["id"] is None for k in (2, 3, 4, 5))
    plans = {r["request_id"]: r for r in AC.access_responses(requests, assets, FX.permissions(spark, SMALL), none, FX.users(spark, SMALL), NOW).collect()}
    assert [plans[k]["status"] for k in (2, 3)] == ["forbidden", "not_found"] and plans[2]["uri"] is None and plans[1]["uri"] == a["uri"]


@pytest.mark.parametrize("sort_by,order", [("mat_version", "asc"), ("mat_version", "desc"), ("created_at", "desc"), ("name", "asc")])
def test_pages_by_key_are_the_pages_by_offset(spark, sort_by, order):
    live = FX.assets(spark, SMALL, with_columns=False).where(compose_filters(datastack="ds1", now=NOW)).cache()
    want = [r["id"] for r in live.orderBy(*L.order_nulls_first(sort_by, order)).collect()]
    seen, cursor = [], None
    for _ in range(6):
        page = L.page_after(live, sort_by, order, 40, cursor).collect()
        seen += [r["id"] for r in page]
        cursor = (page[-1]["cursor_value"], page[-1]["cursor_id"])
    assert seen == want[:240] and page[0]["total"] == len(want)


def test_the_key_reaches_the_scan(spark, tmp_path):
    FX.assets(spark, SMALL, with_columns=False).write.parquet(str(tmp_path / "a"))
    rows = spark.read.parquet(str(tmp_path / "a")).where(L.after("created_at", "asc", dt.datetime(1995, 1, 1), "7"))
    assert "GreaterThanOrEqual(created_at" in rows._jdf.queryExecution().toString()


def test_a_forbidden_caller_gets_one_row(spark):
    rows = spark.range(3).select(F.col("id").cast("string").alias("id"))
    args = FX.permissions(spark, SMALL), FX.users(spark, SMALL)
    assert [(r["caller"], r["status"], r["id"]) for r in L.for_caller(rows, -1, "ds1", *args).collect()] == [(-1, "forbidden", None)]
    assert sorted(r["id"] for r in L.for_caller(rows, 97, "ds1", *args).collect()) == ["0", "1", "2"]
    assert L.for_caller(rows.where("false"), 97, "ds1", *args).collect() == []


def test_targets_of_a_version(spark):
    mat = spark.createDataFrame([("d", 1, "table", "t", False, ["a", "x_bbox"]), ("d", 2, "table", "t", True, ["b"]), ("d", 2, "view", "v", True, ["c"])],
                                "datastack string, version int, object_type string, object_name string, is_current boolean, fields array<string>")
    asked = spark.createDataFrame([("d", "t", "table", 1), ("d", "t", "table", None), ("d", "v", "view", 2), ("d", "v", "view", 1)],
                                  "datastack string, target_name string, target_type string, version int")
    got = sorted((r["version"] or 0, r["pos"], r["column_name"]) for r in RF.target_columns(mat, asked).collect())
    assert got == [(0, 0, "b"), (1, 0, "a"), (1, 1, "x"), (2, 0, "c")]
    assert [tuple(r)[1:] for r in RF.linkable_targets(mat, "d", 1).collect()] == [("t", "table")]
    assert RF.target_columns(mat, asked.drop("version")).count() == 4


def test_without_a_reference_service_candidates_pass(spark):
    cands = spark.createDataFrame([("d", '{"source": "materialization"}'), ("d", "{}")], "datastack string, properties string")
    got = CK.mat_table_verify(cands, FX.mat_objects(spark, SMALL), configured=False).collect()
    assert [(r["matverify_passed"], bool(r["matverify_message"])) for r in got] == [(True, True), (None, False)]


@pytest.mark.parametrize("managed,properties,error", [
    (True, "{}", None), (False, None, None), (None, "{}", "is_managed is required"), (True, "[1]", "properties must be an object"),
    (True, "7", "properties must be an object"), (True, "null", "properties must be an object"), (True, "{", "properties must be an object"),
    (True, "", "properties must be an object"), (True, '{"a": [1, {}]}', None)])
def test_required_and_object_fields(spark, managed, properties, error):
    row = (1, 1, "d", "n", None, 0, "gs://b/x", "delta", "table", managed, "static", "stable", properties, None, None)
    from assetdeck.schema import CANDIDATE

    got = RQ.with_request_check(spark.createDataFrame([row], CANDIDATE), True).first()["request_errors"]
    assert got == ([error] if error else [])


def test_stored_columns_merge_without_a_shuffle(spark):
    from assetdeck.operators import annotations as AN
    from assetdeck.operators import changes as CH
    from assetdeck.sources.column_store import ColumnStore

    assets, ann = FX.assets(spark, SMALL), FX.annotations(spark, SMALL)
    store = ColumnStore.fresh(spark, buckets=4)
    half = F.pmod(F.col("id").cast("long"), F.lit(2))
    for k in (0, 1):  # two batches
        part = assets.where(half == k)
        store.add(part, ann.join(part.select(F.col("id").alias("asset_id")), "asset_id", "left_semi"))
    merged = store.merged()
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # these tables are small; large ones are joined like this
    assert shuffles(store.merged()) == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    text = lambda rows: sorted(map(str, rows.collect()))
    known = ann.join(assets.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
    cols = AN.explode_columns(assets)
    assert text(merged.select("asset_id", "pos", "name", "dtype", "description", "kind")) == text(
        AN.merge_columns(cols, known).select("asset_id", "pos", "name", "dtype", "description", "kind"))
    req, new = FX.annotation_updates(spark, SMALL)
    after_, _ = CH.replace_annotations(assets, store.annotations(), req, new.select(*store.annotations().columns), FX.mat_objects(spark, SMALL), NOW)
    later = store.replaced(after_)
    again = ColumnStore(spark.newSession(), "other_name", store.root, 4, later.generation)  # another session, another name
    assert again.annotations().count() == after_.count() and again.columns().count() == cols.count()
    assert shuffles(again.merged()) == 0
    assert store.annotations().count() == known.count()  # the earlier generation is untouched
    later.drop_tables()
    again.drop_tables()


def test_listing_for_several_callers_is_computed_once(spark, tmp_path):
    spark.range(3).selectExpr("CAST(id AS STRING) AS id").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    users = spark.createDataFrame([(97, True), (5, False)], "user_id long, is_admin boolean")
    permissions = spark.createDataFrame([(5, "ds1", "view"), (6, "ds2", "view")], "user_id long, resource string, permission string")
    out = L.for_callers(rows, (97, 5, 6, -1), "ds1", permissions, users)
    assert out._jdf.queryExecution().optimizedPlan().toString().count(" parquet") == 1
    got = sorted((r["caller"], r["status"], r["id"] or "") for r in out.collect())
    assert got == [(-1, "forbidden", "")] + [(5, "ok", i) for i in "012"] + [(6, "forbidden", "")] + [(97, "ok", i) for i in "012"]


def test_no_row_whose_key_is_wanted_is_lost(spark):
    from assetdeck.operators.joins import among

    rows = spark.range(20_000).selectExpr("CAST(id % 10000 AS STRING) AS id", "id AS n").unionByName(
        spark.createDataFrame([(None, -1)], "id string, n long"))
    keys = spark.range(0, 30_000, 100).selectExpr("CAST(id AS STRING) AS k").unionByName(spark.createDataFrame([(None,), ("0",)], "k string"))
    kept = among(rows, "id", keys)
    assert kept.columns == rows.columns and kept.count() < 300
    exact = lambda df: sorted(r["n"] for r in df.join(keys, F.col("id") == F.col("k"), "left_semi").collect())
    assert exact(kept) == exact(rows) and len(exact(kept)) == 200
    numbers = keys.selectExpr("CAST(k AS INT) AS k")  # another type: left to the join, which compares them all the same
    assert among(rows, "id", numbers).count() == rows.count()
    assert among(rows, "id", keys.where("false")).count() == 0


def test_what_nobody_may_see_is_not_shuffled(spark, tmp_path):
    FX.assets(spark, SMALL).write.parquet(str(tmp_path / "assets"))
    FX.annotations(spark, SMALL).write.parquet(str(tmp_path / "annotations"))
    assets, ann = (spark.read.parquet(str(tmp_path / t)) for t in ("assets", "annotations"))
    requests = assets.where("pmod(crc32(id), 50) = 0").selectExpr("CAST(id AS LONG) AS request_id", "97L AS user_id", "id AS asset_id")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # these tables are small; large ones are joined like this
    try:
        detail = V.asset_detail(requests, assets, ann, FX.permissions(spark, SMALL), FX.memberships(spark, SMALL), FX.users(spark, SMALL), NOW)
        rows = detail.collect()
        plan = detail._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    at = [i for i, line in enumerate(plan) if "FileScan parquet [asset_id#" in line]
    assert at
    for i in at:  # filtered before it is shuffled
        shuffle = max(k for k in range(i) if "Exchange hashpartitioning(asset_id#" in plan[k])
        assert any("_word#" in line and "LeftSemi" in line for line in plan[shuffle:i])
    seen = {r["asset_id"] for r in rows if r["status"] == "ok"}
    assert seen and len(rows) == requests.count()
    for r in rows:
        assert (r["id"] is not None) == (r["status"] == "ok")
    counts = {r["asset_id"]: r["count"] for r in ann.groupBy("asset_id").count().collect()}
    assert all(len(r["annotations"]) == counts.get(r["id"], 0) for r in rows if r["asset_type"] == "table")
