"""Permission rules."""

import datetime as dt

from assetdeck.operators import access as AC

USERS = [(1, False), (2, True), (3, False)]
PERMS = [(1, "ds1", "edit"), (1, "ds2", "view"), (3, "ds1", "admin"), (1, "grpA", "view")]
GROUPS = [(3, "grpB")]


def _p(spark):
    return (spark.createDataFrame(USERS, "user_id long, is_admin boolean"),
            spark.createDataFrame(PERMS, "user_id long, resource string, permission string"),
            spark.createDataFrame(GROUPS, "user_id long, group_name string"))


def test_datastack_permission(spark):
    users, perms, _ = _p(spark)
    req = spark.createDataFrame([(1, 1, "ds1"), (2, 1, "ds2"), (3, 2, "ds9"), (4, 3, "ds1"), (5, 4, "ds1")],
                                "request_id int, user_id long, datastack string")
    got = {r["request_id"]: r["allowed"] for r in AC.datastack_permission(req, perms, users, wanted="edit").collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}
    off = AC.datastack_permission(req, perms, users, wanted="edit", auth_enabled=False)
    assert all(r["allowed"] for r in off.collect())


def test_asset_view_access(spark):
    users, perms, groups = _p(spark)
    now = dt.datetime(2025, 1, 1)
    assets = spark.createDataFrame([("a1", "ds2", None, None), ("a2", "ds1", "grpA", None), ("a3", "ds1", "grpB", None),
                                    ("a4", "ds2", "", None), ("a5", "ds2", None, now - dt.timedelta(days=1))],
                                   "id string, datastack string, access_group string, expires_at timestamp")
    req = spark.createDataFrame([(1, 1, "a1"), (2, 1, "a2"), (3, 1, "a3"), (4, 3, "a3"), (5, 1, "a4"), (6, 1, "a5"), (7, 1, "zz")],
                                "request_id int, user_id long, asset_id string")
    got = {r["request_id"]: r["status"] for r in AC.asset_view_access(req, assets, perms, groups, users, now).collect()}
    assert got == {1: "ok", 2: "ok", 3: "forbidden", 4: "ok", 5: "ok", 6: "not_found", 7: "not_found"}


def test_shares_group(spark):
    users, _, groups = _p(spark)
    req = spark.createDataFrame([(1, 3, ["grpB", "x"]), (2, 3, ["x"]), (3, 2, ["x"]), (4, 1, [])],
                                "request_id int, user_id long, required_groups array<string>")
    got = {r["request_id"]: r["shares"] for r in AC.shares_group(req, groups, users).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_access_plan(spark):
    assets = spark.createDataFrame([("a", "gs://bucket-1/t/x", "delta", True, None), ("b", "s3://b/x", "delta", True, None),
                                    ("c", "s3://b/x", "delta", False, None), ("d", "gs://B/x", None, True, None)],
                                   "id string, uri string, format string, is_managed boolean, expires_at timestamp")
    got = {r["id"]: r for r in AC.access_plan(assets, dt.datetime(2025, 1, 1)).collect()}
    assert (got["a"]["status"], got["a"]["storage_provider"], got["a"]["bucket"], got["a"]["prefix"]) == ("ok", "gcs", "bucket-1", "t/x")
    assert got["b"]["error"] == "Unsupported storage scheme: 's3'"
    assert (got["c"]["status"], got["c"]["storage_provider"]) == ("ok", None)
    assert got["d"]["error"] == "Invalid GCS bucket name: 'B'"
