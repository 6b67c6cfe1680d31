"""Column kinds, form parsing and the explore view's cells."""

from datetime import datetime

import pytest

from assetdeck import schema as S
from assetdeck.functions import kinds as K
from assetdeck.operators import display as D
from assetdeck.schema import KIND


@pytest.mark.parametrize("level,ok", [("root_id", True), ("supervoxel_id", True), ("level2_id", True), ("level10_id", True),
                                      ("level_id", False), ("Level2_id", False), ("level2_id\n", False), ("", False)])
def test_node_level(spark, level, ok):
    df = spark.createDataFrame([(level,)], "l string")
    assert df.select(K.valid_node_level("l")).first()[0] is ok


def _kind(**kw):
    base = {f.name: None for f in KIND.fields}
    base.update(kw)
    return tuple(base[f.name] for f in KIND.fields)


def test_kind_errors(spark):
    rows = [
        (1, _kind(kind="materialization", target_table="t", target_column="c")),
        (2, _kind(kind="materialization", target_table="t")),
        (3, _kind(kind="segmentation", node_level="level2_id")),
        (4, _kind(kind="segmentation", node_level="bad")),
        (5, _kind(kind="packed_point", resolution=[4.0, 4.0, 40.0])),
        (6, _kind(kind="packed_point", resolution=[4.0, 4.0])),
        (7, _kind(kind="packed_point")),
        (8, _kind(kind="split_point", axis="x")),
        (9, _kind(kind="split_point", axis="w")),
        (10, _kind(kind="weird")),
    ]
    df = spark.createDataFrame(rows, f"i int, k {KIND.simpleString()}")
    got = {r["i"]: r["e"] for r in df.select("i", K.kind_error("k").alias("e")).collect()}
    assert [i for i, e in sorted(got.items()) if e is None] == [1, 3, 5, 7, 8]


def test_kind_label(spark):
    rows = [
        (1, _kind(kind="materialization", target_table="t", target_column="c")),
        (2, _kind(kind="segmentation", node_level="root_id")),
        (3, _kind(kind="packed_point", resolution=[4.0, 4.0, 40.0])),
        (4, _kind(kind="split_point", axis="x", point_group="g")),
        (5, _kind(kind="split_point", axis="y", axis_resolution=0.0)),
    ]
    df = spark.createDataFrame(rows, f"i int, k {KIND.simpleString()}")
    got = {r["i"]: r["l"] for r in df.select("i", K.kind_label("k").alias("l")).collect()}
    assert got == {1: "mat → t.c", 2: "seg root_id", 3: "packed point res=4.0×4.0×40.0",
                   4: "split point x (g)", 5: "split point y"}


def test_form_node_level_and_resolution(spark):
    df = spark.createDataFrame([("custom", "3", "4, 4, 40"), ("custom", "", "1,2"), ("root_id", "", ""), ("", "", "1,x,2")],
                               "nl string, cl string, res string")
    got = df.select(K.node_level_from_form("nl", "cl").alias("n"), K.parse_resolution("res").alias("r"),
                    K.resolution_has_non_number("res").alias("bad")).collect()
    assert [r["n"] for r in got] == ["level3_id", None, "root_id", None]
    assert got[0]["r"] == [4.0, 4.0, 40.0] and got[1]["r"] is None
    assert [r["bad"] for r in got] == [False, False, False, True]


def test_cells_print_by_type_and_carry_their_heading(spark):
    row = {"id": "1", "name": "n", "mat_version": 1234, "format": None, "maturity": "stable", "asset_type": "table", "source": "user",
           "mutability": "static", "created_at": datetime(2020, 1, 2, 3, 4, 5), "revision": 4321, "owner": 98765, "datastack": "d",
           "uri": "u", "is_managed": True, "cached_metadata": (1234567, 3, 2048, None, None)}
    other = row | {"id": "2", "asset_type": "asset"}
    df = spark.createDataFrame([tuple(r.get(c) for c in S.ASSET_COLUMNS) for r in (row, other)], S.ASSET)
    shown = D.display_view(df)
    table, asset = shown.orderBy("id").collect()
    assert table[1:] == ("n", "1234", "—", "stable", "1,234,567", "user", "table", "static", "2020-01-02 03:04:05", "3", "2.0 KB",
                         "4,321", "98765")
    assert (asset["cached_metadata_n_rows"], asset["cached_metadata_n_bytes"], asset["source"]) == ("—", "—", "—")
    page = {f.name: f.metadata for f in shown.schema if f.metadata}
    assert page["cached_metadata_n_rows"] == {"heading": "Rows"} and page["owner"] == {"heading": "Owner ID"}


def test_unknown_path():
    with pytest.raises(ValueError, match="nope.x"):
        D.cells(["name", "nope.x"])


def test_dot_path_null_parent(spark):
    df = spark.createDataFrame([(1, None), (2, (0, 0, 0, None, None))],
                               "id int, cached_metadata struct<n_rows:bigint,n_columns:int,n_bytes:bigint,columns:array<string>,partition_columns:array<string>>")
    got = {r["id"]: r["v"] for r in df.select("id", D.dot_path("cached_metadata.n_rows").alias("v")).collect()}
    assert got == {1: None, 2: 0}
