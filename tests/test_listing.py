"""Listing: NULLs first both ways, tie-break, paging rules, wildcards, expiry edges."""

import datetime as dt

import pytest

from assetdeck import fixtures as FX
from assetdeck.operators import listing as L
from assetdeck.operators import predicates as P
from assetdeck.plans import all_queries
from conftest import SMALL

# the five-asset listing seed: two NULL versions drive NULLS FIRST
SEED = [
    ("1", "synapse_table", 1078, 0, "delta", "table"),
    ("2", "nucleus_detection", 1078, 0, "delta", "table"),
    ("3", "my_upload", None, 0, "parquet", "table"),
    ("4", "synapse_partners", 1077, 0, "delta", "table"),
    ("5", "precomputed_mesh", None, 1, "precomputed", "asset"),
]


@pytest.fixture(scope="module")
def seed(spark):
    now = dt.datetime(2026, 1, 1)
    rows = [(i, "ds", n, v, r, f"gs://b/{i}", f_, t, now, None) for i, n, v, r, f_, t in SEED]
    return spark.createDataFrame(rows, "id string, datastack string, name string, mat_version int, revision int, uri string, "
                                       "format string, asset_type string, created_at timestamp, expires_at timestamp")


def test_nulls_first_both_directions(seed):
    asc = [r["id"] for r in L.page(seed, "mat_version", "asc", limit=10).collect()]
    desc = [r["id"] for r in L.page(seed, "mat_version", "desc", limit=10).collect()]
    assert asc[:2] == ["3", "5"] and asc[2:] == ["4", "1", "2"]
    assert desc[:2] == ["3", "5"] and desc[2:] == ["1", "2", "4"]


def test_sort_fallback_and_bounds(seed):
    got = [r["name"] for r in L.page(seed, "cached_metadata.n_rows", "asc", limit=5).collect()]
    assert got == sorted(got)
    with pytest.raises(ValueError):
        L.page(seed, "name", "asc", limit=0)
    with pytest.raises(ValueError):
        L.page(seed, "name", "asc", limit=1001)
    with pytest.raises(ValueError):
        L.page(seed, "name", "sideways", limit=5)


def test_offset_without_limit_is_ignored(seed):
    assert L.page(seed, "name", "asc", limit=None, offset=3).count() == 5


def test_page_total_and_positions(seed):
    rows = L.page(seed, "name", "asc", limit=2, offset=1).collect()
    assert [r["page_pos"] for r in rows] == [2, 3]
    assert {r["total"] for r in rows} == {5}


def test_name_contains_wildcards(spark):
    df = spark.createDataFrame([("synXa",), ("syna",), ("other",)], "name string")
    assert [r[0] for r in df.where(P.name_contains("N_A")).collect()] == ["synXa"]
    assert df.where(P.name_contains("%")).count() == 3


def test_expiry_equality_list_vs_get(spark):
    now = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([("a", now), ("b", None), ("c", now - dt.timedelta(seconds=1))], "id string, expires_at timestamp")
    listed = sorted(r[0] for r in df.where(P.not_expired(now)).collect())
    visible = sorted(r[0] for r in df.where(~P.is_expired(now)).collect())
    assert listed == ["b"]          # list hides expires_at == now
    assert visible == ["a", "b"]    # get still shows it


def test_explore_page_on_driver_tables(spark):
    a = FX.assets(spark, SMALL, with_columns=False)
    p = L.explore_page(a, "ds1", FX.DEFAULT_NOW, limit=10, offset=0, name="", format="delta").collect()
    assert 0 < len(p) <= 10
    assert {r["showing_from"] for r in p} == {1}
    assert all(r["mat_version"] != "" for r in p)


PUSHED = {"by_datastack": "PartitionFilters: [isnotnull(datastack", "not_expired": "Or(IsNull(expires_at)", "is_expired": "LessThan(expires_at",
          "name_eq": "EqualTo(name,tbl_42)", "mat_version_eq": "EqualTo(mat_version,903)", "revision_eq": "EqualTo(revision,3)",
          "format_eq": "EqualTo(format,delta)", "asset_type_eq": "EqualTo(asset_type,asset)", "mutability_eq": "EqualTo(mutability,mutable)",
          "maturity_eq": "EqualTo(maturity,draft)", "source_eq": "EqualTo(source,materialization)", "scan_tables": "EqualTo(asset_type,table)",
          "get_by_id": "expires_at", "compose_filters": "EqualTo(maturity,stable)"}


@pytest.mark.parametrize("name", PUSHED)
def test_predicates_reach_the_scan(spark, capsys, name):
    all_queries()[0][name](spark, SMALL).explain("formatted")
    filters = [line for line in capsys.readouterr().out.splitlines() if line.startswith(("PushedFilters", "PartitionFilters"))]
    assert any(PUSHED[name] in line for line in filters), filters
