"""Wide rows are derived in tasks of bounded size, however large the splits of their source are."""

from pyspark.sql import functions as F

from assetdeck import fixtures as FX
from assetdeck.operators import forms
from assetdeck.plans import q_listing
from conftest import SMALL


def _largest_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_form_cells_come_from_bounded_tasks(spark, monkeypatch):
    whole, pivoted = FX.form_cells(spark, SMALL), _rows(forms.pivot_cells(FX.form_cells(spark, SMALL)))
    before = _rows(whole)
    monkeypatch.setattr(FX, "ROWS_PER_TASK", 250)
    cells = FX.form_cells(spark, SMALL)
    assert _largest_task(cells) < 10 * 500  # ten cells a row, hash-dealt
    assert _rows(cells) == before
    assert _rows(forms.pivot_cells(cells)) == pivoted


def test_stored_assets_are_written_from_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(FX, "ROWS_PER_TASK", 100)
    assets = FX.assets_to_store(spark, SMALL)
    assert _largest_task(assets) < 200
    assert sorted(r.id for r in assets.collect()) == sorted(r.id for r in FX.assets(spark, SMALL).collect())
    stored = q_listing._stored(spark, SMALL)
    assert sorted(map(str, stored.collect())) == sorted(map(str, FX.assets(spark, SMALL).select(*stored.columns).collect()))


def test_few_rows_stay_as_they_are(spark):
    df = spark.range(100, numPartitions=3).toDF("n")
    assert FX.spread(df, 1000) is df
    dealt = FX.spread(df, 5)
    assert dealt.rdd.getNumPartitions() >= 20 and _rows(dealt) == _rows(df)
