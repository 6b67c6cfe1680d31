"""Batch admission against the one-at-a-time rule it replaces."""

import random

from pyspark.sql import functions as F

from assetdeck import fixtures as FX
from assetdeck.operators import admission as AD
from assetdeck.schema import CANDIDATE
from conftest import SMALL


def sequential(cands, store):
    """Reference loop: one registration at a time in seq order."""
    keys = {(a["datastack"], a["name"], a["mat_version"], a["revision"]): a["id"] for a in store}
    uris = {a["uri"]: a["id"] for a in store}
    out = {}
    for c in sorted(cands, key=lambda r: r["seq"]):
        k = (c["datastack"], c["name"], c["mat_version"], c["revision"])
        if c["gate_status"] is not None:
            out[c["seq"]] = (c["gate_status"], None)
        elif k in keys:
            out[c["seq"]] = ("duplicate", keys[k])
        elif c["uri"] in uris:
            out[c["seq"]] = ("duplicate_uri", uris[c["uri"]])
        elif c["content_status"] is not None:
            out[c["seq"]] = (c["content_status"], None)
        else:
            new = f"new-{c['seq']}"
            keys[k] = new
            uris[c["uri"]] = new
            out[c["seq"]] = ("created", None)
    return out


def _run(spark, cands_df, assets_df):
    labelled, rounds = AD.admit(cands_df, assets_df)
    got = {r["seq"]: (r["admission_status"], r["existing_id"]) for r in labelled.collect()}
    want = sequential([r.asDict() for r in cands_df.collect()], [r.asDict() for r in assets_df.collect()])
    return got, want, rounds


def test_admission_matches_sequential_on_driver_tables(spark):
    c = FX.candidates(spark, SMALL).withColumn(
        "gate_status", F.when(F.col("seq") % 41 == 0, F.lit("forbidden"))).withColumn(
        "content_status", F.when(F.col("seq") % 7 == 0, F.lit("invalid")))
    a = FX.assets(spark, SMALL, with_columns=False)
    got, want, rounds = _run(spark, c, a)
    assert got == want
    assert rounds >= 1
    assert sum(1 for s, _ in got.values() if s == "created") > 0
    assert sum(1 for s, _ in got.values() if s == "duplicate") > 0


def test_admission_random_collisions(spark):
    rng = random.Random(7)
    for trial in range(3):
        rows = []
        for seq in range(300):
            rows.append((seq, 1, f"ds{rng.randrange(2)}", f"n{rng.randrange(12)}",
                         rng.choice([None, 1, 2]), rng.randrange(2), f"gs://b/{rng.randrange(40)}", "delta", "table",
                         True, "static", "stable", "{}", None, None))
        c = spark.createDataFrame(rows, CANDIDATE).withColumn("gate_status", F.lit(None).cast("string")).withColumn(
            "content_status", F.when(F.col("seq") % 11 == 0, F.lit("invalid")))
        a = FX.assets(spark, SMALL, with_columns=False).limit(0)
        got, want, _ = _run(spark, c, a)
        assert got == want, trial


def test_admission_chain_needs_many_rounds(spark):
    # candidate i shares its key with i-1 and its URI with i+1: a long chain
    rows = [(i, 1, "ds0", f"n{(i + 1) // 2}", 1, 0, f"gs://b/{i // 2}", "delta", "table", True, "static", "stable", "{}", None, None)
            for i in range(1, 41)]
    c = spark.createDataFrame(list(reversed(rows)), CANDIDATE).withColumn("gate_status", F.lit(None).cast("string")).withColumn(
        "content_status", F.lit(None).cast("string"))
    a = FX.assets(spark, SMALL, with_columns=False).limit(0)
    got, want, rounds = _run(spark, c, a)
    assert got == want


def test_admission_with_a_hot_key(spark):
    """A third of the batch shares one key (and another third one URI): still the sequential answer."""
    rows = []
    for seq in range(600):
        if seq % 3 == 0:
            name, uri = "hot", f"gs://b/{seq}"
        elif seq % 3 == 1:
            name, uri = f"n{seq}", "gs://b/hot"
        else:
            name, uri = f"n{seq % 50}", f"gs://b/{seq % 70}"
        rows.append((seq, 1, "ds0", name, None, 0, uri, "delta", "table", True, "static", "stable", "{}", None, None))
    c = spark.createDataFrame(rows, CANDIDATE).withColumn("gate_status", F.lit(None).cast("string")).withColumn(
        "content_status", F.lit(None).cast("string"))
    a = FX.assets(spark, SMALL, with_columns=False).limit(0)
    got, want, _ = _run(spark, c, a)
    assert got == want
    assert sum(1 for s, _ in got.values() if s == "created") > 2


def _chain(n):
    """Candidate i shares its key with one neighbour and its URI with the other."""
    return [(i, 1, "ds0", f"n{(i + 1) // 2}", 1, 0, f"gs://b/{i // 2}", "delta", "table", True, "static", "stable", "{}", None, None) for i in range(1, n + 1)]


def _open(spark, rows):
    none = F.lit(None).cast("string")
    return spark.createDataFrame(rows, CANDIDATE).withColumn("gate_status", none).withColumn("content_status", none)


def test_long_chain_takes_logarithmically_many_rounds(spark):
    a = FX.assets(spark, SMALL, with_columns=False).limit(0)
    got, want, rounds = _run(spark, _open(spark, _chain(10_000)), a)
    assert got == want and rounds < 20


def test_chains_of_any_shape_equal_the_loop(spark, monkeypatch):
    monkeypatch.setattr(AD, "PLAIN_ROUNDS", 0)
    rng = random.Random(3)
    a = FX.assets(spark, SMALL, with_columns=False).limit(0)
    for trial in range(3):
        links = list(range(1, 200))
        numbers = rng.sample(range(1000), 199)  # arrival in any order along the chain, and some extra collisions
        rows = [(seq, *r[1:]) for seq, r in zip(numbers, _chain(199))]
        rows += [(1000 + k, 1, "ds0", f"n{rng.choice(links) // 2}", 1, 0, f"gs://b/{rng.choice(links) // 2}", "delta", "table", True, "static",
                  "stable", "{}", None, None) for k in range(40 * trial)]
        got, want, _ = _run(spark, _open(spark, rows), a)
        assert got == want, trial
