"""Mixing: targets, exact quotas, disjoint draws, and the law of the splitting tree."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from assetdeck.llm import mixing

KINDS = "doc_id long, text string, source string, size int, rank long, n long, taken long"


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(k, "w " * (k % 40), f"s{k % 7}", 1, 1, 1, 1) for k in range(900)]
    rows += [(None, None, None, 1, 1, 1, 1), (None, "one two", None, 1, 1, 1, 1), (5000, "x " * 30_000, "s1", 1, 1, 1, 1), (5001, "", "none but blanks", 1, 1, 1, 1)]
    rows += [(7000, "same words here", "copies", 1, 1, 1, 1)] * 300
    return spark.createDataFrame(rows, KINDS).repartition(5)


def words(text):
    return len((text or "").split())


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = sum(weight[s] for s in order if s not in capped)
        share = {s: (total - sum(3 * sizes[x] for x in capped)) * weight[s] / left for s in order if s not in capped}
        above = {s for s, t in share.items() if t > 3 * sizes[s]}
        if not above:
            return {s: share.get(s, 3.0 * sizes[s]) for s in order}
        capped |= above


def test_taken_words_meet_the_targets(mixed):
    sizes = collections.Counter()
    for r in mixed.collect():
        sizes[r.source] += words(r.text)
    want = water(sizes)
    plan, draws = mixing.mix(mixed)
    got = {r.source: r for r in plan.groupBy("source").agg(F.first("source_size").alias("z"), F.first("target").alias("t"), F.first("rank").alias("k")).collect()}
    taken = {r["rank"]: r.w for r in draws.groupBy("rank").agg(F.sum(F.col("size") * F.col("copies")).alias("w")).collect()}
    assert set(got) == set(want)
    for s, r in got.items():
        assert r.z == sizes[s] and math.isclose(r.t, want[s]), s
        assert taken.get(r.k, 0) <= r.t + 1e-6
        assert r.t - taken.get(r.k, 0) <= max(40, 0.02 * r.t) or s == "s1", s


def test_one_row_per_document_and_reruns_agree(mixed):
    rows = sorted(map(tuple, mixing.taken(mixed).collect()), key=repr)
    assert rows == sorted(map(tuple, mixing.taken(mixed.repartition(3)).collect()), key=repr)
    assert sorted((r[0], r[1]) for r in rows if r[0]) == sorted((r.doc_id, words(r.text)) for r in mixed.collect() if r.doc_id)
    assert all(0 <= r[4] <= 3 * r[1] and (r[1] == 0 or r[4] % r[1] == 0) for r in rows)


def test_every_block_is_dealt_once_and_shards_are_even(mixed):
    sizes = mixing.sized(mixed)
    sources = mixing.targets(sizes)
    drawn = mixing.quotas(mixing.blocked(sizes, sources), sources)
    want = sorted(map(tuple, drawn.select("rank", "nth").distinct().collect()))
    dealt = mixing.dealt(drawn, 3).collect()
    assert sorted((r["rank"], r.nth) for r in dealt) == want
    per_shard = collections.Counter(r.shard for r in dealt)
    assert max(per_shard.values()) - min(per_shard.values()) <= math.ceil(math.log2(len(per_shard))) + 1


def test_shards_hold_every_copy_drawn(mixed):
    _, draws = mixing.mix(mixed, 2)
    assert mixing.shards(draws).count() == draws.agg(F.sum("copies")).first()[0]


def test_splits_follow_the_hypergeometric_law(spark):
    total, marked, drawn, n = 50, 20, 15, 4000
    u = (F.col("id") + 0.5) / n
    lit = lambda x: F.lit(x).cast("long")
    got = collections.Counter(r[0] for r in spark.range(n).select(mixing.hypergeometric(lit(total), lit(marked), lit(drawn), u)).collect())
    for k in range(16):
        p = math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn)
        assert abs(got[k] / n - p) < 2 / n, k
    ends = [(0, 0, 0, 0), (5, 5, 3, 3), (5, 0, 3, 0), (9, 4, 9, 4), (1, 1, 1, 1), (100_000, 99_999, 100_000, 99_999)]
    for t, m, d, k in ends:
        for v in (0.0, 0.999999):
            assert spark.range(1).select(mixing.hypergeometric(lit(t), lit(m), lit(d), F.lit(v))).first()[0] == k


def test_ranks_follow_code_points_over_partitions(spark):
    names = [f"é{k}" for k in range(40)] + [f"z{k}" for k in range(40)] + [f"Z{k}" for k in range(40)] + ["", "\U0001f600", "￿", None]
    got = {r.source: r["rank"] for r in mixing.ranked(spark.createDataFrame([(s,) for s in names], "source string").repartition(6)).collect()}
    assert sorted(names, key=lambda s: (s is None, [ord(c) for c in s or ""])) == sorted(names, key=got.get)


def test_empty_table_and_empty_texts(spark):
    assert mixing.taken(spark.createDataFrame([], KINDS)).collect() == []
    rows = spark.createDataFrame([(1, None, "a", 1, 1, 1, 1), (2, " \t", None, 1, 1, 1, 1)], KINDS)
    assert sorted(map(tuple, mixing.taken(rows).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_many_rows_of_one_document_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    rows = spark.createDataFrame([(1, "a b c", "x", 1, 1, 1, 1)] * 100 + [(2, "d e", "y", 1, 1, 1, 1)] * 10, KINDS)
    got = mixing.taken(rows).collect()
    assert len(got) == 110 and sum(r.taken for r in got if r.doc_id == 2) == 60  # y stops at three times its 20 words
    assert sum(r.taken for r in got if r.doc_id == 1) == 258  # 86 times three words, of a target of 260
