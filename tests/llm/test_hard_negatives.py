"""Hard negatives against brute force, with an index of tiny cells, blocks, batches and rounds."""

import math
import random

import numpy as np
import pytest

from assetdeck.llm import hard_negatives

KIND = "vec_id long, embedding array<float>, label int, id long, q string, cell int, query long"


def brute(rows):
    rows = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, y in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, (i, y, v) in enumerate(rows):
        if i % 50:
            continue
        order = sorted((-score(v, w), j, z, n) for n, (j, z, w) in enumerate(rows))
        same = [(-s, j) for s, j, z, n in order if z == y]
        same.remove(next(x for x in same if x[1] == i))
        for s, j in same[:5]:
            hit = [(-t, m) for t, m, z, _ in order if z != y and 50 * s <= -100 * t <= 95 * s][:3]
            out += [(i, j, r, m, s, t) for r, (t, m) in enumerate(hit, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "q", 2, 3) for i, v, y in rows], KIND).repartition(4)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vector = lambda d: [rng.gauss(0, 1 / d**0.5) for _ in range(d)]
    rows = [(i, vector(12), rng.randrange(3)) for i in range(1, 401)]
    hot = vector(12)
    rows += [(i, hot, 1) for i in range(1000, 1200)] + [(i, [x + 1e-3 * rng.random() for x in hot], rng.randrange(3)) for i in range(1200, 1350)]
    rows += [(0, [0.0] * 12, 1), (3000, None, 1), (3050, vector(12), None), (3100, [None, *vector(11)], 1), (3150, [math.nan, *vector(11)], 1),
             (3200, [math.inf, *vector(11)], 0), (None, vector(12), 1), (3250, vector(5), 2), (3300, [], 2), (3350, [-x for x in hot], 1)]
    return rows


@pytest.mark.parametrize("small", [True, False])
def test_equals_brute_force(spark, rows, monkeypatch, small):
    if small:
        for name, value in dict(PER_CELL=8, BLOCK=5, BATCH=2, FIRST_ROUND=16, GROWTH=3, SAMPLE=64).items():
            monkeypatch.setattr(hard_negatives, name, value)
    got = hard_negatives.mine(*hard_negatives.scaled(table(spark, rows))).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_repeated_ids_and_empty_tables(spark):
    assert hard_negatives.mine(*hard_negatives.scaled(table(spark, []))).collect() == []
    one = [(50, [1.0, 0.0], 1)]
    assert hard_negatives.mine(*hard_negatives.scaled(table(spark, one))).collect() == []
    twice = [(50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (51, [0.8, 0.1], 2)]
    got = sorted(map(tuple, hard_negatives.mine(*hard_negatives.scaled(table(spark, twice))).collect()))
    assert got == [(50, 50, 1, 51, 65536, 256 * 204)] * 2


def test_walk_goes_in_falling_order_from_any_pause():
    rng = np.random.default_rng(1)
    bounds = rng.integers(-50, 50, 7), rng.integers(-50, 50, 5)
    want = sorted((-int(a + b) for a in bounds[0] for b in bounds[1]))
    walk, opened = [], []
    while True:
        part = []
        for bound, cell, opened in hard_negatives.visit(bounds, opened):
            if len(part) == 4:
                break
            part.append((bound, cell))
        if not part:
            break
        walk += part
    assert [-b for b, _ in walk] == want and len({c for _, c in walk}) == 35
