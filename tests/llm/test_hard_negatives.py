"""Hard negatives against brute force, the index against plain products, awkward rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelscan.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label long"


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    good = [(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    good = sorted(set(good))
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    out = []
    for a in (r for r in good if r[0] % every == 0):
        near = sorted(((-score(a, r), r[0]) for r in good if r != a and r[1] == a[1]))[:positives]
        other = sorted((-score(a, r), r[0]) for r in good if r[1] != a[1])
        for ps, p in near:
            inside = [(s, n) for s, n in other if low * -ps <= -100 * s <= high * -ps][:negatives]
            out += [(a[0], p, k + 1, n, -ps, -s) for k, (s, n) in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("x").alias("LABEL"), F.lit(1).alias("key"), F.lit(2).alias("v"), F.lit(3).alias("rank"))
    return sorted(map(tuple, hn.hard_negatives(frame, **more).collect()))


def clusters(n, dims, seed, spread=0.35):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dims)) * np.linspace(1.5, 0.1, dims)
    own = r.integers(0, 12, n)
    x = centres[own] + spread * r.normal(size=(n, dims)) * np.linspace(1.5, 0.1, dims)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, x[i].tolist(), int(r.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize(("n", "dims", "spread"), [(900, 24, 0.35), (700, 40, 0.05), (300, 3, 2.0)])
def test_clusters_equal_brute_force(spark, n, dims, spread):
    rows = clusters(n, dims, n, spread)
    assert mined(spark, rows, every=9) == brute(rows, every=9)


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    rows = clusters(400, 16, 5)
    expected = brute(rows, every=4)
    monkeypatch.setattr(hn, "MOST_BLOCK", 40)
    assert mined(spark, rows, every=4) == expected
    monkeypatch.setattr(hn, "ROUNDS", ())
    assert mined(spark, rows, every=4) == expected


def test_awkward_rows(spark):
    r = random.Random(2)
    v = lambda: [r.uniform(-1, 1) for _ in range(5)]
    rows = [(i, v(), i % 3) for i in range(120)]
    same = v()
    rows += [(200 + i, same, i % 2) for i in range(100)]  # one very common vector: ties by vec_id
    rows += [(400, None, 1), (450, v(), None), (None, v(), 1), (500, [0.1, None], 1), (550, [float("nan")] * 5, 1), (600, [float("inf"), 1.0], 2)]
    rows += [(650, [0.0] * 5, 1), (700, [], 2), (750, [0.5, 0.5], 0), (800, v(), 7), rows[0], rows[0], (50, v(), 1), (-50, v(), 2)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, every=1, positives=2, negatives=1, low=10, high=100) == brute(rows, 1, 2, 1, 10, 100)
    assert mined(spark, rows[:0]) == []
    assert mined(spark, [(1, [1.0], 1)]) == []


def test_large_components_are_exact(spark):
    r = random.Random(7)
    rows = [(i, [r.uniform(-1, 1) * 4e6 for _ in range(4)], i % 2) for i in range(60)]
    assert mined(spark, rows, every=10) == brute(rows, every=10)


def test_index_equals_plain_products_and_leaves_dimensions_out():
    r = np.random.default_rng(3)
    rows = np.floor(256 * r.normal(size=(500, 40)) * np.linspace(1, 0.02, 40))
    anchors = np.floor(256 * r.normal(size=(30, 40)) * np.linspace(1, 0.02, 40))
    scores = anchors @ rows.T
    index = hn.Index(rows)
    for least in (np.quantile(scores, 0.99, axis=1), np.quantile(scores, 0.4, axis=1), np.full(30, -np.inf)):
        found = {a: dict(zip(i.tolist(), s.tolist(), strict=True)) for a, i, s in index.search(anchors, least)}
        for a in range(30):
            assert found[a] == {int(i): int(scores[a, i]) for i in np.flatnonzero(scores[a] >= least[a])}
    high = np.quantile(scores, 0.99, axis=1)
    cuts = index._cuts(index._remaining(anchors[:, index.order]), high)
    assert (cuts < len(index.starts) - 1).mean() > 0.9
