"""Similarity over distinct pairs: the bounds hold, nothing above the least ratio is lost."""

import itertools

from labelscan.functions.similarity import length_bound, ratio, ratio_bound, with_similarity
from pyspark.sql import functions as F

WORDS = ["", "a", "manufactured", "manufacturcd", "mktd by", "marketed", "marked", "aaaa", "aaab", "baaa", "Ümlaut", "umlaut", "importer", "imported by", None]


def _table(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(itertools.product(WORDS, WORDS))]
    return spark.createDataFrame(rows + rows[:40], "id int, a string, b string")


def test_all_pairs_equal_the_plain_ratio(spark):
    got = sorted(tuple(r) for r in with_similarity(_table(spark), "a", "b").collect())
    assert len(got) == len(WORDS) ** 2 + 40
    assert all(r == (None if a is None or b is None else ratio(a, b)) for _, a, b, r in got)


def test_bounds_lose_no_pair(spark):
    rows = _table(spark).where("a IS NOT NULL AND b IS NOT NULL")
    for r in rows.select("a", "b", length_bound(F.col("a"), F.col("b")).alias("l"), ratio_bound(F.col("a"), F.col("b")).alias("m")).collect():
        assert ratio(r.a, r.b) <= r.m + 1e-12 and r.m <= r.l + 1e-12
    for r in with_similarity(rows, "a", "b", least=0.7, name="score").collect():
        assert r.score == (ratio(r.a, r.b) if ratio(r.a, r.b) >= 0.7 else None)


def test_no_window_and_no_rows(spark):
    rows = _table(spark)
    assert "Window" not in with_similarity(rows, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert with_similarity(rows.limit(0), "a", "b").count() == 0
