"""Columns whose names clash pass through the operators that keep all columns."""

import pytest

from labelscan.llm.pii_tagger import redact
from labelscan.llm.quality_cascade import quality

LONG = " ".join(f"word{i}" for i in range(80))


def _docs(spark, rows):
    """A table with TEXT, text and two columns x."""
    return spark.createDataFrame(rows, "TEXT string, doc_id long, a string, n_chars long, b int, c int").toDF("TEXT", "doc_id", "text", "n_chars", "x", "x")


def test_quality(spark):
    out = quality(_docs(spark, [("few", 1, LONG, 9, 1, 2), (LONG, 2, "few", 9, 3, 4), (LONG, 3, None, 9, 5, 6), (LONG, 3, None, 9, 5, 6)]))
    assert out.columns == ["TEXT", "doc_id", "text", "n_chars", "x", "x", "rejected_by"]
    assert sorted((r[1], r[6] is None, r[4], r[5]) for r in out.collect()) == [(1, True, 1, 2), (2, False, 3, 4), (3, False, 5, 6), (3, False, 5, 6)]


@pytest.mark.parametrize("rows", [[("a@b.com", 1, "to c@d.com now", 14, 1, 2), (None, 2, None, None, 3, 4), (None, 2, "", 0, 3, 4)], []])
def test_redact(spark, rows):
    out = redact(_docs(spark, rows))
    assert out.columns == ["TEXT", "doc_id", "text", "n_chars", "x", "x"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(([("a@b.com", 1, "to <EMAIL> now", 14, 1, 2), (None, 2, None, None, 3, 4), (None, 2, "", 0, 3, 4)] if rows else []), key=str)


def test_text_of_another_case(spark):
    docs = spark.createDataFrame([(1, LONG)], "doc_id long, Text string")
    assert quality(docs).columns == ["doc_id", "Text", "rejected_by"]
    assert redact(docs).columns == ["doc_id", "Text"]
