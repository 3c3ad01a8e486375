"""Languages by compression: held-out accuracy, what is learned from, awkward rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from labelscan.llm import compression_language as cl

DOCS = "doc_id long, text string, lang string"


def out_of_training(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def known(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")


def test_held_out_accuracy(known):
    found = cl.identify(known).join(known.drop("text"), "doc_id").collect()
    assert len(found) == known.count()
    for r in found:
        assert r.held_out == out_of_training(r.doc_id) and 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    sure = [r for r in held if r.accepted]
    assert len(sure) > 0.85 * len(held) and sum(r.lang_pred == r.lang for r in sure) / len(sure) > 0.98


def test_neither_held_out_labels_nor_other_columns_matter(known):
    held = cl.held_out()
    wrong = known.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("fr")).withColumn("n_chars", F.lit(1))
    assert sorted(map(tuple, cl.identify(wrong).collect())) == sorted(map(tuple, cl.identify(known).collect()))


def test_sample_is_bounded_and_repeatable(known):
    first, again = cl.learn(known), cl.learn(known.repartition(7))
    assert first == again and set(first) == {"en", "de", "fr", "es"}
    assert all(0 < len(x) <= cl.DICTIONARY for x in first.values())
    assert all(len(x) <= 5_000 for x in cl.learn(known, dictionary=5_000).values())


def test_awkward_rows(spark, known):
    two = known.where("lang in ('en', 'fr')").select("doc_id", "text", "lang")
    dictionaries = cl.learn(two)
    text = two.where("lang = 'fr'").first().text
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n 12 __ !", "en"), (4, text, None), (4, text, None), (None, text, "zz"), (5, text * 400, "en"), (6, "x", None)]
    docs = spark.createDataFrame(rows, DOCS).select("*", F.lit("y").alias("TEXT"), F.lit(1.5).alias("score"), F.lit("k").alias("lang_pred"))
    got = sorted((r.doc_id or -1, r.lang_pred, r.score > 0, r.accepted) for r in cl.classify(docs, dictionaries).collect())
    assert [x for x in got if x[0] < 6] == [
        (-1, "fr", True, True), (1, "und", False, False), (2, "und", False, False), (3, "und", False, False), (4, "fr", True, True), (4, "fr", True, True), (5, "fr", True, True),
    ]
    assert got[-1][1] in ("en", "fr")
    assert cl.identify(docs.limit(0)).count() == 0
    # nothing to learn from: no language
    assert {r.lang_pred for r in cl.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_one_language_and_ties():
    one = cl.Classifier({"en": b"some words of one language"})
    assert one("some words") == ("en", 1.0, 1.0)
    two = cl.Classifier({"aa": b"same words", "bb": b"same words"})
    assert two("same words") == ("aa", 0.0, 0.0)
