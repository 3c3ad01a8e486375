"""Patterns run once for every distinct text, however often labels repeat it."""

from pyspark.sql import functions as F

from labelscan.operators import extract as EX
from labelscan.operators.texts import distinct_rows, once_per_text
from labelscan.session import tasks


def test_once_per_text(spark):
    rows = spark.createDataFrame([(i, f"t{i % 3}") for i in range(300)], "i int, t string")
    seen = []

    def make(texts):
        seen.append(texts)
        return texts.select("t", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).filter("NOT (t = 't0' AND n = 2)")

    found = once_per_text(rows, ["t"], make).collect()
    assert sorted(r.t for r in seen[0].collect()) == ["t0", "t1", "t2"]
    assert len(found) == 500 and len({(r.i, r.n) for r in found}) == 500


def test_patterns_read_distinct_texts(spark):
    """The labels' own values are found on one row a text, and come back for every block."""
    blocks = [("s", i, 0, "Net Qty: 5 g", 0.9, 0, 0, 10, 10) for i in range(50)]
    names = "scan_id string, image_idx int, block_idx int, text string, confidence double, x_min int, y_min int, x_max int, y_max int"
    tagged = EX.tag(EX.prepare(spark.createDataFrame(blocks, names)))
    assert EX.own_values(tagged.select("t").distinct()).count() < 5
    own = EX.own_matches(tagged).filter("field = 'netQuantity' AND key.p = 0").groupBy("image_idx").agg(F.first("value").alias("v")).collect()
    assert sorted((r.image_idx, r.v) for r in own) == [(i, "5 g") for i in range(50)]


def test_distinct_rows_are_dealt_to_all_cores(spark):
    """Few texts make one small shuffle, which Spark would merge into one task."""
    rows = spark.range(4000).select(F.concat(F.lit("t"), F.col("id") % 400).alias("t"))
    counts = [r["count"] for r in distinct_rows(rows).groupBy(F.input_file_name().alias("f")).count().collect()]
    assert sum(counts) == 400 and len(counts) == tasks(spark) and max(counts) <= 2 * 400 / tasks(spark)


def test_patterns_stay_behind_distinct(spark):
    """A filter by a pattern is no part of the plan that makes texts distinct."""
    rows = spark.range(4000).select(F.concat(F.lit("t"), F.col("id") % 400).alias("t"))
    plan = distinct_rows(rows).filter(F.col("t").rlike("7$"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "Aggregate" not in plan


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_whole_texts_are_repaired_once(spark):
    """F8: phone, e-mail and website read one repaired text, and a settled field is not looked for."""
    rows = [("s", 0, "Tel: 1800 100 1000 mail care at brand.example visit www.brand.com", []), ("s", 1, "Tel: 1800 100 1000", ["phone"])]
    texts = spark.createDataFrame(rows, "scan_id string, image_idx int, full_text string, settled array<string>")
    found = EX.text_matches(texts, ["phone", "email", "website"])
    assert _plan(found).count(r"\s+at\s+") == 1
    assert sorted((r.image_idx, r.field, r.value) for r in found.collect()) == [
        (0, "email", "care@brand.example"), (0, "phone", "1800 100 1000"), (0, "website", "www.brand.com"),
    ]


def test_branches_share_their_distinct_texts(spark, monkeypatch):
    """labels, values and importers read one list of the distinct texts of all blocks."""
    names = "scan_id string, image_idx int, block_idx int, text string, confidence double, x_min int, y_min int, x_max int, y_max int"
    blocks = [("s", 0, 0, "Importer:", 0.9, 0, 0, 90, 10), ("s", 0, 1, "Acme Traders Pvt Ltd", 0.9, 0, 20, 90, 30)]
    kept = EX.prepare(spark.createDataFrame(blocks, names))
    calls = []
    from labelscan.operators import texts as T

    real = T.distinct_rows

    def counted(rows):
        calls.append(rows.columns)
        return real(rows)

    monkeypatch.setattr(T, "distinct_rows", counted)
    monkeypatch.setattr(EX, "distinct_rows", counted)
    found = EX.winning_matches(kept, fields=["importerName"]).collect()
    assert [r.value for r in found] == ["Acme Traders Pvt Ltd"]
    assert [c for c in calls if "t" in c] == [["t"]]


def test_country_phrases_are_told_once_and_only_where_open(spark):
    """no phrase is searched in the text of an image whose country a block gives; others keep their order."""
    text = "Made in India"
    rows = [("s", 0, text, True, True, ["countryOfOrigin"])] + [("s", i, text, True, True, None) for i in range(1, 40)]
    texts = spark.createDataFrame(rows, "scan_id string, image_idx int, full_text string, has_geometry boolean, inline_origin boolean, settled array<string>")
    found = EX.country_text(texts)
    assert "ArrowEvalPython" not in _plan(found)
    got = sorted((r.image_idx, r.key.p, r.value) for r in found.collect())
    assert got == sorted((i, p, "India") for i in range(1, 40) for p in (1, 4))
