"""Queries over sources, streams and end-to-end jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelscan.operators import jobs as J
from labelscan.plans.extract_queries import QUALITY, spread_blocks
from labelscan.plans.registry import query
from labelscan.plans.rule_queries import ALL_SQL, COUNTS, OVERALL
from labelscan.plans.scan_queries import NOW, SCORE, TOP, TREND
from labelscan.plans.views import sql_on, table, view
from labelscan.session import checkpoint_folder
from labelscan.sources import images as SI
from labelscan.streaming import flows as FL

FILES = """SELECT doc_id, doc_id % 5 AS kind, text FROM {documents}"""


@query("src_1", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'PNG' WHEN 2 THEN 'BMP' END AS format,
  CASE WHEN doc_id % 5 = 4 THEN 'invalid_image' WHEN octet_length(encode(text)) + CASE doc_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 8 WHEN 2 THEN 2 ELSE 0 END > 3000 THEN 'file_too_large'
    WHEN doc_id % 5 IN (0, 1) THEN NULL ELSE 'invalid_image' END AS reason FROM documents""")
def src_1(spark, sf):
    k, body = F.col("kind"), F.col("text").cast("binary")
    glue = lambda h: F.concat(F.unhex(F.lit(h)), body)
    content = (
        F.when(k == 0, glue("FFD8FF")).when(k == 1, glue("89504E470D0A1A0A")).when(k == 2, glue("424D"))
        .when(k == 3, body).otherwise(F.unhex(F.lit("")))
    )
    files = sql_on(spark, sf, FILES).select("doc_id", content.alias("content"))
    return SI.check_images(files, max_size=3000).select("doc_id", "format", "reason")


GROUPS = "SELECT scan_id, image_idx, NOT (scan_key % 6 = 0 AND image_idx = 1) AS accepted, scan_key FROM {image_values_v}"


@query("src_2", f"""SELECT scan_id, image_idx FROM ({GROUPS}) g WHERE scan_id IN (SELECT scan_id FROM ({GROUPS}) q GROUP BY scan_id HAVING count(*) BETWEEN 1 AND 4 AND bool_and(accepted))""")
def src_2(spark, sf):
    return SI.check_groups(sql_on(spark, sf, GROUPS)).select("scan_id", "image_idx")


@query("src_3", """SELECT scan_id, image_idx, count(*) FILTER (WHERE keep) AS n_blocks, coalesce(string_agg(trim(text), ' ' ORDER BY block_idx) FILTER (WHERE keep), '') AS full_text
FROM (SELECT *, block_idx % 5 <> 1 AND block_idx % 5 <> 2 AND trim(text) <> '' AS keep FROM {ocr_blocks_v}) b GROUP BY scan_id, image_idx""")
def src_3(spark, sf):
    c = F.col
    at = lambda x, y: F.array(c(x).cast("double"), c(y).cast("double"))
    box = F.array(at("x_min", "y_min"), at("x_max", "y_min"), at("x_max", "y_max"), at("x_min", "y_max"))
    k = c("block_idx") % 5
    line = F.struct(
        F.when(k == 1, F.slice(box, 1, 3)).otherwise(box).alias("box"), c("text"),
        F.when(k == 2, F.lit("n/a")).otherwise(c("confidence").cast("string")).alias("confidence"),
    )
    raw = view(spark, sf, "ocr_blocks_v").groupBy("scan_id", "image_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("block_idx", line.alias("l")))), lambda x: x["l"]).alias("lines")
    )
    return SI.normalise_ocr(raw).select(
        "scan_id", "image_idx", F.size("text_blocks").cast("bigint").alias("n_blocks"), "full_text"
    )


# --- streams ----------------------------------------------------------------------------------------
STREAM_STATUS = "CASE event_type WHEN 'purchase' THEN 'COMPLIANT' WHEN 'error' THEN 'NON_COMPLIANT' ELSE 'PARTIAL' END"


def _fresh(spark):
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/data", f"{base}/checkpoint"


def event_stream(spark, sf):
    events = FL.read_table_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema)
    return events.select(
        F.col("event_id").cast("string").alias("scan_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.expr(STREAM_STATUS).alias("compliance_status"),
    )


@query("str_1", f"""WITH r AS ({ALL_SQL}), c AS (SELECT product_id, {COUNTS} FROM r GROUP BY product_id)
SELECT product_id, {OVERALL} AS overall_status, cast(failed_rules + manual_review_rules AS int) AS n_violations FROM c""")
def str_1(spark, sf):
    parts = FL.read_table_stream(spark, sf, "part.parquet", table(spark, sf, "part").schema)
    name = f"part_stream_{uuid.uuid4().hex}"
    parts.createOrReplaceTempView(name)
    products = sql_on(spark, sf, "SELECT * FROM {products_v}", {"part": name})
    out = FL.evaluate_stream(products)
    data, checkpoint = _fresh(spark)
    FL.append_to(out, data, checkpoint).awaitTermination()
    spark.catalog.dropTempView(name)
    return spark.read.schema(out.schema).parquet(data).select(
        "product_id", "overall_status", F.size("violations").alias("n_violations")
    )


def arrive(spark, sf, repeats, take):
    """The scans in five runs of a stream, out of order: every run brings a fifth of all days of the year.

    With ``repeats`` every other run also brings the scans of all earlier ones again. ``take`` starts the
    query over the stream; each run starts anew from the checkpoint of the run before it.
    """
    folder = _fresh(spark)[0]
    scans = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("scan_id"), F.col("ts").cast("timestamp").alias("ts"), F.expr(STREAM_STATUS).alias("compliance_status")
    )
    part = F.pmod(-F.dayofyear("ts"), F.lit(5))
    for k in range(5):
        again = (part < k) & F.lit(repeats and k % 2 == 1)
        scans.filter(part == k).unionByName(scans.filter(again)).write.mode("append").parquet(folder)
        take(spark.readStream.schema(scans.schema).parquet(folder)).awaitTermination()


@query("str_2", f"SELECT cast(event_id AS varchar) AS scan_id, {STREAM_STATUS} AS compliance_status FROM events")
def str_2(spark, sf):
    data, checkpoint = _fresh(spark)
    arrive(spark, sf, True, lambda scans: FL.keep_first(scans, data, checkpoint))
    return FL.first_arrivals(spark, data, "scan_id string, ts timestamp, compliance_status string").select("scan_id", "compliance_status")


@query("str_2_bounded", f"SELECT cast(event_id AS varchar) AS scan_id, {STREAM_STATUS} AS compliance_status FROM events")
def str_2_bounded(spark, sf):
    once = event_stream(spark, sf)
    twice = once.unionByName(event_stream(spark, sf))  # every scan arrives two times
    data, checkpoint = _fresh(spark)
    FL.append_to(FL.once_per_scan(twice), data, checkpoint).awaitTermination()
    return spark.read.schema(once.schema).parquet(data).select("scan_id", "compliance_status")


@query("str_3", f"""SELECT cast(ts AS date) AS day, count(*) FILTER (WHERE s = 'COMPLIANT') AS passed, count(*) FILTER (WHERE s = 'NON_COMPLIANT') AS failed,
  count(*) FILTER (WHERE s = 'PARTIAL') AS warning FROM (SELECT ts, {STREAM_STATUS} AS s FROM events) e GROUP BY 1""")
def str_3(spark, sf):
    data, checkpoint = _fresh(spark)
    arrive(spark, sf, False, lambda scans: FL.upsert_daily_status(scans, data, checkpoint))
    return FL.daily_counts(spark, data)


# --- jobs ----------------------------------------------------------------------------------------------
@query("job_1")
def job_1(spark, sf):
    return J.scan_single_images(spread_blocks(spark, sf), sql_on(spark, sf, QUALITY), 4.0).select(
        "scan_id", "product_name", "manufacturer", "net_quantity", "mrp", "batch_number", "mfg_date", "consumer_care",
        "compliance_status", F.size("violations").alias("n_violations"), "image_ref",
    )


@query("job_2")
def job_2(spark, sf):
    records, _ = J.scan_image_sets(spread_blocks(spark, sf), sql_on(spark, sf, QUALITY), 4.0)
    return records.select(
        "scan_id", "product_name", "manufacturer", "net_quantity", "mrp", "batch_number", "mfg_date", "consumer_care",
        "compliance_status", F.size("violations").alias("n_violations"), "image_ref",
    )


@query("job_3", f"""WITH r AS ({ALL_SQL}), c AS (SELECT product_id, {COUNTS} FROM r GROUP BY product_id)
SELECT product_id, {OVERALL} AS overall_status, cast(failed_rules + manual_review_rules AS int) AS n_violations FROM c""")
def job_3(spark, sf):
    return J.evaluate_directly(view(spark, sf, "products_v")).select(
        "product_id", "overall_status", F.size("violations").alias("n_violations")
    )


@query("job_4", f"""
WITH t AS (SELECT count(*) AS total, count(*) FILTER (WHERE compliance_status = 'COMPLIANT') AS p, count(*) FILTER (WHERE compliance_status = 'PARTIAL') AS w,
  count(*) FILTER (WHERE compliance_status = 'NON_COMPLIANT') AS f, round(avg({SCORE}), 1) AS a FROM {{scored_scans_v}}), top AS ({TOP} 4), trend AS ({TREND})
SELECT 'summary' AS section, 'Total' AS label, cast(total AS double) AS value FROM t UNION ALL SELECT 'summary', 'Average score', a FROM t
UNION ALL SELECT 'breakdown', 'Passed', cast(p AS double) FROM t UNION ALL SELECT 'breakdown', 'Warnings', cast(w AS double) FROM t
UNION ALL SELECT 'breakdown', 'Failed', cast(f AS double) FROM t UNION ALL SELECT 'top products', name, cast(violations AS double) FROM top
UNION ALL SELECT 'trend', strftime(day, '%Y-%m-%d'), cast(passed + failed + warning AS double) FROM trend
UNION ALL SELECT 'categories', CASE WHEN contains(lower(field), 'mrp') THEN 'Incorrect MRP' WHEN contains(lower(field), 'netquantity') OR contains(lower(field), 'net_quantity') THEN 'Net Quantity Issues'
  WHEN contains(lower(field), 'readability') OR contains(lower(field), 'font') OR contains(lower(field), 'size') THEN 'Readability Issues' ELSE 'Missing Declarations' END, cast(count(*) AS double)
FROM {{violations_v}} GROUP BY 2""")
def job_4(spark, sf):
    return J.analytics_snapshot(view(spark, sf, "scored_scans_v"), view(spark, sf, "violations_v"), NOW)


