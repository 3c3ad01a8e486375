"""Queries over adapters, product intake and the rule catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelscan.functions.catalogue import ENTRIES, UPDATED, rule_catalogue
from labelscan.operators import adapters as D
from labelscan.operators import evaluate as E
from labelscan.operators import scans as S
from labelscan.operators.rules import ALL_RULES
from labelscan.plans.registry import query
from labelscan.plans.rule_queries import ALL_SQL, HINTS
from labelscan.plans.views import sql_on, view
from labelscan.sources import scans as SRC

EXTRACTED = """
SELECT product_id AS scan_id, product_name AS p_name, manufacturer_name AS m_name, manufacturer_address AS m_addr, net_quantity AS qty, mrp AS price,
  CASE WHEN product_key % 3 = 0 THEN ('B' || product_id) ELSE NULL END AS batch,
  month_of_packing AS mm, year_of_packing AS yy, CASE WHEN product_key % 4 = 0 THEN '' ELSE '12' END AS em,
  CASE WHEN product_key % 5 = 0 THEN NULL ELSE '2027' END AS ey, consumer_care AS care, country_of_origin AS origin,
  importer_name AS importer, unit_sale_price AS usp, font_size_mm AS mm_height,
  CASE product_key % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS grade,
  CASE WHEN product_key % 6 = 0 THEN '' WHEN product_key % 6 = 1 THEN NULL ELSE 'POOR' END AS q1, 'ACCEPTABLE' AS q2,
  CASE WHEN product_key % 7 = 0 THEN '' ELSE 'first text' END AS t1, 'second text' AS t2,
  cast(product_key % 4 AS int) AS n_measured, product_key
FROM {products_v}
"""
MFG = "CASE WHEN coalesce(mm, '') <> '' AND coalesce(yy, '') <> '' THEN mm || '/' || yy END"
EXP = "CASE WHEN coalesce(em, '') <> '' AND coalesce(ey, '') <> '' THEN em || '/' || ey END"


def ocr_results(spark, sf):
    """Extraction results as nested structs, one row per scan."""
    c = F.col
    block = F.struct(F.lit(0).alias("block_index"), F.lit("MRP").alias("text"), F.lit(20).alias("height_px"))
    comparison = F.struct(
        F.slice(F.array(block, block, block), F.lit(1), c("n_measured")).alias("measured_blocks"),
        F.when(c("n_measured") > 0, F.lit(18)).alias("smallest_height_px"),
        F.when(c("n_measured") > 0, F.lit(20.5)).alias("median_height_px"),
        F.when(c("n_measured") > 0, F.lit(24)).alias("largest_height_px"),
    )
    fields = F.struct(
        c("p_name").alias("productName"), c("m_name").alias("manufacturerName"),
        c("m_addr").alias("manufacturerAddress"), c("qty").alias("netQuantity"), c("price").alias("mrp"),
        c("batch").alias("batchNumber"), c("mm").alias("monthOfPacking"), c("yy").alias("yearOfPacking"),
        c("em").alias("expiryMonth"), c("ey").alias("expiryYear"), c("care").alias("consumerCare"),
        c("origin").alias("countryOfOrigin"), c("importer").alias("importerName"),
        c("usp").alias("unitSalePrice"), c("mm_height").alias("fontHeightMm"),
        c("grade").alias("extraction_confidence"), c("q2").alias("quality_status"),
        comparison.alias("fontHeightPxComparison"),
    )
    return sql_on(spark, sf, EXTRACTED).select(
        "scan_id", fields.alias("fields"), F.struct(c("q1").alias("quality_status")).alias("quality"),
        c("t1").alias("full_text"), c("t2").alias("combined_full_text"),
    )


FLAT_SQL = f"""SELECT scan_id, p_name AS product_name, m_name AS manufacturer, qty AS net_quantity, price AS mrp, batch AS batch_number, {MFG} AS mfg_date,
  care AS consumer_care, coalesce(nullif(t1, ''), t2) AS raw_ocr_text, m_addr AS manufacturer_address,
  coalesce(nullif(q1, ''), q2) AS quality_status, grade AS extraction_confidence, origin AS country_of_origin, importer AS importer_name,
  usp AS unit_sale_price, mm_height AS font_size_mm, {EXP} AS expiry_date FROM ({EXTRACTED}) x"""


@query("prj_1", FLAT_SQL)
def prj_1(spark, sf):
    return D.flat_fields(ocr_results(spark, sf)).drop("font_readability_px")


@query("prj_2", f"""SELECT scan_id, CASE WHEN n_measured > 0 THEN 18 END AS smallest, CASE WHEN n_measured > 0 THEN cast(20.5 AS double) END AS median,
  CASE WHEN n_measured > 0 THEN 24 END AS largest, CASE WHEN n_measured > 0 THEN least(n_measured, 3) END AS block_count FROM ({EXTRACTED}) x""")
def prj_2(spark, sf):
    return ocr_results(spark, sf).select(
        "scan_id", D.font_px_summary(F.col("fields.fontHeightPxComparison")).alias("px")
    ).select("scan_id", "px.*")


DATES = f"""SELECT * EXCEPT (mfg_date), CASE cast(scan_id AS bigint) % 4 WHEN 0 THEN '2026-07' WHEN 1 THEN '07/2026' WHEN 2 THEN '7/26' ELSE mfg_date END AS mfg_date FROM ({FLAT_SQL}) y"""


@query("prj_3", f"""
WITH f AS (SELECT *, CASE cast(scan_id AS bigint) % 4 WHEN 0 THEN '2026-07' WHEN 1 THEN '07/2026' WHEN 2 THEN '7/26' ELSE mfg_date END AS d FROM ({FLAT_SQL}) y)
SELECT scan_id AS product_id, product_name, cast(NULL AS string) AS product_type, false AS is_imported, manufacturer AS manufacturer_name, importer_name,
  CASE WHEN regexp_full_match(d, '[^/-]{{2}}[/-][^/-]{{4}}') THEN substr(d, 1, 2) WHEN regexp_full_match(d, '[^/-]{{4}}[/-][^/-]{{2}}') THEN substr(d, 6, 2) END AS month_of_packing,
  CASE WHEN regexp_full_match(d, '[^/-]{{2}}[/-][^/-]{{4}}') THEN substr(d, 4, 4) WHEN regexp_full_match(d, '[^/-]{{4}}[/-][^/-]{{2}}') THEN substr(d, 1, 4) END AS year_of_packing,
  expiry_date, font_size_mm FROM f""")
def prj_3(spark, sf):
    flat = D.flat_fields(ocr_results(spark, sf))
    key = F.col("scan_id").cast("bigint") % 4
    dated = flat.withColumn(
        "mfg_date",
        F.when(key == 0, "2026-07").when(key == 1, "07/2026").when(key == 2, "7/26").otherwise(F.col("mfg_date")),
    )
    return D.rule_payload(dated).select(
        "product_id", "product_name", "product_type", "is_imported", "manufacturer_name", "importer_name",
        "month_of_packing", "year_of_packing", "expiry_date", "font_size_mm",
    )


@query("flt_11", f"SELECT scan_id, quality_status FROM ({FLAT_SQL}) y WHERE extraction_confidence = 'LOW'")
def flt_11(spark, sf):
    return D.low_confidence(D.flat_fields(ocr_results(spark, sf))).select("scan_id", "quality_status")


STATUS = """CASE WHEN bool_or(status = 'FAIL') THEN 'NON_COMPLIANT' WHEN bool_or(status = 'MANUAL_REVIEW') THEN 'PARTIAL'
  WHEN bool_or(status = 'PASS') THEN 'COMPLIANT' ELSE 'PARTIAL' END"""


@query("prj_4", f"""
WITH r AS ({ALL_SQL}), h AS ({HINTS}), s AS (SELECT product_id, {STATUS} AS compliance_status FROM r GROUP BY product_id),
n AS ({" UNION ALL ".join("SELECT '{}' AS rule_id, '{}' AS rule".format(r.rule_id, r.name.replace("'", "''")) for r in ALL_RULES)})
SELECT r.product_id, s.compliance_status, n.rule, concat(rtrim(r.message, ' .'), '. Suggested fix: ', h.hint) AS description, r.field
FROM r JOIN h ON h.rule_id = r.rule_id JOIN n ON n.rule_id = r.rule_id JOIN s ON s.product_id = r.product_id WHERE r.status IN ('FAIL', 'MANUAL_REVIEW')""")
def prj_4(spark, sf):
    compliance = D.scan_compliance(E.evaluate_products(view(spark, sf, "products_v")))
    return compliance.select("product_id", "compliance_status", F.explode("violations").alias("v")).select(
        "product_id", "compliance_status", "v.*"
    )


@query("prj_5", f"""
SELECT scan_id, product_name, manufacturer, net_quantity, mrp, batch_number, mfg_date, consumer_care, expiry_date AS nested_expiry,
  CASE cast(scan_id AS bigint) % 2 WHEN 0 THEN 'uploads/img0.jpg' ELSE 'uploads/scanned_image.jpg' END AS image_ref FROM ({FLAT_SQL}) y""")
def prj_5(spark, sf):
    flat = D.flat_fields(ocr_results(spark, sf))
    files = D.first_file(view(spark, sf, "image_values_v").filter("scan_key % 2 = 0"))
    named = flat.join(files, "scan_id", "left")
    verdict = flat.select(F.col("scan_id").alias("product_id"), F.lit("PARTIAL").alias("compliance_status"))
    return D.scan_record(named, verdict).select(
        "scan_id", *D.PROMOTED, F.col("extracted_fields.expiry_date").alias("nested_expiry"), "image_ref"
    )


STORED = """
SELECT s.scan_id, s.user_id, s.ts, s.product_name, s.manufacturer, cast(NULL AS string) AS net_quantity, cast(NULL AS string) AS mrp, s.batch_number,
  cast(NULL AS string) AS mfg_date, cast(NULL AS string) AS consumer_care,
  CASE WHEN s.scan_key % 3 = 0 THEN NULL ELSE ('{"expiry_date": "12/2027", "batch_number": "' || s.batch_number || '"}') END AS extracted_fields,
  CASE WHEN s.scan_key % 5 = 0 THEN NULL ELSE s.compliance_status END AS compliance_status,
  CASE WHEN s.scan_key % 4 = 0 THEN NULL ELSE '[{"rule": "R1", "description": "d", "field": "mrp"}, {"rule": "R2", "description": "e", "field": "label"}]' END AS violations,
  CASE WHEN s.scan_key % 2 = 0 THEN NULL ELSE 'uploads/a.jpg' END AS image_ref, s.scan_key
FROM {scans_v} s
"""
RESPONSE_SQL = f"""SELECT scan_id, user_id, product_name, CASE WHEN extracted_fields IS NULL THEN NULL ELSE '12/2027' END AS expiry_date,
  coalesce(compliance_status, 'PARTIAL') AS status, cast(CASE WHEN violations IS NULL THEN 0 ELSE 2 END AS int) AS n_violations,
  CASE WHEN violations IS NULL THEN NULL ELSE 'R1' END AS first_rule, coalesce(image_ref, '') AS image_ref FROM ({STORED}) q"""


def _response(spark, sf):
    return D.scan_response(sql_on(spark, sf, STORED)).select(
        "scan_id", "user_id", F.col("product.product_name").alias("product_name"),
        F.try_element_at("extracted_fields", F.lit("expiry_date")).alias("expiry_date"),
        F.col("compliance.status").alias("status"), F.size("compliance.violations").alias("n_violations"),
        F.try_element_at("compliance.violations", F.lit(1))["rule"].alias("first_rule"), "image_ref",
    )


query("prj_6", RESPONSE_SQL)(_response)


@query("sca_24", f"""SELECT scan_id, CASE WHEN extracted_fields IS NULL THEN 'none' ELSE batch_number END AS batch,
  CASE WHEN violations IS NULL THEN 'none' ELSE 'mrp' END AS first_field FROM ({STORED}) q""")
def sca_24(spark, sf):
    return sql_on(spark, sf, STORED).select(
        "scan_id", F.coalesce(F.get_json_object("extracted_fields", "$.batch_number"), F.lit("none")).alias("batch"),
        F.coalesce(F.get_json_object("violations", "$[0].field"), F.lit("none")).alias("first_field"),
    )


@query("prj_8", f"""
SELECT scan_id, CASE WHEN mm_height IS NOT NULL THEN '≈ ' || cast(mm_height AS varchar) || ' mm' WHEN n_measured > 0 THEN 'Relative: 18-24 px (median 20.5), no mm calibration'
  ELSE 'Not Detected' END AS font_text FROM ({EXTRACTED}) x""")
def prj_8(spark, sf):
    flat = D.flat_fields(ocr_results(spark, sf))
    return flat.select(
        "scan_id", S.font_display(F.col("font_size_mm"), F.col("font_readability_px")).alias("font_text")
    )


# --- product intake ------------------------------------------------------------------------------
PAYLOADS = """
SELECT product_key, CASE product_key % 6
  WHEN 0 THEN '{"productId": "P' || product_id || '", "mrp": "Rs. 5", "unknown": 1}'
  WHEN 1 THEN '{"productName": "no id"}'
  WHEN 2 THEN '{"productId": "P' || product_id || '", "fieldEvidence": {"mrp": {"field": "mrp", "source": "OCR", "confidence": 1.5}}}'
  WHEN 3 THEN '{"productId": "P' || product_id || '", "fieldEvidence": {"mrp": {"field": "mrp", "value": "Rs. 5", "source": "OCR", "confidence": 0.5}}}'
  WHEN 4 THEN 'not json'
  ELSE '{"productId": "P' || product_id || '", "isImported": true, "fontSizeMm": 1.5}' END AS value
FROM {products_v}
"""


@query("src_4", """
SELECT product_key, product_key % 6 IN (0, 3, 5) AS valid, CASE WHEN product_key % 6 IN (0, 2, 3, 5) THEN 'P' || cast(product_key AS varchar) END AS product_id,
  CASE product_key % 6 WHEN 1 THEN 'productId: missing' WHEN 2 THEN 'fieldEvidence -> mrp -> confidence: out_of_range' WHEN 4 THEN 'body: json_invalid' ELSE '' END AS errors
FROM {products_v}""")
def src_4(spark, sf):
    checked = SRC.validate_payloads(SRC.parse_payloads(sql_on(spark, sf, PAYLOADS), "value"))
    return checked.select(
        "product_key", "valid", "product_id",
        F.array_join(F.transform("errors", lambda e: F.concat_ws(": ", e["field"], e["type"])), "; ").alias("errors"),
    )


# --- scan ingest -------------------------------------------------------------------------------------
INCOMING = """
SELECT CASE WHEN scan_key % 4 = 0 THEN ('new-' || cast(scan_key AS string)) ELSE scan_id END AS scan_id,
  CASE WHEN scan_key % 10 = 9 THEN NULL ELSE user_id END AS user_id,
  CASE scan_key % 3 WHEN 0 THEN '2001-07-01T10:00:00' WHEN 1 THEN 'bad' ELSE NULL END AS timestamp, compliance_status, scan_key
FROM {scan_core_v}
"""


@query("src_6", """
SELECT scan_id, user_id, CASE WHEN scan_key % 3 = 0 THEN '2001-07-01 10:00:00' ELSE '2001-08-02 00:00:00' END AS at,
  CASE WHEN scan_key % 3 = 0 THEN date '2001-07-01' ELSE date '2001-08-02' END AS scan_date
FROM (SELECT CASE WHEN scan_key % 4 = 0 THEN 'new-' || cast(scan_key AS varchar) ELSE scan_id END AS scan_id, user_id, scan_key FROM {scan_core_v}) t
WHERE scan_key % 10 <> 9 AND scan_key % 4 = 0""")
def src_6(spark, sf):
    incoming, stored = sql_on(spark, sf, INCOMING), view(spark, sf, "scan_core_v")
    accepted, _ = SRC.prepare_scans(incoming, now="2001-08-02 00:00:00")
    return SRC.only_new(accepted, stored).select(
        "scan_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "scan_date"
    )


@query("src_7", """
SELECT scan_id, CASE WHEN scan_key % 3 = 0 THEN (SELECT min(user_id) FROM {users_v}) ELSE user_id END AS user_id FROM {scan_core_v}""")
def src_7(spark, sf):
    scans = view(spark, sf, "scan_core_v")
    old = scans.filter("scan_key % 3 = 0").drop("user_id")
    both = old.unionByName(scans.filter("scan_key % 3 <> 0"), allowMissingColumns=True)
    return SRC.backfill_user(both, view(spark, sf, "users_v")).select("scan_id", "user_id")


# --- catalogue ----------------------------------------------------------------------------------------
_q = lambda s: s.replace("'", "''")
_NAMES = {r.rule_id: r for r in ALL_RULES}
CATALOGUE_SQL = " UNION ALL ".join(
    f"SELECT '{rid}' AS rule_id, '{_q(_NAMES[rid].name)}' AS title, '{cat}' AS category, '{_NAMES[rid].target}' AS target_field,"
    f" '{_NAMES[rid].severity}' AS severity, '{_q(text)}' AS description, '{UPDATED}' AS updated"
    for rid, cat, text, *_ in ENTRIES
)
USE_SQL = f"""r AS ({ALL_SQL}), u AS (SELECT rule_id, count(*) FILTER (WHERE status IN ('FAIL', 'MANUAL_REVIEW')) AS findings FROM r GROUP BY rule_id)"""


def _with_use(spark, sf, rules):
    """Catalogue rows with the number of findings of each rule in the product table."""
    found = E.rule_results(view(spark, sf, "products_v")).groupBy("rule_id").agg(
        F.count_if(F.col("status").isin("FAIL", "MANUAL_REVIEW")).alias("findings")
    )
    return rules.join(found, "rule_id")


@query("flt_7", f"""WITH {USE_SQL}, k AS ({CATALOGUE_SQL})
SELECT k.rule_id, k.title, k.category, u.findings FROM k JOIN u ON u.rule_id = k.rule_id WHERE k.category = 'Mandatory'
  AND (contains(lower(title), 'name') OR contains(lower(k.rule_id), 'name') OR contains(lower(description), 'name') OR contains(lower(target_field), 'name') OR contains(lower(severity), 'name'))""")
def flt_7(spark, sf):
    rules = S.search_rules(rule_catalogue(spark), "NAME", "Mandatory")
    return _with_use(spark, sf, rules).select("rule_id", "title", "category", "findings")


@query("srt_6", f"""WITH {USE_SQL}, k AS ({CATALOGUE_SQL})
SELECT k.rule_id, k.updated, u.findings FROM k JOIN u ON u.rule_id = k.rule_id ORDER BY try_cast(updated AS timestamp) DESC NULLS LAST, k.rule_id""")
def srt_6(spark, sf):
    return S.sort_rules(_with_use(spark, sf, rule_catalogue(spark))).select("rule_id", "updated", "findings")

