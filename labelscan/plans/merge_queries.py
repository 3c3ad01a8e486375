"""Queries over per-image field values: evidence, confidence, merge and second pass."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from labelscan.functions import vocab as V
from labelscan.operators import merge as M
from labelscan.plans.registry import query
from labelscan.plans.views import sql_on, view


def re2(pattern: str) -> str:
    """The same pattern for an ASCII engine: Java's Unicode flags dropped."""
    return re.sub(r"\(\?([a-zA-Z]+)\)", lambda m: "(?" + "".join(c for c in m.group(1) if c in "is") + ")"
                  if any(c in "is" for c in m.group(1)) else "", pattern).replace("'", "''")


def m(col, pattern):
    return f"regexp_matches({col}, '{re2(pattern)}')"


V_ = "trim(value)"
T_ = "lower(full_text)"
STRENGTH = f"""CASE WHEN coalesce({V_}, '') = '' THEN 0
 WHEN field = 'mrp' THEN CASE WHEN {m(V_, V.EV_MRP_QTY)} AND NOT {m(V_, V.EV_MRP_NOT_QTY)} THEN 0 WHEN NOT {m(V_, '[0-9]')} THEN 0
   WHEN ({m(V_, V.EV_MRP_LABEL_VALUE)} OR {m(T_, V.EV_MRP_LABEL_TEXT)}) AND ({m(V_, V.EV_MRP_CURRENCY)} OR {m(V_, V.EV_MRP_TAX)}) THEN 3
   WHEN {m(V_, V.EV_MRP_LABEL_VALUE)} OR {m(T_, V.EV_MRP_LABEL_TEXT)} OR {m(V_, V.EV_MRP_CURRENCY)} THEN 2 ELSE 1 END
 WHEN field = 'netQuantity' THEN CASE WHEN {m(V_, V.EV_QTY_UNIT)} AND {m(T_, V.EV_QTY_LABEL)} THEN 3 WHEN {m(V_, V.EV_QTY_UNIT)} THEN 2 ELSE 1 END
 WHEN field IN ('manufacturerName', 'packerName') THEN CASE WHEN {m(T_, V.EV_MAKER_LABEL)} AND {m(V_, V.EV_CORP)} THEN 3
   WHEN {m(T_, V.EV_MAKER_LABEL)} OR {m(V_, V.EV_CORP)} THEN 2 WHEN len(regexp_extract_all({V_}, '[A-Za-z]{{2,}}')) >= 2 THEN 2 ELSE 1 END
 WHEN field = 'unitSalePrice' THEN CASE WHEN ({m(V_, V.EV_UNIT_PRICE_VALUE)} OR {m(T_, V.EV_UNIT_PRICE_TEXT)}) AND {m(V_, '[0-9]')} THEN 3
   WHEN {m(V_, V.EV_UNIT_PRICE_SHAPE)} THEN 2 ELSE 1 END
 WHEN field IN ('monthOfPacking', 'yearOfPacking') THEN CASE WHEN {m(T_, V.EV_MADE)} THEN 3 ELSE 2 END
 WHEN field = 'consumerCare' THEN CASE WHEN contains({V_}, '@') OR {m(V_, V.EV_TOLL_FREE)} THEN 3 WHEN {m(T_, V.EV_CARE)} THEN 2 ELSE 1 END
 WHEN field = 'countryOfOrigin' THEN CASE WHEN {m(T_, V.EV_ORIGIN)} THEN 3 ELSE 2 END
 WHEN field = 'batchNumber' THEN CASE WHEN NOT {m(V_, '[A-Za-z0-9]')} OR length({V_}) < 2 THEN 0
   WHEN {m(T_, V.EV_BATCH)} AND length({V_}) >= 3 THEN 3 WHEN {m(T_, V.EV_BATCH)} THEN 2 ELSE 1 END
 WHEN field = 'productName' THEN CASE WHEN {m(V_, V.NAME_PRICE_CODE)} OR {m(V_, V.NAME_DANGLING)} OR {m(V_, V.NAME_LEADING)}
   OR {m(V_, V.EV_NAME_INSTRUCTION)} OR {m(V_, V.NAME_CLAIMS)} OR {m(V_, V.EV_NAME_WEB)} OR {m(V_, V.NAME_CARE_TEXT)}
   OR length({V_}) < 3 OR contains({V_}, '?') OR contains({V_}, '!') OR ends_with({V_}, '.')
   OR length(regexp_replace({V_}, '[^A-Za-z]', '', 'g')) < 0.40 * length({V_}) THEN 0
   WHEN {m(V_, V.EV_NAME_PROMO)} THEN 1
   WHEN {m(T_, V.EV_NAME_LABEL)} AND len(regexp_extract_all({V_}, '[A-Za-z]{{2,}}')) >= 1 THEN 3
   WHEN len(regexp_extract_all({V_}, '[A-Za-z]{{2,}}')) >= 2 THEN 2 WHEN len(regexp_extract_all({V_}, '[A-Za-z]{{2,}}')) = 1 THEN 1 ELSE 0 END
 ELSE 2 END"""

CAND = f"""c AS (SELECT scan_id, image_idx, file_name, field, value, lower({V_}) AS norm, round_even(mean_conf, 3) AS conf,
  {STRENGTH} AS strength FROM {{image_fields_v}} WHERE coalesce({V_}, '') <> '')"""
RANKED = f"""{CAND}, w AS (SELECT *, row_number() OVER p AS rank, lead(norm) OVER p AS n_norm, lead(conf) OVER p AS n_conf,
  lead(strength) OVER p AS n_strength, count(*) OVER g AS n, min(norm) OVER g AS lo, max(norm) OVER g AS hi,
  first_value(value) OVER (PARTITION BY scan_id, field ORDER BY image_idx) AS first_value,
  first_value(strength) OVER (PARTITION BY scan_id, field ORDER BY image_idx) AS first_strength
  FROM c WINDOW p AS (PARTITION BY scan_id, field ORDER BY strength DESC, conf DESC, image_idx), g AS (PARTITION BY scan_id, field))"""
RESOLVED = f"""{RANKED}, r AS (SELECT scan_id, field, lo <> hi AS conflict,
  lo <> hi AND (strength = 0 OR (strength <= 1 AND n_strength <= 1) OR (strength = n_strength AND abs(conf - n_conf) < 0.001 AND norm <> n_norm)) AS unresolved,
  CASE WHEN lo = hi THEN CASE WHEN first_strength > 0 THEN first_value END
    WHEN strength = 0 OR (strength <= 1 AND n_strength <= 1) OR (strength = n_strength AND abs(conf - n_conf) < 0.001 AND norm <> n_norm) THEN NULL
    ELSE value END AS value,
  CASE WHEN lo = hi THEN NULL WHEN strength = 0 OR (strength <= 1 AND n_strength <= 1) OR (strength = n_strength AND abs(conf - n_conf) < 0.001 AND norm <> n_norm)
    THEN 'Candidates could not be safely resolved due to insufficient contextual evidence or tied OCR confidence; resolved to null for verification.'
    WHEN strength = n_strength THEN concat('Selected value ''', value, ''' from image ''', file_name, ''' due to higher OCR confidence (', printf('%.3f', conf), ' vs ', printf('%.3f', n_conf), ').')
    ELSE concat('Selected value ''', value, ''' from image ''', file_name, ''' due to stronger statutory evidence (strength=', strength, ' vs ', n_strength,
      ', ocr_confidence=', printf('%.3f', conf), ' vs ', printf('%.3f', n_conf), ').') END AS reason
  FROM w WHERE rank = 1)"""
WIDE = ", ".join(f"max(CASE WHEN field = '{f}' THEN value END) AS {f}" for f in V.MERGE_FIELDS)
CORE = "field IN ('mrp', 'netQuantity', 'manufacturerName', 'monthOfPacking', 'yearOfPacking')"
GRADE = f"""CASE WHEN bool_or(unresolved) THEN 'LOW' WHEN bool_or(conflict) THEN 'MEDIUM' WHEN count(*) FILTER (WHERE {CORE} AND value IS NOT NULL) >= 2 THEN 'HIGH'
  WHEN count(*) FILTER (WHERE {CORE} AND value IS NOT NULL) >= 1 OR bool_or(NOT {CORE} AND value IS NOT NULL AND NOT (field = 'isImported' AND value = 'false')) THEN 'MEDIUM'
  ELSE 'LOW' END"""


@query("sca_20", f"SELECT scan_id, image_idx, field, {STRENGTH} AS strength FROM {{image_fields_v}}")
def sca_20(spark, sf):
    return view(spark, sf, "image_fields_v").select(
        "scan_id", "image_idx", "field",
        M.evidence_strength(F.col("field"), F.col("value"), F.col("full_text")).alias("strength"),
    )


@query("win_2", f"""WITH {RANKED} SELECT scan_id, image_idx, field, value, strength, cast(rank AS int) AS rank, n_norm AS next_norm, n_conf AS next_conf FROM w""")
def win_2(spark, sf):
    ranked = M.ranked(M.candidates(view(spark, sf, "image_fields_v")))
    return ranked.select(
        "scan_id", "image_idx", "field", "value", "strength", "rank",
        F.col("next.norm").alias("next_norm"), F.col("next.conf").alias("next_conf"),
    )


@query("agg_8", f"WITH {RESOLVED} SELECT scan_id, {WIDE}, {GRADE} AS extraction_confidence FROM r GROUP BY scan_id")
def agg_8(spark, sf):
    return M.merge_images(view(spark, sf, "image_fields_v"))[0]


@query("agg_8_conflicts", f"WITH {RESOLVED} SELECT scan_id, field, value AS resolved_value, reason AS resolution_reason FROM r WHERE conflict")
def agg_8_conflicts(spark, sf):
    return M.merge_images(view(spark, sf, "image_fields_v"))[1].drop("competing_values")


@query("agg_9", f"WITH {RESOLVED} SELECT scan_id, {GRADE} AS extraction_confidence FROM r GROUP BY scan_id")
def agg_9(spark, sf):
    return M.merge_images(view(spark, sf, "image_fields_v"))[0].select("scan_id", "extraction_confidence")


@query("set_2", f"""WITH {CAND} SELECT scan_id, field, count(DISTINCT norm) AS n_values, min(norm) = max(norm) AS agreed FROM c GROUP BY scan_id, field""")
def set_2(spark, sf):
    return M.candidates(view(spark, sf, "image_fields_v")).groupBy("scan_id", "field").agg(
        F.count_distinct("norm").alias("n_values"), (F.min("norm") == F.max("norm")).alias("agreed")
    )


@query("agg_5", """
SELECT scan_id, image_idx, round(avg(coalesce(CASE WHEN block_idx = 5 THEN NULL ELSE confidence END, 0.0)), 6) AS merge_conf,
  round(avg(coalesce(CASE WHEN block_idx = 5 THEN NULL ELSE confidence END, 1.0)), 6) AS extract_conf FROM {ocr_blocks_v} GROUP BY scan_id, image_idx""")
def agg_5(spark, sf):
    blocks = view(spark, sf, "ocr_blocks_v").withColumn(
        "confidence", F.when(F.col("block_idx") != 5, F.col("confidence"))
    )
    a, b = M.mean_confidence(blocks, 0.0), M.mean_confidence(blocks, 1.0)
    keys = ["scan_id", "image_idx"]
    return a.join(b.withColumnRenamed("mean_conf", "e"), keys).select(
        *keys, F.round("mean_conf", 6).alias("merge_conf"), F.round("e", 6).alias("extract_conf")
    )


@query("jn_7", """
WITH f AS MATERIALIZED (SELECT scan_id, image_idx, field, mean_conf, lower(trim(value)) AS v FROM {image_fields_v}),
b AS MATERIALIZED (SELECT scan_id, image_idx, lower(text) AS t, max(confidence) AS conf FROM {ocr_blocks_v} GROUP BY ALL),
w AS MATERIALIZED (SELECT scan_id, image_idx, field, unnest(regexp_split_to_array(v, '[\\s:,\\-/]+')) AS token FROM f WHERE v <> ''),
hits AS (SELECT f.scan_id, f.image_idx, f.field, b.conf FROM f JOIN b ON b.scan_id = f.scan_id AND b.image_idx = f.image_idx WHERE f.v <> '' AND (contains(b.t, f.v) OR contains(f.v, b.t))
  UNION ALL SELECT w.scan_id, w.image_idx, w.field, b.conf FROM w JOIN b ON b.scan_id = w.scan_id AND b.image_idx = w.image_idx WHERE length(w.token) >= 3 AND contains(b.t, w.token)),
h AS MATERIALIZED (SELECT scan_id, image_idx, field, max(conf) AS best FROM hits GROUP BY ALL)
SELECT f.scan_id, f.image_idx, f.field, coalesce(h.best, f.mean_conf) AS field_conf FROM f LEFT JOIN h
  ON h.scan_id = f.scan_id AND h.image_idx = f.image_idx AND h.field = f.field""")
def jn_7(spark, sf):
    values = view(spark, sf, "image_fields_v").select("scan_id", "image_idx", "field", "value", "mean_conf")
    return M.field_confidence(values, view(spark, sf, "ocr_blocks_v")).select(
        "scan_id", "image_idx", "field", "field_conf"
    )


@query("sca_27", """
SELECT scan_id, image_idx, field, array_to_string(list_filter(regexp_split_to_array(lower(trim(value)), '[\\s:,\\-/]+'), lambda x: length(x) >= 3), '|') AS tokens
FROM {image_fields_v} WHERE value IS NOT NULL""")
def sca_27(spark, sf):
    from labelscan.functions.text import tokens3

    return view(spark, sf, "image_fields_v").filter("value IS NOT NULL").select(
        "scan_id", "image_idx", "field", F.array_join(tokens3(F.col("value")), "|").alias("tokens")
    )


IMAGES = """SELECT scan_id, image_idx, (scan_key + image_idx) % 7 <> 0 AS success,
  CASE WHEN scan_key % 5 = 0 AND image_idx = 1 THEN '  ' ELSE concat(' ', file_name, ' ') END AS full_text FROM {image_values_v}"""


@query("agg_10", f"""
SELECT scan_id, count(*) AS total_images, count(*) FILTER (WHERE success) AS successful_images, count(*) FILTER (WHERE NOT success) AS failed_images,
  coalesce(string_agg(trim(full_text), ' ' ORDER BY image_idx) FILTER (WHERE success AND trim(full_text) <> ''), '') AS combined_full_text
FROM ({IMAGES}) t GROUP BY scan_id""")
def agg_10(spark, sf):
    return M.image_totals(sql_on(spark, sf, IMAGES))


FIRST = """SELECT scan_id, image_idx, mrp, net_quantity, manufacturer_name, month_of_packing, year_of_packing, consumer_care, full_text,
  CASE scan_key % 4 WHEN 0 THEN 'POOR' WHEN 1 THEN 'ACCEPTABLE' WHEN 2 THEN 'ACCEPTABLE' ELSE 'UNREADABLE' END AS quality_status FROM {image_values_v}"""
SECOND = """SELECT scan_id, image_idx, 'MRP Rs. 9.00' AS mrp, '1 kg' AS net_quantity, 'Second Foods' AS manufacturer_name, '01' AS month_of_packing,
  '2026' AS year_of_packing, 'a@b.example' AS consumer_care,
  CASE WHEN scan_key % 3 = 0 THEN 'short' ELSE concat(full_text, ' and more') END AS full_text FROM {image_values_v} WHERE scan_key % 5 <> 1"""
DUE = "(quality_status NOT IN ('POOR', 'UNREADABLE') AND (mrp IS NULL OR net_quantity IS NULL OR manufacturer_name IS NULL))"


@query("flt_12", f"SELECT scan_id, image_idx FROM ({FIRST}) t WHERE {DUE}")
def flt_12(spark, sf):
    first = sql_on(spark, sf, FIRST)
    return first.filter(M.needs_second_pass(F.col("quality_status"))).select("scan_id", "image_idx")


def _jn_11_sql(fill):
    cols = ", ".join(
        (f"CASE WHEN d AND s.scan_id IS NOT NULL THEN coalesce(a.{c}, s.{c}) ELSE a.{c} END AS {c}" if fill else f"a.{c}")
        for c in M.FILL_FIELDS
    )
    return f"""SELECT a.scan_id, a.image_idx, a.quality_status, {cols},
      CASE WHEN d AND length(s.full_text) > length(a.full_text) THEN s.full_text ELSE a.full_text END AS full_text,
      d AND s.scan_id IS NOT NULL AS retried, {'true' if fill else 'false'} AS filled
      FROM (SELECT *, {DUE} AS d FROM ({FIRST}) q) a LEFT JOIN ({SECOND}) s ON s.scan_id = a.scan_id AND s.image_idx = a.image_idx"""


@query("jn_11", _jn_11_sql(False) + " UNION ALL " + _jn_11_sql(True))
def jn_11(spark, sf):
    first, second = sql_on(spark, sf, FIRST), sql_on(spark, sf, SECOND)
    text = M.second_pass(first, second, "text").withColumn("filled", F.lit(False))
    return text.unionByName(M.second_pass(first, second, "fill").withColumn("filled", F.lit(True)))
