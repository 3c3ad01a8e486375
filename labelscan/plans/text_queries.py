"""Queries for the scalar functions, over whole texts of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelscan.functions import labels as L
from labelscan.functions import text as X
from labelscan.functions import vocab as V
from labelscan.functions.similarity import with_similarity
from labelscan.operators import extract as EX
from labelscan.operators import maker as MK
from labelscan.operators import rows as RW
from labelscan.operators import spatial as SP
from labelscan.operators.texts import once_per_text
from labelscan.plans.merge_queries import m, re2
from labelscan.plans.registry import query
from labelscan.plans.views import sql_on, table, view



def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def blocks(spark, sf):
    return view(spark, sf, "ocr_blocks_v")


KEY = ["scan_id", "image_idx", "block_idx"]
K = "scan_id, image_idx, block_idx"


@query("sca_1", "SELECT doc_id, md5(translate(translate(text, '0123456789', '०१२३४५६७८९'), '०१२३४५६७८९', '0123456789')) AS h FROM documents")
def sca_1(spark, sf):
    hindi = F.translate(F.col("text"), "0123456789", V.DEVANAGARI_DIGITS)
    return docs(spark, sf).select("doc_id", F.md5(X.ascii_digits(hindi).cast("binary")).alias("h"))


@query("sca_2", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS h FROM documents")
def sca_2(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.label_form(F.col("text")).cast("binary")).alias("h"))


BOXES = f"SELECT {K}, x_min, y_min, x_max, y_max, CASE WHEN block_idx % 7 = 0 THEN 2 ELSE 4 END AS points FROM {{ocr_blocks_v}}"


@query("sca_3", f"""SELECT {K}, CASE WHEN points = 4 THEN x_min END AS x_lo, CASE WHEN points = 4 THEN y_min END AS y_lo, CASE WHEN points = 4 THEN x_max + 3 END AS x_hi,
  CASE WHEN points = 4 THEN y_max + 1 END AS y_hi, CASE WHEN points = 4 THEN (2 * x_min + 2 * x_max + 3) / 4.0::double END AS cx, CASE WHEN points = 4 THEN (2 * y_min + 2 * y_max + 1) / 4.0::double END AS cy FROM ({BOXES}) b""")
def sca_3(spark, sf):
    at = lambda x, y: F.array(x, y)
    c = F.col
    quad = F.array(at(c("x_min"), c("y_min")), at(c("x_max") + 3, c("y_min")), at(c("x_max"), c("y_max") + 1), at(c("x_min"), c("y_max")))
    rows = sql_on(spark, sf, BOXES).withColumn("box", F.slice(quad, F.lit(1), c("points")))
    g = SP.box_metrics(c("box"))
    return rows.select(*KEY, g["x_min"].alias("x_lo"), g["y_min"].alias("y_lo"), g["x_max"].alias("x_hi"),
                       g["y_max"].alias("y_hi"), g["cx"].alias("cx"), g["cy"].alias("cy"))


RAW_PRICE = """SELECT product_id, product_key, CASE product_key % 6 WHEN 0 THEN mrp WHEN 1 THEN 'MRP 899 00' WHEN 2 THEN 'MRP ₹ 45,5' WHEN 3 THEN 'Price: 120' WHEN 4 THEN 'no price'
  ELSE 'MRP Rs 75.00 incl of taxes' END AS raw FROM {products_v}"""


@query("sca_4", f"""SELECT product_id, CASE WHEN raw IS NULL THEN NULL WHEN NOT regexp_matches(raw, '[0-9]') THEN raw
  WHEN raw = 'MRP 899 00' THEN 'MRP Rs. 899.00' WHEN raw = 'MRP ₹ 45,5' THEN 'MRP ₹ 45.50' WHEN raw = 'Price: 120' THEN 'MRP Rs. 120.00'
  ELSE CASE WHEN contains(raw, '₹') THEN 'MRP ₹ ' ELSE 'MRP Rs. ' END || regexp_extract(raw, '[0-9]+\\.[0-9]{{2}}') || CASE WHEN regexp_matches(raw, '(?i)\\b(inclusive|incl|tax|taxes)\\b') THEN ' (inclusive of all taxes)' ELSE '' END END AS mrp
FROM ({RAW_PRICE}) r""")
def sca_4(spark, sf):
    return sql_on(spark, sf, RAW_PRICE).select("product_id", X.normalise_mrp(F.col("raw"), F.lit("")).alias("mrp"))


RAW_USP = """SELECT product_id, product_key, CASE product_key % 4 WHEN 0 THEN 'Rs. 40,5' WHEN 1 THEN '12' WHEN 2 THEN '7.25' ELSE 'free' END AS v,
  CASE product_key % 3 WHEN 0 THEN 'Unit Sale Price ₹ /100 g' WHEN 1 THEN 'Price per kg /kg' ELSE 'plain' END AS ctx FROM {products_v}"""


@query("sca_5", f"""SELECT product_id, CASE WHEN product_key % 4 = 3 THEN 'free' ELSE CASE product_key % 3 WHEN 0 THEN '₹ ' ELSE 'Rs. ' END
  || CASE product_key % 4 WHEN 0 THEN '40.5' WHEN 1 THEN '12.00' ELSE '7.25' END || CASE product_key % 3 WHEN 0 THEN '/100 g' WHEN 1 THEN '/kg' ELSE '' END END AS unit_price FROM ({RAW_USP}) r""")
def sca_5(spark, sf):
    return sql_on(spark, sf, RAW_USP).select(
        "product_id", X.normalise_unit_price(F.col("v"), F.col("ctx")).alias("unit_price")
    )


RAW_DATE = """SELECT product_id, product_key, CASE product_key % 7 WHEN 0 THEN 'Jan' WHEN 1 THEN 'sept' WHEN 2 THEN 'DECEMBER' WHEN 3 THEN '7' WHEN 4 THEN '13' WHEN 5 THEN 'ja' ELSE ' may ' END AS mm,
  CASE product_key % 2 WHEN 0 THEN '26' ELSE '2027' END AS yy FROM {products_v}"""


@query("sca_6", f"""SELECT product_id, CASE product_key % 7 WHEN 0 THEN '01' WHEN 1 THEN '09' WHEN 2 THEN '12' WHEN 3 THEN '07' WHEN 4 THEN '13' WHEN 5 THEN NULL ELSE '05' END AS month,
  CASE product_key % 2 WHEN 0 THEN '2026' ELSE '2027' END AS year FROM ({RAW_DATE}) r""")
def sca_6(spark, sf):
    return sql_on(spark, sf, RAW_DATE).select(
        "product_id", X.month_number(F.col("mm")).alias("month"), X.year_number(F.col("yy")).alias("year")
    )


@query("sca_7")
def sca_7(spark, sf):
    """Digit repair needs look-around, which the checker's regex engine lacks."""
    damaged = F.translate(F.col("text"), "01", "OI")
    return docs(spark, sf).select("doc_id", F.md5(X.repair_digits(damaged).cast("binary")).alias("h"))


@query("sca_8")
def sca_8(spark, sf):
    """Contact repair needs look-behind as well; covered by fixtures."""
    return docs(spark, sf).select("doc_id", F.md5(X.repair_contact(F.col("text")).cast("binary")).alias("h"))


# damaged numbers and addresses of known outcome, by key class
NUMBERS = """SELECT p_partkey, cast(p_partkey AS string) AS k, p_partkey % 8 AS c, CASE p_partkey % 8 WHEN 0 THEN concat(p_partkey, 'O', p_partkey) WHEN 1 THEN concat(p_partkey, '|', p_partkey)
  WHEN 2 THEN concat(p_partkey, 'I') WHEN 3 THEN concat(p_partkey, 'lO', p_partkey) WHEN 4 THEN concat(p_partkey, 'l0O', p_partkey) WHEN 5 THEN concat('O', p_partkey)
  WHEN 6 THEN concat(p_partkey, 'o', p_partkey, 'i', p_partkey) ELSE p_name END AS t, p_name FROM {part}"""
CONTACTS = """SELECT p_partkey, concat('care', p_partkey) AS n, p_partkey % 7 AS c, CASE p_partkey % 7 WHEN 0 THEN concat('care', p_partkey, ' @ example . com')
  WHEN 1 THEN concat('care', p_partkey, ' at example.com') WHEN 2 THEN concat('care', p_partkey, '@example com') WHEN 3 THEN concat('care', p_partkey, ' @example.org')
  WHEN 4 THEN concat('ac care', p_partkey, '@example.in') WHEN 5 THEN concat('at home ', p_partkey) ELSE NULL END AS t FROM {part}"""


@query("sca_7_cases", f"""SELECT p_partkey, CASE c WHEN 0 THEN k || '0' || k WHEN 1 THEN k || '1' || k WHEN 2 THEN k || 'I' WHEN 3 THEN k || 'lO' || k WHEN 4 THEN k || '100' || k
  WHEN 5 THEN 'O' || k WHEN 6 THEN k || '0' || k || '1' || k ELSE p_name END AS fixed FROM ({NUMBERS}) n""")
def sca_7_cases(spark, sf):
    """Digit repair by known outcome: the checker's patterns have no look-around, so every class names its result."""
    return sql_on(spark, sf, NUMBERS).select("p_partkey", X.repair_digits(F.col("t")).alias("fixed"))


@query("sca_8_cases", f"""SELECT p_partkey, CASE WHEN c <= 2 THEN n || '@example.com' WHEN c = 3 THEN n || '@example.org' WHEN c = 4 THEN n || '@example.in'
  WHEN c = 5 THEN 'at home ' || p_partkey END AS fixed FROM ({CONTACTS}) n""")
def sca_8_cases(spark, sf):
    return sql_on(spark, sf, CONTACTS).select("p_partkey", X.repair_contact(F.col("t")).alias("fixed"))


TOLL = re2(V.TOLL_FREE)


@query("sca_9", f"""SELECT doc_id, nullif(regexp_extract(text, '{TOLL}'), '') AS toll_free, nullif(regexp_extract(text, '{re2(V.MOBILE)}'), '') AS mobile,
  nullif(regexp_extract(text, '{re2(V.LANDLINE)}'), '') AS landline FROM documents""")
def sca_9(spark, sf):
    ascii_only = lambda p: p.replace("(?U)", "")
    return docs(spark, sf).select(
        "doc_id", X.first_match(F.col("text"), ascii_only(V.TOLL_FREE)).alias("toll_free"),
        X.first_match(F.col("text"), ascii_only(V.MOBILE)).alias("mobile"), X.first_match(F.col("text"), ascii_only(V.LANDLINE)).alias("landline"),
    )


@query("sca_9_blocks", f"""SELECT {K}, CASE WHEN contains(text, '1800-100-1000') THEN '1800-100-1000' END AS phone FROM {{ocr_blocks_v}}""")
def sca_9_blocks(spark, sf):
    return blocks(spark, sf).select(*KEY, EX.block_phone(X.strip(F.col("text"))).alias("phone"))


@query("sca_10", f"""SELECT doc_id, nullif(regexp_extract(text, '{re2(V.EMAIL)}'), '') AS email, nullif(regexp_extract(text, '{re2(V.WEBSITE)}'), '') AS website FROM documents""")
def sca_10(spark, sf):
    plain = lambda p: p.replace("(?iU)", "(?i)").replace("(?U)", "")
    return docs(spark, sf).select(
        "doc_id", X.first_match(F.col("text"), plain(V.EMAIL)).alias("email"), X.first_match(F.col("text"), plain(V.WEBSITE)).alias("website")
    )


SUFFIX = re2(V.COMPANY_SUFFIX)


@query("sca_11", f"SELECT {K}, nullif(trim(regexp_extract(text, '{SUFFIX}', 1)), '') AS name, nullif(trim(regexp_extract(text, '{SUFFIX}', 2)), '') AS rest FROM {{ocr_blocks_v}}")
def sca_11(spark, sf):
    return blocks(spark, sf).select(*KEY, X.company_name(F.col("text")).alias("name"), X.company_rest(F.col("text")).alias("rest"))


@query("sca_12", f"""SELECT {K}, NOT {m('lower(text)', '|'.join(V.TRADEMARK_WORDS))} AND NOT contains(text, '@') AND NOT {m('trim(text)', V.COMPANY_REJECT)}
  AND NOT {m('trim(text)', V.COMPANY_REJECT_START)} AS company FROM {{ocr_blocks_v}}""")
def sca_12(spark, sf):
    return blocks(spark, sf).select(*KEY, X.is_company(F.col("text")).alias("company"))


ADDRESS = "|".join(rf"\b{w}\b" if len(w) <= 3 else w for w in V.ADDRESS_WORDS)


@query("sca_13", f"SELECT {K}, regexp_matches(lower(text), '{ADDRESS}') AS address FROM {{ocr_blocks_v}}")
def sca_13(spark, sf):
    return blocks(spark, sf).select(*KEY, X.is_address(F.col("text")).alias("address"))


RAW_COUNTRY = """SELECT s.s_suppkey, CASE s.s_suppkey % 8 WHEN 0 THEN 'India' WHEN 1 THEN ' united kingdom. ' WHEN 2 THEN 'CHINA by Acme' WHEN 3 THEN 'origin' WHEN 4 THEN 'Indai'
  WHEN 5 THEN n.n_name WHEN 6 THEN 'Net Wt' ELSE 'Germony' END AS raw FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey"""


@query("sca_14", f"""SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'India' WHEN 1 THEN 'United' WHEN 2 THEN 'China' WHEN 4 THEN 'India' WHEN 7 THEN 'Germany' END AS country FROM ({RAW_COUNTRY}) r""")
def sca_14(spark, sf):
    return sql_on(spark, sf, RAW_COUNTRY).select("s_suppkey", L.valid_country(F.col("raw")).alias("country"))


RAW_BATCH = """SELECT product_id, product_key, CASE product_key % 9 WHEN 0 THEN 'B' || product_id || 'X' WHEN 1 THEN ': AB12 Mfg 01/2026' WHEN 2 THEN 'See below' WHEN 3 THEN '03/2026' WHEN 4 THEN 'Rs 50'
  WHEN 5 THEN '100 ml' WHEN 6 THEN 'B12345/Mfg Date' WHEN 7 THEN 'X' ELSE '#L-77, ' END AS raw FROM {products_v}"""


@query("sca_15", f"""SELECT product_id, CASE product_key % 9 WHEN 0 THEN 'B' || product_id || 'X' WHEN 1 THEN 'AB12' WHEN 6 THEN 'B12345' WHEN 8 THEN 'L-77' END AS batch FROM ({RAW_BATCH}) r""")
def sca_15(spark, sf):
    return sql_on(spark, sf, RAW_BATCH).select("product_id", X.clean_batch(F.col("raw")).alias("batch"))


VARIANTS = ", ".join(f"({i}, '{c}', '{v}')" for i, (c, v) in enumerate(L.VARIANTS))
CONCEPT = f"""d(label_ord, concept, variant) AS (VALUES {VARIANTS}), t AS (SELECT DISTINCT text, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS c FROM {{ocr_blocks_v}}),
k AS (SELECT t.text, arg_min(d.concept, d.label_ord) AS concept FROM t JOIN d ON starts_with(t.c, d.variant) GROUP BY t.text)"""
BOUNDARY_SET = ", ".join(f"'{c}'" for c in V.BOUNDARY_CONCEPTS)
FORMS = ", ".join("'" + f.replace("'", "''") + "'" for f in L._LABEL_FORMS)


@query("sca_16", f"""WITH {CONCEPT}
SELECT {K}, {m('o.text', V.SECTION_BOUNDARY)} OR coalesce(k.concept IN ({BOUNDARY_SET}), false) AS boundary,
  {m("regexp_replace(trim(o.text), '[ ]+', ' ', 'g')", V.FIELD_LABEL)} OR coalesce(k.concept || '|' || trim(regexp_replace(lower(o.text), '[^a-z0-9]+', ' ', 'g')) IN ({FORMS}), false) AS field_label,
  {m("trim(regexp_replace(lower(o.text), '[^a-z0-9]+', ' ', 'g'))", V.COUNTRY_LABEL_LOOSE)} AS country_label
FROM {{ocr_blocks_v}} o LEFT JOIN k ON k.text = o.text""")
def sca_16(spark, sf):
    c = F.col("concept")
    kinds = lambda texts: texts.withColumn("concept", L.exact_label(F.col("text"))).select(
        "text", L.is_section_boundary(F.col("text"), c).alias("boundary"), L.is_field_label(F.col("text"), c).alias("field_label"),
        X.looks_like_country_label(F.col("text")).alias("country_label"),
    )
    return once_per_text(blocks(spark, sf).select(*KEY, "text"), ["text"], kinds).drop("text")


SLANT = f"SELECT {K}, text, (block_idx % 5) * 0.05 AS slope FROM {{ocr_blocks_v}}"


@query("sca_18", f"""WITH s AS (SELECT {K}, (block_idx % 5) * 0.05::double AS slope, lag((block_idx % 5) * 0.05::double) OVER (PARTITION BY scan_id, image_idx ORDER BY block_idx) AS prev FROM {{ocr_blocks_v}})
SELECT {K}, coalesce(slope <= 0.12 OR abs(slope - prev) <= 0.04, true) AS plausible FROM s""")
def sca_18(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("scan_id", "image_idx").orderBy("block_idx")
    slope = (F.col("block_idx") % 5) * F.lit(0.05)
    rows = blocks(spark, sf).select(*KEY, slope.alias("slope")).withColumn("prev", F.lag("slope").over(w))
    return rows.select(*KEY, MK.plausible_slope(F.col("slope"), F.col("prev")).alias("plausible"))


@query("sca_19")
def sca_19(spark, sf):
    """Unlabelled-name test of every block (letter classes and look-around differ in the checker)."""
    return blocks(spark, sf).select(*KEY, EX.plausible_plain_name(X.strip(F.col("text")), F.col("confidence")).alias("plain_name"))


PLAIN_NAMES = """SELECT p_partkey, p_partkey % 9 AS c, CASE p_partkey % 9 WHEN 0 THEN 'Crunchy Oat Cookies' WHEN 1 THEN 'Masala Noodles' WHEN 2 THEN 'Really Good Oats?' WHEN 3 THEN 'Cookies'
  WHEN 4 THEN 'Crunchy Oat Cookies.' WHEN 5 THEN 'Acme Snacks Pvt Ltd' WHEN 6 THEN 'Crunchy Oat Cookies' WHEN 7 THEN 'one two three four five six' ELSE '12 34 ab cd 5678901' END AS t,
  cast(CASE p_partkey % 9 WHEN 6 THEN 0.7 ELSE 0.9 END AS double) AS conf FROM {part}"""


@query("sca_19_cases", f"SELECT p_partkey, c <= 1 AS plain_name FROM ({PLAIN_NAMES}) n")
def sca_19_cases(spark, sf):
    """Unlabelled names by known outcome: question, one word, full stop, company, low confidence, many words, few letters."""
    return sql_on(spark, sf, PLAIN_NAMES).select("p_partkey", EX.plausible_plain_name(F.col("t"), F.col("conf")).alias("plain_name"))


_any = lambda words: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query("sca_21", f"""SELECT {K}, CASE WHEN {_any(V.ROLE_MAKER)} THEN 4 WHEN {_any(V.ROLE_MARKETER)} THEN 3 WHEN {_any(V.ROLE_OFFICE)} THEN 2 ELSE 0 END AS score FROM {{ocr_blocks_v}}""")
def sca_21(spark, sf):
    return blocks(spark, sf).select(*KEY, X.role_score(F.col("text")).alias("score"))


# pairs whose longest blocks are known: equal texts, a text and its beginning or extension, no common letter, known words
PAIRS = """SELECT p_partkey, p_name AS a, CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, '#') WHEN 2 THEN substr(p_name, 1, 5) WHEN 3 THEN '0123'
  WHEN 4 THEN '' WHEN 5 THEN concat('<<', p_name, '>>') END AS b FROM {part}
UNION ALL SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'manufactured' WHEN 1 THEN 'wikimedia' WHEN 2 THEN '' END AS a,
  CASE p_partkey % 4 WHEN 0 THEN 'manufacturcd' WHEN 1 THEN 'wikimania' WHEN 2 THEN '' ELSE 'x' END AS b FROM {part}"""
RATIOS = f"""SELECT p_partkey, a, b, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = b THEN 1.0 WHEN a = 'manufactured' THEN 22.0 / 24 WHEN a = 'wikimedia' THEN 14.0 / 18
  WHEN b = '0123' OR b = '' THEN 0.0 ELSE 2.0 * least(length(a), length(b)) / (length(a) + length(b)) END::double AS ratio FROM ({PAIRS}) p"""


@query("sca_22", f"SELECT p_partkey, a, b, round(ratio, 9) AS ratio FROM ({RATIOS}) r")
def sca_22(spark, sf):
    return with_similarity(sql_on(spark, sf, PAIRS), "a", "b").withColumn("ratio", F.round("ratio", 9))


SIMILAR = 0.82


@query("udf_3", f"""SELECT a, b, count(*) AS n, round(CASE WHEN ratio >= {SIMILAR} THEN ratio END, 9) AS ratio FROM ({RATIOS}) r
WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b, ratio""")
def udf_3(spark, sf):
    """Rows by pair, with the ratio where it reaches the least one; other pairs are settled by the bounds."""
    counted = sql_on(spark, sf, PAIRS).filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return with_similarity(counted, "a", "b", least=SIMILAR).withColumn("ratio", F.round("ratio", 9))


@query("udf_4", """SELECT scan_id, image_idx, count(*) AS blocks, count(DISTINCT y_min) AS rows FROM {ocr_blocks_v} GROUP BY scan_id, image_idx""")
def udf_4(spark, sf):
    return RW.visual_rows(blocks(spark, sf)).groupBy("scan_id", "image_idx").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_distinct("row_id").alias("rows")
    )


# ASCII text, because the checker's word boundaries know ASCII only
ASCII = "SELECT doc_id, regexp_replace(text, '[^ -~]+', ' '{g}) AS text FROM {{documents}}"


@query("sca_25", f"SELECT doc_id, md5(trim(regexp_replace(text, '{re2(V.BOUNDARY_KEYWORDS)}.*$', ''))) AS h FROM ({ASCII.format(g=", 'g'")}) d")
def sca_25(spark, sf):
    return sql_on(spark, sf, ASCII.format(g="")).select("doc_id", F.md5(X.cut_at_boundary(F.col("text")).cast("binary")).alias("h"))


DAMAGED = """SELECT product_id AS scan_id, 0 AS image_idx, cast(product_key AS int) AS block_idx, product_key, CASE product_key % 5 WHEN 0 THEN 'Manufacturcd by ' || coalesce(manufacturer_name, 'X')
  WHEN 1 THEN 'Markeled bv: Acme Ltd' WHEN 2 THEN 'hello for all' WHEN 3 THEN 'Pakced by Y' ELSE product_name END AS t FROM {products_v}"""


@query("sca_26", f"""SELECT scan_id, CASE product_key % 5 WHEN 0 THEN 'manufacturcd' WHEN 1 THEN 'markeled' WHEN 3 THEN 'pakced' END AS word,
  CASE product_key % 5 WHEN 0 THEN substr(t, 17) WHEN 1 THEN 'Acme Ltd' WHEN 3 THEN 'Y' END AS rest FROM ({DAMAGED}) d""")
def sca_26(spark, sf):
    return MK.with_corrupted(sql_on(spark, sf, DAMAGED)).select("scan_id", F.col("c_word").alias("word"), F.col("c_rest").alias("rest"))


MONTHS = ", ".join(f"'{x}'" for x in V.VALID_MONTHS)
KINDS = ", ".join(f"'{x}'" for x in V.PERISHABLE_TYPES)
LANDS = ", ".join(f"'{x}'" for x in V.COUNTRIES)


@query("set_3", f"""SELECT product_id, coalesce(lower(product_type) IN ({KINDS}), false) AS perishable, coalesce(lower(month_of_packing) IN ({MONTHS}), false) AS month_ok,
  coalesce(lower(country_of_origin) IN ({LANDS}), false) AS country_ok FROM {{products_v}}""")
def set_3(spark, sf):
    member = lambda c, xs: F.coalesce(F.lower(c).isin(xs), F.lit(False))
    return view(spark, sf, "products_v").select(
        "product_id", member("product_type", V.PERISHABLE_TYPES).alias("perishable"),
        member("month_of_packing", V.VALID_MONTHS).alias("month_ok"), member("country_of_origin", V.COUNTRIES).alias("country_ok"),
    )
