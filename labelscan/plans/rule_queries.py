"""Queries over the product view: rules, roll-up, violations, registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelscan.functions import vocab as V
from labelscan.functions.text import quantity_category
from labelscan.operators import evaluate as E
from labelscan.operators import rules as R
from labelscan.operators.custom import python_rule
from labelscan.plans.registry import query
from labelscan.plans.views import view

WS = "' ' || chr(9) || chr(10) || chr(13)"


def _blank(c):
    return f"coalesce(trim({c}, {WS}), '') = ''"


def _re(c, pattern):
    return f"coalesce(regexp_matches({c}, '{pattern}'), false)"


TAX = " OR ".join(f"contains(lower(mrp), '{w}')" for w in V.TAX_CLAUSES)
USP1 = r"(?i)(?:₹|rs\.?|inr)\s*\d+(?:\.\d+)?\s*(?:/|per)\s*(?:g|gram|kg|kilogram|ml|l|liter|litre|m|cm|n|unit|piece)"
USP2 = r"(?i)unit\s*(?:sale\s*)?price\s*:?\s*(?:₹|rs\.?|inr)?\s*\d+"
EXP = [
    r"(?i)\bbest\s*before\s*:?\s*\d+\s*(?:months?|years?|days?)\b",
    r"(?i)\bexp(?:iry)?\s*(?:date)?\s*:?\s*(?:0?[1-9]|1[0-2])[/\.-]\d{2,4}\b",
    r"(?i)\buse\s*by\s*:?\s*(?:0?[1-9]|1[0-2])[/\.-]\d{2,4}\b",
    r"(?i)\b(?:0?[1-9]|1[0-2])[/\.-](?:20\d{2}|\d{4})\b",
]
MONTHS = ", ".join(f"'{m}'" for m in V.VALID_MONTHS)
CATEGORY = (
    r"CASE WHEN regexp_matches(net_quantity, '(?i)\b(sq m|sq cm|sq meter|square meter)\b') THEN 'AREA'"
    r" WHEN regexp_matches(net_quantity, '(?i)\b(g|gram|grams|kg|kilogram|kilograms|mg|milligram)\b') THEN 'WEIGHT'"
    r" WHEN regexp_matches(net_quantity, '(?i)\b(ml|milliliter|millilitres|l|liter|liters|litre|litres|cl)\b') THEN 'VOLUME'"
    r" WHEN regexp_matches(net_quantity, '(?i)\b(m|meter|meters|cm|centimeter|mm|millimeter)\b') THEN 'LENGTH'"
    r" WHEN regexp_matches(net_quantity, '(?i)\b(n|units|pcs|pieces|count|items|no|number)\b') THEN 'NUMBER_OR_UNIT' END"
)
USP_IN = lambda c: f"({_re(c, USP1)} OR {_re(c, USP2)})"
PERISH = "lower(trim(coalesce(product_type, ''))) IN ('food','cosmetics','pharma','pharmaceuticals','drug','drugs','beverage','beverages')"
IMP = "coalesce(is_imported, false)"

# rule id -> (applicable, [(condition, status, severity, message expression)])
LADDER = {
    "rul_01": ("true", "CRITICAL", [
        (_blank("mrp"), "FAIL", None, "'MRP declaration is completely missing from product payload.'"),
        (f"NOT {_re('mrp', '[0-9]')}", "FAIL", None, "'MRP declaration does not contain a valid numeric price value.'"),
        (f"({TAX})", "PASS", None, "'MRP value, currency representation, and tax inclusion phrase (''incl. of all taxes'') are clearly declared.'"),
        ("true", "MANUAL_REVIEW", None, "'Numeric MRP value is present, but statutory presentation details and tax inclusion clause (''incl. of all taxes'') cannot be verified from structured input.'"),
    ]),
    "rul_02": ("true", "HIGH", [
        (_blank("net_quantity"), "FAIL", None, "'Net Quantity declaration is completely missing from product payload.'"),
        (f"NOT {_re('net_quantity', '[0-9]')}", "FAIL", None, "'Net Quantity declaration lacks a valid numeric quantity value.'"),
        (f"({CATEGORY}) IS NOT NULL", "PASS", None, f"concat('Net Quantity declaration is present in valid statutory metric units (Category: ', {CATEGORY}, ').')"),
        ("true", "MANUAL_REVIEW", None, "'Net Quantity numeric value present, but unit category alignment requires physical label verification.'"),
    ]),
    "rul_03": ("coalesce(is_imported, true)", "CRITICAL", [
        ("is_imported IS NULL", "MANUAL_REVIEW", None, "'Import status is unconfirmed in structured payload; manual review required to determine if commodity is imported.'"),
        (_blank("importer_name"), "FAIL", None, "'Mandatory Importer name and address declaration is missing on imported package.'"),
        ("true", "PASS", None, "'Importer declaration is present on imported package.'"),
    ]),
    "rul_04": ("true", "HIGH", [
        (_blank("product_name"), "FAIL", None, "'Generic or common name of the commodity is completely missing from product payload.'"),
        (f"length(trim(product_name)) < 2 OR NOT {_re('product_name', '[[:alpha:]]')}", "MANUAL_REVIEW", None, "'Declared commodity name appears vague or numerical; manual label verification required.'"),
        ("true", "PASS", None, "'Generic or common name of commodity is declared.'"),
    ]),
    "rul_05": (f"NOT ({IMP} AND coalesce(manufacturer_name, '') = '' AND coalesce(packer_name, '') = '')", "CRITICAL", [
        (f"{_blank('manufacturer_name')} AND {_blank('packer_name')}", "FAIL", None, "'Name of Manufacturer or Packer is completely missing from product payload.'"),
        ("true", "PASS", None, "'Manufacturer or Packer name declaration is present in structured payload.'"),
    ]),
    "rul_06": (f"NOT ({IMP} AND coalesce(manufacturer_name, '') = '' AND coalesce(packer_name, '') = '' AND coalesce(manufacturer_address, '') = '')", "HIGH", [
        (_blank("manufacturer_address"), "FAIL", None, "'Manufacturer or Packer address declaration is completely missing from product payload.'"),
        (_re("manufacturer_address", r"\b[1-9]\d{2}\s?\d{3}\b"), "PASS", None, "'Manufacturer or Packer address text is present with 6-digit pincode.'"),
        ("true", "MANUAL_REVIEW", None, "'Manufacturer or Packer address text is present, but missing 6-digit pincode; manual verification required.'"),
    ]),
    "rul_07": ("true", "HIGH", [
        (f"{_blank('month_of_packing')} AND {_blank('year_of_packing')}", "FAIL", None, "'Month and Year of packing or manufacture is completely missing.'"),
        (f"{_blank('month_of_packing')} OR {_blank('year_of_packing')}", "FAIL", None, "'Incomplete date declaration; both Month AND Year of packing/manufacture are required.'"),
        (f"lower(trim(month_of_packing)) NOT IN ({MONTHS})", "MANUAL_REVIEW", None, "concat('Month value ''', trim(month_of_packing), ''' is non-standard; manual label verification required.')"),
        (f"NOT {_re('trim(year_of_packing)', '^([0-9]{2}|[0-9]{4})$')}", "MANUAL_REVIEW", None, "concat('Year value ''', trim(year_of_packing), ''' is non-standard; manual label verification required.')"),
        ("true", "PASS", None, "'Month and Year of packing/manufacture declaration is present in standard format.'"),
    ]),
    "rul_08": ("true", "HIGH", [
        (_blank("consumer_care"), "FAIL", None, "'Consumer care contact details are completely missing from product payload.'"),
        (_re("consumer_care", "(?i)@|email|tel|phone|call|[0-9]"), "PASS", None, "'Consumer care contact details (phone/email/address) are declared.'"),
        ("true", "MANUAL_REVIEW", None, "'Consumer care details provided but lack clear telephone/email contact format; manual verification required.'"),
    ]),
    "rul_09": (f"{IMP} OR NOT ({_blank('country_of_origin')})", "CRITICAL", [
        (f"{_blank('country_of_origin')} AND {IMP}", "FAIL", None, "'Mandatory Country of Origin declaration is missing on imported package.'"),
        (f"NOT ({_blank('country_of_origin')})", "PASS", None, "concat('Country of Origin declaration is present: ''', trim(country_of_origin), '''.')"),
        ("true", "MANUAL_REVIEW", "LOW", "'Country of Origin detail requires manual label review.'"),
    ]),
    "rul_10": (f"NOT ({_blank('unit_sale_price')}) OR {USP_IN('mrp')} OR {_re('net_quantity', '[0-9]')}", "HIGH", [
        (f"NOT ({_blank('unit_sale_price')}) AND {USP_IN('unit_sale_price')}", "PASS", None, "concat('Unit Sale Price declaration is present: ''', trim(unit_sale_price), '''.')"),
        (f"NOT ({_blank('unit_sale_price')})", "MANUAL_REVIEW", None, "concat('Unit Sale Price text ''', trim(unit_sale_price), ''' is non-standard; manual label verification required.')"),
        (USP_IN("mrp"), "PASS", None, f"concat('Unit Sale Price detected in price snippet: ''', coalesce(nullif(regexp_extract(mrp, '{USP1}'), ''), nullif(regexp_extract(mrp, '{USP2}'), '')), '''.')"),
        (f"NOT ({_blank('net_quantity')})", "MANUAL_REVIEW", None, "'Unit Sale Price declaration is missing; manual verification required to check applicability under Rule 6(11).'"),
        ("true", "MANUAL_REVIEW", "LOW", "'Unit Sale Price declaration is missing and net quantity is unprovided.'"),
    ]),
    "rul_11": (f"{PERISH} OR NOT ({_blank('expiry_date')})", "HIGH", [
        (f"NOT ({_blank('expiry_date')}) AND (" + " OR ".join(_re("expiry_date", p) for p in EXP) + ")", "PASS", None, "concat('Expiry / Best Before declaration is present: ''', trim(expiry_date), '''.')"),
        (f"NOT ({_blank('expiry_date')})", "MANUAL_REVIEW", None, "concat('Expiry / Best Before text ''', trim(expiry_date), ''' is non-standard; manual label verification required.')"),
        (PERISH, "FAIL", None, "concat('Mandatory Best Before / Expiry Date declaration is missing for perishable category ''', product_type, '''.')"),
        (f"NOT ({_blank('product_type')})", "NOT_APPLICABLE", None, "'Expiry date declaration is not mandatory for non-perishable commodity.'"),
        ("true", "MANUAL_REVIEW", None, "'Expiry date declaration is not present; verify if commodity is non-perishable.'"),
    ]),
    "rul_12": ("font_size_mm IS NOT NULL", "HIGH", [
        ("font_size_mm < 1.0", "FAIL", None, "concat('Measured declaration font height (', printf('%.1f', font_size_mm), ' mm) is below absolute statutory minimum requirement of 1.0 mm.')"),
        ("true", "PASS", None, "concat('Declaration font size measurement (', printf('%.1f', font_size_mm), ' mm) satisfies statutory legibility requirements.')"),
    ]),
    "rul_13": (f"NOT ({_blank('declaration_placement')}) OR is_pdp_placement_valid IS NOT NULL", "HIGH", [
        ("is_pdp_placement_valid", "PASS", None, "'Mandatory declarations are properly placed on the Principal Display Panel (PDP).'"),
        ("NOT is_pdp_placement_valid", "FAIL", None, "'Mandatory declarations are placed outside the statutory Principal Display Panel.'"),
        (_re("upper(declaration_placement)", "PDP|FRONT|PRINCIPAL|MAIN PANEL"), "PASS", None, "concat('Declaration placement area ''', declaration_placement, ''' satisfies Principal Display Panel requirements.')"),
        ("true", "MANUAL_REVIEW", None, "concat('Declaration placement location ''', declaration_placement, ''' requires manual label verification for PDP compliance.')"),
    ]),
    "rul_14": ("contrast_ratio IS NOT NULL OR is_legible IS NOT NULL", "HIGH", [
        ("NOT is_legible", "FAIL", None, "'Label text legibility does not meet statutory standards under Rule 8.'"),
        ("contrast_ratio >= 4.5", "PASS", None, "concat('Text contrast ratio (', cast(contrast_ratio AS varchar), ':1) meets statutory legibility standards.')"),
        ("contrast_ratio < 3.0", "FAIL", None, "concat('Text contrast ratio (', cast(contrast_ratio AS varchar), ':1) is insufficient for legibility under Rule 8.')"),
        ("contrast_ratio IS NOT NULL", "MANUAL_REVIEW", None, "concat('Text contrast ratio (', cast(contrast_ratio AS varchar), ':1) requires manual verification.')"),
        ("true", "PASS", None, "'Visual legibility and contrast meet statutory standards.'"),
    ]),
}


def _case(key, what):
    """CASE ladder of one rule: what = status, severity or message."""
    applicable, own, branches = LADDER[key]
    rule = R.ALL_RULES[int(key[-2:]) - 1]
    skip = {
        "status": "'NOT_APPLICABLE'", "severity": f"'{own}'",
        "message": f"'Rule ''{rule.rule_id}'' is not applicable for this product configuration.'",
    }[what]
    out = f"CASE WHEN NOT coalesce({applicable}, false) THEN {skip}"
    for cond, status, severity, message in branches:
        sev = severity or ("MEDIUM" if status == "MANUAL_REVIEW" else own)
        out += f" WHEN {cond} THEN " + {"status": f"'{status}'", "severity": f"'{sev}'", "message": message}[what]
    return out + " END"


def _rule_select(key):
    rule = R.ALL_RULES[int(key[-2:]) - 1]
    return (
        f"SELECT product_id, {int(key[-2:])} AS rule_ord, '{rule.rule_id}' AS rule_id,"
        f" {_case(key, 'status')} AS status, {_case(key, 'severity')} AS severity,"
        f" {_case(key, 'message')} AS message, '{rule.target}' AS field FROM {{products_v}}"
    )


ALL_SQL = " UNION ALL ".join(_rule_select(k) for k in LADDER)
COUNTS = (
    "count(*) AS total_rules, count(*) FILTER (WHERE status = 'PASS') AS passed_rules,"
    " count(*) FILTER (WHERE status = 'FAIL') AS failed_rules,"
    " count(*) FILTER (WHERE status = 'MANUAL_REVIEW') AS manual_review_rules,"
    " count(*) FILTER (WHERE status = 'NOT_APPLICABLE') AS not_applicable_rules"
)
OVERALL = (
    "CASE WHEN failed_rules > 0 THEN 'FAIL' WHEN manual_review_rules > 0 THEN 'MANUAL_REVIEW'"
    " WHEN passed_rules > 0 THEN 'PASS' WHEN not_applicable_rules > 0 THEN 'NOT_APPLICABLE' ELSE 'PASS' END"
)
HINTS = " UNION ALL ".join(
    "SELECT '{}' AS rule_id, '{}' AS hint".format(r.rule_id, r.hint.replace("'", "''")) for r in R.ALL_RULES
)


def _one_rule(rule):
    def run(spark, sf):
        return E.rule_results(view(spark, sf, "products_v"), [rule]).select(
            "product_id", F.lit(R.ALL_RULES.index(rule) + 1).alias("rule_ord"), "rule_id", "status",
            "severity", "message", "field",
        )

    return run


for _i, _rule in enumerate(R.ALL_RULES, start=1):
    query(f"rul_{_i:02d}", _rule_select(f"rul_{_i:02d}"))(_one_rule(_rule))


@query("rul_15", f"""
WITH r AS ({ALL_SQL}), c AS (SELECT product_id, {COUNTS} FROM r GROUP BY product_id)
SELECT product_id, cast(total_rules AS int) AS total_rules, cast(passed_rules AS int) AS passed_rules,
  cast(failed_rules AS int) AS failed_rules, cast(manual_review_rules AS int) AS manual_review_rules,
  cast(not_applicable_rules AS int) AS not_applicable_rules, {OVERALL} AS overall_status,
  cast(failed_rules + manual_review_rules AS int) AS n_violations FROM c""")
def rul_15(spark, sf):
    return E.evaluate_products(view(spark, sf, "products_v")).select(
        "product_id", "total_rules", "passed_rules", "failed_rules", "manual_review_rules",
        "not_applicable_rules", "overall_status", F.size("violations").alias("n_violations"),
    )


@query("jn_1", ALL_SQL)
def jn_1(spark, sf):
    return E.rule_results(view(spark, sf, "products_v")).select(
        "product_id", "rule_ord", "rule_id", "status", "severity", "message", "field"
    )


@query("jn_2", f"""
WITH r AS ({ALL_SQL}), h AS ({HINTS})
SELECT product_id, r.rule_id, status, coalesce(h.hint, concat('Review and rectify statutory declaration for rule ', r.rule_id, '.')) AS remediation
FROM r LEFT JOIN (SELECT * FROM h WHERE rule_id <> 'LM-RULE-READ-014') h ON h.rule_id = r.rule_id""")
def jn_2(spark, sf):
    # the last rule is left out of the dimension, so its default text is exercised
    results = E.rule_results(view(spark, sf, "products_v"))
    return E.with_remediation(results, E.remediation_table(spark, R.ALL_RULES[:-1])).select(
        "product_id", "rule_id", "status", "remediation"
    )


EVIDENCE_SQL = """
SELECT product_id, 'mrp' AS field, coalesce(CASE WHEN product_key % 12 = 0 THEN concat('ocr:', mrp) END, mrp) AS value,
  CASE WHEN product_key % 12 = 0 THEN 'OCR' ELSE 'STRUCTURED_INPUT' END AS source,
  CASE WHEN product_key % 12 = 0 THEN 0.96 ELSE 1.0 END AS confidence FROM {products_v}
"""


def products_with_evidence(spark, sf):
    made = F.create_map(
        F.lit("mrp"),
        F.struct(
            F.lit("mrp").alias("field"), F.concat(F.lit("ocr:"), "mrp").alias("value"),
            F.lit("OCR").alias("source"), F.lit(0.96).alias("confidence"),
            F.lit(None).cast("string").alias("rawAnnotation"),
        ),
    )
    return view(spark, sf, "products_v").withColumn(
        "evidence", F.when(F.col("product_key") % 12 == 0, made)
    )


@query("jn_3", """
SELECT product_id, 'mrp' AS field, CASE WHEN product_key % 12 = 0 THEN concat('ocr:', coalesce(mrp, '?')) ELSE mrp END AS value,
  CASE WHEN product_key % 12 = 0 THEN 'OCR' ELSE 'STRUCTURED_INPUT' END AS source,
  CASE WHEN product_key % 12 = 0 THEN cast(0.96 AS double) ELSE cast(1.0 AS double) END AS confidence
FROM {products_v}
UNION ALL
SELECT product_id, 'isLegible' AS field, CASE is_legible WHEN true THEN 'true' WHEN false THEN 'false' END AS value,
  'STRUCTURED_INPUT' AS source, cast(1.0 AS double) AS confidence FROM {products_v}""")
def jn_3(spark, sf):
    products = products_with_evidence(spark, sf).withColumn(
        "evidence",
        F.transform_values(
            "evidence",
            lambda k, e: e.withField("value", F.coalesce(e["value"], F.lit("ocr:?"))),
        ),
    )
    legible = R.Rule("EV-ONLY", "Evidence of legibility", target="isLegible",
                     branches=(R.Branch(lambda: F.lit(True), V.PASS, "ok"),))
    return E.rule_results(products, [R.MRP, legible]).select(
        "product_id", "evidence.field", "evidence.value", "evidence.source", "evidence.confidence"
    )


@query("agg_1", f"""
WITH r AS ({ALL_SQL}), c AS (SELECT product_id, {COUNTS} FROM r GROUP BY product_id)
SELECT *, {OVERALL} AS overall_status FROM c""")
def agg_1(spark, sf):
    return E.roll_up(E.rule_results(view(spark, sf, "products_v")))


@query("agg_2", f"""
WITH r AS ({ALL_SQL}), c AS (SELECT product_id, count(*) FILTER (WHERE status = 'PASS') AS pass,
  count(*) FILTER (WHERE status = 'FAIL') AS fail, count(*) FILTER (WHERE status = 'MANUAL_REVIEW') AS manual_review,
  count(*) FILTER (WHERE status = 'NOT_APPLICABLE') AS not_applicable FROM r GROUP BY product_id)
SELECT c.*, CASE WHEN product_key % 12 = 0 THEN 'OCR,STRUCTURED_INPUT' ELSE 'STRUCTURED_INPUT' END AS evidence_sources
FROM c JOIN {{products_v}} p ON p.product_id = c.product_id""")
def agg_2(spark, sf):
    trace = E.decision_trace(E.rule_results(products_with_evidence(spark, sf)))
    return trace.withColumn("evidence_sources", F.array_join("evidence_sources", ","))


@query("agg_3", f"""
WITH r AS ({ALL_SQL}), h AS ({HINTS})
SELECT product_id, r.rule_ord, r.rule_id, severity, message, field, h.hint AS remediation
FROM r JOIN h ON h.rule_id = r.rule_id WHERE status IN ('FAIL', 'MANUAL_REVIEW')""")
def agg_3(spark, sf):
    results = E.rule_results(view(spark, sf, "products_v"))
    return E.violations(results, E.remediation_table(spark)).select(
        "product_id", "rule_ord", "rule_id", "severity", "message", "field", "remediation"
    )


@query("udf_1", """
SELECT product_id, cast(2 AS int) AS total_rules, CASE WHEN product_name IS NULL OR trim(product_name) = '' THEN 'FAIL'
  WHEN length(product_name) > 10 OR product_name = '7' THEN 'MANUAL_REVIEW' ELSE 'PASS' END AS overall_status
FROM {products_v}""")
def udf_1(spark, sf):
    """A registry with one stock rule and one custom rule; a repeated id is ignored."""
    long_name = R.Rule(
        "CUSTOM-LEN-001", "Name length", target="productName", severity="LOW",
        applicable=lambda: F.col("product_name").isNotNull(),
        branches=(
            R.Branch(lambda: F.length("product_name") > 10, V.MANUAL_REVIEW, "Name is long."),
            R.Branch(lambda: F.lit(True), V.PASS, "Name is short."),
        ),
    )
    registry = R.RuleRegistry([R.PRODUCT_NAME, long_name])
    registry.register(R.Rule("CUSTOM-LEN-001", "ignored"))
    return E.evaluate_products(view(spark, sf, "products_v"), registry.all()).select(
        "product_id", "total_rules", "overall_status"
    )


FAILURE = "'Internal rule execution failure: '"


@query("udf_1_raising", f"""
SELECT product_id, 'CUSTOM-PRICE' AS rule_id, CASE WHEN mrp IS NULL OR mrp = 'MRP on pack' THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE WHEN mrp IS NULL OR mrp = 'MRP on pack' THEN 'CRITICAL' ELSE 'LOW' END AS severity,
  CASE WHEN mrp IS NULL THEN {FAILURE} || 'no mrp' WHEN mrp = 'MRP on pack' THEN {FAILURE} || 'no price in MRP on pack' ELSE 'Price found.' END AS message FROM {{products_v}}
UNION ALL SELECT product_id, 'CUSTOM-MONTH', CASE WHEN month_of_packing IS NULL THEN 'NOT_APPLICABLE' WHEN month_of_packing = '13' THEN 'FAIL' ELSE 'PASS' END,
  CASE WHEN month_of_packing = '13' THEN 'CRITICAL' ELSE 'MEDIUM' END,
  CASE WHEN month_of_packing IS NULL THEN 'Rule ''CUSTOM-MONTH'' is not applicable for this product configuration.' WHEN month_of_packing = '13' THEN {FAILURE} || 'month 13' ELSE 'Month is valid.' END
FROM {{products_v}}""")
def udf_1_raising(spark, sf):
    """Two Python rules that raise for some products, one by row and one by batch, beside each other."""

    def price(row):
        if row["mrp"] is None:
            raise TypeError("no mrp")
        if not any(c.isdigit() for c in row["mrp"]):
            raise ValueError(f"no price in {row['mrp']}")
        return V.PASS, "Price found."

    def month(rows):
        if (rows["month_of_packing"] == "13").any():
            raise ValueError("month 13")
        return rows.assign(status=V.PASS, severity="MEDIUM", message="Month is valid.")

    rules = [
        python_rule("CUSTOM-PRICE", "Price", price, ["mrp"], severity="LOW"),
        python_rule("CUSTOM-MONTH", "Month", month, ["monthOfPacking"], by_batch=True, severity="MEDIUM", applicable=lambda: F.col("month_of_packing").isNotNull()),
    ]
    return E.rule_results(view(spark, sf, "products_v"), rules).select("product_id", "rule_id", "status", "severity", "message")


@query("udf_2", """
SELECT product_id, 'CUSTOM-MIN' AS rule_id, 'PASS' AS status, 'HIGH' AS severity, 'general' AS field,
  cast(NULL AS string) AS evidence_value FROM {products_v}""")
def udf_2(spark, sf):
    """A rule with every default: applicable, HIGH, no target field."""
    rule = R.Rule("CUSTOM-MIN", "Minimal", branches=(R.Branch(lambda: F.lit(True), V.PASS, "ok"),))
    return E.rule_results(view(spark, sf, "products_v"), [rule]).select(
        "product_id", "rule_id", "status", "severity", "field", F.col("evidence.value").alias("evidence_value")
    )


@query("sca_17", f"SELECT product_id, {CATEGORY} AS category FROM {{products_v}}")
def sca_17(spark, sf):
    return view(spark, sf, "products_v").select(
        "product_id", quantity_category(F.col("net_quantity")).alias("category")
    )
