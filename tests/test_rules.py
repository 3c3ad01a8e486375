"""Every branch of every rule, the roll-up and the registry."""

import pytest
from pyspark.sql import functions as F

from labelscan.operators import evaluate as E
from labelscan.operators import rules as R

CASES = [
    # rule, product columns, status, severity
    (R.MRP, {}, "FAIL", "CRITICAL"), (R.MRP, {"mrp": " \t\n"}, "FAIL", "CRITICAL"),
    (R.MRP, {"mrp": "MRP on pack"}, "FAIL", "CRITICAL"),
    (R.MRP, {"mrp": "Rs. 250 (Incl. of all taxes)"}, "PASS", "CRITICAL"),
    (R.MRP, {"mrp": "मूल्य २५० सभी करों सहित"}, "PASS", "CRITICAL"),
    (R.MRP, {"mrp": "Rs. 250"}, "MANUAL_REVIEW", "MEDIUM"),
    (R.NET_QUANTITY, {}, "FAIL", "HIGH"), (R.NET_QUANTITY, {"net_quantity": "a few"}, "FAIL", "HIGH"),
    (R.NET_QUANTITY, {"net_quantity": "500 g"}, "PASS", "HIGH"),
    (R.NET_QUANTITY, {"net_quantity": "500ml"}, "MANUAL_REVIEW", "MEDIUM"),
    (R.IMPORTER, {"is_imported": False}, "NOT_APPLICABLE", "CRITICAL"),
    (R.IMPORTER, {}, "MANUAL_REVIEW", "MEDIUM"), (R.IMPORTER, {"is_imported": True}, "FAIL", "CRITICAL"),
    (R.IMPORTER, {"is_imported": True, "importer_name": "A"}, "PASS", "CRITICAL"),
    (R.PRODUCT_NAME, {}, "FAIL", "HIGH"), (R.PRODUCT_NAME, {"product_name": "77"}, "MANUAL_REVIEW", "MEDIUM"),
    (R.PRODUCT_NAME, {"product_name": "Tea"}, "PASS", "HIGH"),
    (R.MAKER_NAME, {"is_imported": True}, "NOT_APPLICABLE", "CRITICAL"),
    (R.MAKER_NAME, {"is_imported": True, "packer_name": " "}, "FAIL", "CRITICAL"),
    (R.MAKER_NAME, {"packer_name": "P"}, "PASS", "CRITICAL"),
    (R.MAKER_ADDRESS, {"is_imported": True}, "NOT_APPLICABLE", "HIGH"),
    (R.MAKER_ADDRESS, {}, "FAIL", "HIGH"),
    (R.MAKER_ADDRESS, {"manufacturer_address": "Noida 201 301"}, "PASS", "HIGH"),
    (R.MAKER_ADDRESS, {"manufacturer_address": "Noida"}, "MANUAL_REVIEW", "MEDIUM"),
    (R.PACKING_DATE, {}, "FAIL", "HIGH"), (R.PACKING_DATE, {"month_of_packing": "07"}, "FAIL", "HIGH"),
    (R.PACKING_DATE, {"month_of_packing": "13", "year_of_packing": "2026"}, "MANUAL_REVIEW", "MEDIUM"),
    (R.PACKING_DATE, {"month_of_packing": "July", "year_of_packing": "202"}, "MANUAL_REVIEW", "MEDIUM"),
    (R.PACKING_DATE, {"month_of_packing": " July ", "year_of_packing": "26"}, "PASS", "HIGH"),
    (R.CONSUMER_CARE, {}, "FAIL", "HIGH"), (R.CONSUMER_CARE, {"consumer_care": "write to us"}, "MANUAL_REVIEW", "MEDIUM"),
    (R.CONSUMER_CARE, {"consumer_care": "Call us"}, "PASS", "HIGH"),
    (R.ORIGIN, {"is_imported": False}, "NOT_APPLICABLE", "CRITICAL"),
    (R.ORIGIN, {"is_imported": True}, "FAIL", "CRITICAL"), (R.ORIGIN, {"country_of_origin": "India"}, "PASS", "CRITICAL"),
    (R.UNIT_PRICE, {}, "NOT_APPLICABLE", "HIGH"), (R.UNIT_PRICE, {"unit_sale_price": "Rs 0.50/g"}, "PASS", "HIGH"),
    (R.UNIT_PRICE, {"unit_sale_price": "ask"}, "MANUAL_REVIEW", "MEDIUM"),
    (R.UNIT_PRICE, {"mrp": "₹ 10 (Rs 0.50/g)"}, "PASS", "HIGH"),
    (R.UNIT_PRICE, {"net_quantity": "100 g"}, "MANUAL_REVIEW", "MEDIUM"),
    (R.EXPIRY, {}, "NOT_APPLICABLE", "HIGH"), (R.EXPIRY, {"product_type": " Food "}, "FAIL", "HIGH"),
    (R.EXPIRY, {"expiry_date": "Best Before 12 Months"}, "PASS", "HIGH"), (R.EXPIRY, {"expiry_date": "soon"}, "MANUAL_REVIEW", "MEDIUM"),
    (R.FONT_HEIGHT, {}, "NOT_APPLICABLE", "HIGH"), (R.FONT_HEIGHT, {"font_size_mm": 0.9}, "FAIL", "HIGH"),
    (R.FONT_HEIGHT, {"font_size_mm": 1.0}, "PASS", "HIGH"),
    (R.PLACEMENT, {}, "NOT_APPLICABLE", "HIGH"), (R.PLACEMENT, {"is_pdp_placement_valid": True}, "PASS", "HIGH"),
    (R.PLACEMENT, {"is_pdp_placement_valid": False, "declaration_placement": "PDP"}, "FAIL", "HIGH"),
    (R.PLACEMENT, {"declaration_placement": "Front panel"}, "PASS", "HIGH"),
    (R.PLACEMENT, {"declaration_placement": "Side"}, "MANUAL_REVIEW", "MEDIUM"),
    (R.READABILITY, {}, "NOT_APPLICABLE", "HIGH"), (R.READABILITY, {"is_legible": False, "contrast_ratio": 9.0}, "FAIL", "HIGH"),
    (R.READABILITY, {"contrast_ratio": 4.5}, "PASS", "HIGH"), (R.READABILITY, {"contrast_ratio": 2.9}, "FAIL", "HIGH"),
    (R.READABILITY, {"contrast_ratio": 3.5}, "MANUAL_REVIEW", "MEDIUM"), (R.READABILITY, {"is_legible": True}, "PASS", "HIGH"),
]
KINDS = {"is_imported": "boolean", "is_pdp_placement_valid": "boolean", "is_legible": "boolean", "font_size_mm": "double", "contrast_ratio": "double"}
COLUMNS = sorted(set(R.PRODUCT_COLUMNS.values()) - {"product_id", "principal_display_area_cm2"})


@pytest.fixture(scope="module")
def products(spark):
    schema = "product_id string, " + ", ".join(f"{c} {KINDS.get(c, 'string')}" for c in COLUMNS)
    rows = [(str(i), *[case[1].get(c) for c in COLUMNS]) for i, case in enumerate(CASES)]
    return spark.createDataFrame(rows, schema)


def test_every_branch(products):
    got = {(r.product_id, r.rule_id): (r.status, r.severity) for r in E.rule_results(products).collect()}
    assert len(got) == 14 * len(CASES)
    wrong = [(c, got[(str(i), c[0].rule_id)]) for i, c in enumerate(CASES) if got[(str(i), c[0].rule_id)] != c[2:]]
    assert not wrong


def test_row_form_equals_long_form(products):
    rows = E.evaluate_products(products)
    long = E.roll_up(E.rule_results(products))
    cols = ["product_id", "passed_rules", "failed_rules", "manual_review_rules", "not_applicable_rules", "overall_status"]
    assert sorted(map(tuple, rows.select(*cols).collect())) == sorted(map(tuple, long.select(*cols).collect()))
    assert rows.filter(F.size("violations") != F.col("failed_rules") + F.col("manual_review_rules")).count() == 0


def test_no_shuffle_in_the_row_form(products):
    plan = E.evaluate_products(products)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_evidence_does_not_change_the_verdict(spark, products):
    made = "map('mrp', named_struct('field','mrp','value','x','source','OCR','confidence',0.99D,'rawAnnotation',cast(null as string)))"
    other = products.withColumn("evidence", F.expr(made))
    a = {tuple(r) for r in E.rule_results(products).select("product_id", "rule_id", "status").collect()}
    b = {tuple(r) for r in E.rule_results(other).select("product_id", "rule_id", "status").collect()}
    assert a == b
    trace = E.decision_trace(E.rule_results(other)).first()
    assert list(trace.evidence_sources) == ["OCR", "STRUCTURED_INPUT"]


def test_registry_and_custom_rules(products):
    registry = R.RuleRegistry()
    first = registry.register(R.Rule("A", "first", branches=(R.Branch(lambda: F.lit(True), "PASS", "ok"),)))
    registry.register(R.Rule("A", "second"))
    assert [r.name for r in registry.all()] == ["first"] and first.severity == "HIGH"
    verdict = lambda: F.struct(F.lit("FAIL").alias("status"), F.lit("LOW").alias("severity"), F.lit("no").alias("message"))
    registry.register(R.Rule("B", "by column", custom=verdict))
    row = E.rule_results(products, registry.all()).filter("rule_id = 'B'").first()
    assert (row.status, row.severity, row.message) == ("FAIL", "LOW", "no")
    registry.clear()
    assert E.evaluate_products(products, registry.all()).filter("overall_status <> 'PASS'").count() == 0


def test_rules_that_raise_fail_their_own_row(spark):
    from labelscan.operators.custom import python_rule

    rows = [(str(i), v) for i, v in enumerate(["10", "x", None, "7", "", "99", "seven"])]
    products = spark.createDataFrame(rows, "product_id string, mrp string")
    calls = lambda row: ("PASS" if int(row["mrp"]) < 50 else "FAIL", "a number", *(["LOW"] if row["mrp"] == "7" else []))

    def batch(frame):
        if frame["mrp"].isna().any():
            raise ValueError("a gap")
        return frame.assign(status="PASS", severity="LOW", message=frame["mrp"])

    suite = [
        python_rule("ROW", "by row", calls, ["mrp"]), python_rule("BATCH", "by batch", batch, ["mrp"], by_batch=True),
        python_rule("ODD", "no status", lambda row: ("MAYBE", "?"), ["mrp"]), python_rule("SHORT", "too few", lambda frame: frame.iloc[:0], ["mrp"], by_batch=True),
        R.Rule("STOCK", "stock", branches=(R.Branch(lambda: F.lit(True), "PASS", "ok"),)),
    ]
    got = {}
    for r in E.rule_results(products.repartition(1), suite).collect():
        got.setdefault(r.rule_id, {})[r.product_id] = (r.status, r.severity, r.message)
    error = "Internal rule execution failure: "
    bad = lambda x: ("FAIL", "CRITICAL", error + x)
    invalid = "invalid literal for int() with base 10: "
    assert {k: v for k, v in got["ROW"].items() if k != "2"} == {
        "0": ("PASS", "HIGH", "a number"), "1": bad(invalid + "'x'"), "3": ("PASS", "LOW", "a number"), "4": bad(invalid + "''"),
        "5": ("FAIL", "HIGH", "a number"), "6": bad(invalid + "'seven'"),
    }
    assert got["ROW"]["2"][:2] == ("FAIL", "CRITICAL") and "NoneType" in got["ROW"]["2"][2]
    assert got["BATCH"] == {i: ("PASS", "LOW", v) if v is not None else bad("a gap") for i, v in rows}
    assert set(got["ODD"].values()) == {bad("no known status: MAYBE")}
    assert set(got["SHORT"].values()) == {bad("0 results for 1 rows")} and set(got["STOCK"].values()) == {("PASS", "HIGH", "ok")}
    overall = {r.product_id: r.overall_status for r in E.evaluate_products(products, suite).collect()}
    assert set(overall.values()) == {"FAIL"}
    assert E.rule_results(products.limit(0), suite).count() == 0


def test_equal_rows_that_raise_are_tried_once():
    """halving a batch costs calls for its distinct rows, not for every row; each row keeps its result."""
    import pandas as pd

    from labelscan.operators import custom as C

    calls = []

    def evaluate(rows):
        calls.append(len(rows))
        if (rows["m"] == "13").any():
            raise ValueError("month 13")
        return pd.DataFrame({"status": "PASS", "severity": "LOW", "message": rows["m"].fillna("none") + rows["x"].astype(str)})

    rows = pd.DataFrame({"m": [None if i % 14 == 0 else str(i % 14) for i in range(2800)], "x": [(0.0, -0.0)[i % 2] for i in range(2800)]})
    found = C._judge(evaluate, rows)
    want = [("FAIL", "CRITICAL", "Internal rule execution failure: month 13") if m == "13" else ("PASS", "LOW", (m or "none") + str(x)) for m, x in zip(rows["m"], rows["x"])]
    assert found == want
    assert len(calls) < 30
    # rows that cannot be compared are halved as they are
    lists = pd.DataFrame({"m": ["13", "1"], "x": [["a"], ["b"]]})
    assert [r[0] for r in C._judge(evaluate, lists)] == ["FAIL", "PASS"]
