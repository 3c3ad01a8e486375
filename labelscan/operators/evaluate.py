"""Rule suite over a product table: row-level results, roll-up and violations.

Everything is a projection on the product row (arrays of structs), so the same
functions serve batch and streaming input and never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscan.functions import vocab as V
from labelscan.operators.rules import ALL_RULES, PRODUCT_COLUMNS, Rule, Suite

EVIDENCE_TYPE = (
    "struct<field:string,value:string,source:string,confidence:double,rawAnnotation:string>"
)


def _target_values(suite: Suite, columns: list[str]) -> Column:
    """``array<string>``: the value of every rule's target field."""
    out = []
    for r in suite.rules:
        source = PRODUCT_COLUMNS.get(r.target or "")
        known = source in columns
        out.append(F.col(source).cast("string") if known else F.lit(None).cast("string"))
    return F.array(*out)


def _evidence(suite: Suite, columns: list[str], pos: Column) -> Column:
    """JN-3: supplied evidence of the target field, else a synthesised one."""
    target = suite.of_rule(lambda r: r.target or "general", pos)
    made = F.struct(
        target.alias("field"), F.element_at(F.col("target_values"), pos + 1).alias("value"),
        F.lit("STRUCTURED_INPUT").alias("source"), F.lit(1.0).alias("confidence"),
        F.lit(None).cast("string").alias("rawAnnotation"),
    )
    if "evidence" not in columns:
        return made
    supplied = F.try_element_at(F.col("evidence"), target).cast(EVIDENCE_TYPE)
    return F.coalesce(supplied, made.cast(EVIDENCE_TYPE))


def _complete(products: DataFrame) -> DataFrame:
    """Add product columns that the input lacks, as typed nulls."""
    types = {
        "is_imported": "boolean", "is_pdp_placement_valid": "boolean", "is_legible": "boolean",
        "font_size_mm": "double", "contrast_ratio": "double", "principal_display_area_cm2": "double",
    }
    missing = [c for c in PRODUCT_COLUMNS.values() if c not in products.columns]
    return products.select(
        "*", *[F.lit(None).cast(types.get(c, "string")).alias(c) for c in missing]
    )


def _coded(products: DataFrame, suite: Suite) -> tuple[DataFrame, list[str]]:
    full = _complete(products)
    names = full.columns
    # custom results once per product, ahead of anything that repeats its rows or walks its codes
    return full.select(
        "*", suite.codes().alias("codes"), _target_values(suite, names).alias("target_values"), *suite.custom_columns()
    ), names


def with_results(products: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """RUL-15 (row level): add ``results array<struct>``, one entry per rule in order."""
    suite = Suite(ALL_RULES if rules is None else rules)
    coded, names = _coded(products, suite)
    results = F.transform(
        "codes",
        lambda code, pos: F.struct(
            (pos + 1).alias("rule_ord"),
            suite.of_rule(lambda r: r.rule_id, pos).alias("rule_id"),
            suite.of_rule(lambda r: r.name, pos).alias("rule_name"),
            suite.status(code).alias("status"), suite.severity(code).alias("severity"),
            suite.message(code).alias("message"),
            suite.of_rule(lambda r: r.target or "general", pos).alias("field"),
            _evidence(suite, names, pos).alias("evidence"),
        ),
    )
    return coded.select(*names, results.alias("results"))


def rule_results(
    products: DataFrame, rules: list[Rule] | None = None, keep: tuple[str, ...] = ("product_id",)
) -> DataFrame:
    """JN-1: every product with every rule, as long rows (one ``posexplode``)."""
    suite = Suite(ALL_RULES if rules is None else rules)
    coded, names = _coded(products, suite)
    # the outer form adds no "array is not empty" filter, whose constraints would be
    # propagated through every column of the product table while planning
    long = coded.select("*", F.posexplode_outer("codes").alias("pos", "code"))
    pos, code = F.col("pos"), F.col("code")
    return long.select(
        *keep, (pos + 1).alias("rule_ord"),
        suite.of_rule(lambda r: r.rule_id, pos).alias("rule_id"),
        suite.of_rule(lambda r: r.name, pos).alias("rule_name"),
        suite.status(code).alias("status"), suite.severity(code).alias("severity"),
        suite.message(code).alias("message"),
        suite.of_rule(lambda r: r.target or "general", pos).alias("field"),
        _evidence(suite, names, pos).alias("evidence"),
    )


def status_of_counts(n_pass: Column, n_fail: Column, n_review: Column, n_skip: Column) -> Column:
    """Precedence FAIL > MANUAL_REVIEW > PASS > NOT_APPLICABLE; no rules at all is PASS."""
    return (
        F.when(n_fail > 0, F.lit(V.FAIL))
        .when(n_review > 0, F.lit(V.MANUAL_REVIEW))
        .when(n_pass > 0, F.lit(V.PASS))
        .when(n_skip > 0, F.lit(V.NOT_APPLICABLE))
        .otherwise(F.lit(V.PASS))
    )


def roll_up(results: DataFrame, by: list[str] | str = "product_id") -> DataFrame:
    """AGG-1 over long rule results: counts per status and the overall status."""
    by = [by] if isinstance(by, str) else by
    n = lambda s: F.count_if(F.col("status") == s)
    return (
        results.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("total_rules"),
            n(V.PASS).alias("passed_rules"), n(V.FAIL).alias("failed_rules"),
            n(V.MANUAL_REVIEW).alias("manual_review_rules"),
            n(V.NOT_APPLICABLE).alias("not_applicable_rules"),
        )
        .withColumn(
            "overall_status",
            status_of_counts(
                F.col("passed_rules"), F.col("failed_rules"), F.col("manual_review_rules"),
                F.col("not_applicable_rules"),
            ),
        )
    )


def decision_trace(results: DataFrame, by: str = "product_id") -> DataFrame:
    """AGG-2: status counts with the distinct evidence sources (at most five)."""
    return results.groupBy(by).agg(
        F.count_if(F.col("status") == V.PASS).alias("pass"),
        F.count_if(F.col("status") == V.FAIL).alias("fail"),
        F.count_if(F.col("status") == V.MANUAL_REVIEW).alias("manual_review"),
        F.count_if(F.col("status") == V.NOT_APPLICABLE).alias("not_applicable"),
        F.array_sort(F.collect_set("evidence.source")).alias("evidence_sources"),
    )


def remediation_table(spark, rules: list[Rule] | None = None) -> DataFrame:
    """Rule dimension: one short row per rule, so its size is fixed by the code."""
    rules = ALL_RULES if rules is None else rules
    rows = [
        (i, r.rule_id, r.name, r.severity, r.target or "general", r.hint)
        for i, r in enumerate(rules, start=1)
    ]
    return spark.createDataFrame(
        rows, "rule_ord int, rule_id string, rule_name string, severity string, field string, hint string"
    )


def remediation(rule_id: Column, hint: Column) -> Column:
    return F.coalesce(
        F.when(hint != "", hint),
        F.concat(F.lit("Review and rectify statutory declaration for rule "), rule_id, F.lit(".")),
    )


def with_remediation(results: DataFrame, dimension: DataFrame) -> DataFrame:
    """JN-2: left join to the rule dimension (a constant handful of rows) with a default."""
    dim = dimension.select("rule_id", "hint")
    return (
        results.join(F.broadcast(dim), "rule_id", "left")
        .withColumn("remediation", remediation(F.col("rule_id"), F.col("hint")))
        .drop("hint")
    )


def violations(results: DataFrame, dimension: DataFrame) -> DataFrame:
    """AGG-3: failed and to-be-reviewed results with their remediation, long form."""
    bad = results.filter(F.col("status").isin(V.FAIL, V.MANUAL_REVIEW))
    return with_remediation(bad, dimension)


def evaluate_products(products: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """RUL-15: one row per product with counts, verdict, trace and violations.

    Works on the row's own ``results`` array: no shuffle, valid on streams.
    """
    rules = ALL_RULES if rules is None else rules
    base = with_results(products, rules)
    if not rules:
        zero = F.lit(0)
        return base.select(
            "product_id", F.lit(V.PASS).alias("overall_status"), zero.alias("total_rules"),
            zero.alias("passed_rules"), zero.alias("failed_rules"),
            zero.alias("manual_review_rules"), zero.alias("not_applicable_rules"),
        )
    hints = {r.rule_id: r.hint for r in rules if r.hint}
    hint_map = F.create_map(*[F.lit(x) for kv in hints.items() for x in kv]) if hints else F.create_map()

    def count(status):
        return F.size(F.filter("results", lambda r: r["status"] == status))

    bad = F.transform(
        F.filter("results", lambda r: r["status"].isin(V.FAIL, V.MANUAL_REVIEW)),
        lambda r: F.struct(
            r["rule_id"].alias("rule_id"), r["rule_name"].alias("rule_name"),
            r["severity"].alias("severity"), r["message"].alias("message"),
            r["field"].alias("field"),
            remediation(r["rule_id"], F.try_element_at(hint_map, r["rule_id"])).alias("remediation"),
        ),
    )
    counted = base.select(
        *base.columns,
        count(V.PASS).alias("passed_rules"), count(V.FAIL).alias("failed_rules"),
        count(V.MANUAL_REVIEW).alias("manual_review_rules"),
        count(V.NOT_APPLICABLE).alias("not_applicable_rules"),
        F.size("results").alias("total_rules"), bad.alias("violations"),
        F.array_sort(F.array_distinct(F.transform("results", lambda r: r["evidence"]["source"])))
        .alias("evidence_sources"),
    )
    return counted.withColumn(
        "overall_status",
        status_of_counts(
            F.col("passed_rules"), F.col("failed_rules"), F.col("manual_review_rules"),
            F.col("not_applicable_rules"),
        ),
    )
