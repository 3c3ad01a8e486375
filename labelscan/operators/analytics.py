"""Reports over stored scans: status shares, scores, trends, offenders, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscan.functions import vocab as V
from labelscan.operators.scans import DEFAULT_ZONE, local_day


def share(part: Column, whole: Column) -> Column:
    """Percentage to one decimal; 0.0 when the population is empty."""
    return F.coalesce(F.round(F.try_divide(part * F.lit(100.0), whole), 1), F.lit(0.0))


def status_kpis(scans: DataFrame, review: str = "partial", by: list[str] | None = None) -> DataFrame:
    """AGG-11: counts and percentages.

    ``review`` is ``"partial"`` (only PARTIAL) or ``"rest"`` (everything that is
    neither compliant nor non-compliant).  Pass a page or a latest-n DataFrame to
    get the figures of that population.  With ``by`` the result is a rollup, so
    one pass gives the overall row (null keys) and the groups.
    """
    s = F.col("compliance_status")
    known = s.isin(V.COMPLIANT, V.NON_COMPLIANT)
    is_review = (s == V.PARTIAL) if review == "partial" else ~F.coalesce(known, F.lit(False))
    grouped = scans.rollup(*by) if by else scans.groupBy()
    counted = grouped.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s == V.COMPLIANT).alias("passed"),
        F.count_if(s == V.NON_COMPLIANT).alias("failed"),
        F.count_if(is_review).alias("review"),
    )
    total = F.col("total")
    return counted.select(
        "*", share(F.col("passed"), total).alias("passed_pct"),
        share(F.col("failed"), total).alias("failed_pct"),
        share(F.col("review"), total).alias("review_pct"),
    )


def scan_score(status: Column, n_violations: Column) -> Column:
    """AGG-12: 100, or a penalty per violation with a floor."""
    full = F.lit(V.SCORE_FULL)
    return (
        F.when(status == V.COMPLIANT, full)
        .when(status == V.NON_COMPLIANT,
              F.greatest(F.lit(V.SCORE_FAIL_FLOOR), full - n_violations * V.SCORE_FAIL_STEP))
        .otherwise(F.greatest(F.lit(V.SCORE_WARN_FLOOR), full - n_violations * V.SCORE_WARN_STEP))
    )


def average_score(scored: DataFrame) -> DataFrame:
    """AGG-12: mean score to one decimal (0.0 without scans)."""
    score = scan_score(F.col("compliance_status"), F.col("n_violations"))
    return scored.agg(
        F.count(F.lit(1)).alias("scans"),
        F.coalesce(F.round(F.avg(score), 1), F.lit(0.0)).alias("avg_score"),
    )


def violation_category(field: Column) -> Column:
    """AGG-13: category of one violation by its field name."""
    f = F.lower(F.coalesce(field, F.lit("")))
    return (
        F.when(f.contains("mrp"), F.lit("Incorrect MRP"))
        .when(f.contains("netquantity") | f.contains("net_quantity"), F.lit("Net Quantity Issues"))
        .when(f.contains("readability") | f.contains("font") | f.contains("size"),
              F.lit("Readability Issues"))
        .otherwise(F.lit("Missing Declarations"))
    )


def violation_categories(violations: DataFrame) -> DataFrame:
    """AGG-13: number of violations per category."""
    return violations.groupBy(violation_category(F.col("field")).alias("category")).agg(
        F.count(F.lit(1)).alias("violations")
    )


def top_offenders(scored: DataFrame, k: int = 4) -> DataFrame:
    """AGG-14: products with most violations among scans that are not compliant.

    A scan without violations counts one; ties by name.  Groups are pre-aggregated
    before the shuffle and only ``k`` rows leave each partition of the sort.
    """
    name = F.col("product_name")
    if "extracted_product_name" in scored.columns:
        other = F.col("extracted_product_name")
        name = F.coalesce(F.when(name != "", name), F.when(other != "", other))
    named = F.coalesce(F.when(name != "", name), F.lit(V.NO_PRODUCT))
    status, n = F.col("compliance_status"), F.col("n_violations")
    not_ok = F.coalesce(status != V.COMPLIANT, F.lit(True))
    return (
        scored.filter(not_ok).groupBy(named.alias("name"))
        .agg(
            F.sum(F.greatest(n, F.lit(1))).alias("violations"),
            F.round(F.avg(scan_score(status, n)), 0).cast("bigint").alias("score"),
            F.count(F.lit(1)).alias("scans"),
        )
        .orderBy(F.col("violations").desc(), "name").limit(k)
    )


def day_spine(spark, now: str, days: int = 7, zone: str = DEFAULT_ZONE) -> DataFrame:
    """JN-10: the last ``days`` local days up to ``now`` (a UTC timestamp text)."""
    today = local_day(F.lit(now).cast("timestamp"), zone)
    return spark.range(1).select(
        F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day")
    )


def daily_counts(scans: DataFrame, zone: str = DEFAULT_ZONE) -> DataFrame:
    s = F.col("compliance_status")
    return (
        scans.filter(F.col("ts").isNotNull()).groupBy(local_day(F.col("ts"), zone).alias("day"))
        .agg(
            F.count_if(s == V.COMPLIANT).alias("passed"),
            F.count_if(s == V.NON_COMPLIANT).alias("failed"),
            F.count_if(~F.coalesce(s.isin(V.COMPLIANT, V.NON_COMPLIANT), F.lit(False))).alias("warning"),
        )
    )


def rolling_trend(scans: DataFrame, now: str, days: int = 7, zone: str = DEFAULT_ZONE) -> DataFrame:
    """AGG-15: zero-filled daily counts of the last ``days`` local days."""
    end = F.lit(now).cast("timestamp")
    first = F.date_sub(local_day(end, zone), days - 1)
    # a coarse range on the stored column prunes files before the exact day match
    recent = scans.filter(F.col("ts") >= F.to_utc_timestamp(first.cast("timestamp"), zone))
    spine = day_spine(scans.sparkSession, now, days, zone)
    # the spine has `days` rows, so it is the side to broadcast; outer on it
    counts = daily_counts(recent, zone).join(F.broadcast(spine), "day", "left_semi")
    filled = spine.join(counts, "day", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return filled.select(
        "day", F.date_format("day", "EEE").alias("day_name"), zero("passed"), zero("failed"),
        zero("warning"),
    )


def trend_bound(trend: DataFrame) -> DataFrame:
    """AGG-16: axis bound max(5, largest day)."""
    total = F.col("passed") + F.col("failed") + F.col("warning")
    return trend.agg(F.greatest(F.lit(5).cast("bigint"), F.max(total)).alias("max_total"))


# --- report rows ---------------------------------------------------------------------------
# fixed values: labels, columns and defaults of the per-scan report
REPORT_LINES = [
    ("Product Name", "product_name", "Not available"),
    ("Manufacturer", "manufacturer", "Not available"),
    ("Manufacturer Address", "manufacturer_address", "Not available"),
    ("Net Quantity", "net_quantity", "Not available"),
    ("MRP", "mrp", "Not available"),
    ("Batch Number", "batch_number", "Not available"),
    ("Mfg Date", "mfg_date", "Not available"),
    ("Consumer Care", "consumer_care", "Not available"),
    ("Country of Origin", "country_of_origin", "Not Detected"),
    ("Importer Name", "importer_name", "Not Detected"),
    ("Expiry Date", "expiry_date", "Not Detected"),
    ("Unit Sale Price", "unit_sale_price", "Not Detected"),
    ("Font Size", "font_size_text", "Not Detected"),
]


def scan_report(scans: DataFrame) -> DataFrame:
    """SRC-8: product lines and verdict of every scan as ``(scan_id, ord, label, value)``."""
    have = set(scans.columns)
    lines = []
    for i, (label, column, default) in enumerate(REPORT_LINES, start=1):
        value = F.col(column).cast("string") if column in have else F.lit(None).cast("string")
        lines.append(
            F.struct(
                F.lit(i).alias("ord"), F.lit(label).alias("label"),
                F.coalesce(F.when(value != "", value), F.lit(default)).alias("value"),
            )
        )
    status = F.col("compliance_status")
    verdict = F.upper(F.coalesce(F.when(status != "", status), F.lit("Not available")))
    lines.append(
        F.struct(
            F.lit(len(REPORT_LINES) + 1).alias("ord"), F.lit("Compliance Verdict").alias("label"),
            verdict.alias("value"),
        )
    )
    return scans.select("scan_id", F.explode_outer(F.array(*lines)).alias("l")).select("scan_id", "l.*")


def violation_report(scans: DataFrame) -> DataFrame:
    """SRC-8: numbered violation lines; one fixed line when there are none."""
    none = F.struct(
        F.lit(1).alias("number"), F.lit("No violations detected.").alias("title"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("field"),
    )
    text = lambda c: F.coalesce(F.when(c != "", c), F.lit("Not available"))
    made = F.transform(
        "violations",
        lambda v, i: F.struct(
            (i + 1).alias("number"),
            F.concat((i + 1).cast("string"), F.lit(". "), text(v["rule"])).alias("title"),
            text(v["description"]).alias("description"), F.nullif(v["field"], F.lit("")).alias("field"),
        ),
    )
    lines = F.when(F.coalesce(F.size("violations"), F.lit(0)) > 0, made).otherwise(F.array(none))
    return scans.select("scan_id", F.explode_outer(lines).alias("v")).select("scan_id", "v.*")


def analytics_report(scored: DataFrame, top: int = 5) -> DataFrame:
    """SRC-9: totals, breakdown, mean score and top products as one table."""
    s = F.col("compliance_status")
    score = scan_score(s, F.col("n_violations"))
    totals = scored.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == V.COMPLIANT).alias("passed"),
        F.count_if(s == V.PARTIAL).alias("warnings"), F.count_if(s == V.NON_COMPLIANT).alias("failed"),
        F.coalesce(F.round(F.avg(score), 1), F.lit(0.0)).alias("avg_score"),
    )
    n, total = lambda c: F.col(c).cast("double"), F.col("total")
    none = F.lit(None).cast("double")
    row = lambda section, label, value, pct: F.struct(
        F.lit(section).alias("section"), F.lit(label).alias("label"), value.alias("value"), pct.alias("pct")
    )
    head = totals.select(
        F.explode_outer(
            F.array(
                row("summary", "Total", n("total"), none),
                row("summary", "Average score", F.col("avg_score"), none),
                row("breakdown", "Passed", n("passed"), share(F.col("passed"), total)),
                row("breakdown", "Warnings", n("warnings"), share(F.col("warnings"), total)),
                row("breakdown", "Failed", n("failed"), share(F.col("failed"), total)),
            )
        ).alias("r")
    ).select("r.*")
    tops = top_offenders(scored, top).select(
        F.lit("top products").alias("section"), F.col("name").alias("label"),
        F.col("violations").cast("double").alias("value"), none.alias("pct"),
    )
    return head.unionByName(tops)
