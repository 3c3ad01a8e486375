"""Stored scans: predicates, lookups, paging, recent lists and catalogue search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscan.functions import vocab as V
from labelscan.functions.text import contains_any, strip

DEFAULT_ZONE = "Asia/Kolkata"


# --- predicates ------------------------------------------------------------------------
def search_filter(text: str, scans: DataFrame) -> Column:
    """FLT-2: trimmed, case-insensitive substring in name, id, maker or batch."""
    needle = text.strip().lower()
    if not needle:
        return F.lit(True)
    batch = F.col("batch_number")
    if "extracted_batch_number" in scans.columns:
        batch = F.coalesce(F.when(batch != "", batch), F.col("extracted_batch_number"))
    out = F.lit(False)
    for c in (F.col("product_name"), F.col("scan_id"), F.col("manufacturer"), batch):
        out = out | F.lower(F.coalesce(c, F.lit(""))).contains(needle)
    return out


def display_status(status: Column) -> Column:
    return (
        F.when(status == V.COMPLIANT, F.lit("Compliant"))
        .when(status == V.NON_COMPLIANT, F.lit("Non-Compliant"))
        .otherwise(F.lit("Partial"))
    )


def status_filter(wanted: str, status: Column) -> Column:
    """FLT-3: display status, where an unknown status counts as Partial."""
    return F.lit(True) if wanted == "All Status" else display_status(status) == wanted


def local_day(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def date_filter(span: str, ts: Column, now: Column, zone: str = DEFAULT_ZONE) -> Column:
    """FLT-4: ``All Time``, ``Today``, ``Last 7 Days`` or ``Last 30 Days`` before ``now``."""
    if span == "Today":
        return F.coalesce(local_day(ts, zone) == local_day(now, zone), F.lit(False))
    days = {"Last 7 Days": 7, "Last 30 Days": 30}.get(span)
    if days is None:
        return F.lit(True) if span == "All Time" else ts.isNotNull()
    # a plain range on the stored column, so it reaches the file scan
    return F.coalesce(
        (ts <= now) & (ts >= now - F.make_dt_interval(F.lit(days))), F.lit(False)
    )


def of_user(scans: DataFrame, user_id: str | None) -> DataFrame:
    """FLT-5: rows of one user (all rows when no user is given)."""
    return scans if not user_id else scans.filter(F.col("user_id") == user_id)


def get_scan(scans: DataFrame, scan_id: str, user_id: str | None = None) -> DataFrame:
    """FLT-6: point lookup; another user's scan is simply not found."""
    return of_user(scans.filter(F.col("scan_id") == scan_id), user_id)


def is_problem(status: Column) -> Column:
    """FLT-8."""
    return status.isin(V.NON_COMPLIANT, V.PARTIAL)


def search_rules(rules: DataFrame, text: str = "", category: str = "All Rules") -> DataFrame:
    """FLT-7: substring in title, id, description, target field or severity, and category."""
    needle = text.lower()
    hit = F.lit(False)
    for c in ("title", "rule_id", "description", "target_field", "severity"):
        hit = hit | F.lower(F.col(c)).contains(needle)
    out = rules.filter(hit)
    return out if category == "All Rules" else out.filter(F.col("category") == category)


def sort_rules(rules: DataFrame, newest_first: bool = True) -> DataFrame:
    """SRT-6: by update time (text that is no date sorts last), ties by rule id."""
    at = F.try_to_timestamp(F.col("updated"))
    key = at.desc_nulls_last() if newest_first else at.asc_nulls_last()
    return rules.orderBy(key, "rule_id")


# --- joins with users ---------------------------------------------------------------------
def scans_of_active_users(scans: DataFrame, users: DataFrame) -> DataFrame:
    """JN-9: scans whose user exists and is active."""
    return scans.join(users.filter("is_active").select("user_id"), "user_id", "left_semi")


def orphan_scans(scans: DataFrame, users: DataFrame) -> DataFrame:
    """JN-9 complement: scans of unknown or inactive users."""
    return scans.join(users.filter("is_active").select("user_id"), "user_id", "left_anti")


# --- lists -----------------------------------------------------------------------------------
def latest_first() -> list[Column]:
    """Order of the listing: newest first, ties by scan id."""
    return [F.col("ts").desc(), F.col("scan_id")]


def page(scans: DataFrame, user_id: str | None = None, page: int = 1, limit: int = 20) -> DataFrame:
    """SRT-1: one page, newest first; ties by scan id. ``limit`` must be 1 to 100, ``page`` 1 or more."""
    if not 1 <= limit <= 100 or page < 1:
        raise ValueError("limit must be 1 to 100 and page 1 or more")
    return of_user(scans, user_id).orderBy(*latest_first()).offset((page - 1) * limit).limit(limit)


def numbered_page(
    scans: DataFrame, user_id: str | None = None, page_no: int = 1, limit: int = 20
) -> DataFrame:
    """WIN-9: a page with the running row number of the whole listing.

    The page has at most 100 rows, so the ordering window sees only those.
    """
    rows = page(scans, user_id, page_no, limit)
    number = F.row_number().over(Window.orderBy(*latest_first())) + F.lit((page_no - 1) * limit)
    return rows.withColumn("row_number", number)


def page_info(scans: DataFrame, user_id: str | None, page: int, limit: int) -> DataFrame:
    """SRT-2: total, pages and first/last row shown."""
    total = F.col("total")
    return (
        of_user(scans, user_id).agg(F.count(F.lit(1)).alias("total"))
        .select(
            "total",
            F.greatest(F.lit(1), F.ceil(total / F.lit(limit))).cast("bigint").alias("total_pages"),
            F.when(total == 0, F.lit(0)).otherwise(F.lit((page - 1) * limit + 1)).cast("bigint")
            .alias("first_row"),
            F.least(F.lit(page * limit), total).cast("bigint").alias("last_row"),
        )
    )


def recent(scans: DataFrame, n: int = 5) -> DataFrame:
    """SRT-3: the newest ``n`` scans."""
    return scans.orderBy(*latest_first()).limit(n)


def notifications(scans: DataFrame, window: int = 20, n: int = 5) -> DataFrame:
    """SRT-4: problem scans among the newest ``window``, at most ``n``."""
    newest = scans.orderBy(*latest_first()).limit(window)
    return newest.filter(is_problem(F.col("compliance_status"))).orderBy(*latest_first()).limit(n)


def latest_per_user(scans: DataFrame, k: int) -> DataFrame:
    """WIN-8: newest ``k`` scans of every user.

    The rank filter becomes a per-partition group limit before the shuffle, so a
    user with a third of all scans ships at most ``k`` rows per input partition.
    """
    w = Window.partitionBy("user_id").orderBy(*latest_first())
    return scans.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def count_scans(scans: DataFrame, by_user: bool = False) -> DataFrame:
    """AGG-17: number of scans, overall or per user."""
    grouped = scans.groupBy("user_id") if by_user else scans.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("scans"))


# --- display ----------------------------------------------------------------------------------
def scan_time(raw: Column) -> Column:
    """SCA-23: ISO text (zone-less means UTC) to a timestamp; null when unreadable."""
    text = strip(raw)
    zoned = text.rlike(r"(?:Z|[+-]\d{2}:\d{2})$")
    return F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))


def display_rows(scans: DataFrame, zone: str = DEFAULT_ZONE) -> DataFrame:
    """PRJ-7: labels, short ids, local date and time, default product name."""
    status, local = F.col("compliance_status"), F.from_utc_timestamp("ts", zone)
    history = display_status(status)
    report = (
        F.when(status == V.COMPLIANT, F.lit("Passed")).when(status == V.NON_COMPLIANT, F.lit("Failed"))
        .otherwise(F.lit("Warning"))
    )
    dashboard = (
        F.when(status == V.COMPLIANT, F.lit("Compliant"))
        .when(status == V.NON_COMPLIANT, F.lit("Non-Compliant")).otherwise(F.lit("Under Review"))
    )
    score_text = (
        F.when(status == V.COMPLIANT, F.lit("100/100")).when(status == V.NON_COMPLIANT, F.lit("FAIL"))
        .otherwise(F.lit("REVIEW"))
    )
    name = F.col("product_name")
    return scans.select(
        "scan_id", history.alias("history_status"), report.alias("report_status"),
        dashboard.alias("dashboard_status"), score_text.alias("score_text"),
        F.concat(F.lit("Scan #"), F.substring("scan_id", 1, 8)).alias("history_id"),
        F.concat(F.lit("INS-"), F.upper(F.substring("scan_id", 1, 8))).alias("report_id"),
        F.concat(F.lit("LMC-"), F.upper(F.substring("scan_id", 1, 5))).alias("dashboard_id"),
        F.coalesce(F.date_format(local, "MMM d, yyyy"), F.lit("N/A")).alias("local_date"),
        F.coalesce(F.date_format(local, "hh:mm a"), F.lit("N/A")).alias("local_time"),
        F.coalesce(F.when(name != "", name), F.lit("Unknown Product")).alias("product"),
    )


def font_display(mm: Column, px: Column) -> Column:
    """PRJ-8: millimetres if known, else the pixel range, else "Not Detected"."""
    relative = F.concat(
        F.lit("Relative: "), px["smallest"].cast("string"), F.lit("-"), px["largest"].cast("string"),
        F.lit(" px (median "), px["median"].cast("string"), F.lit("), no mm calibration"),
    )
    return (
        F.when(mm.isNotNull(), F.concat(F.lit("≈ "), mm.cast("string"), F.lit(" mm")))
        .when(px.isNotNull(), relative).otherwise(F.lit("Not Detected"))
    )


def quality_class(blur: Column, brightness: Column) -> Column:
    """PRJ-9: UNREADABLE, POOR or ACCEPTABLE from blur and brightness."""
    return (
        F.when((blur < 25) | (brightness < 25) | (brightness > 240), F.lit("UNREADABLE"))
        .when((blur < 100) | (brightness < 60) | (brightness > 200), F.lit("POOR"))
        .otherwise(F.lit("ACCEPTABLE"))
    )


def image_quality(metrics: DataFrame) -> DataFrame:
    """PRJ-9 over a metrics table."""
    blur, bright = F.col("blur_score"), F.col("brightness")
    return metrics.select(
        "image_id", F.round(blur, 2).alias("blur_score"), (blur < 100).alias("is_blurry"),
        F.round(bright, 2).alias("brightness"), quality_class(blur, bright).alias("quality_status"),
    )
