"""Queries over stored scans: filters, paging, users, ingest and report rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscan.operators import analytics as A
from labelscan.operators import scans as S
from labelscan.plans.registry import query
from labelscan.plans.views import sql_on, table, view
from labelscan.session import checkpoint_folder
from labelscan.sources.scan_table import ScanTable

NOW = "2001-08-02 00:00:00"
DISPLAY = "CASE compliance_status WHEN 'COMPLIANT' THEN 'Compliant' WHEN 'NON_COMPLIANT' THEN 'Non-Compliant' ELSE 'Partial' END"
LOCAL = "(ts + INTERVAL 330 MINUTE)"


@query("flt_2", """
SELECT scan_id, product_name, manufacturer, batch_number FROM {scans_v}
WHERE contains(lower(coalesce(product_name, '')), 'ring') OR contains(lower(scan_id), 'ring')
  OR contains(lower(coalesce(manufacturer, '')), 'ring') OR contains(lower(coalesce(batch_number, '')), 'ring')
UNION ALL
SELECT scan_id, product_name, manufacturer, batch_number FROM {scans_v}
WHERE contains(lower(coalesce(product_name, '')), 'b12') OR contains(lower(scan_id), 'b12')
  OR contains(lower(coalesce(manufacturer, '')), 'b12') OR contains(lower(coalesce(batch_number, '')), 'b12')""")
def flt_2(spark, sf):
    scans = view(spark, sf, "scans_v")
    cols = ["scan_id", "product_name", "manufacturer", "batch_number"]
    one = scans.filter(S.search_filter("  RING ", scans)).select(*cols)
    return one.unionByName(scans.filter(S.search_filter("b12", scans)).select(*cols))


@query("flt_3", f"SELECT scan_id, {DISPLAY} AS display FROM {{scan_core_v}} WHERE {DISPLAY} = 'Partial'")
def flt_3(spark, sf):
    status = F.col("compliance_status")
    return view(spark, sf, "scan_core_v").filter(S.status_filter("Partial", status)).select(
        "scan_id", S.display_status(status).alias("display")
    )


@query("flt_4", f"""
SELECT scan_id, 'Today' AS span FROM {{scan_core_v}} WHERE cast({LOCAL} AS date) = cast(timestamp '2001-08-01 20:00:00' + INTERVAL 330 MINUTE AS date)
UNION ALL SELECT scan_id, 'Last 7 Days' FROM {{scan_core_v}} WHERE ts <= timestamp '2001-08-02 00:00:00' AND ts >= timestamp '2001-07-26 00:00:00'
UNION ALL SELECT scan_id, 'Last 30 Days' FROM {{scan_core_v}} WHERE ts <= timestamp '2001-08-02 00:00:00' AND ts >= timestamp '2001-07-03 00:00:00'""")
def flt_4(spark, sf):
    scans = view(spark, sf, "scan_core_v")
    now = F.lit(NOW).cast("timestamp")
    evening = F.lit("2001-08-01 20:00:00").cast("timestamp")
    pick = lambda span, at: scans.filter(S.date_filter(span, F.col("ts"), at)).select(
        "scan_id", F.lit(span).alias("span")
    )
    return pick("Today", evening).unionByName(pick("Last 7 Days", now)).unionByName(pick("Last 30 Days", now))


@query("flt_5", "SELECT scan_id, user_id FROM {scan_core_v} WHERE user_id = '899'")
def flt_5(spark, sf):
    return S.of_user(view(spark, sf, "scan_core_v"), "899").select("scan_id", "user_id")


@query("flt_6", """
SELECT scan_id, user_id, compliance_status FROM {scan_core_v} WHERE scan_id = 'scan-42'
UNION ALL SELECT scan_id, user_id, compliance_status FROM {scan_core_v} WHERE scan_id = 'scan-0' AND user_id = 'nobody'""")
def flt_6(spark, sf):
    scans = view(spark, sf, "scan_core_v").select("scan_id", "user_id", "compliance_status")
    return S.get_scan(scans, "scan-42").unionByName(S.get_scan(scans, "scan-0", "nobody"))


@query("flt_8", "SELECT scan_id, compliance_status FROM {scan_core_v} WHERE compliance_status IN ('NON_COMPLIANT', 'PARTIAL')")
def flt_8(spark, sf):
    return view(spark, sf, "scan_core_v").filter(S.is_problem(F.col("compliance_status"))).select(
        "scan_id", "compliance_status"
    )


@query("srt_1", """
SELECT scan_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM {scan_core_v}
ORDER BY ts DESC, scan_id LIMIT 20 OFFSET 20""")
def srt_1(spark, sf):
    return S.page(view(spark, sf, "scan_core_v"), page=2, limit=20).select(
        "scan_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")
    )


@query("srt_2", """
SELECT count(*) AS total, cast(greatest(1, ceil(count(*) / 20.0)) AS bigint) AS total_pages,
  cast(CASE WHEN count(*) = 0 THEN 0 ELSE 41 END AS bigint) AS first_row, cast(least(60, count(*)) AS bigint) AS last_row
FROM {scan_core_v}""")
def srt_2(spark, sf):
    return S.page_info(view(spark, sf, "scan_core_v"), None, page=3, limit=20)


SCORE = """CASE compliance_status WHEN 'COMPLIANT' THEN 100 WHEN 'NON_COMPLIANT' THEN greatest(10, 100 - n_violations * 25)
  ELSE greatest(30, 100 - n_violations * 15) END"""


@query("srt_3", f"SELECT scan_id, coalesce(product_name, 'Unknown Product') AS product, cast({SCORE} AS bigint) AS score FROM {{scored_scans_v}} ORDER BY ts DESC, scan_id LIMIT 5")
def srt_3(spark, sf):
    scans = view(spark, sf, "scored_scans_v")
    return S.recent(scans).select(
        "scan_id", F.coalesce("product_name", F.lit("Unknown Product")).alias("product"),
        A.scan_score(F.col("compliance_status"), F.col("n_violations")).alias("score"),
    )


@query("srt_4", """
SELECT scan_id, compliance_status FROM (SELECT * FROM {scan_core_v} ORDER BY ts DESC, scan_id LIMIT 20) t
WHERE compliance_status IN ('NON_COMPLIANT', 'PARTIAL') ORDER BY ts DESC, scan_id LIMIT 5""")
def srt_4(spark, sf):
    return S.notifications(view(spark, sf, "scan_core_v")).select("scan_id", "compliance_status")


@query("win_8", """
SELECT user_id, scan_id, cast(rn AS int) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, scan_id) AS rn
  FROM {scan_core_v}) t WHERE rn <= 3""")
def win_8(spark, sf):
    return S.latest_per_user(view(spark, sf, "scan_core_v"), 3).select("user_id", "scan_id", "rank")


@query("win_9", """
SELECT scan_id, cast(rn AS int) AS row_number FROM (SELECT scan_id, row_number() OVER (ORDER BY ts DESC, scan_id) AS rn FROM {scan_core_v}) t
WHERE rn BETWEEN 21 AND 40""")
def win_9(spark, sf):
    return S.numbered_page(view(spark, sf, "scan_core_v"), None, 2, 20).select("scan_id", "row_number")


@query("jn_9", """
SELECT scan_id, user_id, 'active' AS kind FROM {scan_core_v} WHERE user_id IN (SELECT user_id FROM {users_v} WHERE is_active)
UNION ALL SELECT scan_id, user_id, 'orphan' FROM {scan_core_v} WHERE user_id NOT IN (SELECT user_id FROM {users_v} WHERE is_active)""")
def jn_9(spark, sf):
    scans, users = view(spark, sf, "scan_core_v").select("scan_id", "user_id"), view(spark, sf, "users_v")
    active = S.scans_of_active_users(scans, users).select("scan_id", "user_id", F.lit("active").alias("kind"))
    return active.unionByName(
        S.orphan_scans(scans, users).select("scan_id", "user_id", F.lit("orphan").alias("kind"))
    )


@query("agg_17", """
SELECT user_id, count(*) AS scans FROM {scan_core_v} GROUP BY user_id
UNION ALL SELECT NULL AS user_id, count(*) FROM {scan_core_v}""")
def agg_17(spark, sf):
    scans = view(spark, sf, "scan_core_v")
    whole = S.count_scans(scans).select(F.lit(None).cast("string").alias("user_id"), "scans")
    return S.count_scans(scans, by_user=True).unionByName(whole)


@query("prj_7", f"""
SELECT scan_id, {DISPLAY} AS history_status,
  CASE compliance_status WHEN 'COMPLIANT' THEN 'Passed' WHEN 'NON_COMPLIANT' THEN 'Failed' ELSE 'Warning' END AS report_status,
  CASE compliance_status WHEN 'COMPLIANT' THEN 'Compliant' WHEN 'NON_COMPLIANT' THEN 'Non-Compliant' ELSE 'Under Review' END AS dashboard_status,
  CASE compliance_status WHEN 'COMPLIANT' THEN '100/100' WHEN 'NON_COMPLIANT' THEN 'FAIL' ELSE 'REVIEW' END AS score_text,
  concat('Scan #', substr(scan_id, 1, 8)) AS history_id, concat('INS-', upper(substr(scan_id, 1, 8))) AS report_id,
  concat('LMC-', upper(substr(scan_id, 1, 5))) AS dashboard_id, strftime({LOCAL}, '%b %-d, %Y') AS local_date,
  strftime({LOCAL}, '%I:%M %p') AS local_time, coalesce(product_name, 'Unknown Product') AS product
FROM {{scans_v}}""")
def prj_7(spark, sf):
    return S.display_rows(view(spark, sf, "scans_v"))


@query("prj_9", """
SELECT image_id, round(blur_score, 2) AS blur_score, blur_score < 100 AS is_blurry, round(brightness, 2) AS brightness,
  CASE WHEN blur_score < 25 OR brightness < 25 OR brightness > 240 THEN 'UNREADABLE'
    WHEN blur_score < 100 OR brightness < 60 OR brightness > 200 THEN 'POOR' ELSE 'ACCEPTABLE' END AS quality_status
FROM {metrics_v}""")
def prj_9(spark, sf):
    return S.image_quality(view(spark, sf, "metrics_v"))


RAW_TIMES = """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN '2024-01-05T10:00:00' WHEN 1 THEN '2024-01-05T10:00:00Z'
  WHEN 2 THEN '2024-01-05T10:00:00+05:30' WHEN 3 THEN 'yesterday' ELSE ' 2024-01-05T23:59:59 ' END AS raw FROM {events}
"""


@query("sca_23", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN '2024-01-05 10:00:00' WHEN 1 THEN '2024-01-05 10:00:00'
  WHEN 2 THEN '2024-01-05 04:30:00' WHEN 3 THEN NULL ELSE '2024-01-05 23:59:59' END AS at FROM {events}""")
def sca_23(spark, sf):
    raw = sql_on(spark, sf, RAW_TIMES)
    return raw.select(
        "event_id", F.date_format(S.scan_time(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("at")
    )


# --- analytics -----------------------------------------------------------------------------
KPI = """count(*) AS total, count(*) FILTER (WHERE compliance_status = 'COMPLIANT') AS passed,
  count(*) FILTER (WHERE compliance_status = 'NON_COMPLIANT') AS failed, count(*) FILTER (WHERE compliance_status = 'PARTIAL') AS review,
  round(100.0::double * count(*) FILTER (WHERE compliance_status = 'COMPLIANT') / count(*), 1) AS passed_pct,
  round(100.0::double * count(*) FILTER (WHERE compliance_status = 'NON_COMPLIANT') / count(*), 1) AS failed_pct,
  round(100.0::double * count(*) FILTER (WHERE compliance_status = 'PARTIAL') / count(*), 1) AS review_pct"""


@query("agg_11", f"""
SELECT user_id, 'all' AS population, {KPI} FROM {{scan_core_v}} GROUP BY ROLLUP (user_id)
UNION ALL SELECT NULL, 'latest 100', {KPI} FROM (SELECT * FROM {{scan_core_v}} ORDER BY ts DESC, scan_id LIMIT 100) t""")
def agg_11(spark, sf):
    scans = view(spark, sf, "scan_core_v")
    per_user = A.status_kpis(scans, by=["user_id"]).withColumn("population", F.lit("all"))
    latest = A.status_kpis(S.recent(scans, 100), review="rest").select(
        F.lit(None).cast("string").alias("user_id"), F.lit("latest 100").alias("population"), "*"
    )
    return per_user.unionByName(latest)


@query("agg_12", f"SELECT count(*) AS scans, round(avg({SCORE}), 1) AS avg_score FROM {{scored_scans_v}}")
def agg_12(spark, sf):
    return A.average_score(view(spark, sf, "scored_scans_v"))


@query("agg_13", """
SELECT CASE WHEN contains(lower(field), 'mrp') THEN 'Incorrect MRP'
  WHEN contains(lower(field), 'netquantity') OR contains(lower(field), 'net_quantity') THEN 'Net Quantity Issues'
  WHEN contains(lower(field), 'readability') OR contains(lower(field), 'font') OR contains(lower(field), 'size') THEN 'Readability Issues'
  ELSE 'Missing Declarations' END AS category, count(*) AS violations
FROM {violations_v} GROUP BY 1""")
def agg_13(spark, sf):
    return A.violation_categories(view(spark, sf, "violations_v"))


TOP = f"""SELECT coalesce(nullif(product_name, ''), 'Unidentified Product') AS name, cast(sum(greatest(n_violations, 1)) AS bigint) AS violations,
  cast(round(avg({SCORE}), 0) AS bigint) AS score, count(*) AS scans
FROM {{scored_scans_v}} WHERE compliance_status <> 'COMPLIANT' GROUP BY 1 ORDER BY violations DESC, name LIMIT """


@query("agg_14", TOP + "4")
def agg_14(spark, sf):
    return A.top_offenders(view(spark, sf, "scored_scans_v"), 4)


@query("srt_5", TOP + "5")
def srt_5(spark, sf):
    return A.top_offenders(view(spark, sf, "scored_scans_v"), 5)


TREND = f"""SELECT d.day, strftime(d.day, '%a') AS day_name,
  count(*) FILTER (WHERE compliance_status = 'COMPLIANT') AS passed, count(*) FILTER (WHERE compliance_status = 'NON_COMPLIANT') AS failed,
  count(*) FILTER (WHERE compliance_status NOT IN ('COMPLIANT', 'NON_COMPLIANT')) AS warning
FROM (SELECT cast(unnest(generate_series(date '2001-07-27', date '2001-08-02', INTERVAL 1 DAY)) AS date) AS day) d
LEFT JOIN (SELECT cast({LOCAL} AS date) AS scan_day, compliance_status FROM {{scan_core_v}}) s ON s.scan_day = d.day GROUP BY d.day"""


@query("agg_15", TREND)
def agg_15(spark, sf):
    return A.rolling_trend(view(spark, sf, "scan_core_v"), NOW)


@query("agg_16", f"SELECT cast(greatest(5, max(passed + failed + warning)) AS bigint) AS max_total FROM ({TREND}) t")
def agg_16(spark, sf):
    return A.trend_bound(A.rolling_trend(view(spark, sf, "scan_core_v"), NOW))


@query("jn_10", f"""
SELECT d.day, count(scan_day) AS scans
FROM (SELECT cast(unnest(generate_series(date '2001-07-27', date '2001-08-02', INTERVAL 1 DAY)) AS date) AS day) d
LEFT JOIN (SELECT cast({LOCAL} AS date) AS scan_day FROM {{scan_core_v}}) s ON s.scan_day = d.day GROUP BY d.day""")
def jn_10(spark, sf):
    trend = A.rolling_trend(view(spark, sf, "scan_core_v"), NOW)
    return trend.select("day", (F.col("passed") + F.col("failed") + F.col("warning")).alias("scans"))


REPORT_SQL = " UNION ALL ".join(
    f"SELECT scan_id, cast({i} AS int) AS ord, '{label}' AS label, "
    + (f"coalesce(nullif({col}, ''), '{default}')" if col in ("product_name", "manufacturer", "batch_number") else f"'{default}'")
    + " AS value FROM {scans_v}"
    for i, (label, col, default) in enumerate(A.REPORT_LINES, start=1)
) + " UNION ALL SELECT scan_id, cast(14 AS int), 'Compliance Verdict', compliance_status FROM {scans_v}"


@query("src_8", REPORT_SQL)
def src_8(spark, sf):
    return A.scan_report(view(spark, sf, "scans_v"))


@query("src_8_violations", """
SELECT scan_id, cast(row_number() OVER (PARTITION BY scan_id ORDER BY line_number, part_key, price) AS int) AS number,
  concat(cast(row_number() OVER (PARTITION BY scan_id ORDER BY line_number, part_key, price) AS varchar), '. ', rule) AS title,
  description, field FROM {violations_v}
UNION ALL SELECT scan_id, 1, 'No violations detected.', NULL, NULL FROM {scan_core_v}
WHERE scan_id NOT IN (SELECT scan_id FROM {violations_v})""")
def src_8_violations(spark, sf):
    """Violation lines from the stored violation arrays (bounded per scan by its rules)."""
    listed = (
        view(spark, sf, "violations_v").groupBy("scan_id")
        .agg(F.array_sort(F.collect_list(F.struct("line_number", "part_key", "price", "rule", "description", "field"))).alias("violations"))
    )
    scans = view(spark, sf, "scan_core_v").select("scan_id").join(listed, "scan_id", "left")
    return A.violation_report(scans)


@query("src_9", f"""
WITH t AS (SELECT count(*) AS total, count(*) FILTER (WHERE compliance_status = 'COMPLIANT') AS p, count(*) FILTER (WHERE compliance_status = 'PARTIAL') AS w,
  count(*) FILTER (WHERE compliance_status = 'NON_COMPLIANT') AS f, round(avg({SCORE}), 1) AS a FROM {{scored_scans_v}}), top AS ({TOP} 5)
SELECT 'summary' AS section, 'Total' AS label, cast(total AS double) AS value, cast(NULL AS double) AS pct FROM t
UNION ALL SELECT 'summary', 'Average score', a, NULL FROM t
UNION ALL SELECT 'breakdown', 'Passed', cast(p AS double), round(100.0::double * p / total, 1) FROM t
UNION ALL SELECT 'breakdown', 'Warnings', cast(w AS double), round(100.0::double * w / total, 1) FROM t
UNION ALL SELECT 'breakdown', 'Failed', cast(f AS double), round(100.0::double * f / total, 1) FROM t
UNION ALL SELECT 'top products', name, cast(violations AS double), NULL FROM top""")
def src_9(spark, sf):
    return A.analytics_report(view(spark, sf, "scored_scans_v"), 5)


@query("set_1", """
SELECT scan_id FROM (SELECT scan_id FROM {scan_core_v} ORDER BY ts DESC, scan_id LIMIT 100) a
UNION ALL SELECT scan_id FROM (SELECT scan_id FROM {scan_core_v} ORDER BY ts DESC, scan_id LIMIT 100 OFFSET 100) b""")
def set_1(spark, sf):
    scans = view(spark, sf, "scan_core_v")
    first, second = S.page(scans, None, 1, 100), S.page(scans, None, 2, 100)
    return first.unionByName(second).select("scan_id")


# --- the laid-out table --------------------------------------------------------------------------
_TABLES: dict = {}


def scan_table(spark, sf):
    """All scans in three appends, of which the last two bring known scans again; written once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TABLES:
        stored = ScanTable(spark, f"{checkpoint_folder(spark)}/scans-{uuid.uuid4().hex}", unit="month")
        scans = view(spark, sf, "scans_v")
        third = F.col("scan_key") % 3
        for k in range(3):
            stored.append(scans.filter(third <= k).drop("scan_key"))
        _TABLES[key] = stored
    return _TABLES[key]


@query("src_6_table", """SELECT scan_id, user_id, cast(ts AS date) AS scan_date, compliance_status, product_name, manufacturer, batch_number FROM {scans_v}""")
def src_6_table(spark, sf):
    return scan_table(spark, sf).rows().select("scan_id", "user_id", "scan_date", "compliance_status", "product_name", "manufacturer", "batch_number")


@query("flt_4_table", f"""SELECT scan_id, 'Today' AS span FROM {{scan_core_v}} WHERE cast({LOCAL} AS date) = cast(timestamp '2001-08-01 20:00:00' + INTERVAL 330 MINUTE AS date)
UNION ALL SELECT scan_id, 'Last 7 Days' FROM {{scan_core_v}} WHERE ts <= timestamp '2001-08-02 00:00:00' AND ts >= timestamp '2001-07-26 00:00:00'
UNION ALL SELECT scan_id, 'Last 30 Days' FROM {{scan_core_v}} WHERE ts <= timestamp '2001-08-02 00:00:00' AND ts >= timestamp '2001-07-03 00:00:00'""")
def flt_4_table(spark, sf):
    stored = scan_table(spark, sf)
    pick = lambda span, at: stored.in_span(span, at).select("scan_id", F.lit(span).alias("span"))
    return pick("Today", "2001-08-01 20:00:00").unionByName(pick("Last 7 Days", NOW)).unionByName(pick("Last 30 Days", NOW))


@query("flt_6_table", """SELECT scan_id, user_id, compliance_status FROM {scan_core_v} WHERE scan_id IN ('scan-42', 'scan-7')
UNION ALL SELECT scan_id, user_id, compliance_status FROM {scan_core_v} WHERE scan_id = 'scan-0' AND user_id = 'nobody'""")
def flt_6_table(spark, sf):
    stored = scan_table(spark, sf)
    found = [stored.get("scan-42"), stored.get("scan-7"), stored.get("scan-0", "nobody"), stored.get("no such scan")]
    return reduce(DataFrame.unionByName, found).select("scan_id", "user_id", "compliance_status")


@query("srt_1_table", """SELECT scan_id, page FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, scan_id) AS r FROM {scan_core_v}) s
JOIN (VALUES (1, 'first', 1, 20), (2, 'deep', 701, 750), (3, 'behind', 751, 790)) p(o, page, a, b) ON r BETWEEN a AND b""")
def srt_1_table(spark, sf):
    """The first page, a page by number, and the page behind its last row by key."""
    stored = scan_table(spark, sf)
    deep = stored.page(15, 50)
    last = deep.orderBy(F.col("ts"), F.col("scan_id").desc()).first()
    pages = {"first": stored.page(), "deep": deep, "behind": stored.page_after(last.ts, last.scan_id, 40)}
    return reduce(DataFrame.unionByName, [rows.select("scan_id", F.lit(name).alias("page")) for name, rows in pages.items()])


@query("agg_15_table", TREND)
def agg_15_table(spark, sf):
    return A.rolling_trend(scan_table(spark, sf).since_days(NOW, 7), NOW)
