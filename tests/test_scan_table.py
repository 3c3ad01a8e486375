"""The stored scans: idempotent appends, look-ups, ranges and pages, and what their plans read."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from labelscan.operators import scans as S
from labelscan.sources.scan_table import ID_BUCKETS, ScanTable, id_bucket

SCHEMA = "scan_id string, user_id string, ts timestamp, compliance_status string"


def at(day, hour=0):
    return dt.datetime(2026, 3, day, hour)


@pytest.fixture(scope="module")
def rows():
    # a third of all scans on one day, and by one user; ties in time
    return [(f"s{i:03d}", f"u{i % 3 if i % 2 else 0}", at(10 if i % 3 == 0 else 1 + i % 28, i % 5), "PARTIAL") for i in range(240)]


@pytest.fixture(scope="module", params=["day", "month"])
def stored(request, spark, rows, tmp_path_factory):
    out = ScanTable(spark, str(tmp_path_factory.mktemp("table")), SCHEMA, request.param)
    frame = lambda part: spark.createDataFrame(part, SCHEMA)
    assert out.append(frame(rows[:100])) == 1
    assert out.append(frame(rows[60:180] + rows[170:175])) == 2
    out.append(frame(rows[150:]))
    out.append(frame(rows[150:]), 3)  # run again with its number
    out.append(frame(rows[:0]))
    return out


def listing(rows):
    return sorted(rows, key=lambda r: (-r[2].timestamp(), r[0]))


def read(df):
    return [tuple(r) for r in df.select("scan_id", "user_id", "ts", "compliance_status").collect()]


def parts_read(spark, df, what="numPartitions"):
    """Day folders (or files) that the scans of a query have opened."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else stages hide the scans
    try:
        df = df.select("*")
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply(what).value() for i in range(leaves.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_append_is_idempotent(stored, rows):
    assert sorted(read(stored.rows())) == sorted(rows)
    assert stored.ids().count() == len(rows) and sum(stored.day_counts().values()) == len(rows)


def test_other_columns_are_null_and_new_columns_may_come(spark, stored, tmp_path):
    table = ScanTable(spark, str(tmp_path), SCHEMA)
    table.append(spark.createDataFrame([("a", at(1), 5)], "SCAN_ID string, ts timestamp, other int"))
    wider = ScanTable(spark, str(tmp_path), f"{SCHEMA}, batch_number string")
    wider.append(spark.createDataFrame([("b", at(2), "B1"), ("c", None, None)], "scan_id string, ts timestamp, batch_number string"))
    assert sorted(tuple(r) for r in wider.rows().select("scan_id", "user_id", "batch_number").collect()) == [("a", None, None), ("b", None, "B1"), ("c", None, None)]
    assert [r.scan_id for r in wider.page().collect()] == ["b", "a", "c"]
    assert [r.scan_id for r in wider.page_after(at(2), "b").collect()] == ["a", "c"]
    assert wider.get("c").count() == 1


def test_look_up_reads_one_bucket_and_one_day(spark, stored, rows):
    for i in (0, 7, 100, 239):
        assert read(stored.get(rows[i][0])) == [rows[i]]
        assert read(stored.get(rows[i][0], rows[i][1])) == [rows[i]] and read(stored.get(rows[i][0], "nobody")) == []
    assert read(stored.get("none")) == []
    text = plan(stored.get("s007"))
    assert "period" in text.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(scan_id,s007)" in text
    # the day of s007, in each batch that has it
    assert parts_read(spark, stored.get("s007")) <= 3
    bucket = stored.ids().filter(F.col("id_bucket") == id_bucket(F.lit("s007")))
    assert parts_read(spark, bucket) <= 3 < ID_BUCKETS


@pytest.mark.parametrize(("page", "limit"), [(1, 20), (3, 7), (12, 20), (13, 20), (2, 100), (40, 6), (41, 6)])
def test_pages_by_number(stored, rows, page, limit):
    assert read(stored.page(page, limit)) == listing(rows)[(page - 1) * limit : page * limit]


def test_pages_by_key_walk_the_whole_listing(stored, rows):
    got, last = read(stored.page(1, 50)), None
    while last != got[-1]:
        last = got[-1]
        got += read(stored.page_after(last[2], last[0], 50))
    assert got == listing(rows)
    own, all_own = [r for r in listing(rows) if r[1] == "u0"], []
    key = (at(28, 23), "")
    while part := read(stored.page_after(*key, limit=60, user_id="u0")):
        all_own += part
        key = (part[-1][2], part[-1][0])
    assert all_own == own


def test_pages_and_ranges_open_only_their_days(spark, stored):
    whole = parts_read(spark, stored.rows())
    assert stored.unit == "month" or parts_read(spark, stored.page(1, 5)) <= 6 and parts_read(spark, stored.page(30, 5)) <= 6 and parts_read(spark, stored.page_after(at(20), "s000", 5)) <= 9 < whole
    now = "2026-03-20 12:00:00"
    for span in ("Today", "Last 7 Days", "Last 30 Days", "All Time"):
        same = stored.rows().filter(S.date_filter(span, F.col("ts"), F.lit(now).cast("timestamp")))
        assert sorted(read(stored.in_span(span, now))) == sorted(read(same))
    text = plan(stored.in_span("Last 7 Days", now))
    assert "period" in text.split("PartitionFilters: [")[1].split("]")[0]
    if stored.unit == "month":
        return
    assert parts_read(spark, stored.in_span("Last 7 Days", now)) <= 24 and parts_read(spark, stored.in_span("Today", now)) <= 6
    assert parts_read(spark, stored.since_days(now, 3)) < whole / 2


def test_wrong_pages_are_refused(stored):
    for page, limit in ((0, 20), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            stored.page(page, limit)
