"""Stream sinks that lose nothing: several batches out of order, repeats, late rows, a batch that is run again."""

import datetime as dt
import shutil

import pytest

from labelscan.streaming import flows as FL

SCANS = "scan_id string, ts timestamp, compliance_status string"


def at(day, month=3, hour=12):
    return dt.datetime(2026, month, day, hour)


BATCHES = [
    [("a", at(10), "COMPLIANT"), ("b", at(12), "PARTIAL"), ("a", at(11), "PARTIAL"), (None, at(1), "COMPLIANT")],
    [("c", at(2), "NON_COMPLIANT"), ("a", at(9), "NON_COMPLIANT"), ("d", at(12, hour=6), "COMPLIANT")],  # c comes late
    [("e", at(3, month=4), "COMPLIANT"), ("b", at(12), "PARTIAL"), ("f", None, None)],
    [("g", at(2, month=3), "COMPLIANT"), ("g", at(1, month=3), "PARTIAL"), ("c", at(2), "NON_COMPLIANT")],  # g comes late
]


@pytest.fixture
def runs(spark, tmp_path):
    """Feeds the batches one by one into a sink; ``again`` runs a batch twice from the same checkpoint."""

    def feed(start, again=None):
        source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
        for n, rows in enumerate(BATCHES):
            spark.createDataFrame(rows, SCANS).coalesce(1).write.mode("append").parquet(source)
            if n == again:
                shutil.copytree(checkpoint, f"{checkpoint}-before")
            start(spark.readStream.schema(SCANS).parquet(source), folder, checkpoint).awaitTermination()
            if n == again:
                start(spark.readStream.schema(SCANS).parquet(source), folder, f"{checkpoint}-before").awaitTermination()
                checkpoint = f"{checkpoint}-before"
        return folder

    return feed


@pytest.mark.parametrize("again", [None, 2])
def test_keep_first_keeps_every_scan_once(spark, runs, again):
    folder = runs(FL.keep_first, again)
    first = {r.scan_id: (r.ts, r.compliance_status, r.batch_id) for r in FL.first_arrivals(spark, folder, SCANS).collect()}
    assert FL.first_arrivals(spark, folder, SCANS).count() == len(first) == 7
    assert first["a"] == (at(10), "COMPLIANT", 0) and first["c"] == (at(2), "NON_COMPLIANT", 1)
    assert first["g"] == (at(1), "PARTIAL", 3) and first["f"] == (None, None, 2)
    late = sorted((r.reason, r.scan_id or "") for r in FL.late_arrivals(spark, folder, SCANS).collect())
    assert late == [("late", "c"), ("late", "g"), ("no_id", "")]
    counts = [tuple(r) for r in FL.arrival_counts(spark, folder).orderBy("batch_id").drop("latest", "batch_id").collect()]
    # rows, first arrivals, repeats, late, without id
    assert counts == [(4, 2, 1, 0, 1), (3, 2, 1, 1, 0), (3, 2, 1, 0, 0), (3, 1, 2, 1, 0)]


@pytest.mark.parametrize("again", [None, 3])
def test_daily_counts_take_late_rows(spark, runs, again):
    folder = runs(FL.upsert_daily_status, again)
    expected = {}
    for _, ts, status in (row for batch in BATCHES for row in batch):
        day = expected.setdefault(ts and ts.date(), [0, 0, 0])
        day[{"COMPLIANT": 0, "NON_COMPLIANT": 1}.get(status, 2)] += 1
    got = {r.day: [r.passed, r.failed, r.warning] for r in FL.daily_counts(spark, folder).collect()}
    assert got == expected


def test_months_without_changes_are_not_rewritten(spark, runs, tmp_path):
    folder = runs(FL.upsert_daily_status)
    files = lambda month: {p.name for p in (tmp_path / "out" / "days" / f"month={month}").glob("*.parquet")}
    april, march = files("2026-04-01"), files("2026-03-01")
    spark.createDataFrame([("z", at(30), "PARTIAL")], SCANS).write.mode("append").parquet(str(tmp_path / "in"))
    FL.upsert_daily_status(spark.readStream.schema(SCANS).parquet(str(tmp_path / "in")), folder, str(tmp_path / "checkpoint")).awaitTermination()
    assert files("2026-04-01") == april and files("2026-03-01") != march
