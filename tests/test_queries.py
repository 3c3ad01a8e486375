"""Every registered query against its SQL on the smallest tables; plan and stream checks."""

import check
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    ok, detail = check.check(spark, con, name, SF)
    assert ok, detail


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_latest_per_user_limits_before_the_shuffle(spark):
    plan = entry.queries()["win_8"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_point_lookup_is_pushed_down(spark):
    from pyspark.sql import functions as F

    from labelscan.operators.scans import of_user

    scans = spark.read.parquet(f"{SF}/events.parquet").withColumnRenamed("user_id", "owner").withColumn("user_id", F.col("event_type"))
    plan = of_user(scans, "error")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan
