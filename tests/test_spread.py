"""The rows of a small file that the views multiply are dealt to all cores before."""

import os

import pytest
from pyspark.sql import functions as F

from labelscan.plans import views
from labelscan.plans.views import view

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver tables")
@pytest.mark.parametrize("name", ["products_v", "ocr_blocks_v", "image_fields_v"])
def test_tasks(spark, name):
    counts = [r["count"] for r in view(spark, SF, name).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert len(counts) == tasks
    assert max(counts) <= 2 * sum(counts) / tasks


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver tables")
def test_tasks_grow_with_the_file(spark, monkeypatch):
    """A larger file makes more tasks and not larger ones; the rows are the same."""
    monkeypatch.setattr(views, "SPREAD_BYTES", 1 << 10)
    size = os.path.getsize(f"{SF}/part.parquet")
    counts = [r["count"] for r in view(spark, SF, "products_v").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(counts) > spark.sparkContext.defaultParallelism and sum(counts) == 2000
    assert len(counts) <= -(-size // (1 << 10))
