"""Session defaults for local runs; a cluster passes its own configuration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "labelscan") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # small files are read as partitions of their own, so that CPU-heavy stages spread
        .config("spark.sql.files.openCostInBytes", "65536")
        # methods above this size are not compiled by the JVM's JIT: prefer split projections
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN_FOLDER: dict[str, str] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where it is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN_FOLDER[app]


def tasks(spark: SparkSession) -> int:
    """Tasks for few rows with much work, which would be merged into few by their size."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def staged(df: DataFrame) -> DataFrame:
    """Write a table that several branches read, and read it back.

    The written table survives lost executors, is computed once, and lets every
    branch read only its own columns.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
