"""Structured Streaming flows over arriving products and scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelscan.functions import vocab as V
from labelscan.operators import adapters as D
from labelscan.operators import evaluate as E


def evaluate_stream(products: DataFrame) -> DataFrame:
    """STR-1: verdict and violations of every arriving product.

    The rule suite works on the row alone, so the stream keeps no state.
    """
    scored = E.evaluate_products(products)
    return scored.select(
        "product_id", "overall_status", D.scan_status(F.col("overall_status")).alias("compliance_status"),
        F.transform("violations", D.scan_violation).alias("violations"),
    )


def once_per_scan(scans: DataFrame, delay: str = "1 day") -> DataFrame:
    """STR-2 with bounded state: drop repeated arrivals of a scan id.

    Rows more than ``delay`` behind the watermark are dropped; ``keep_first`` loses none."""
    return scans.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["scan_id"])


def daily_status(scans: DataFrame, delay: str = "1 day") -> DataFrame:
    """STR-3 with bounded state: status counts per day.

    In update mode rows later than ``delay`` are dropped; ``upsert_daily_status`` loses none."""
    return (
        scans.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w")).agg(*_status_counts())
        .select(F.to_date("w.start").alias("day"), "passed", "failed", "warning")
    )


def _status_counts() -> list[Column]:
    s = F.col("compliance_status")
    return [
        F.count_if(s == V.COMPLIANT).alias("passed"), F.count_if(s == V.NON_COMPLIANT).alias("failed"),
        F.count_if(~F.coalesce(s.isin(V.COMPLIANT, V.NON_COMPLIANT), F.lit(False))).alias("warning"),
    ]


# --- sinks without loss ------------------------------------------------------------------
# Every batch writes its own folder ``batch_id=n`` by overwriting it, and reads only the folders of
# earlier batches. A batch that is run again after a failure therefore gives the same tables.
def _prepare(spark: SparkSession, path: str, schema: str, by: str = "batch_id") -> None:
    """The table as an empty folder, where there is none yet."""
    spark.createDataFrame([], schema).write.partitionBy(by).mode("append").parquet(path)


def _batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows of all batches, or of those before one."""
    rows = spark.read.schema(f"{schema}, batch_id bigint").option("basePath", path).parquet(path)
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def _write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("update")
        .trigger(availableNow=True).start()
    )


def keep_first(scans: DataFrame, folder: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """STR-2: the first arrival of every scan id, however late it comes and however far apart repeats are.

    Three tables under ``folder``, read with ``first_arrivals``, ``late_arrivals`` and ``arrival_counts``:

    * ``scans``: one row per scan_id, the first batch's; within a batch the earliest ts (then a hash of the
      row). Known ids are found by a semi-join of the id column with the batch, so that the small side,
      the batch, is the one that may be broadcast, and then an anti-join of the batch with what was found.
    * ``late``: rows of ``scans`` whose ts lies more than ``delay`` behind the latest ts of earlier batches,
      and rows without a scan_id, which are no scans and are kept here only (reason ``late`` or ``no_id``).
    * ``counts``: rows, first arrivals, repeats, late ones, rows without id, and the latest ts of each batch.
    """
    schema = _ddl(scans)

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        arrived = batch.filter("scan_id IS NOT NULL").groupBy("scan_id").agg(
            F.min_by(F.struct(*batch.columns), F.struct("ts", F.xxhash64(*batch.columns))).alias("row")
        ).select("row.*")
        ids = batch.select("scan_id").distinct()
        seen = _batches(spark, f"{folder}/scans", schema, n).select("scan_id").join(ids, "scan_id", "left_semi")
        _write_batch(arrived.join(seen, "scan_id", "left_anti").select(*batch.columns), f"{folder}/scans", n)
        new = _batches(spark, f"{folder}/scans", schema).filter(F.col("batch_id") == n).drop("batch_id")
        mark = _batches(spark, f"{folder}/counts", COUNTS, n).agg(F.max("latest")).first()[0]
        behind = F.coalesce(F.col("ts") < F.lit(mark) - F.expr(f"interval {delay}"), F.lit(False)) if mark else F.lit(False)
        aside = new.filter(behind).withColumn("reason", F.lit("late"))
        nameless = batch.filter("scan_id IS NULL").withColumn("reason", F.lit("no_id"))
        _write_batch(aside.unionByName(nameless), f"{folder}/late", n)
        late = _batches(spark, f"{folder}/late", f"{schema}, reason string").filter(F.col("batch_id") == n)
        none = {"n_rows": F.lit(0), "n_first": F.lit(0), "n_late": F.lit(0), "n_no_id": F.lit(0), "latest": F.lit(None).cast("timestamp")}
        row = lambda rows, **known: rows.agg(*[known.get(c, x).alias(c) for c, x in none.items()])
        parts = row(batch, n_rows=F.count("*"), latest=F.max("ts")).unionByName(row(new, n_first=F.count("*"))).unionByName(
            row(late, n_late=F.count_if(F.col("reason") == "late"), n_no_id=F.count_if(F.col("reason") == "no_id"))
        )
        counts = parts.agg(*[F.sum(c).alias(c) for c in none if c != "latest"], F.max("latest").alias("latest"))
        repeated = (F.col("n_rows") - F.col("n_first") - F.col("n_no_id")).alias("n_repeated")
        _write_batch(counts.select("n_rows", "n_first", repeated, "n_late", "n_no_id", "latest"), f"{folder}/counts", n)

    for name, kind in (("scans", schema), ("late", f"{schema}, reason string"), ("counts", COUNTS)):
        _prepare(scans.sparkSession, f"{folder}/{name}", f"{kind}, batch_id bigint")
    return _start(scans, each, checkpoint)


COUNTS = "n_rows bigint, n_first bigint, n_repeated bigint, n_late bigint, n_no_id bigint, latest timestamp"


def first_arrivals(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return _batches(spark, f"{folder}/scans", schema)


def late_arrivals(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return _batches(spark, f"{folder}/late", f"{schema}, reason string")


def arrival_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _batches(spark, f"{folder}/counts", COUNTS)


DAYS = "day date, month date, passed bigint, failed bigint, warning bigint"


def upsert_daily_status(scans: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """STR-3: status counts per day, brought up to date by every batch; late rows count like any other.

    A batch adds its counts per day to the log ``changes``, a few rows, and then replaces in the table
    ``days`` the months that it changed by their sums over the log. Months it did not change stay as they
    are, no state is kept in memory, and a batch that is run again gives the same. Read with ``daily_counts``.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        dated = batch.withColumn("day", F.to_date("ts"))
        counts = dated.groupBy("day", F.trunc("day", "month").alias("month")).agg(*_status_counts())
        _write_batch(counts, f"{folder}/changes", n)
        log = _batches(spark, f"{folder}/changes", DAYS)
        changed = log.filter(F.col("batch_id") == n).select("month").distinct()
        # a null ts has a null month, which takes part like the others
        touched = log.alias("l").filter(F.col("batch_id") <= n).join(changed.alias("c"), F.col("l.month").eqNullSafe(F.col("c.month")), "left_semi")
        sums = touched.groupBy("day", "month").agg(*[F.sum(c).alias(c) for c in ("passed", "failed", "warning")])
        sums.write.partitionBy("month").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{folder}/days")

    _prepare(scans.sparkSession, f"{folder}/changes", f"{DAYS}, batch_id bigint")
    _prepare(scans.sparkSession, f"{folder}/days", DAYS, by="month")
    return _start(scans, each, checkpoint)


def daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The table of ``upsert_daily_status``; rows without a ts stand under a null day."""
    path = f"{folder}/days"
    return spark.read.schema("day date, passed bigint, failed bigint, warning bigint, month date").option("basePath", path).parquet(path).drop("month")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append sink for STR-1 and STR-2: exactly once, restartable from its checkpoint."""
    return (
        stream.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def read_table_stream(spark: SparkSession, folder: str, file_name: str, schema) -> DataFrame:
    """File stream over one table file of a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file_name).parquet(folder)
