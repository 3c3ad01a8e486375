"""The stored scans as a laid-out table (SRC-6, SRC-7, SRT-1, FLT-4, FLT-5, FLT-6, AGG-15).

Three folders, each written batch by batch as ``batch_id=n``:

* ``scans``: the rows by period, a day or a month, inside a file by day, user and time, so that a range of days
  opens only its folders and a user only some row groups.
* ``ids``: scan_id and scan_date by a hash of the id, inside a file by id. A look-up opens one bucket and then
  one period; an append finds known ids without reading rows.
* ``counts``: rows per day, from which a page far down the listing finds its days.

A batch that is written again with its number replaces itself, so an append that failed half way is repeated
as it was. Files are cut by size (a rebalance by period), not by a fixed number of pieces. The schema is declared
and not read from footers: columns that older files lack are null.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscan.operators.scans import DEFAULT_ZONE, date_filter, latest_first, local_day, of_user
from labelscan.session import staged

SCAN_SCHEMA = (
    "scan_id string, user_id string, ts timestamp, compliance_status string, product_name string, manufacturer string, batch_number string"
)
#: Fixed for a stored table: the bucket of an id follows from it.
ID_BUCKETS = 64
IDS, COUNTS = "scan_id string, scan_date date", "scan_date date, n bigint"


def id_bucket(scan_id):
    return F.pmod(F.xxhash64(scan_id), F.lit(ID_BUCKETS)).cast("int")


class ScanTable:
    """The table at ``path``; ``schema`` (with scan_id and ts) may gain columns over time.

    ``unit`` is fixed for a stored table: ``day`` if a day fills a file or more, else ``month``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = SCAN_SCHEMA, unit: str = "day"):
        if unit not in ("day", "month"):
            raise ValueError("unit must be day or month")
        self.spark, self.path, self.schema, self.unit = spark, path, schema, unit
        for name, kind, by in (("scans", f"{schema}, scan_date date", "period date"), ("ids", IDS, "id_bucket int"), ("counts", COUNTS, "")):
            full = ", ".join(x for x in (kind, by, "batch_id bigint") if x)
            spark.createDataFrame([], full).write.partitionBy("batch_id", *([by.split()[0]] if by else [])).mode("append").parquet(f"{path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        root = f"{self.path}/{name}"
        return self.spark.read.schema(f"{schema}, batch_id bigint").option("basePath", root).parquet(root)

    # --- reading ------------------------------------------------------------------------------
    def rows(self) -> DataFrame:
        return self._read("scans", f"{self.schema}, scan_date date, period date").drop("batch_id", "period")

    def _days(self, first=None, last=None, among: list | None = None) -> DataFrame:
        """Rows of a range of days (columns or values; open where null) or of some days; null days only ``among`` such."""
        rows, day, period = self._read("scans", f"{self.schema}, scan_date date, period date").drop("batch_id"), F.col("scan_date"), F.col("period")
        if among is not None:
            known = [F.lit(d) for d in among if d is not None]
            hit = period.isin(*[self._period(d) for d in known]) & day.isin(*known) if known else F.lit(False)
            return rows.filter(hit | period.isNull() if None in among else hit).drop("period")
        if first is not None:
            rows = rows.filter((period >= self._period(first)) & (day >= first))
        if last is not None:
            rows = rows.filter((period <= self._period(last)) & (day <= last))
        return rows.drop("period")

    def _period(self, day):
        return F.trunc(day, "month") if self.unit == "month" else day

    def ids(self) -> DataFrame:
        return self._read("ids", f"{IDS}, id_bucket int")

    def day_counts(self) -> dict[dt.date | None, int]:
        """Rows of every day, the latest first; one row a day reaches the driver."""
        days = self._read("counts", COUNTS).groupBy("scan_date").agg(F.sum("n").alias("n"))
        return {r.scan_date: r.n for r in days.orderBy(F.col("scan_date").desc_nulls_last()).collect()}

    def get(self, scan_id: str, user_id: str | None = None) -> DataFrame:
        """FLT-6: one bucket of ids, then the day that it names."""
        own = self.ids().filter((F.col("id_bucket") == id_bucket(F.lit(scan_id))) & (F.col("scan_id") == scan_id))
        days = [r.scan_date for r in own.select("scan_date").distinct().collect()]
        return of_user(self._days(among=days).filter(F.col("scan_id") == scan_id), user_id)

    def _between(self, days: list[dt.date | None]) -> DataFrame:
        """The rows of neighbouring days of the listing."""
        known = [d for d in days if d is not None]
        rows = self._days(F.lit(min(known)), F.lit(max(known))) if known else self._days(among=[])
        return rows.unionByName(self._days(among=[None])) if None in days else rows

    def in_span(self, span: str, now: str, zone: str = DEFAULT_ZONE) -> DataFrame:
        """FLT-4: the rows of ``date_filter``, with the days that they can lie on."""
        at, first, last = F.lit(now).cast("timestamp"), None, None
        days = {"Last 7 Days": 7, "Last 30 Days": 30}.get(span)
        if span == "Today":
            start = F.to_utc_timestamp(local_day(at, zone).cast("timestamp"), zone)
            first, last = F.to_date(start), F.to_date(start + F.expr("interval 1 day"))
        elif days is not None:
            first, last = F.to_date(at - F.make_dt_interval(F.lit(days))), F.to_date(at)
        return self._days(first, last).filter(date_filter(span, F.col("ts"), at, zone))

    def since_days(self, now: str, days: int, zone: str = DEFAULT_ZONE) -> DataFrame:
        """Rows from the day on at which the last ``days`` local days begin, for AGG-15."""
        first = F.date_sub(local_day(F.lit(now).cast("timestamp"), zone), days - 1)
        return self._days(first=F.to_date(F.to_utc_timestamp(first.cast("timestamp"), zone)))

    def page(self, page_no: int = 1, limit: int = 20) -> DataFrame:
        """SRT-1: a page of the whole listing by number; only the days that it lies on are read."""
        _check(page_no, limit)
        start, before, days = (page_no - 1) * limit, 0, []
        offset = 0
        for day, n in self.day_counts().items():
            if before + n > start and before < start + limit:
                if not days:
                    offset = start - before
                days.append(day)
            before += n
        return self._between(days).orderBy(*latest_first()).offset(offset).limit(limit)

    def page_after(self, ts: dt.datetime, scan_id: str, limit: int = 20, user_id: str | None = None) -> DataFrame:
        """SRT-1 by key: the ``limit`` rows that follow the row (ts, scan_id) in the listing.

        No row in front of the page is sorted or skipped, however far down it lies. Without a user the days
        below are known from the counts; a user's rows may lie on any earlier day.
        """
        _check(1, limit)
        key = F.lit(ts).cast("timestamp")
        behind = (F.col("ts") < key) | (F.col("ts") == key) & (F.col("scan_id") > scan_id) | F.col("ts").isNull()
        if user_id:
            rows = of_user(self._days(last=F.to_date(key)).unionByName(self._days(among=[None])), user_id)
        else:
            first = self.spark.range(1).select(F.to_date(key)).first()[0]
            days, below = [first], 0
            for day, n in self.day_counts().items():
                if (day is None or day < first) and below < limit:
                    days.append(day)
                    below += n
            rows = self._between(days)
        return rows.filter(behind).orderBy(*latest_first()).limit(limit)

    # --- writing --------------------------------------------------------------------------------
    def append(self, scans: DataFrame, batch_id: int | None = None) -> int:
        """SRC-6: adds the scans whose id is not stored yet; of equal new ids the earliest row (then a hash) stays.

        Without a number the batch gets the next one. A repeated append with the same number replaces it.
        Known ids are those that the batch shares with ``ids``, found by a semi-join in which the batch is
        the side that may be small; rows of the table are not read.
        """
        n = (self.ids().agg(F.max("batch_id")).first()[0] or 0) + 1 if batch_id is None else batch_id
        columns = self.spark.createDataFrame([], self.schema).schema
        own = {c.lower() for c in scans.columns}
        shaped = scans.select(*[(F.col(f.name) if f.name.lower() in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns])
        names = columns.names
        first = shaped.groupBy("scan_id").agg(F.min_by(F.struct(*names), F.struct("ts", F.xxhash64(*names))).alias("row")).select("row.*")
        placed = staged(first.withColumns({"scan_date": F.to_date("ts"), "id_bucket": id_bucket("scan_id")}))
        others = self.ids().filter(F.col("batch_id") != n).select("id_bucket", "scan_id")
        known = others.join(placed.select("id_bucket", "scan_id"), ["id_bucket", "scan_id"], "left_semi")
        new = staged(placed.join(known, ["id_bucket", "scan_id"], "left_anti").select(*names, "scan_date", "id_bucket"))
        ids = new.select("scan_id", "scan_date", "id_bucket").hint("rebalance", "id_bucket").sortWithinPartitions("id_bucket", "scan_id")
        ids.write.mode("overwrite").partitionBy("id_bucket").parquet(f"{self.path}/ids/batch_id={n}")
        counts = new.groupBy("scan_date").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{self.path}/counts/batch_id={n}")
        rows = new.drop("id_bucket").withColumn("period", self._period(F.col("scan_date"))).hint("rebalance", "period")
        rows = rows.sortWithinPartitions("period", "scan_date", *(c for c in ("user_id", "ts") if c in names))
        rows.write.mode("overwrite").partitionBy("period").parquet(f"{self.path}/scans/batch_id={n}")
        return n


def _check(page_no: int, limit: int) -> None:
    if not 1 <= limit <= 100 or page_no < 1:
        raise ValueError("limit must be 1 to 100 and page 1 or more")
