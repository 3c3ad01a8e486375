"""Reading products and scans, and writing the scan table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelscan.functions import vocab as V
from labelscan.functions.text import empty, null_if_empty
from labelscan.operators.rules import PRODUCT_COLUMNS
from labelscan.operators.scans import scan_time

_KINDS = {
    "isImported": T.BooleanType(), "isPDPPlacementValid": T.BooleanType(), "isLegible": T.BooleanType(),
    "fontSizeMm": T.DoubleType(), "principalDisplayAreaCm2": T.DoubleType(), "contrastRatio": T.DoubleType(),
}
EVIDENCE = T.StructType(
    [
        T.StructField("field", T.StringType()), T.StructField("value", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("confidence", T.DoubleType()),
        T.StructField("rawAnnotation", T.StringType()),
    ]
)
PAYLOAD_SCHEMA = T.StructType(
    [T.StructField(f, _KINDS.get(f, T.StringType())) for f in PRODUCT_COLUMNS]
    + [T.StructField("fieldEvidence", T.MapType(T.StringType(), EVIDENCE))]
)
CORRUPT = "_corrupt"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: JSON lines with an enforced schema; unreadable lines stay as ``_corrupt``."""
    schema = T.StructType(PAYLOAD_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])
    raw = (
        spark.read.schema(schema).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).json(path)
    )
    return _product_columns(raw, [])


def parse_payloads(lines: DataFrame, column: str) -> DataFrame:
    """SRC-4 for JSON text in a column (batch or stream); other columns are kept."""
    schema = T.StructType(PAYLOAD_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])
    keep = [c for c in lines.columns if c != column]
    parsed = lines.select(
        *keep,
        F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("p"),
    ).select(*keep, "p.*")
    return _product_columns(parsed, keep)


def _product_columns(raw: DataFrame, keep: list[str]) -> DataFrame:
    return raw.select(
        *keep, *[F.col(f).alias(c) for f, c in PRODUCT_COLUMNS.items()],
        F.coalesce("fieldEvidence", F.create_map().cast(PAYLOAD_SCHEMA["fieldEvidence"].dataType)).alias("evidence"),
        F.col(CORRUPT),
    )


def _error(field: Column, kind: str, message: str) -> Column:
    return F.struct(field.alias("field"), F.lit(kind).alias("type"), F.lit(message).alias("message"))


def validate_payloads(products: DataFrame) -> DataFrame:
    """SRC-4: add ``errors array<struct<field,type,message>>`` and ``valid``."""
    corrupt = F.col(CORRUPT).isNotNull()
    none = F.array().cast("array<struct<field:string,type:string,message:string>>")
    one = lambda cond, err: F.when(cond, F.array(err)).otherwise(none)
    bad_evidence = F.transform(
        F.filter(
            F.map_entries("evidence"),
            lambda e: ~F.coalesce(e["value"]["confidence"].between(0.0, 1.0), F.lit(True)),
        ),
        lambda e: _error(
            F.concat(F.lit("fieldEvidence -> "), e["key"], F.lit(" -> confidence")), "out_of_range",
            "Confidence must lie between 0 and 1",
        ),
    )
    bad_source = F.transform(
        F.filter(
            F.map_entries("evidence"),
            lambda e: ~F.coalesce(e["value"]["source"].isin(V.EVIDENCE_SOURCES), F.lit(True)),
        ),
        lambda e: _error(
            F.concat(F.lit("fieldEvidence -> "), e["key"], F.lit(" -> source")), "enum",
            "Unknown evidence source",
        ),
    )
    errors = F.when(
        corrupt, F.array(_error(F.lit("body"), "json_invalid", "Record is not valid JSON"))
    ).otherwise(
        F.concat(
            one(F.col("product_id").isNull(), _error(F.lit("productId"), "missing", "Field required")),
            bad_evidence, bad_source,
        )
    )
    return products.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def split_payloads(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid products, quarantine with errors)."""
    checked = validate_payloads(products)
    return checked.filter("valid").drop("errors", "valid", CORRUPT), checked.filter("NOT valid")


# --- scan table ---------------------------------------------------------------------------------
def prepare_scans(incoming: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """SRC-6: (accepted, rejected).  A user is mandatory; a missing id becomes a uuid,
    a missing or unreadable time becomes ``now``."""
    has_user = ~empty(F.col("user_id"))
    given = scan_time(F.col("timestamp")) if "timestamp" in incoming.columns else F.col("ts")
    ts = F.coalesce(given, F.lit(now).cast("timestamp"))
    new_id = F.coalesce(null_if_empty(F.col("scan_id")), F.uuid())
    drop = [c for c in ("timestamp", "ts", "scan_id") if c in incoming.columns]
    shaped = incoming.select(
        new_id.alias("scan_id"), ts.alias("ts"), F.to_date(ts).alias("scan_date"),
        *[c for c in incoming.columns if c not in drop],
    )
    return shaped.filter(has_user), shaped.filter(~has_user)


def only_new(scans: DataFrame, stored: DataFrame) -> DataFrame:
    """Scans whose id is not stored yet (idempotent append)."""
    return scans.join(stored.select("scan_id"), "scan_id", "left_anti")


def append_scans(scans: DataFrame, path: str) -> None:
    """SRC-6 sink: Parquet partitioned by day (``scan_table`` adds an id index and counts).

    Rows are rebalanced by day, so a day with a third of all scans is cut into files of the
    advised size instead of being one task, and small days share tasks.
    """
    spread = scans.hint("rebalance", "scan_date")
    spread.write.mode("append").partitionBy("scan_date").parquet(path)


def read_scans(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC-7: old and new files read with one schema.

    With a declared ``schema`` no footer is read for it; without, all footers are merged.
    """
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    return spark.read.option("mergeSchema", "true").parquet(path)


# fixed value: id of the user that owns rows from before users existed
LEGACY_USER = "legacy-system-user"


def backfill_user(scans: DataFrame, users: DataFrame, fallback: str = LEGACY_USER) -> DataFrame:
    """SRC-7: rows without an owner get the first user, or the system user when there is none."""
    rows = scans if "user_id" in scans.columns else scans.withColumn("user_id", F.lit(None).cast("string"))
    first = users.agg(F.min("user_id")).scalar()
    return rows.withColumn("user_id", F.coalesce(F.col("user_id"), first, F.lit(fallback)))
