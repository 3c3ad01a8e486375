"""Shape changes between extraction, rules, stored scans and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscan.functions import vocab as V
from labelscan.functions.text import null_if_empty, strip

# extraction field -> column of the flat record
FLAT_COLUMNS = {
    "productName": "product_name", "manufacturerName": "manufacturer", "netQuantity": "net_quantity",
    "mrp": "mrp", "batchNumber": "batch_number", "consumerCare": "consumer_care",
    "manufacturerAddress": "manufacturer_address", "extraction_confidence": "extraction_confidence",
    "countryOfOrigin": "country_of_origin", "importerName": "importer_name",
    "unitSalePrice": "unit_sale_price", "fontHeightMm": "font_size_mm",
}
PROMOTED = [
    "product_name", "manufacturer", "net_quantity", "mrp", "batch_number", "mfg_date", "consumer_care",
]


def _field(df: DataFrame, name: str, kind: str = "string") -> Column:
    """``fields.<name>``, or a typed null when the struct lacks it."""
    have = df.schema["fields"].dataType.fieldNames()
    return F.col(f"fields.{name}") if name in have else F.lit(None).cast(kind)


def _month_year(month: Column, year: Column) -> Column:
    both = (F.coalesce(month, F.lit("")) != "") & (F.coalesce(year, F.lit("")) != "")
    return F.when(both, F.concat_ws("/", month, year))


def font_px_summary(comparison: Column) -> Column:
    """PRJ-2: smallest, median, largest and block count when any block was measured."""
    n = F.size(comparison["measured_blocks"])
    return F.when(
        F.coalesce(n, F.lit(0)) > 0,
        F.struct(
            comparison["smallest_height_px"].alias("smallest"), comparison["median_height_px"].alias("median"),
            comparison["largest_height_px"].alias("largest"), n.alias("block_count"),
        ),
    )


def flat_fields(ocr: DataFrame) -> DataFrame:
    """PRJ-1: extraction result (``fields``, ``quality``, texts) to the flat record."""
    f = lambda name, kind="string": _field(ocr, name, kind)
    text = null_if_empty(F.col("full_text"))
    if "combined_full_text" in ocr.columns:
        text = F.coalesce(text, F.col("combined_full_text"))
    px = (
        font_px_summary(F.col("fields.fontHeightPxComparison"))
        if "fontHeightPxComparison" in ocr.schema["fields"].dataType.fieldNames()
        else F.lit(None).cast("struct<smallest:int,median:double,largest:int,block_count:int>")
    )
    quality = F.coalesce(null_if_empty(F.col("quality.quality_status")), f("quality_status"))
    keep = [c for c in ocr.columns if c not in ("fields", "quality", "full_text", "combined_full_text")]
    return ocr.select(
        *keep,
        *[f(src, "double" if src == "fontHeightMm" else "string").alias(dst) for src, dst in FLAT_COLUMNS.items()],
        _month_year(f("monthOfPacking"), f("yearOfPacking")).alias("mfg_date"),
        _month_year(f("expiryMonth"), f("expiryYear")).alias("expiry_date"),
        text.alias("raw_ocr_text"), quality.alias("quality_status"), px.alias("font_readability_px"),
    )


def low_confidence(flat: DataFrame) -> DataFrame:
    """FLT-11: extractions graded LOW."""
    return flat.filter(F.col("extraction_confidence") == "LOW")


def rule_payload(flat: DataFrame, id_column: str = "scan_id") -> DataFrame:
    """PRJ-3: flat record to the product row of the rules.

    Extraction knows neither import status nor product type, so these are fixed.
    """
    parts = F.split(F.translate("mfg_date", "-", "/"), "/")
    a, b = strip(parts[0]), strip(F.try_element_at(parts, F.lit(2)))
    two = F.size(parts) == 2
    month_first = two & (F.length(a) == 2) & (F.length(b) == 4)
    year_first = two & (F.length(a) == 4) & (F.length(b) == 2)
    font = F.col("font_size_mm") if "font_size_mm" in flat.columns else F.lit(None)
    return flat.select(
        F.col(id_column).alias("product_id"), "product_name", F.lit(None).cast("string").alias("product_type"),
        F.lit(False).alias("is_imported"), F.col("manufacturer").alias("manufacturer_name"),
        "manufacturer_address", F.lit(None).cast("string").alias("packer_name"), "importer_name",
        "net_quantity", "mrp", "unit_sale_price",
        F.when(month_first, a).when(year_first, b).alias("month_of_packing"),
        F.when(month_first, b).when(year_first, a).alias("year_of_packing"),
        "expiry_date", "consumer_care", "country_of_origin", font.cast("double").alias("font_size_mm"),
    )


def scan_status(overall: Column) -> Column:
    """PRJ-4: verdict of the rules to the status of a scan."""
    up = F.upper(F.coalesce(overall, F.lit("")))
    return (
        F.when(up == V.PASS, F.lit(V.COMPLIANT)).when(up == V.FAIL, F.lit(V.NON_COMPLIANT))
        .otherwise(F.lit(V.PARTIAL))
    )


def violation_text(message: Column, remediation: Column) -> Column:
    """Message without its trailing stop, followed by the suggested fix."""
    msg = F.coalesce(message, F.lit(""))
    clean = F.rtrim(msg, F.lit(" ."))
    fix = F.concat(F.lit("Suggested fix: "), remediation)
    joined = F.when(clean != "", F.concat(clean, F.lit(". "), fix)).otherwise(fix)
    return F.when(F.coalesce(remediation, F.lit("")) != "", joined).otherwise(msg)


def scan_violation(v: Column) -> Column:
    return F.struct(
        F.coalesce(null_if_empty(v["rule_name"]), null_if_empty(v["rule_id"]), F.lit("RULE_CHECK")).alias("rule"),
        violation_text(v["message"], v["remediation"]).alias("description"),
        F.coalesce(null_if_empty(v["field"]), F.lit("label")).alias("field"),
    )


def scan_compliance(evaluated: DataFrame) -> DataFrame:
    """PRJ-4 over the output of the rule suite."""
    return evaluated.select(
        "product_id", scan_status(F.col("overall_status")).alias("compliance_status"),
        F.transform("violations", scan_violation).alias("violations"),
    )


def scan_record(flat: DataFrame, compliance: DataFrame, id_column: str = "scan_id") -> DataFrame:
    """PRJ-5: promoted columns, the whole flat record as a struct, image reference.

    The two inputs share one key per row; ``flat`` may carry user_id, ts and file_name.
    """
    name = F.col("file_name") if "file_name" in flat.columns else F.lit(None).cast("string")
    image = F.concat(F.lit("uploads/"), F.coalesce(null_if_empty(name), F.lit("scanned_image.jpg")))
    meta = [c for c in (id_column, "user_id", "ts", "file_name") if c in flat.columns]
    packed = F.struct(*[F.col(c) for c in flat.columns if c not in meta])
    keep = [c for c in meta if c != "file_name"]
    left = flat.select(
        *keep, *[c for c in PROMOTED], packed.alias("extracted_fields"), image.alias("image_ref")
    )
    right = compliance.withColumnRenamed("product_id", id_column)
    return left.join(right, id_column)


def first_file(images: DataFrame) -> DataFrame:
    """PRJ-5: file name of the first image of every scan."""
    return images.groupBy("scan_id").agg(F.min_by("file_name", "image_idx").alias("file_name"))


VIOLATION_LIST = "array<struct<rule:string,description:string,field:string>>"


def scan_response(rows: DataFrame) -> DataFrame:
    """PRJ-6 and SCA-24: stored row to the nested response, with defaults.

    ``violations`` and ``extracted_fields`` may be JSON text or already typed.
    """
    kind = dict(rows.dtypes)
    violations = F.col("violations")
    if kind["violations"] == "string":
        violations = F.from_json("violations", VIOLATION_LIST)
    fields = F.col("extracted_fields")
    if kind["extracted_fields"] == "string":
        fields = F.from_json("extracted_fields", "map<string,string>")
        fields = F.coalesce(fields, F.create_map().cast("map<string,string>"))
    return rows.select(
        "scan_id", "user_id", "ts", F.struct(*PROMOTED).alias("product"), fields.alias("extracted_fields"),
        F.struct(
            F.coalesce("compliance_status", F.lit(V.PARTIAL)).alias("status"),
            F.coalesce(violations, F.array().cast(VIOLATION_LIST)).alias("violations"),
        ).alias("compliance"),
        F.coalesce("image_ref", F.lit("")).alias("image_ref"),
    )
