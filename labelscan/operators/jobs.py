"""End-to-end jobs: from text blocks to stored scans, and analytics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscan.functions import vocab as V
from labelscan.operators import adapters as D
from labelscan.operators import analytics as A
from labelscan.operators import evaluate as E
from labelscan.operators import extract as X
from labelscan.operators import merge as M
from labelscan.operators.spatial import IMAGE
from labelscan.session import staged

SINGLE_FIELDS = [f for f in V.MERGE_FIELDS if f not in ("productId", "productType", "isImported", "packerName")]


def _records(flat: DataFrame) -> DataFrame:
    """Flat records to scan records with their verdict (PRJ-3, RUL-15, PRJ-4, PRJ-5)."""
    flat = staged(flat)
    compliance = D.scan_compliance(E.evaluate_products(D.rule_payload(flat)))
    return D.scan_record(flat, compliance)


def scan_single_images(
    blocks: DataFrame, quality: DataFrame | None = None, calibration: float | None = None, images: DataFrame | None = None
) -> DataFrame:
    """JOB-1: every image is a scan of its own, named ``<scan>/<image>``.

    ``images`` (scan_id, image_idx, optional full_text) names all images, those without a block too.
    """
    # many branches read the blocks: where they come from is worked out once
    blocks = staged(blocks)
    found = X.extract_fields(blocks, quality, calibration, images)
    px = F.struct("measured_blocks", "smallest_height_px", "median_height_px", "largest_height_px")
    nested = found.select(
        F.concat_ws("/", "scan_id", F.col("image_idx").cast("string")).alias("scan_id"),
        F.struct(*SINGLE_FIELDS, "extraction_confidence", px.alias("fontHeightPxComparison")).alias("fields"),
        F.struct("quality_status").alias("quality"), "full_text",
    )
    return _records(D.flat_fields(nested))


def image_candidates(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Long candidates of the merge from the extraction of every image."""
    items = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in SINGLE_FIELDS + ["isImported"]]
    )
    means = M.mean_confidence(blocks)
    wide = found.drop("mean_conf").join(means, IMAGE, "left").select(
        *IMAGE, F.concat(F.lit("img"), F.col("image_idx").cast("string"), F.lit(".jpg")).alias("file_name"),
        "full_text", F.coalesce("mean_conf", F.lit(0.0)).alias("mean_conf"), items.alias("items"),
    )
    long = wide.select(*IMAGE, "file_name", "full_text", "mean_conf", F.explode_outer("items").alias("i")).select(
        *IMAGE, "file_name", "full_text", "mean_conf", "i.*"
    )
    return M.field_confidence(long.filter("value IS NOT NULL"), blocks)


def scan_image_sets(
    blocks: DataFrame, quality: DataFrame | None = None, calibration: float | None = None, images: DataFrame | None = None
):
    """JOB-2: (scan records, conflicts) of scans with several images; ``images`` as in JOB-1."""
    blocks = staged(blocks)
    found = staged(X.extract_fields(blocks, quality, calibration, images))
    resolved = staged(M.resolve(M.candidates(image_candidates(found, blocks))))
    merged = found.select("scan_id").distinct().join(M.merged_fields(resolved), "scan_id", "left")
    merged = merged.withColumn("extraction_confidence", F.coalesce("extraction_confidence", F.lit("LOW")))
    texts = found.filter("full_text IS NOT NULL").groupBy("scan_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("image_idx", "full_text"))), lambda p: p["full_text"]), " ")
        .alias("combined_full_text")
    )
    nested = merged.join(texts, "scan_id", "left").select(
        "scan_id", F.struct(*V.MERGE_FIELDS, "extraction_confidence").alias("fields"),
        F.struct(F.lit(None).cast("string").alias("quality_status")).alias("quality"),
        F.lit(None).cast("string").alias("full_text"), "combined_full_text",
    )
    return _records(D.flat_fields(nested)), M.conflicts(resolved)


def evaluate_directly(products: DataFrame) -> DataFrame:
    """JOB-3: products to verdict and counts."""
    return E.evaluate_products(products).select(
        "product_id", "overall_status", "total_rules", "passed_rules", "failed_rules", "manual_review_rules",
        "not_applicable_rules", "violations",
    )


def analytics_snapshot(scored: DataFrame, violations: DataFrame, now: str) -> DataFrame:
    """JOB-4: all report figures as ``(section, label, value)``."""
    report = A.analytics_report(scored, 4).select("section", "label", "value")
    categories = A.violation_categories(violations).select(
        F.lit("categories").alias("section"), F.col("category").alias("label"), F.col("violations").cast("double").alias("value")
    )
    trend = A.rolling_trend(scored, now).select(
        F.lit("trend").alias("section"), F.date_format("day", "yyyy-MM-dd").alias("label"),
        (F.col("passed") + F.col("failed") + F.col("warning")).cast("double").alias("value"),
    )
    return report.unionByName(categories).unionByName(trend)
