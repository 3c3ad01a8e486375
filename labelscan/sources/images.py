"""Image files, OCR results and the labelled sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscan.functions import vocab as V
from labelscan.functions.text import strip

# fixed values: leading bytes (hex) of known image formats
SIGNATURES = [("JPEG", "FFD8FF"), ("PNG", "89504E470D0A1A0A"), ("BMP", "424D"), ("GIF", "474946"), ("WEBP", "52494646")]


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: image files with their checks; the bytes are read once, in tasks."""
    files = spark.read.format("binaryFile").load(path)
    named = files.select("path", "length", "content", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"))
    return check_images(named)


def image_format(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for name, start in reversed(SIGNATURES):
        out = F.when(head.startswith(start), F.lit(name)).otherwise(out)
    return out


def check_images(files: DataFrame, max_size: int = V.MAX_IMAGE_BYTES) -> DataFrame:
    """SRC-1: add format, ``accepted`` and the reason of a rejection.

    The format is taken from the leading bytes, never from the name or declared type.
    """
    size, kind = F.length("content"), image_format(F.col("content"))
    reason = (
        F.when(size > max_size, F.lit("file_too_large")).when(size == 0, F.lit("invalid_image"))
        .when(~F.coalesce(kind.isin("JPEG", "PNG"), F.lit(False)), F.lit("invalid_image"))
    )
    detail = (
        F.when(size > max_size, F.lit("File size exceeds 10MB limit."))
        .when(size == 0, F.lit("Uploaded file is empty."))
        .when(kind.isNull(), F.lit("Invalid image file or corrupted image data."))
        .when(~kind.isin("JPEG", "PNG"),
              F.concat(F.lit("Unsupported image format: '"), kind, F.lit("'. Only JPEG and PNG images are supported.")))
    )
    return files.withColumns({"format": kind, "reason": reason, "detail": detail}).withColumn(
        "accepted", F.col("reason").isNull()
    )


def known_extension(file_name: Column) -> Column:
    """Extensions the extractor takes."""
    return F.lower(F.regexp_extract(file_name, r"\.([^.]+)$", 1)).isin(V.IMAGE_EXTENSIONS)


def check_groups(images: DataFrame, max_images: int = V.MAX_IMAGES) -> DataFrame:
    """SRC-2: images of scans with one to four images that are all acceptable."""
    good = images.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("accepted").alias("all_ok")
    ).filter(F.col("n").between(1, max_images) & F.col("all_ok"))
    return images.join(good.select("scan_id"), "scan_id", "left_semi")


RAW_LINES = "array<struct<box:array<array<double>>,text:string,confidence:string>>"


def normalise_ocr(images: DataFrame, lines: str = "lines") -> DataFrame:
    """SRC-3: keep lines with a box of four points, numeric confidence and text.

    Works on the line array of each image row, without a shuffle.
    """
    usable = F.filter(
        lines,
        lambda x: (F.size(x["box"]) == 4) & F.forall(x["box"], lambda p: F.size(p) >= 2)
        & x["confidence"].try_cast("double").isNotNull() & (F.coalesce(strip(x["text"]), F.lit("")) != ""),
    )
    blocks = F.transform(
        F.coalesce(usable, F.array().cast(RAW_LINES)),
        lambda x: F.struct(
            strip(x["text"]).alias("text"), x["confidence"].try_cast("double").alias("confidence"),
            F.transform(x["box"], lambda p: F.transform(p, lambda v: v.cast("int"))).alias("box"),
        ),
    )
    keep = [c for c in images.columns if c != lines]
    done = images.select(*keep, blocks.alias("text_blocks"))
    return done.withColumn(
        "full_text", F.array_join(F.transform("text_blocks", lambda b: b["text"]), " ")
    ).withColumn("success", F.size("text_blocks") > 0)


def to_blocks(normalised: DataFrame) -> DataFrame:
    """Long block table with edges, from the block arrays of ``normalise_ocr``."""
    from labelscan.operators.spatial import box_metrics

    long = normalised.select("scan_id", "image_idx", F.posexplode("text_blocks").alias("block_idx", "b"))
    g = box_metrics(F.col("b.box"))
    box = F.col("b.box")
    dx, dy = F.abs(box[1][0] - box[0][0]), F.abs(box[1][1] - box[0][1])
    return long.select(
        "scan_id", "image_idx", "block_idx", "b.text", "b.confidence",
        *[g[c].alias(c) for c in ("x_min", "y_min", "x_max", "y_max")],
        (dy / F.greatest(dx, F.lit(1))).alias("slope"),
    )


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: the labelled sample CSV; ``violations`` is the split list, empty for NONE."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    clean = raw.toDF(*[c.replace("﻿", "").strip('"') for c in raw.columns])
    parts = F.transform(F.split("violation", ";"), lambda v: F.trim(v))
    none = F.array().cast("array<string>")
    listed = F.when(F.upper(F.trim("violation")) == "NONE", none).otherwise(F.filter(parts, lambda v: v != ""))
    return clean.withColumn("violations", F.coalesce(listed, none))


def sample_violations(sample: DataFrame) -> DataFrame:
    """SRC-5: one row per violation; images without any stay with null."""
    return sample.select("product_id", "image_id", F.explode_outer("violations").alias("violation"))
