"""Merging the fields of several images of one product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscan.functions import vocab as V
from labelscan.functions.text import has, letters_share, strip, tokens3


# --- confidence ----------------------------------------------------------------------------
def mean_confidence(blocks: DataFrame, default: float = 0.0) -> DataFrame:
    """AGG-5: mean block confidence per image; a missing confidence counts ``default``."""
    return blocks.groupBy("scan_id", "image_idx").agg(
        F.avg(F.coalesce("confidence", F.lit(default))).alias("mean_conf")
    )


def field_confidence(values: DataFrame, blocks: DataFrame) -> DataFrame:
    """JN-7: confidence of a value = best confidence of a block that carries it.

    ``values`` holds one row per (scan, image, field), so the key of the join has at
    most as many rows on that side as there are fields and the work per image is
    linear in its blocks.  No match gives the mean confidence of the image.
    """
    v, t = F.lower(strip("value")), F.lower(strip("text"))
    # candidates travel as one short array per image; blocks stay the only many side
    per_image = (
        values.filter(v != "").groupBy("scan_id", "image_idx")
        .agg(F.collect_list(F.struct("field", "value", v.alias("v"), tokens3(F.col("value")).alias("tokens"), "mean_conf")).alias("cands"))
    )
    texts = blocks.select("scan_id", "image_idx", t.alias("t"), "confidence").filter(F.col("t") != "")
    hit = lambda c: (
        F.col("t").contains(c["v"]) | c["v"].contains(F.col("t"))
        | F.exists(c["tokens"], lambda x: F.col("t").contains(x))
    )
    matched = (
        texts.join(per_image.select("scan_id", "image_idx", "cands"), ["scan_id", "image_idx"])
        .select(
            "scan_id", "image_idx", "confidence",
            F.explode(F.filter("cands", hit)).alias("c"),
        )
        .groupBy("scan_id", "image_idx", F.col("c.field").alias("field"))
        .agg(F.max(F.coalesce("confidence", "c.mean_conf")).alias("best"))
    )
    return values.join(matched, ["scan_id", "image_idx", "field"], "left").select(
        *values.columns, F.coalesce("best", "mean_conf").alias("field_conf")
    )


# --- evidence ------------------------------------------------------------------------------------
def evidence_strength(field: Column, value: Column, full_text: Column) -> Column:
    """SCA-20: 3 strong, 2 moderate, 1 weak, 0 invalid; 2 for fields without a ladder."""
    v = strip(value)
    text = F.lower(F.coalesce(full_text, F.lit("")))
    n = lambda *steps: _ladder(steps)

    mrp_label = has(v, V.EV_MRP_LABEL_VALUE) | has(text, V.EV_MRP_LABEL_TEXT)
    currency = has(v, V.EV_MRP_CURRENCY)
    mrp = n(
        (has(v, V.EV_MRP_QTY) & ~has(v, V.EV_MRP_NOT_QTY), 0), (~has(v, r"(?U)\d"), 0),
        (mrp_label & (currency | has(v, V.EV_MRP_TAX)), 3), (mrp_label | currency, 2), (None, 1),
    )
    unit = has(v, V.EV_QTY_UNIT)
    quantity = n((unit & has(text, V.EV_QTY_LABEL), 3), (unit, 2), (None, 1))
    corp, maker_label = has(v, V.EV_CORP), has(text, V.EV_MAKER_LABEL)
    maker = n(
        (maker_label & corp, 3), (maker_label | corp, 2), (has(v, V.EV_TWO_WORDS), 2), (None, 1)
    )
    imp_label = has(text, V.EV_IMPORTER_LABEL)
    importer = n((imp_label & corp, 3), (imp_label, 2), (None, 1))
    usp_label = has(v, V.EV_UNIT_PRICE_VALUE) | has(text, V.EV_UNIT_PRICE_TEXT)
    unit_price = n(
        (usp_label & has(v, r"(?U)\d"), 3), (has(v, V.EV_UNIT_PRICE_SHAPE), 2), (None, 1)
    )
    made = n((has(text, V.EV_MADE), 3), (None, 2))
    expiry = n((has(text, V.EV_EXPIRY), 3), (None, 2))
    care = n((v.contains("@") | has(v, V.EV_TOLL_FREE), 3), (has(text, V.EV_CARE), 2), (None, 1))
    origin = n((has(text, V.EV_ORIGIN), 3), (None, 2))
    batch_label = has(text, V.EV_BATCH)
    batch = n(
        (~has(v, "[A-Za-z0-9]") | (F.length(v) < 2), 0), (batch_label & (F.length(v) >= 3), 3),
        (batch_label, 2), (None, 1),
    )
    one_word, two_words = has(v, "[A-Za-z]{2,}"), has(v, V.EV_TWO_WORDS)
    bad_name = (
        has(v, V.NAME_PRICE_CODE) | has(v, r"(?U)@\s*\d+[/-]\d+") | has(v, V.NAME_DANGLING)
        | has(v, V.NAME_LEADING) | has(v, V.EV_NAME_INSTRUCTION) | has(v, V.NAME_CLAIMS)
        | has(v, V.EV_NAME_WEB) | has(v, V.NAME_CARE_TEXT) | (F.length(v) < 3)
        | v.contains("?") | v.contains("!") | v.endswith(".")
        | (letters_share(v) < V.NAME_MIN_LETTERS)
    )
    name = n(
        (bad_name, 0), (has(v, V.EV_NAME_PROMO), 1), (has(text, V.EV_NAME_LABEL) & one_word, 3),
        (two_words, 2), (one_word, 1), (None, 0),
    )
    return (
        F.when(F.coalesce(v, F.lit("")) == "", F.lit(0))
        .when(field == "mrp", mrp).when(field == "netQuantity", quantity)
        .when(field.isin("manufacturerName", "packerName"), maker)
        .when(field == "importerName", importer).when(field == "unitSalePrice", unit_price)
        .when(field.isin("monthOfPacking", "yearOfPacking"), made)
        .when(field.isin("expiryMonth", "expiryYear"), expiry).when(field == "consumerCare", care)
        .when(field == "countryOfOrigin", origin).when(field == "batchNumber", batch)
        .when(field == "productName", name).otherwise(F.lit(2))
    )


def _ladder(steps) -> Column:
    out = None
    for cond, score in steps:
        if cond is None:
            return F.lit(score) if out is None else out.otherwise(F.lit(score))
        out = F.when(cond, F.lit(score)) if out is None else out.when(cond, F.lit(score))
    return out


def candidates(image_fields: DataFrame) -> DataFrame:
    """Non-blank values with rounded confidence and evidence strength.

    Input columns: scan_id, image_idx, file_name, field, value, full_text and
    field_conf (or mean_conf when no per-field confidence is known).
    """
    conf = "field_conf" if "field_conf" in image_fields.columns else "mean_conf"
    rows = image_fields.filter(strip("value") != "")
    return rows.select(
        "scan_id", "image_idx", "file_name", "field", "value",
        F.lower(strip("value")).alias("norm"), F.bround(conf, 3).alias("conf"),
        evidence_strength(F.col("field"), F.col("value"), F.col("full_text")).alias("strength"),
    )


def ranked(cands: DataFrame) -> DataFrame:
    """WIN-2: candidates by strength, confidence and image, with the runner-up alongside."""
    w = Window.partitionBy("scan_id", "field").orderBy(
        F.col("strength").desc(), F.col("conf").desc(), "image_idx"
    )
    return cands.select(
        "*", F.row_number().over(w).alias("rank"),
        F.lead(F.struct("value", "norm", "conf", "strength")).over(w).alias("next"),
    )


def _struct_of(cands: DataFrame) -> Column:
    return F.struct("image_idx", "file_name", "value", "norm", "conf", "strength")


def resolve(cands: DataFrame) -> DataFrame:
    """AGG-8 core: one row per (scan, field) with the merged value and conflict data.

    A scan has at most four images (the ingest check rejects larger ones as a
    whole), so a group is a handful of rows.  Rows are hashed by scan alone, which
    also serves the later per-scan aggregation: one shuffle in all.
    """
    grouped = (
        cands.repartition("scan_id").groupBy("scan_id", "field")
        .agg(F.array_sort(F.collect_list(_struct_of(cands))).alias("cands"))
    )
    order = F.array_sort(
        F.transform(
            "cands",
            lambda c: F.struct(
                (-c["strength"]).alias("s"), (-c["conf"]).alias("k"), c["image_idx"].alias("i"), c.alias("c")
            ),
        )
    )
    first = F.col("cands")[0]
    win, nxt = F.col("win"), F.col("nxt")
    agreed = F.size(F.array_distinct(F.transform("cands", lambda c: c["norm"]))) == 1
    tie = (
        (win["strength"] == nxt["strength"]) & (F.abs(win["conf"] - nxt["conf"]) < 0.001)
        & (win["norm"] != nxt["norm"])
    )
    unsafe = (win["strength"] == 0) | ((win["strength"] <= 1) & (nxt["strength"] <= 1)) | tie
    num = lambda c: F.format_string("%.3f", c)
    lead_text = F.concat(
        F.lit("Selected value '"), win["value"], F.lit("' from image '"), win["file_name"], F.lit("' ")
    )
    by_conf = F.concat(
        lead_text, F.lit("due to higher OCR confidence ("), num(win["conf"]), F.lit(" vs "),
        num(nxt["conf"]), F.lit(")."),
    )
    by_evidence = F.concat(
        lead_text, F.lit("due to stronger statutory evidence (strength="),
        win["strength"].cast("string"), F.lit(" vs "), nxt["strength"].cast("string"),
        F.lit(", ocr_confidence="), num(win["conf"]), F.lit(" vs "), num(nxt["conf"]), F.lit(")."),
    )
    unresolved = F.lit(
        "Candidates could not be safely resolved due to insufficient contextual "
        "evidence or tied OCR confidence; resolved to null for verification."
    )
    judged = grouped.select(
        "scan_id", "field", "cands", (F.size("cands") > 1).alias("many"), agreed.alias("agreed"),
        order.alias("o"),
    ).select(
        "scan_id", "field", "cands", (F.col("many") & ~F.col("agreed")).alias("conflict"),
        F.col("o")[0]["c"].alias("win"),
        F.when(F.size("o") > 1, F.try_element_at("o", F.lit(2))["c"]).alias("nxt"),
    )
    settled = judged.select("*", F.coalesce(F.col("conflict") & unsafe, F.lit(False)).alias("unresolved"))
    return settled.select(
        "scan_id", "field", "conflict", "unresolved",
        F.when(~F.col("conflict"), F.when(first["strength"] > 0, first["value"]))
        .when(~F.col("unresolved"), win["value"]).alias("value"),
        F.when(F.col("conflict"), F.when(F.col("unresolved"), unresolved)
               .when(win["strength"] == nxt["strength"], by_conf).otherwise(by_evidence)).alias("reason"),
        F.transform(
            "cands",
            lambda c: F.struct(
                c["value"].alias("value"), c["file_name"].alias("source_image"), c["conf"].alias("ocr_confidence")
            ),
        ).alias("competing_values"),
    )


def conflicts(resolved: DataFrame) -> DataFrame:
    """Conflict table of AGG-8."""
    return resolved.filter("conflict").select(
        "scan_id", "field", F.col("value").alias("resolved_value"), "competing_values",
        F.col("reason").alias("resolution_reason"),
    )


def merged_fields(resolved: DataFrame) -> DataFrame:
    """AGG-8 and AGG-9: one wide row per scan with the merged values and their grade.

    The explicit field list makes this a plain conditional aggregate, on the
    partitioning that ``resolve`` already established.
    """
    fields = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in V.MERGE_FIELDS]
    core = F.col("field").isin(V.CORE_FIELDS)
    truthy = (
        F.col("value").isNotNull() & ~core
        & ~((F.col("field") == "isImported") & (F.lower("value") == "false"))
        & ~((F.col("field") == "fontHeightMm") & F.coalesce(F.col("value").try_cast("double") == 0, F.lit(False)))
    )
    wide = resolved.groupBy("scan_id").agg(
        *fields, F.max("unresolved").alias("any_unresolved"), F.max("conflict").alias("any_conflict"),
        F.count_if(core & F.col("value").isNotNull()).alias("n_core"), F.max(truthy).alias("any_other"),
    )
    grade = (
        F.when(F.col("any_unresolved"), F.lit("LOW")).when(F.col("any_conflict"), F.lit("MEDIUM"))
        .when(F.col("n_core") >= 2, F.lit("HIGH"))
        .when((F.col("n_core") >= 1) | F.col("any_other"), F.lit("MEDIUM")).otherwise(F.lit("LOW"))
    )
    return wide.select("scan_id", *V.MERGE_FIELDS, grade.alias("extraction_confidence"))


def merge_images(image_fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged fields, conflicts) of a long table of per-image field values."""
    resolved = resolve(candidates(image_fields))
    return merged_fields(resolved), conflicts(resolved)


def image_totals(images: DataFrame) -> DataFrame:
    """AGG-10: images per scan, how many worked, and their texts in image order."""
    ok = F.coalesce(F.col("success"), F.lit(True))
    text = strip("full_text")
    parts = F.array_sort(F.collect_list(F.when(ok & (text != ""), F.struct("image_idx", text.alias("t")))))
    return images.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total_images"), F.count_if(ok).alias("successful_images"),
        F.count_if(~ok).alias("failed_images"),
        F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("combined_full_text"),
    )


# --- second pass ---------------------------------------------------------------------------------
KEY_FIELDS = ["mrp", "net_quantity", "manufacturer_name"]
FILL_FIELDS = KEY_FIELDS + ["month_of_packing", "year_of_packing", "consumer_care"]


def needs_second_pass(quality: Column) -> Column:
    """FLT-12: a readable image that lacks price, quantity or maker."""
    lacking = F.lit(False)
    for f in KEY_FIELDS:
        lacking = lacking | F.col(f).isNull()
    return F.coalesce(~quality.isin("POOR", "UNREADABLE"), F.lit(True)) & lacking


def second_pass(first: DataFrame, second: DataFrame, mode: str = "text") -> DataFrame:
    """JN-11: merge a second reading of the images that need one.

    ``text`` takes the second text when it is longer; ``fill`` also fills missing
    key fields from it.
    """
    keys = ["scan_id", "image_idx"]
    other = second.select(
        *keys, F.col("full_text").alias("_text"),
        *[F.col(f).alias(f"_{f}") for f in FILL_FIELDS], F.lit(True).alias("_seen"),
    )
    due = needs_second_pass(F.col("quality_status"))
    retried = F.coalesce(F.col("_seen"), F.lit(False)) & due
    longer = F.coalesce(F.length("_text") > F.coalesce(F.length("full_text"), F.lit(0)), F.lit(False))
    out = first.join(other, keys, "left")
    fill = {
        f: F.when(retried, F.coalesce(F.col(f), F.col(f"_{f}"))).otherwise(F.col(f)) if mode == "fill" else F.col(f)
        for f in FILL_FIELDS
    }
    rest = [c for c in first.columns if c not in fill and c != "full_text"]
    return out.select(
        *rest, *[c.alias(f) for f, c in fill.items()],
        F.when(retried & longer, F.col("_text")).otherwise(F.col("full_text")).alias("full_text"),
        retried.alias("retried"),
    )
