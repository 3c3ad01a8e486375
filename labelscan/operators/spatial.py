"""Spatial pairing of text blocks of one image (label -> value, nearby, right neighbour).

All three are range joins.  Both sides are cut into bands of ``BAND`` pixels on the
axis that must overlap, and the band is part of the join key, so the blocks of one
image are spread over many keys and only blocks in the same band meet.  A pair that
shares several bands is kept in the first common band only.  What lies below a label has
no bound; ``nearest_below`` finds the nearest of it, in images of many blocks by a sweep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscan.functions import vocab as V
from labelscan.session import staged

IMAGE = ["scan_id", "image_idx"]
BAND = 256
#: The highest level of dyadic cells, which are 2**TOP pixels wide there; wider spans take several of them.
TOP = 12
#: Up to this many values of one image and field are met one by one; more of them are swept.
FEW = 64
CELL_TYPE = "struct<kind: string, level: int, place: bigint>"
GEOMETRY = ["x_min", "y_min", "x_max", "y_max"]
#: relation -> axes on which label and value must overlap
AXES = {"row": ["y"], "row_below": ["y", "x"], "near": ["y"], "right_of": ["y"]}


def box_metrics(box: Column) -> dict[str, Column]:
    """SCA-3: edges and centre of a box of at least four points; null otherwise."""
    ok = F.coalesce(F.size(box), F.lit(0)) >= 4
    xs, ys = F.transform(box, lambda p: p[0]), F.transform(box, lambda p: p[1])
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    return {
        "x_min": F.when(ok, F.array_min(xs)), "y_min": F.when(ok, F.array_min(ys)),
        "x_max": F.when(ok, F.array_max(xs)), "y_max": F.when(ok, F.array_max(ys)),
        "cx": F.when(ok, mean(xs)), "cy": F.when(ok, mean(ys)),
    }


def reading_key(prefix: str = "") -> list[Column]:
    """WIN-1: top, left, index; a block without a box uses its index."""
    idx = F.col(f"{prefix}block_idx")
    return [
        F.coalesce(F.col(f"{prefix}y_min"), idx).cast("double"),
        F.coalesce(F.col(f"{prefix}x_min"), idx).cast("double"), idx,
    ]


def reading_order(blocks: DataFrame) -> DataFrame:
    """WIN-1: 0-based position of every block in reading order."""
    w = Window.partitionBy(*IMAGE).orderBy(*reading_key())
    return blocks.withColumn("pos", F.row_number().over(w) - 1)


def _bands(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / BAND), F.floor(high / BAND))


def _center(prefix: str, axis: str) -> Column:
    a, b = ("x_min", "x_max") if axis == "x" else ("y_min", "y_max")
    return (F.col(prefix + a) + F.col(prefix + b)) / 2.0


def _cell(kind: str, level, place) -> Column:
    return F.struct(F.lit(kind).alias("kind"), level.cast("int").alias("level"), place.cast("long").alias("place"))


def _shift(c: Column, level: Column) -> Column:
    """``c`` divided by 2**level, rounded down."""
    return F.call_function("shiftright", c, level)


def _cells_at(kind: str, x: Column) -> Column:
    """The dyadic cells that hold a place: one on every level."""
    return F.transform(F.sequence(F.lit(0), F.lit(TOP)), lambda k: _cell(kind, k, _shift(x.cast("long"), k)))


def _cells_of(kind: str, low: Column, high: Column) -> Column:
    """The fewest dyadic cells that make up ``low`` to ``high`` (two a level at most, but for the highest level).

    Every place of the range lies in exactly one of them; an empty range has none.
    """
    low, high = low.cast("long"), high.cast("long")
    ends = lambda k: (-_shift(-low, k), _shift(high + 1, k))

    def level(k):
        first, end = ends(k)
        odd = lambda c: (first < end) & (F.pmod(c, F.lit(2)) == 1)
        return F.array(F.when(odd(first), _cell(kind, k, first)), F.when(odd(end), _cell(kind, k, end - 1)))

    first, end = ends(F.lit(TOP))
    wide = F.when(first < end, F.transform(F.sequence(first, end - 1), lambda c: _cell(kind, F.lit(TOP), c)))
    narrow = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(TOP - 1)), level))
    return F.filter(F.concat(narrow, F.coalesce(wide, F.array().cast(f"array<{CELL_TYPE}>"))), lambda c: c.isNotNull())


def nearest_below(labels: DataFrame, values: DataFrame, few: int = FEW) -> DataFrame:
    """The nearest value below each label: IMAGE, field, l_block_idx, v_block_idx, gap, dcx.

    ``labels`` and ``values``: IMAGE, field, block_idx and geometry in whole pixels. A value is below a label if
    it starts at or under the label's lower edge and shares a column of pixels with it; nearest is the smallest
    gap, then the smallest distance of the centres, then the smaller index. Labels without such a value, and
    blocks without a box, give no row.

    A label meets all values of its image and field if those are ``few``, so at most that many rows a label;
    where there are more, ``_met_by_sweep`` finds the next ones.
    """
    boxed, group = F.col("x_min").isNotNull(), [*IMAGE, "field"]
    lab = labels.filter(boxed).select(
        *group, F.col("block_idx").alias("l_block_idx"), F.col("x_min").alias("l_lo"), F.col("x_max").alias("l_hi"), F.col("y_max").cast("long").alias("y"))
    val = values.filter(boxed).select(
        *group, F.col("block_idx").alias("v_block_idx"), F.col("x_min").alias("v_lo"), F.col("x_max").alias("v_hi"), F.col("y_min").cast("long").alias("top"))
    crowded = staged(val.groupBy(*group).count().filter(F.col("count") > few).select(*group))
    plain = lab.join(crowded, group, "left_anti").join(val.join(crowded, group, "left_anti"), group).filter(
        "top >= y AND v_hi >= l_lo AND v_lo <= l_hi")
    swept = _met_by_sweep(lab.join(crowded, group, "left_semi"), val.join(crowded, group, "left_semi"))
    met = plain.select(*swept.columns).unionByName(swept).filter("l_block_idx <> v_block_idx")
    best = F.min(F.struct(
        (F.col("top") - F.col("y")).cast("double").alias("gap"),
        F.abs((F.col("v_lo") + F.col("v_hi")) / 2.0 - (F.col("l_lo") + F.col("l_hi")) / 2.0).alias("dcx"), "v_block_idx"))
    return met.groupBy(*group, "l_block_idx").agg(best.alias("best")).select(*group, "l_block_idx", "best.*")


def _met_by_sweep(lab: DataFrame, val: DataFrame) -> DataFrame:
    """The values at and next under each label's lower edge, column by column: both sides' columns, side by side.

    Two spans share a column if the value covers the label's left edge, or begins in the rest of the label's
    span. Either is a place inside a range: the place goes to its cell on every level, the range to the few
    dyadic cells that make it up, and they meet in exactly one. In each cell one sweep from the bottom up finds
    the next value under each label, so the work is the number of blocks times the levels, however tall the image.
    """
    place = [*IMAGE, "field", "cell"]
    a, b = F.col("l_lo"), F.col("l_hi")
    lab = lab.select("*", F.explode(F.concat(_cells_at("covers", a), _cells_of("begins", a + 1, b))).alias("cell"))
    a, b = F.col("v_lo"), F.col("v_hi")
    val = val.select("*", F.explode(F.concat(_cells_of("covers", a, b), _cells_at("begins", a))).alias("cell"))
    tops = val.select(*place, F.col("top").alias("y"), F.col("top").alias("seen")).distinct()
    # from the bottom up; at one height labels come first, so that they see what lies strictly under them
    w = Window.partitionBy(*place).orderBy(F.col("y").desc(), F.col("seen").isNotNull())
    swept = lab.withColumn("seen", F.lit(None).cast("long")).unionByName(tops, allowMissingColumns=True)
    swept = swept.withColumn("next", F.last("seen", ignorenulls=True).over(w)).filter("l_block_idx IS NOT NULL")
    # values at the edge itself are looked up beside the next ones: a flat block is no value of its own
    asked = swept.select("*", F.explode(F.array("y", "next")).alias("top")).filter("top IS NOT NULL")
    return asked.join(val, [*place, "top"]).drop("cell", "seen", "next")


def pairs(labels: DataFrame, values: DataFrame, payload: list[str], value_payload: list[str], nearest: bool = False) -> DataFrame:
    """Pairs of a label block and a value block with their ranking key ``n1..n5``.

    ``labels``: IMAGE, field, rel, dist, block_idx, geometry and ``payload``.
    ``values``: IMAGE, field, block_idx, geometry and ``value_payload``.
    Relations: ``row`` (same visual row), ``row_below`` (same row, else below),
    ``near`` (vertical gap up to ``dist``), ``right_of`` (right neighbour within ``dist``).
    With ``nearest``, of the values below a label only the nearest is paired with it; a label has one row per
    field then, and a value too.
    """
    has_box = F.col("x_min").isNotNull()
    grow = F.when(F.col("rel") == "near", F.col("dist")).otherwise(F.lit(0))
    y = lambda g: _bands(F.col("y_min") - g, F.col("y_max") + g)
    x = _bands(F.col("x_min"), F.col("x_max"))
    on = lambda axis, bands: F.transform(
        bands, lambda b: F.struct(F.lit(axis).alias("axis"), b.alias("band"), F.element_at(bands, 1).alias("first"))
    )
    lab = labels.filter(has_box).select(
        *IMAGE, "field", F.col("rel"), F.col("dist"),
        *[F.col(c).alias("l_" + c) for c in ["block_idx", *GEOMETRY, *payload]],
        F.explode(
            on("y", y(grow)) if nearest else F.when(F.col("rel") == "row_below", F.concat(on("y", y(grow)), on("x", x))).otherwise(on("y", y(grow)))
        ).alias("k"),
    ).select("*", F.col("k.axis").alias("axis"), F.col("k.band").alias("band"), F.col("k.first").alias("l_first")).drop("k")
    val = values.filter(has_box).select(
        *IMAGE, "field", *[F.col(c).alias("v_" + c) for c in ["block_idx", *GEOMETRY, *value_payload]],
        F.explode(on("y", y(F.lit(0))) if nearest else F.concat(on("y", y(F.lit(0))), on("x", x))).alias("k"),
    ).select("*", F.col("k.axis").alias("axis"), F.col("k.band").alias("band"), F.col("k.first").alias("v_first")).drop("k")
    joined = lab.join(val, [*IMAGE, "field", "axis", "band"]).filter(
        (F.col("l_block_idx") != F.col("v_block_idx")) & (F.col("band") == F.greatest("l_first", "v_first"))
    )
    l, v = (lambda c: F.col("l_" + c)), (lambda c: F.col("v_" + c))
    overlap = F.greatest(F.lit(0), F.least(l("y_max"), v("y_max")) - F.greatest(l("y_min"), v("y_min")))
    share = F.try_divide(
        overlap.cast("double"), F.least(l("y_max") - l("y_min"), v("y_max") - v("y_min")).cast("double")
    )
    h_gap = F.greatest(v("x_min") - l("x_max"), l("x_min") - v("x_max"), F.lit(0))
    v_gap = F.greatest(v("y_min") - l("y_max"), l("y_min") - v("y_max"), F.lit(0))
    dcx, dcy = F.abs(_center("v_", "x") - _center("l_", "x")), F.abs(_center("v_", "y") - _center("l_", "y"))
    rel, dist, axis = F.col("rel"), F.col("dist"), F.col("axis")
    same_row = (share >= V.SAME_ROW_OVERLAP) & (v("x_min") >= l("x_max") - dist)
    below = (v("y_min") >= l("y_max")) & (v("x_max") >= l("x_min")) & (v("x_min") <= l("x_max"))
    right = (overlap > 0) & (v("x_min") >= l("x_max")) & (h_gap <= dist)
    near = (v_gap <= dist) & (dcy <= dist * 2)
    hit = (
        F.when(axis == "x", below).when(rel.isin("row", "row_below"), same_row)
        .when(rel == "near", near).otherwise(right)
    )
    d = lambda c: c.cast("double")
    key = (
        F.when(axis == "x", F.struct(F.lit(1).alias("n1"), d(v("y_min") - l("y_max")).alias("n2"), F.lit(0.0).alias("n3"), dcx.alias("n4")))
        .when(rel == "near", F.struct(F.lit(0).alias("n1"), d(v_gap).alias("n2"), dcx.alias("n3"), F.lit(0.0).alias("n4")))
        .when(rel == "right_of", F.struct(F.lit(0).alias("n1"), d(h_gap).alias("n2"), d(v("y_min")).alias("n3"), F.lit(0.0).alias("n4")))
        .otherwise(F.struct(F.lit(0).alias("n1"), d(h_gap).alias("n2"), (-share).alias("n3"), dcx.alias("n4")))
    )
    found = joined.filter(F.coalesce(hit, F.lit(False))).select(
        *IMAGE, "field", *[F.col("l_" + c) for c in ["block_idx", *GEOMETRY, *payload]],
        *[F.col("v_" + c) for c in ["block_idx", *value_payload]], key.alias("k"),
    ).select("*", "k.*", F.col("v_block_idx").alias("n5")).drop("k")
    if not nearest:
        return found
    under = labels.filter("rel = 'row_below'")
    # what the sweep needs not is joined to its result
    side = lambda rows, p, more: rows.select(*IMAGE, "field", *[F.col(c).alias(p + c) for c in ["block_idx", *more]])
    best = nearest_below(under, values).join(side(under, "l_", [*GEOMETRY, *payload]), [*IMAGE, "field", "l_block_idx"])
    if value_payload:
        best = best.join(side(values, "v_", value_payload), [*IMAGE, "field", "v_block_idx"])
    rank = {"n1": F.lit(1), "n2": F.col("gap"), "n3": F.lit(0.0), "n4": F.col("dcx"), "n5": F.col("v_block_idx")}
    return found.unionByName(best.withColumns(rank).select(*found.columns))


def block_pairs(blocks: DataFrame, is_label: Column, rel: str, dist: int) -> DataFrame:
    """JN-4, JN-5, JN-6 over whole block tables: every label block with its ranked partners."""
    base = blocks.withColumn("field", F.lit("block"))
    labels = base.filter(is_label).withColumns({"rel": F.lit(rel), "dist": F.lit(dist)})
    found = pairs(labels, base, [], [])
    w = Window.partitionBy(*IMAGE, "l_block_idx").orderBy("n1", "n2", "n3", "n4", "n5")
    return found.select(
        *IMAGE, F.col("l_block_idx").alias("label_idx"), F.col("v_block_idx").alias("value_idx"),
        F.row_number().over(w).alias("rank"),
    )
