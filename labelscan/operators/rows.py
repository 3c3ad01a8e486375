"""Visual rows: which blocks of an image stand on one line (WIN-4, WIN-5)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelscan.operators.spatial import IMAGE, reading_key

# fixed values: minimum overlap and maximum centre distance (in row heights)
ROW_OVERLAP = 0.45
ROW_CENTRE = 0.75


class _Row:
    """Running geometry of one visual row."""

    def __init__(self, top, bottom, centre):
        self.top, self.bottom, self.n = top, bottom, 0
        self.heights = self.centres = 0.0
        self.add(top, bottom, centre)

    def add(self, top, bottom, centre):
        self.top, self.bottom = min(self.top, top), max(self.bottom, bottom)
        self.heights += bottom - top
        self.centres += centre
        self.n += 1

    def takes(self, top, bottom, centre) -> bool:
        height = self.heights / self.n
        smaller = min(max(bottom - top, 1), height)
        shared = max(0, min(bottom, self.bottom) - max(top, self.top))
        if smaller <= 0 or shared / smaller < ROW_OVERLAP:
            return False
        return abs(centre - self.centres / self.n) <= height * ROW_CENTRE


def _row_ids(tops, bottoms) -> list[int]:
    """Greedy rows of one image in reading order; a block joins the first row that takes it."""
    rows: list[_Row | None] = []
    ids = []
    for top, bottom in zip(tops, bottoms):
        if pd.isna(top):
            rows.append(None)
            ids.append(len(rows) - 1)
            continue
        centre = (top + bottom) / 2
        at = next((i for i, r in enumerate(rows) if r is not None and r.takes(top, bottom, centre)), None)
        if at is None:
            rows.append(_Row(top, bottom, centre))
            at = len(rows) - 1
        else:
            rows[at].add(top, bottom, centre)
        ids.append(at)
    return ids


#: Layouts whose rows a worker remembers from batch to batch.
REMEMBERED = 1 << 14


@lru_cache(REMEMBERED)
def _rows_of_layout(tops: bytes, bottoms: bytes) -> list[int]:
    return _row_ids(np.frombuffer(tops).tolist(), np.frombuffer(bottoms).tolist())


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def row_ids(tops: pd.Series, bottoms: pd.Series) -> pd.Series:
    """UDF-4: row ids of whole images, many images per Arrow batch; images of one layout are worked out once."""
    place = lambda ys: np.asarray(ys, dtype="float64").tobytes()
    return pd.Series([_rows_of_layout(place(t), place(b)) for t, b in zip(tops, bottoms)], dtype=object)


def rows_of_images(blocks: DataFrame, columns: list[str]) -> DataFrame:
    """WIN-4, exact: the named columns of every block, and ``row_id``.

    The blocks of one image (one OCR result) are brought together in reading order and
    scored as an array; images travel in Arrow batches instead of one call per image. The
    columns stay with the blocks, so nothing is joined back and the images stay where they are.
    """
    r1, r2, idx = reading_key()
    item = F.struct(
        r1.alias("r1"), r2.alias("r2"), idx.alias("r3"), F.col("y_min").cast("double").alias("lo"),
        F.col("y_max").cast("double").alias("hi"), F.struct(*[c for c in columns if c not in IMAGE]).alias("own"),
    )
    images = blocks.groupBy(*IMAGE).agg(F.array_sort(F.collect_list(item)).alias("bs"))
    pick = lambda name: F.transform("bs", lambda b: b[name])
    scored = images.select(*IMAGE, pick("own").alias("own"), row_ids(pick("lo"), pick("hi")).alias("row_id"))
    out = scored.select(*IMAGE, F.explode(F.arrays_zip("own", "row_id")).alias("z"))
    return out.select(*IMAGE, "z.row_id", "z.own.*")


def visual_rows(blocks: DataFrame) -> DataFrame:
    """WIN-4, exact: ``row_id`` per block."""
    return rows_of_images(blocks, ["block_idx"]).select(*IMAGE, "block_idx", "row_id")


def visual_rows_by_gap(blocks: DataFrame) -> DataFrame:
    """WIN-4 for straight rows, windows only: a block starts a new row when it overlaps
    its predecessor in reading order by less than the minimum share."""
    w = Window.partitionBy(*IMAGE).orderBy(*reading_key())
    top, bottom = F.col("y_min"), F.col("y_max")
    p_top, p_bottom = F.lag("y_min").over(w), F.lag("y_max").over(w)
    shared = F.greatest(F.lit(0), F.least(bottom, p_bottom) - F.greatest(top, p_top))
    share = F.try_divide(shared.cast("double"), F.least(bottom - top, p_bottom - p_top).cast("double"))
    fresh = F.when(p_top.isNotNull() & (share >= ROW_OVERLAP), 0).otherwise(1)
    flagged = blocks.withColumn("fresh", fresh)
    return flagged.withColumn("row_id", F.sum("fresh").over(w).cast("int") - 1).drop("fresh")


def row_texts(blocks_with_rows: DataFrame, text: str = "t") -> DataFrame:
    """WIN-5: blocks of a row from left to right, joined by a blank."""
    part = F.struct(F.coalesce("x_min", "block_idx").alias("x"), F.col("block_idx"), F.col(text).alias("t"))
    parts = F.array_sort(F.collect_list(F.when(F.col(text) != "", part)))
    return blocks_with_rows.groupBy(*IMAGE, "row_id").agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("row_text"), F.count("*").alias("n")
    )


def visual_row_texts(blocks: DataFrame) -> DataFrame:
    return row_texts(rows_of_images(blocks, blocks.columns))
