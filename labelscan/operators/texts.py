"""Work on distinct texts: labels repeat their texts from image to image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscan.session import staged, tasks


def distinct_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows, dealt to all cores and written: they are few, but patterns make each of them costly.

    They are dealt by a hash of their own: by the bare columns the deal would be the one that ``distinct`` made
    already, so Spark would drop it and merge what is small into one task. Unwritten, a test of the distinct rows
    would move ahead of ``distinct`` and run on all of them.
    """
    return staged(rows.distinct().repartition(tasks(rows.sparkSession), F.xxhash64(*rows.columns)))


def once_per_text(rows: DataFrame, own: list[str], make, once: DataFrame | None = None) -> DataFrame:
    """``rows`` beside what ``make`` finds on their distinct texts, by inner join.

    What depends on the columns ``own`` alone is worked out on their distinct values; none of them may be null.
    ``make`` keeps them and adds columns, any number of rows each. Written, they stay what they are: no plan
    works them out again for every row. ``once``: the distinct values, where a caller has them already.
    """
    texts = distinct_rows(rows.select(*own)) if once is None else once.select(*own)
    return rows.join(staged(make(texts)), own)
