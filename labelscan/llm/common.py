"""What the operators of this package share: columns by name, Arrow text as bytes, word hashes, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscan.session import staged

#: Bytes of text that one vectorised step works on (a longer document is one step of its own).
SLICE_BYTES = 1 << 20
#: Fixes the random tables of the hashes.
SEED = 20_240_229


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast; an exact name wins over one that differs in case, other columns are ignored.

    Works on frames with repeated or clashing column names, because columns are found by position.
    """
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = []
    for name, kind in types.items():
        at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not at:
            raise ValueError(f"column {name} is missing")
        out.append(F.col(f"c{at[0]}").cast(kind).alias(name))
    return flat.select(*out)


def text_place(columns: list[str]) -> int:
    """Place of the column text: the first of exactly that name, else the first that differs from it in case."""
    exact = [i for i, c in enumerate(columns) if c == "text"]
    return (exact or [i for i, c in enumerate(columns) if c.lower() == "text"])[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, end to end, and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def row_slices(offs: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of rows with at most ``limit`` bytes each, one row at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# --- words and their hashes -------------------------------------------------------------------------------

#: Words end at the ASCII white space characters 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_random = np.random.default_rng(SEED)
BYTE_VALUES = _random.integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _STEP = (int(x) | 1 for x in _random.integers(0, 2**64, 2, dtype=np.uint64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[base] = have = (made[0], made[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of all words, and the n + 1 offsets of the rows in the word list."""
    word = ~IS_SPACE[data]
    first, last = word.copy(), word.copy()
    if len(data):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = offs[1:] > offs[:-1]
        begin, end = offs[:-1][full], offs[1:][full] - 1
        first[begin], last[end] = word[begin], word[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random byte values, mixed."""
    power, inverse = _power(_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` words inside one row, and each window's first word."""
    at = np.arange(max(0, len(words) - n + 1))
    if len(at):
        row_end = np.repeat(offs[1:], np.diff(offs))[: len(at)]
        at = at[at + n <= row_end]
    power, inverse = _power(_STEP, len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return mix((total[at + n] - total[at]) * inverse[at] + np.uint64(n)), at


# --- connected components ---------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour and contracts the edges, so that the number of
    nodes with edges at least halves; labels and edges are written tables, nothing reaches the driver but
    the number of edges left.
    """
    edges = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = nodes.select("node", F.col("node").alias("root"))
    while edges.limit(1).count():
        parents = staged(edges.groupBy(F.col("b").alias("child")).agg(F.min("a").alias("parent")))
        up = parents.select(F.col("child").alias("parent"), F.col("parent").alias("grand"))
        parents = staged(parents.join(up, "parent", "left").select("child", F.coalesce("grand", "parent").alias("parent")))
        moved = labels.join(parents, F.col("root") == F.col("child"), "left")
        labels = staged(moved.select("node", F.coalesce("parent", "root").alias("root")))
        pa_, pb = (parents.select(F.col("child").alias(f"c{x}"), F.col("parent").alias(f"p{x}")) for x in "ab")
        joined = edges.join(pa_, F.col("a") == F.col("ca"), "left").join(pb, F.col("b") == F.col("cb"), "left")
        ends = joined.select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y")).where("x <> y")
        edges = staged(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels
