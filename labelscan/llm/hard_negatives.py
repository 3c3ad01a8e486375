"""Hard negatives by threshold joins over an inverted index whose dimensions are cut by norm bounds.

Anchors are a stated set of rows; each is held against all rows. Rows and anchors are dealt by hash into blocks
of bounded size, and each pair of a row block and an anchor block is one cell, worked on by one Arrow task.

In a cell, ``Index`` orders the dimensions by falling energy. For anchors with thresholds ``t`` a row's trailing
dimensions are left out of the index from where the norm of its remainder, times that of any anchor's, stays
below ``t``: pairs that meet only there cannot reach it. Partial scores are accumulated over the posting lists
of the groups of dimensions, pairs whose partial score and remaining norms stay below their thresholds are
pruned, and the others are completed exactly.

* Positives, the ``k`` nearest rows of the same label: the threshold is the k-th score found so far and rises.
* Negatives, rows of other labels in a window of scores below each positive: thresholds start high in the
  windows and are lowered in rounds; a window is closed once it holds enough rows, because every row above the
  threshold has been found by then. The last round reaches the windows' lower ends.

A cell returns at most ``k`` rows for each anchor or window, so common vectors do not multiply rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscan.llm.common import pick, staged

#: Most rows of a block, rows of a block while there are fewer than ``SPREAD`` blocks, and that number.
MOST_BLOCK, LEAST_BLOCK, SPREAD = 1 << 17, 1 << 10, 32
#: Dimensions of a group, rows between two rises of the threshold, and partial scores held at once.
GROUP, STEP, SCORES = 8, 4096, 1 << 22
#: Lower thresholds of the rounds, in percent of the positive's score; the window's lower end comes last.
ROUNDS = (80, 65)
#: Whole numbers up to here are exact as doubles.
EXACT = 2.0**53
#: Room for rounding in norm bounds.
ROOM = 1e-9


class Index:
    """Rows (vectors of whole numbers) as posting lists of groups of dimensions."""

    def __init__(self, rows: np.ndarray):
        self.order = np.argsort(-(rows * rows).sum(axis=0), kind="stable")
        self.rows = np.ascontiguousarray(rows[:, self.order])
        self.starts = np.arange(0, rows.shape[1] + GROUP, GROUP)
        self.norms = self._remaining(self.rows)
        self.largest = np.abs(rows).max(initial=0.0)

    def _remaining(self, x: np.ndarray) -> np.ndarray:
        """Norms of what is left of each vector from each group on; 0 behind the last."""
        out = np.zeros((len(x), len(self.starts)))
        for g, s in enumerate(self.starts[:-1]):
            out[:, g] = np.sqrt((x[:, s:] * x[:, s:]).sum(axis=1))
        return out

    def _cuts(self, norms: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first group of each row that the index leaves out."""
        groups = len(self.starts) - 1
        if len(least) == 0 or least.min() <= 0:
            return np.full(len(self.rows), groups)
        with np.errstate(divide="ignore"):
            bound = (least[:, None] / norms).min(axis=0)
        return (self.norms * (1 + ROOM) < bound).argmax(axis=1)

    def search(self, anchors: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, rows, scores) with all rows whose score is at least the anchor's threshold."""
        if not len(self.rows):
            return
        anchors = anchors[:, self.order]
        if max(self.largest, np.abs(anchors).max(initial=0.0)) ** 2 * max(1, anchors.shape[1]) >= EXACT:
            yield from self._search_large(anchors, least)
            return
        own = self._remaining(anchors)
        at_once = max(1, SCORES // len(self.rows))
        # anchors of like thresholds share an index
        by_least = np.argsort(-least, kind="stable")
        for k in range(0, len(anchors), at_once):
            some = by_least[k : k + at_once]
            yield from self._search_some(anchors[some], own[some], least[some], some)

    def _search_some(self, anchors, norms, least, names):
        cuts = self._cuts(norms, least)
        place = np.argsort(-cuts, kind="stable")
        cuts = cuts[place]
        rows, row_norms = self.rows[place], self.norms[place]
        total = np.zeros((len(anchors), len(rows)))
        for g, s in enumerate(self.starts[:-1]):
            listed = int(np.searchsorted(-cuts, -g, side="left"))  # rows with a cut behind g
            if not listed:
                break
            total[:, :listed] += anchors[:, s : s + GROUP] @ rows[:listed, s : s + GROUP].T
        left = row_norms[np.arange(len(rows)), cuts]
        for c in np.unique(cuts):
            here = np.flatnonzero(cuts == c)
            s, part = self.starts[c], total[:, here]
            if s >= rows.shape[1]:
                continue
            open_ = (part + norms[:, c, None] * left[here] * (1 + ROOM) + ROOM) >= least[:, None]
            if open_.mean() > 0.25:
                part = part + anchors[:, s:] @ rows[here, s:].T
            else:
                a, r = np.nonzero(open_)
                part = np.full(part.shape, -np.inf)
                for k in range(0, len(a), SCORES // 64):
                    a_, r_ = a[k : k + SCORES // 64], r[k : k + SCORES // 64]
                    part[a_, r_] = total[a_, here[r_]] + np.einsum("ij,ij->i", anchors[a_, s:], rows[here[r_], s:])
            total[:, here] = part
        for a, name in enumerate(names):
            found = np.flatnonzero(total[a] >= least[a])
            yield int(name), place[found], total[a, found].astype(np.int64)

    def _search_large(self, anchors, least):
        """Numbers too large for exact doubles: Python's whole numbers, all pairs of the cell."""
        rows = [list(map(int, x)) for x in self.rows]
        for a, x in enumerate(anchors):
            x = list(map(int, x))
            scores = [sum(p * q for p, q in zip(x, y, strict=True)) for y in rows]
            found = np.array([i for i, s in enumerate(scores) if s >= least[a]], np.int64)
            yield a, found, np.array([scores[i] for i in found], np.int64)  # beyond 64 bits: OverflowError


def _first(rows: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n rows of highest score, then lowest place."""
    if len(rows) > n:
        level = np.partition(scores, len(scores) - n)[len(scores) - n]
        near = scores >= level
        rows, scores = rows[near], scores[near]
    order = np.lexsort((rows, -scores))[:n]
    return rows[order], scores[order]


def _vectors(table: pa.Table, width: int) -> np.ndarray:
    """The column v as a matrix; missing trailing components are 0."""
    column = table.column("v").combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _cell(rows: pa.Table, anchors: pa.Table):
    """Rows by vec_id, and the vectors of both sides."""
    rows = rows.sort_by([("vec_id", "ascending"), ("key", "ascending")])
    width = max([0, *(pc.max(pc.list_value_length(t.column("v"))).as_py() or 0 for t in (rows, anchors))])
    return rows, _vectors(rows, width), _vectors(anchors, width)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


FOUND = "key long, slot int, vec_id long, score long"


def _out(found: list[tuple[int, int, np.ndarray, np.ndarray]], ids: np.ndarray) -> pa.Table:
    size = [len(rows) for _, _, rows, _ in found]
    whole = lambda k, kind: np.concatenate([np.asarray(x[k], kind) for x in found]) if found else np.zeros(0, kind)
    return pa.table({
        "key": pa.array(np.repeat(np.array([x[0] for x in found], np.int64), size)), "slot": pa.array(np.repeat(np.array([x[1] for x in found], np.int32), size)),
        "vec_id": pa.array(ids[whole(2, np.int64)] if found else np.zeros(0, np.int64)), "score": pa.array(whole(3, np.int64)),
    })


def _positives(k: int):
    def run(_, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _out([], np.zeros(0, np.int64))
        rows, x, a = _cell(rows, anchors)
        labels, keys, ids = (_numbers(rows, c) for c in ("label", "key", "vec_id"))
        anchor_labels, anchor_keys = (_numbers(anchors, c) for c in ("label", "key"))
        out = []
        for label in np.unique(anchor_labels):
            own, near = np.flatnonzero(anchor_labels == label), np.flatnonzero(labels == label)
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own]
            least = np.full(len(own), -np.inf)
            for s in range(0, len(near), STEP):
                part = near[s : s + STEP]
                for i, found, scores in Index(x[part]).search(a[own], least):
                    found = part[found]
                    other = keys[found] != anchor_keys[own[i]]
                    best[i] = _first(np.concatenate([best[i][0], found[other]]), np.concatenate([best[i][1], scores[other]]), k)
                    if len(best[i][0]) == k:
                        least[i] = best[i][1][-1]
            out.extend((anchor_keys[own[i]], 0, *best[i]) for i in range(len(own)))
        return _out(out, ids)

    return run


def _negatives(k: int, percent: int, high: int):
    def run(_, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _out([], np.zeros(0, np.int64))
        rows, x, a = _cell(rows, anchors)
        labels, ids = _numbers(rows, "label"), _numbers(rows, "vec_id")
        anchor_labels, anchor_keys = (_numbers(anchors, c) for c in ("label", "key"))
        windows = [[(w["slot"], -(-percent * w["score"] // 100), high * w["score"] // 100) for w in own] for own in anchors.column("windows").to_pylist()]
        least = np.array([min(low for _, low, _ in own) for own in windows], np.float64)
        out = []
        for i, found, scores in Index(x).search(a, least):
            other = labels[found] != anchor_labels[i]
            found, scores = found[other], scores[other]
            for slot, low, top in windows[i]:
                inside = (scores >= low) & (scores <= top)
                out.append((anchor_keys[i], slot, *_first(found[inside], scores[inside], k)))
        return _out(out, ids)

    return run


def _blocks(n: int) -> int:
    return max(1, -(-n // MOST_BLOCK), min(SPREAD, -(-n // LEAST_BLOCK)))


def _cells(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int, work) -> DataFrame:
    """What ``work`` finds in each pair of a row block and an anchor block."""
    block = lambda n: F.pmod(F.xxhash64("key"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.select("key", "vec_id", "label", "v", block(row_blocks).alias("rb"), every(anchor_blocks).alias("ab"))
    # columns of their own: a cogroup takes a column that both sides share for one
    right = anchors.select(*[F.col(c).alias(c) for c in anchors.columns], block(anchor_blocks).alias("ab"), every(row_blocks).alias("rb"))
    return left.groupBy("rb", "ab").cogroup(right.groupBy("rb", "ab")).applyInArrow(work, FOUND)


def _best(found: DataFrame, n: int, *more: str) -> DataFrame:
    by = Window.partitionBy("key", *more).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def hard_negatives(vectors: DataFrame, every: int = 50, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows of ``vectors`` (vec_id, embedding, label) whose vec_id is divisible by ``every``. A
    component x counts as floor(scale * x); a score is the inner product, a whole number. An anchor's positives
    are its ``positives`` best other rows of the same label; for each of them the ``negatives`` best rows of
    other labels with ``low`` to ``high`` percent of the positive's score are returned (ties by smaller vec_id,
    then in an order of their own that is the same in every run).

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Rows equal
    in vec_id, label and vector count once; rows that share only the vec_id are rows of their own. Vectors of
    different lengths are filled up with zeros. Scores beyond 64 bits raise an OverflowError. Other columns,
    also with clashing names, are ignored; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    given = pick(vectors, vec_id="long", embedding="array<double>", label="long").where("vec_id is not null and label is not null and embedding is not null")
    finite = given.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # larger doubles are whole already and may not fit a long
    whole = F.transform("embedding", lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale))
    rows = staged(finite.select("vec_id", "label", whole.alias("v")).distinct().withColumn("key", F.xxhash64("vec_id", "label", "v")))
    anchors = rows.where(F.col("vec_id") % every == 0)
    n_rows, n_anchors = rows.count(), anchors.count()
    row_blocks, anchor_blocks = _blocks(n_rows), max(1, -(-n_anchors // MOST_BLOCK))

    best = _best(_cells(rows, anchors, row_blocks, anchor_blocks, _positives(positives)), positives)
    # a window below a negative score is empty
    pairs = staged(best.where("score >= 0").select("key", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    open_, done = pairs, None
    for percent in (*(p for p in ROUNDS if low < p < high), low):
        windows = open_.groupBy("key").agg(F.collect_list(F.struct("slot", F.col("positive_score").alias("score"))).alias("windows"))
        found = _cells(rows, anchors.join(windows, "key"), row_blocks, anchor_blocks, _negatives(negatives, percent, high))
        found = staged(_best(found, negatives, "slot"))
        if percent == low:
            closed = found
        else:
            full = found.where(F.col("rank") == negatives).select("key", "slot")
            closed = found.join(full, ["key", "slot"], "left_semi")
            open_ = staged(open_.join(full, ["key", "slot"], "left_anti"))
        done = closed if done is None else done.unionByName(closed)
        if percent == low or not open_.limit(1).count():
            break
    named = done.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(pairs, ["key", "slot"])
    names = anchors.select("key", F.col("vec_id").alias("anchor_id"))
    return named.join(names, "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
