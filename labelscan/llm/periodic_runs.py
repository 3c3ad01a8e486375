"""Periodic runs of words: maximal stretches that repeat with a period, and texts with the repetitions taken out.

A run is a stretch of words of one text in which words ``q`` apart are identical, ``q`` is its smallest period,
it is at least ``max(6, 4 * q)`` words long, and no neighbouring word extends it.

* Texts of a slice are laid end to end as word numbers, longest first, each ended by a number of its own, so
  that nothing reaches over a text. Period ``p`` then looks only at the texts of ``4 * p`` words or more.
* Harmonic grid: every run of period ``p`` holds three grid places ``k * p`` in a row whose words equal those
  ``p`` further on, so the places looked at are n/1 + n/2 + ... in number.
* From such a place the run is measured by two longest common extensions, one forwards and one backwards (on
  the reversed words). ``Extensions`` sorts only the suffixes at places of a difference cover, compares fewer
  than ``COVER`` words to reach a pair of sorted places, and reads the rest from a sparse table over the common
  block prefixes of neighbouring suffixes. It is built only over texts that have such places.
* A run that a multiple of its period finds again has the same ends; the smallest period stays.

Words are compared exactly (numbers of a dictionary of the slice). A text is one record, so its runs are found
inside one task; there is no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscan.llm.common import pick, row_slices, text_bytes

#: Shortest run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: A perfect difference set: every difference modulo 31 is one of two of its members (fixed values).
COVER, MEMBERS = 31, (1, 5, 11, 24, 25, 27)
#: Bytes of text that one slice holds (a longer text is a slice of its own), and queries answered at once.
SLICE, QUERIES = 4 << 20, 1 << 20

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _shifts() -> np.ndarray:
    """For each difference the member x whose partner x + difference is a member, too."""
    out = np.full(COVER, -1)
    for x in MEMBERS:
        for y in MEMBERS:
            out[(y - x) % COVER] = x
    return out


SHIFTS = _shifts()


class Extensions:
    """Longest common prefixes of the suffixes of ``words``, for many pairs of places at once.

    The two places of a query must differ, and their common prefix must end before the end of ``words``.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        # numbers of their own behind the end keep the last blocks apart
        self.words = np.concatenate([words, np.arange(-COVER - 1, -1, dtype=words.dtype) + min(0, int(words.min(initial=0)))])
        own = [np.arange(x, n, COVER) for x in MEMBERS]
        places = np.concatenate(own) if n else np.zeros(0, np.int64)
        m = len(places)
        self.at = np.full(n + COVER + 1, -1, np.int32)
        self.at[places] = np.arange(m)
        blocks = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.words, COVER)[places])
        rank = np.unique(blocks.view(f"V{blocks.itemsize * COVER}").ravel(), return_inverse=True)[1].astype(np.int64) if m else np.zeros(0, np.int64)
        last = np.repeat(np.cumsum([len(x) for x in own]), [len(x) for x in own])
        # prefix doubling over blocks: level k ranks 2**k blocks, -1 stands behind a residue's last block
        levels, step = [rank], 1
        while m and rank.max() < m - 1:
            to = np.arange(m) + step
            inside = to < last
            second = np.where(inside, rank[np.where(inside, to, 0)], -1 - np.arange(m) % COVER)
            key = rank * (m + COVER + 1) + (second + COVER)
            rank = np.unique(key, return_inverse=True)[1]
            if np.array_equal(rank, levels[-1]):
                break
            levels.append(rank)
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.order = np.empty(m, np.int32)
        self.order[order] = np.arange(m)
        # blocks that neighbours in the order share, read off the levels from the longest
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(m - 1, 0), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < m) & (b < m)
            same = inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])
            for x in (a, b):
                x[same] += 1 << k
            common[same] += 1 << k
        self.table = [common]
        while 2 << (len(self.table) - 1) <= len(common):
            half, row = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(row[:-half], row[half:]))

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, up to ``most``."""
        got = np.zeros(len(i), np.int64)
        live = np.flatnonzero(most > 0)
        for t in range(COVER):
            live = live[self.words[i[live] + t] == self.words[j[live] + t]]
            got[live] = t + 1
            live = live[most[live] > t + 1]
            if not len(live):
                break
        return got

    def _blocks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common blocks of two sorted suffixes: the least value between them."""
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level):
            own = level == k
            row = self.table[k]
            out[own] = np.minimum(row[low[own]], row[high[own] - (1 << k)])
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ahead = (SHIFTS[(j - i) % COVER] - i) % COVER
        got = self._compare(i, j, ahead)
        on = np.flatnonzero(got == ahead)
        i, j = i[on] + ahead[on], j[on] + ahead[on]
        far = self._blocks(self.order[self.at[i]], self.order[self.at[j]]) * COVER
        got[on] += far + self._compare(i + far, j + far, np.full(len(on), COVER))
        return got


def _grid(words: np.ndarray, ends: np.ndarray, sizes: np.ndarray):
    """(places, periods) of grid places with two more behind them, all equal to the words one period further.

    ``sizes`` are the words of the texts, falling; ``ends`` the places behind their last words.
    """
    for p in range(1, int(sizes[0]) // LEAST_PERIODS + 1 if len(sizes) else 0):
        texts = int(np.searchsorted(-sizes, -max(LEAST_PERIODS * p, LEAST_WORDS), side="right"))
        if not texts:
            break
        grid = words[: ends[texts - 1] : p]
        same = grid[:-1] == grid[1:]
        found = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(found):
            yield found * p, p


def find_runs(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of the texts, given as arrays of word numbers from 0 on."""
    sizes = np.array([len(x) for x in texts], np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    whole, ends = _lay([texts[k] for k in by_size])
    some = [(at, np.full(len(at), p)) for at, p in _grid(whole, ends, sizes[by_size])]
    empty = np.zeros(0, np.int64)
    if not some:
        return empty, empty, empty, empty
    places, periods = (np.concatenate(x) for x in zip(*some, strict=True))
    # only the texts with such places are sorted
    owner = np.searchsorted(ends, places, side="right")
    kept = np.unique(owner)
    part, part_ends = _lay([texts[by_size[k]] for k in kept])
    begins = np.concatenate([[1], ends[:-1] + 1])
    part_begins = np.concatenate([[1], part_ends[:-1] + 1])
    at = np.searchsorted(kept, owner)
    places = places - begins[owner] + part_begins[at]
    forward, backward = Extensions(part), Extensions(part[::-1].copy())
    found = []
    for k in range(0, len(places), QUERIES):
        i, p, text = places[k : k + QUERIES], periods[k : k + QUERIES], at[k : k + QUERIES]
        inside = i >= part_begins[text]  # a grid place may be an end mark
        i, p, text = i[inside], p[inside], text[inside]
        ahead = forward(i, i + p)
        far = ahead > 2 * p
        i, p, text, ahead = i[far], p[far], text[far], ahead[far]
        behind = backward(len(part) - i, len(part) - i - p)
        size = p + ahead + behind
        run = size >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
        found.append(np.unique(np.stack([by_size[kept[text[run]]], (i - behind - part_begins[text])[run], size[run], p[run]], axis=1), axis=0))
    rows = np.unique(np.concatenate(found), axis=0)
    # of rows with the same text, start and length the first has the smallest period
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    text, start, size, period = rows[first].T
    order = np.lexsort((period, start, text))
    return text[order], start[order], size[order], period[order]


def _lay(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end, with a mark of its own before the first and behind each; places of the marks behind."""
    ends = np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)
    out = np.full(int(ends[-1]) + 1 if len(texts) else 1, -1, np.int32)
    for x, end in zip(texts, ends, strict=True):
        out[end - len(x) : end] = x
    out[ends] = -2 - np.arange(len(ends))
    return out, ends


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _run_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offs = text_bytes(batch.column("text"))
    collapsed, n_words, run_offs, runs = [], [], [0], [[], [], []]
    for a, b in row_slices(offs, SLICE):
        numbers = _Numbers()
        words = [data[offs[k] : offs[k + 1]].tobytes().split() for k in range(a, b)]
        text, start, size, period = find_runs([np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)) for w in words])
        bounds = np.searchsorted(text, np.arange(b - a + 1))
        for k, own in enumerate(words):
            n_words.append(len(own))
            here = slice(bounds[k], bounds[k + 1])
            if here.start < here.stop:
                keep = np.ones(len(own), bool)
                for s, z, p in zip(start[here], size[here], period[here], strict=True):
                    keep[s + p : s + z] = False
                own = [own[i] for i in np.flatnonzero(keep)]
            collapsed.append(b" ".join(own))
        run_offs.extend((run_offs[-1] + bounds[1:]).tolist())
        for into, values in zip(runs, (start, size, period), strict=True):
            into.append(values)
    values = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in runs], ["start", "length", "period"])
    columns = {
        "doc_id": batch.column("doc_id").cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()),
        "runs": pa.ListArray.from_arrays(pa.array(run_offs, pa.int32()), values), "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
    }
    return pa.RecordBatch.from_pydict(columns)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, runs by start and period, and the collapsed text.

    Words are what ASCII white space separates. In the collapsed text, words joined by one space, every word
    that a run contains after its first period is left out. A null, empty or blank text has no runs and an
    empty collapsed text; rows are judged one by one, so repeated rows, equal doc_ids and a null doc_id stay as
    they are; other columns, also with clashing names, are ignored; texts of any length are read whole, by one
    task each; an empty table gives an empty table.
    """
    rows = pick(docs, doc_id="long", text="string")

    def run(batches):
        yield from map(_run_batch, batches)

    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def plant(docs: DataFrame) -> DataFrame:
    """doc_id and text; one text in ten (by the CRC of its doc_id) gets a period from a place on.

    With h = crc32(decimal doc_id), h % 10 = 0 and g = h / 10, each word i >= a of the n words becomes word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) / (3 + g % 8), all divisions whole. A text without
    words and one with a null doc_id stay as they are.
    """
    rows = pick(docs, doc_id="long", text="string")
    h = F.crc32(F.col("doc_id").cast("string"))
    hit = rows.withColumn("words", F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    n, g = F.size("words"), F.floor(h / 10)
    hit = hit.withColumn("from", F.when(n > 0, g % n)).withColumn("period", F.lit(1) + F.floor((n - F.col("from")) / (F.lit(3) + g % 8)))
    at = lambda i: F.when(i < F.col("from"), i).otherwise(F.col("from") + (i - F.col("from")) % F.col("period"))
    made = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.get("words", at(i).cast("int")))
    return hit.select("doc_id", F.when(F.col("from").isNotNull(), F.concat_ws(" ", made)).otherwise(F.col("text")).alias("text"))


def _longest(runs: Column) -> Column:
    """The longest run, then the one that starts first, then the one of the smallest period."""
    return F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))


def run_digests(found: DataFrame) -> DataFrame:
    """Digest columns of the rows of ``periodic_runs``: the longest run, and hashes of all runs and of the text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = found.withColumn("top", _longest(F.col("runs")))
    length = -F.col("top.less")
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * length / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
