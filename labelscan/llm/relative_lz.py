"""Substring deduplication by relative Lempel-Ziv parsing.

Documents are put into reference blocks by ranges of doc_id. The index of a block is the sorted set of the
fingerprints of its windows of ``WINDOW`` words. Every document is parsed greedily against every indexed block
that comes earlier, and against its own block up to the place it has reached: a factor is a longest run of
words all of whose windows are found; windows over a factor's boundary are checked on their own. Factors of
``WINDOW`` words or more are duplicate spans.

Blocks are not compared two by two: their indexes are cut by fingerprint range, the ranges are merged, and
every block gets back one bit for each of its fingerprints (found in an earlier block or not). A fingerprint
counts once per block and task before the shuffle, so frequent passages do not make a large group. The shuffle
holds 8 bytes for each distinct window of a block, the texts once, and the bits.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscan.llm.common import pick, row_slices, text_bytes, window_hashes, word_bounds, word_hashes

#: Words of a window.
WINDOW = 20
#: Fingerprints that one block sends to one range, about; largest block (bytes of text) and range (bytes of fingerprints).
CELL, MOST_BLOCK, MOST_RANGE = 512, 64 << 20, 128 << 20
#: Bytes of text for a word, about; only sizes depend on it.
WORD_BYTES = 6
#: Fingerprints that a task gathers before it sends them.
FLUSH = 2_000_000

SPAN = "array<struct<start:int,size:int>>"


def layout(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Upper doc_ids of all blocks but the last, and the number of fingerprint ranges (a power of two)."""
    total, low = docs.agg(F.sum(F.octet_length("text")), F.min("doc_id")).first()
    windows = max(1, (total or 0) // WORD_BYTES)
    side = math.sqrt(windows / CELL)
    blocks = math.ceil(max(side, (total or 0) / MOST_BLOCK, 1))
    ranges = 1 << math.ceil(math.log2(max(side, windows * 8 / MOST_RANGE, 1)))
    if low is None or blocks == 1:
        return np.zeros(0, np.int64), ranges
    shares = [i / blocks for i in range(1, blocks)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * blocks))).first()[0]
    return np.unique(np.array(bounds, np.int64)), ranges


def _blocks(ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """The block of each doc_id; null ids come last."""
    known = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    return np.searchsorted(bounds, known, side="left").astype(np.int32)


def fingerprints(data: np.ndarray, offs: np.ndarray):
    """Window fingerprints of texts, each window's first word, and the n + 1 word offsets of the texts."""
    starts, ends, rows = word_bounds(data, offs)
    found, at = window_hashes(word_hashes(data, starts, ends), rows, WINDOW)
    return found, at, rows


def _send(bounds: np.ndarray, ranges: int):
    """Rows (block, part, prints): sorted distinct fingerprints of a block in one range."""
    edges = (np.arange(1, ranges, dtype=np.uint64)) * np.uint64((1 << 64) // ranges) if ranges > 1 else np.zeros(0, np.uint64)

    def rows_of(kept):
        blocks = np.concatenate([b for b, _ in kept])
        prints = np.concatenate([p for _, p in kept])
        order = np.argsort(blocks, kind="stable")
        blocks, prints = blocks[order], prints[order]
        who, part, what = [], [], []
        for block in np.unique(blocks).tolist():
            lo, hi = np.searchsorted(blocks, [block, block + 1])
            own = np.unique(prints[lo:hi])
            cuts = np.concatenate([[0], np.searchsorted(own, edges), [len(own)]])
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                who.append(block)
                part.append(k)
                what.append(own[cuts[k] : cuts[k + 1]].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(who, pa.int32()), pa.array(part, pa.int32()), pa.array(what, pa.binary())], names=["block", "part", "prints"])

    def run(batches):
        kept, n = [], 0
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            block = _blocks(batch.column(0), bounds)
            for i, j in row_slices(offs):
                found, at, rows = fingerprints(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                kept.append((block[i:j][np.searchsorted(rows, at, side="right") - 1], found))
                n += len(found)
                if n > FLUSH:
                    yield rows_of(kept)
                    kept, n = [], 0
        if n:
            yield rows_of(kept)

    return run


def _reply(cells: pa.Table) -> pa.Table:
    """For one range: per block, a bit for each of its distinct fingerprints, set if an earlier block has it."""
    blocks = cells.column("block").to_numpy()
    lists = [np.frombuffer(x, np.uint64) for x in cells.column("prints").to_pylist()]
    prints, owner = np.concatenate(lists), np.repeat(blocks, [len(x) for x in lists])
    order = np.lexsort((owner, prints))
    prints, owner = prints[order], owner[order]
    new = np.ones(len(prints), bool)
    new[1:] = (prints[1:] != prints[:-1]) | (owner[1:] != owner[:-1])
    prints, owner = prints[new], owner[new]
    first = np.ones(len(prints), bool)
    first[1:] = prints[1:] != prints[:-1]
    by_block = np.argsort(owner, kind="stable")
    owner, later = owner[by_block], ~first[by_block]
    who, at = np.unique(owner, return_index=True)
    bits = [np.packbits(x).tobytes() for x in np.split(later, at[1:])]
    part = cells.column("part")[0].as_py()
    return pa.table({"block": pa.array(who, pa.int32()), "part": pa.array([part] * len(who), pa.int32()), "n": pa.array(np.diff(np.append(at, len(owner))), pa.int32()), "bits": pa.array(bits, pa.binary())})


def _tag(bounds: np.ndarray):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_blocks(batch.column(0), bounds)), batch.column(0), batch.column(1)], names=["block", "doc_id", "text"])

    return run


def _parse(full: bool):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        ids = docs.column("doc_id").combine_chunks()
        texts = docs.column("text").combine_chunks().cast(pa.large_string()).fill_null("")
        known = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        # documents of one doc_id come in the order of their texts
        order = np.argsort(known, kind="stable")
        if len(known) > 1 and (known[order][1:] == known[order][:-1]).any():
            order = np.array(sorted(range(len(known)), key=lambda i: (known[i], texts[i].as_py())))
        texts = texts.take(pa.array(order))
        data, offs = text_bytes(texts)
        pieces = [fingerprints(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in row_slices(offs)]
        base = np.concatenate([[0], np.cumsum([p[2][-1] for p in pieces])]).astype(np.int64)
        prints = np.concatenate([p[0] for p in pieces])
        at = np.concatenate([p[1] + b for p, b in zip(pieces, base, strict=False)])
        rows = np.concatenate([np.zeros(1, np.int64), *[p[2][1:] + b for p, b in zip(pieces, base, strict=False)]])
        own, first, which = np.unique(prints, return_index=True, return_inverse=True)
        earlier = [np.zeros(0, bool)]
        if replies.num_rows:
            parts = replies.sort_by("part")
            earlier = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in zip(parts.column("n").to_pylist(), parts.column("bits").to_pylist(), strict=True)]
        earlier = np.concatenate(earlier)
        if len(earlier) != len(own):
            raise ValueError("a block and the reply to it differ")
        repeated = earlier[which] | (np.arange(len(prints)) != first[which])
        # factors: words under repeated windows
        change = np.zeros(rows[-1] + 1, np.int64)
        np.add.at(change, at[repeated], 1)
        np.subtract.at(change, at[repeated] + WINDOW, 1)
        gone = np.cumsum(change[:-1]) > 0
        raw, kept, spans = data.tobytes(), [], []
        for i in range(len(rows) - 1):
            words = raw[offs[i] : offs[i + 1]].split()
            drop = gone[rows[i] : rows[i + 1]]
            if drop.any():
                step = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])))
                spans.append([{"start": int(a), "size": int(b - a)} for a, b in zip(step[::2], step[1::2], strict=True)])
                words = [words[k] for k in np.flatnonzero(~drop)]
            else:
                spans.append([])
            kept.append(b" ".join(words))
        removed = np.add.reduceat(np.append(gone, False), rows[:-1]) * (np.diff(rows) > 0) if len(rows) > 1 else np.zeros(0, np.int64)
        out = {
            "doc_id": ids.take(pa.array(order)), "n_words": pa.array(np.diff(rows), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept],
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())]))),
        }
        return pa.table(out | ({"kept": pa.array([x.decode() for x in kept], pa.string())} if full else {}))

    return run


def remove_repeats(docs: DataFrame, full: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (start and size in words) and, if ``full``, kept (the text left).

    A word goes if it lies in a window of 20 words whose sequence also starts earlier: in a smaller doc_id, or
    before it in the same document. Null doc_ids come last, rows of one doc_id in the order of their texts;
    of repeated rows the first stays. Null texts have no words. An empty table gives no rows.
    """
    rows = pick(docs, doc_id="long", text="string")
    bounds, ranges = layout(rows)
    cells = rows.mapInArrow(_send(bounds, ranges), "block int, part int, prints binary")
    replies = cells.groupBy("part").applyInArrow(_reply, "block int, part int, n int, bits binary")
    tagged = rows.mapInArrow(_tag(bounds), "block int, doc_id long, text string")
    schema = f"doc_id long, n_words long, n_removed long, kept_sha256 string, spans {SPAN}" + ", kept string" * full
    return tagged.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_parse(full), schema)
