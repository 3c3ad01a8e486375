"""Token counts by a compiled finite-state tokenizer.

The BPE rule is compiled into a deterministic transducer over bytes. Its state is what the rest of a
pre-token can depend on: the longest suffix read so far that begins a token and, at each place where a later
token may start, the last token of the encoding up to there and the count of tokens relative to the present.
A transition on a byte emits the change of the token count (zero, one or negative: reading on can merge).
States and transitions are built when first met and shared by all texts of a worker; the machine is finite
and does not depend on the data.

A text is cut into chunks; the state map of a chunk is (bytes before its first reset, tokens between its
resets, bytes after its last reset), where a reset is a white space after another character: there the machine
is in its start state, whatever it read before. Maps of neighbouring chunks compose associatively; a prefix
scan of pairs composes all chunks of a document in a logarithmic number of rounds. All pieces of a round are
run through the machine in lockstep, one byte of each piece per step.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelscan.llm.common import pick, row_slices, text_bytes
from labelscan.llm.pretokens import SPACE, Splitter, read_tokenizer

#: Code points of a chunk.
CHUNK = 1 << 14
#: Pieces below this number are stepped one by one.
NARROW = 24
#: The machine is dropped and built anew beyond so many transitions (about 200 MB), which bounds memory.
MOST_EDGES = 1_500_000


class Transducer:
    """The compiled machine: ``count`` runs it over many pre-tokens."""

    def __init__(self, spec: dict):
        self.tokens = {b: i for i, b in spec["tokens"].items()}
        self.names = spec["tokens"]
        self.prefixes = {b[:n] for b in self.tokens for n in range(1, len(b) + 1)}
        self.merges, self.pairs = spec["merges"], spec["pairs"]
        self.known: dict[int, bool] = {}
        self.sorted = sorted(self.tokens)
        self.longer: dict[bytes, list[int]] = {}
        self._reset()

    def _reset(self):
        # a state: (suffix, ((distance, last token or -1 at the start of the piece, count), ...))
        self.states = [(b"", ((0, -1, 0),))]
        self.numbers = {self.states[0]: 0}
        self.edges: dict[int, int] = {}
        self.hopes: dict[tuple[bytes, int], bool] = {}
        self.bits = 16
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int64)

    def seam(self, x: int, y: int, until: int) -> bool:
        """Whether no merge rule of a rank below ``until`` joins the two sides while they stand side by side.

        Merges are undone, latest first; of equal rank, the left one came first.
        """
        while self.pairs.get((x, y), until) >= until:
            if x > y and x in self.merges:
                until, x = x, self.merges[x][1]
            elif y in self.merges:
                until, y = y + 1, self.merges[y][0]
            else:
                return True
        return False

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` can follow ``a`` (-1: the start of the piece) in an encoding."""
        known = self.known.get(a << 20 | b)
        if known is None:
            if a >= 0:
                known = self.seam(a, b, 1 << 30)
            else:
                known = b not in self.merges or (all(self.fits(-1, x) for x in self.merges[b]) and self.seam(*self.merges[b], b))
            if len(self.known) > MOST_EDGES:
                self.known.clear()
            self.known[a << 20 | b] = known
        return known

    def useful(self, start: bytes, last: int) -> bool:
        """Whether some longer token that begins with ``start`` can follow ``last``."""
        if last < 0:
            return True
        found = self.hopes.get((start, last))
        if found is None:
            longer = self.longer.get(start)
            if longer is None:
                lo, hi = bisect_left(self.sorted, start), bisect_left(self.sorted, start + b"\xff" * 200)
                longer = self.longer[start] = [self.tokens[t] for t in self.sorted[lo:hi] if t != start]
            found = self.hopes[start, last] = any(self.fits(last, t) for t in longer)
        return found

    def edge(self, key: int) -> int:
        """The transition on a byte: the next state and the emitted count, packed."""
        if key in self.edges:
            return self.edges[key]
        suffix, places = self.states[key >> 8]
        suffix += bytes([key & 255])
        for distance, last, count in places:  # far places first: the longest token
            token = self.tokens.get(suffix[len(suffix) - distance - 1 :])
            if token is not None and self.fits(last, token):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        emitted = count + 1
        while suffix and suffix not in self.prefixes:
            suffix = suffix[1:]
        ends = {d + 1: (t, c - emitted) for d, t, c in places} | {0: (token, 0)}
        places = []
        for d in range(len(suffix), -1, -1):
            start = suffix[len(suffix) - d :]
            if d in ends and (d == 0 or (start in self.prefixes and self.useful(start, ends[d][0]))):
                places.append((d, *ends[d]))
        state = (suffix, tuple(places))
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        packed = self.numbers[state] << 8 | emitted + 128
        self.edges[key] = packed
        if len(self.edges) * 3 > len(self.keys):
            self.bits += 1
            self.keys = np.full(1 << self.bits, -1, np.int64)
            self.values = np.zeros(1 << self.bits, np.int64)
            known = np.fromiter(self.edges, np.int64, len(self.edges))
            for k, v in zip(known.tolist(), self.edges.values(), strict=True):
                self._put(k, v)
        else:
            self._put(key, packed)
        return packed

    def _slot(self, keys):
        return ((keys * 0x9E3779B1) & 0xFFFFFFFFFFFF) >> 11 & ((1 << self.bits) - 1)

    def _put(self, key: int, value: int):
        at = int(self._slot(key))
        while self.keys[at] != -1:
            at = (at + 1) & ((1 << self.bits) - 1)
        self.keys[at], self.values[at] = key, value

    def step(self, keys: np.ndarray) -> np.ndarray:
        """Transitions of many pieces at once, by open addressing."""
        at = self._slot(keys)
        found = self.keys[at]
        out = self.values[at]
        left = np.flatnonzero(found != keys)
        while len(left):
            new = left[found[left] == -1]
            if len(new):
                for key in np.unique(keys[new]).tolist():
                    self.edge(key)
                at = self._slot(keys)  # the table may have grown
                left = np.flatnonzero(self.keys[at] != keys)
                out = self.values[at]
                found = self.keys[at]
                if not len(left):
                    break
                if (found[left] == -1).any():
                    continue
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found[left] = self.keys[at[left]]
            out[left] = self.values[at[left]]
            left = left[found[left] != keys[left]]
        return out

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece ``data[start:end]``."""
        if len(self.edges) > MOST_EDGES:
            self._reset()
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        begin, size = starts[order], size[order]
        state = np.zeros(len(order), np.int64)
        total = np.zeros(len(order), np.int64)
        wide = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        for t, k in enumerate(wide.tolist()):
            if k < NARROW:
                for i in range(k):
                    now, sum_ = int(state[i]), int(total[i])
                    for byte in data[begin[i] + t : begin[i] + size[i]].tolist():
                        packed = self.edge(now << 8 | byte)
                        now, sum_ = packed >> 8, sum_ + (packed & 255) - 128
                    total[i] = sum_
                break
            packed = self.step(state[:k] << 8 | data[begin[:k] + t])
            state[:k] = packed >> 8
            total[:k] += (packed & 255) - 128
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


class Counter:
    """Counts the tokens of whole texts."""

    _kept: dict = {}

    @classmethod
    def of(cls, key: str, spec) -> Counter:
        """The worker's own counter for this tokenizer, kept between tasks."""
        if key not in cls._kept:
            cls._kept = {key: cls(spec.value)}
        return cls._kept[key]

    def __init__(self, spec: dict):
        self.split, self.machine, self.special = Splitter(spec), Transducer(spec), list(spec["special"])

    def pieces(self, text: str, seams: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start in code points, tokens) of every pre-token."""
        at, bounds = self.split(text, seams)
        return at, self.machine.count(raw, bounds[:-1], bounds[1:])

    def count(self, texts: list[str], chunk: int = CHUNK) -> np.ndarray:
        """Tokens of each text."""
        marks = np.zeros(len(texts), np.int64)
        parts: list[str] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            found = [text]
            for mark in self.special:
                if mark in text:
                    found = [x for part in found for x in part.split(mark)]
            marks[i] = len(found) - 1
            for x in found:
                if x:
                    parts.append(x)
                    owner.append(i)
        if not parts:
            return marks
        whole = "".join(parts)
        cps = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        white = self.split.kinds[cps] == SPACE
        resets = np.zeros(len(cps), bool)
        resets[1:] = white[1:] & ~white[:-1]
        ends = np.cumsum([len(x) for x in parts])
        starts = ends - [len(x) for x in parts]
        # chunks of every part; a chunk's map: [begin, first reset), count, [last reset, end)
        first = np.concatenate([np.arange(a, b, chunk) for a, b in zip(starts, ends, strict=True)])
        part = np.repeat(np.arange(len(parts)), -(-(ends - starts) // chunk))
        last = np.append(first[1:], len(cps))
        reset_at = np.flatnonzero(resets)
        lo, hi = np.searchsorted(reset_at, first, side="right"), np.searchsorted(reset_at, last)
        synced = lo < hi
        head = np.where(synced, reset_at[np.minimum(lo, len(reset_at) - 1)] if len(reset_at) else last, last)
        tail = np.where(synced, reset_at[np.maximum(hi - 1, 0)] if len(reset_at) else first, first)
        total = np.zeros(len(parts), np.int64)
        self._run(whole, cps, head[synced], tail[synced], part[synced], total)
        while len(first) > 1 and (part[1:] == part[:-1]).any():
            # pairs inside a part, from its start: even positions take their right neighbour in
            rank = np.arange(len(part)) - np.searchsorted(part, part)
            left = np.flatnonzero((rank % 2 == 0) & np.append(part[1:] == part[:-1], False))
            right = left + 1
            both, only_l, only_r = synced[left] & synced[right], synced[left] & ~synced[right], ~synced[left] & synced[right]
            # what lies between the last reset of the left and the first of the right is complete now
            self._run(whole, cps, tail[left][both], head[right][both], part[left][both], total)
            head[left] = np.where(synced[left], head[left], np.where(only_r, head[right], last[right]))
            tail[left] = np.where(both | only_r, tail[right], np.where(only_l, tail[left], first[left]))
            synced[left] |= synced[right]
            last[left] = last[right]
            keep = np.ones(len(first), bool)
            keep[right] = False
            first, last, head, tail, synced, part = (x[keep] for x in (first, last, head, tail, synced, part))
        # the text's own ends close the outermost pieces
        self._run(whole, cps, first, np.where(synced, head, last), part, total)
        self._run(whole, cps, tail[synced], last[synced], part[synced], total)
        np.add.at(marks, np.array(owner), total)
        return marks

    def _run(self, whole: str, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, part: np.ndarray, total: np.ndarray):
        """Add the tokens of the given stretches of text to those of their parts."""
        full = ends > starts
        starts, ends, part = starts[full], ends[full], part[full]
        if not len(starts):
            return
        if len(starts) == 1 or (starts[1:] == ends[:-1]).all():
            text = whole[starts[0] : ends[-1]]
        else:
            text = "".join([whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        size = ends - starts
        seams = np.cumsum(size) - size
        at, counts = self.pieces(text, seams, np.frombuffer(text.encode(), np.uint8))
        np.add.at(total, part[np.searchsorted(seams, at, side="right") - 1], counts)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    Null text counts as empty (0 bytes, 0 tokens); rows with null or repeated doc_id are counted row by row.
    Special tokens written in a text count one each, as the library reads them. An empty table gives no rows.
    Whole texts are counted where they lie: nothing is shuffled.
    """
    spark = docs.sparkSession
    found = read_tokenizer(tokenizer)
    key, spec = found["key"], spark.sparkContext.broadcast(found)  # about 1 MB, fixed by the file

    def run(batches):
        counter = Counter.of(key, spec)
        for batch in batches:
            _, offs = text_bytes(batch.column(1))
            for i, j in row_slices(offs):
                texts = [x or "" for x in batch.column(1).slice(i, j - i).to_pylist()]
                n = counter.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(offs[i : j + 1])), pa.array(n), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
