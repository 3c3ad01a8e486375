"""Mixing documents to target weights with soft memberships.

A softmax classifier, fitted on a bounded sample of the labelled table, gives every document a posterior over the
domains. Nonnegative document rates r are fitted by projected gradient steps to the least-squares problem

    min |W^(1/2) (sum_i r_i tokens_i p_i - target * tokens)|^2,    0 <= r <= MOST, starting from r = 1,

so that the expected tokens of every domain match the targets. W is the inverse of sum_i tokens_i p_i p_i^T plus a
ridge, a share of every domain's target; both grow with the tokens, not with their squares, and documents are moved
by their posteriors, so a few very long ones do not hold up the others. A step from W never makes the fit worse.
Before it a longer step, with the W of the rates inside the bounds and a share of the other, is tried, and taken
back if it does not bring the fit closer. The steps end when the targets are met or, where the bounds rule that
out, when the gradient shows that no rates inside the bounds fit better by more than a share GAP; without either
the fit fails.

A step moves a document by its posteriors times one vector; each is one aggregation over all documents, and the
steps so far, a short list of vectors, give back every document's rate without a table per step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscan.llm.common import IS_SPACE, pick, row_slices, staged, text_bytes, word_hashes

#: Domains and their target shares of the tokens.
TARGETS = {"good": 0.90, "poor": 0.07, "toxic": 0.03}
#: Labelled documents that the classifier is fitted on (those with the smallest hashes), size of the features.
SAMPLE, FEATURES = 4000, 4096
#: Largest rate of a document, share of the ridge, gradient steps at most, and the relative error that ends them.
MOST, RIDGE, STEPS, CLOSE = 4.0, 0.005, 300, 1e-6
#: Share of the least-squares sum by which it may be above the least possible one.
GAP = 0.001

#: Kinds of bytes: white space, letters (all of UTF-8 beyond ASCII among them), digits, other signs.
KIND = np.full(256, 3, np.uint8)
KIND[IS_SPACE] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Places that the looks of pieces take; words come after them.
LOOKS = 64


def domain_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table (doc_id, quality, toxic): toxic, else poor or good by quality."""
    rows = pick(labels, doc_id="long", quality="int", toxic="int").where("doc_id is not null and quality is not null and toxic is not null")
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("q")).select("doc_id", F.when(F.col("t") > 0, "toxic").when(F.col("q") > 0, "good").otherwise("poor").alias("domain"))


def features(column: pa.Array, size: int = FEATURES):
    """(first row, last row, rows, places, weights, tokens) of slices of a text column.

    A text's features are its words (presence, damped by their number) and the looks of its pieces (capitals or
    other letters, digits, the first two signs) as shares. A piece is a run of bytes of one kind; all digits are
    one word. ``rows``, ``places`` and ``weights`` are in the order of rows; tokens are the words between ASCII
    white space.
    """
    data, offs = text_bytes(column)
    for i, j in row_slices(offs):
        part, local, n = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], j - i
        kind = KIND[part]
        edge, row_start = np.ones(len(part) + 1, bool), np.zeros(len(part) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[local] = row_start[local] = True
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        full = kind[starts] != 0
        starts, ends = starts[full], ends[full]
        kinds, owner = kind[starts], np.searchsorted(local, starts, side="right") - 1
        tokens = np.bincount(owner[row_start[starts] | (kind[starts - 1] == 0)], minlength=n)
        signs = kinds == 3
        hashes = word_hashes(_LOWER[part], starts, np.where(signs, np.minimum(starts + 2, ends), ends))
        hashes[kinds == 2] = 0
        words = np.unique(owner * size + (hashes % np.uint64(size - LOOKS)).astype(np.int64) + LOOKS)
        capital = np.zeros(len(part) + 1, np.int64)
        np.cumsum((part >= 65) & (part <= 90), out=capital[1:])
        shout = (capital[ends] - capital[starts] == ends - starts) & (ends - starts > 1)
        look = np.where(kinds == 2, 2, shout).astype(np.int64)
        two = part[starts[signs]].astype(np.int64) + np.where(ends[signs] - starts[signs] > 1, part[np.minimum(starts[signs] + 1, len(part) - 1)], 0)
        look[signs] = 3 + two % (LOOKS - 3)
        pieces, shares = np.bincount(owner, minlength=n), np.bincount(owner * LOOKS + look, minlength=n * LOOKS)
        looks = np.flatnonzero(shares)
        word_row, look_row = words // size, looks // LOOKS
        weights = np.concatenate([1 / np.sqrt(np.bincount(word_row, minlength=n))[word_row], 4 * shares[looks] / pieces[look_row]]) if len(words) else np.zeros(0)
        rows, places = np.concatenate([word_row, look_row]), np.concatenate([words % size, looks % LOOKS])
        order = np.argsort(rows, kind="stable")
        yield i, j, rows[order], places[order], weights[order], tokens


def fit_classifier(rows: list[tuple[list[int], list[float], int]], domains: int, size: int = FEATURES, steps: int = 300) -> np.ndarray:
    """Weights (size + 1, domains) of the softmax; the last row is the bias. Without rows all posteriors are equal."""
    w = np.zeros((size + 1, domains))
    if not rows:
        return w
    # at most ``SAMPLE`` by ``FEATURES`` numbers
    x = np.zeros((len(rows), size + 1), np.float32)
    x[:, size] = 1
    for k, (places, values, _) in enumerate(rows):
        x[k, places] = values
    truth = np.eye(domains)[[d for _, _, d in rows]]
    v, before, rate = w.copy(), w.copy(), 0.3
    for k in range(steps):
        score = x @ v.astype(np.float32)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        wrong = (p / p.sum(axis=1, keepdims=True) - truth) / len(rows)
        g = x.T @ wrong.astype(np.float32)
        w = v - rate * 4 * (g + 1e-5 * v)
        v, before = w + k / (k + 3) * (w - before), w
    return w


def _posteriors(weights: np.ndarray, at: int, size: int):
    """Adds tokens (words of the text) and p (posteriors) to every row."""

    def run(batches):
        domains = weights.shape[1]
        for batch in batches:
            for i, j, rows, places, values, tokens in features(batch.column(at), size):
                score = weights[-1] + np.stack([np.bincount(rows, weights=values * weights[places, d], minlength=j - i) for d in range(domains)], axis=1)
                e = np.exp(score - score.max(axis=1, keepdims=True))
                p = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * domains, pa.int32()), pa.array((e / e.sum(axis=1, keepdims=True)).ravel()))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tokens, pa.int64()), p], names=[*batch.schema.names, "tokens", "p"])

    return run


def posteriors(docs: DataFrame, labels: DataFrame, domains: list[str], sample: int = SAMPLE, size: int = FEATURES, keep: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, text, *keep, tokens, p) of every row of ``docs``."""
    rows = pick(docs, doc_id="long", text="string", **keep or {})
    chosen = domain_of(labels).where(F.col("domain").isin(domains)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def examples(batches):
        for batch in batches:
            for i, j, row, places, values, _ in features(batch.column(0), size):
                offs = pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32())
                a, b = (pa.ListArray.from_arrays(offs, pa.array(x)) for x in (places, values))
                yield pa.RecordBatch.from_arrays([a, b, batch.column(1).slice(i, j - i)], names=["a", "b", "domain"])

    # at most ``sample`` ids, hence as many examples: small by construction
    known = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("domain").alias("domain"))
    known = known.select("text", "domain").mapInArrow(examples, "a array<long>, b array<double>, domain string").collect()
    weights = fit_classifier(sorted((r.a, r.b, domains.index(r.domain)) for r in known), len(domains), size)
    return rows.mapInArrow(_posteriors(weights, 1, size), f"{_schema(rows)}, tokens long, p array<double>")


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)


def _columns(batch: pa.RecordBatch, names: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    tokens = batch.column(batch.schema.names.index(names[0])).to_numpy(zero_copy_only=False).astype(float)
    p = batch.column(batch.schema.names.index(names[1])).flatten()
    return tokens, p.to_numpy(zero_copy_only=False).reshape(len(tokens), -1) if len(tokens) else np.zeros((0, 1))


def rates_after(tokens: np.ndarray, p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates of documents with posteriors p (documents, domains) after the given gradient steps."""
    r = np.ones(len(tokens))
    for g in steps:
        r = np.clip(r - p @ g, 0, MOST)
    return np.where(tokens > 0, r, 1.0)


def partial_sums(tokens: np.ndarray, p: np.ndarray, done: list[np.ndarray]) -> np.ndarray:
    """Of some documents after the steps: tokens of the domains; products of free rates and of all; what the last step's gradient could gain at most."""
    mass, r = tokens[:, None] * p, rates_after(tokens, p, done)
    free = (r > 0) & (r < MOST)
    gain = 0.0
    if done:
        slope, before = p @ done[-1], rates_after(tokens, p, done[:-1])
        gain = tokens @ np.where(slope > 0, slope * before, slope * (before - MOST))
    return np.concatenate([r @ mass, (mass[free].T @ p[free]).ravel(), (mass.T @ p).ravel(), mass.sum(axis=0), [gain]])


def solve_rates(gather, targets: np.ndarray, steps: int = STEPS, close: float = CLOSE) -> tuple[list[np.ndarray], float]:
    """The gradient steps and the largest error of a domain as a share of all tokens; ``gather(done)`` sums partial_sums."""
    n = len(targets)
    done: list[np.ndarray] = []
    best, at, wide, tried = np.inf, None, 0.001, False
    for _ in range(steps):
        total, free, every, mass, gain = np.split(gather(done), np.cumsum([n, n * n, n * n, n]))
        free, every, tokens = free.reshape(n, n), every.reshape(n, n), max(mass.sum(), 1e-12)
        share = targets / targets.sum()
        wrong = total - share * tokens
        whole = every + RIDGE * np.diag(np.maximum(share, close)) * tokens
        weights = np.linalg.inv(whole)
        loss = wrong @ weights @ wrong
        if np.abs(wrong).max() <= close * tokens:
            return done, float(np.abs(wrong).max() / tokens)
        if tried and loss > 0.9 * best:
            # not worth it: the safe step from where it started
            wide = min(wide * 10, 1.0)
            done[-1], tried = weights @ at, False
            continue
        if done and not tried and gain[0] <= GAP * best / 2:
            return done, float(np.abs(wrong).max() / tokens)
        if tried:
            wide = max(wide / 10, 1e-8)
        best, at, tried = loss, wrong, True
        done.append(np.linalg.solve(free + wide * whole, wrong))
    raise ValueError(f"the rates do not settle within {steps} steps: an error of {np.abs(at).max() / tokens:.3g} of the tokens is left")


def fit_rates(rows: DataFrame, targets: np.ndarray, steps: int = STEPS, close: float = CLOSE) -> tuple[list[np.ndarray], float]:
    """The gradient steps (vectors over domains) and the error that is left, for rows (tokens, p)."""
    size = len(targets) * (2 * len(targets) + 2) + 1

    def gather(done: list[np.ndarray]) -> np.ndarray:
        def run(batches):
            flat = np.zeros(size)
            for batch in batches:
                tokens, p = _columns(batch, ("tokens", "p"))
                if len(tokens):
                    flat += partial_sums(tokens, p, done)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(flat)], names=["k", "v"])

        got = {r.k: r.v for r in rows.select("tokens", "p").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}  # ``size`` numbers
        return np.array([got.get(k, 0.0) for k in range(size)])

    return solve_rates(gather, targets, steps, close)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, sample: int = SAMPLE, keep: dict[str, str] | None = None) -> DataFrame:
    """doc_id, text, *keep, tokens, p_<domain>, rate, copies of every row of ``docs`` (doc_id, text, *keep: names and types).

    ``rate`` is the expected number of copies, ``copies`` a whole number with that expectation, drawn from a
    hash of the row. Null and empty texts have no tokens: their rate is 1. A domain without any mass cannot be
    matched; the others are then matched as well as least squares allow. Repeated rows are rated row by row.
    """
    targets = targets or TARGETS
    domains = list(targets)
    rows = staged(posteriors(docs, labels, domains, sample, keep=keep))
    # the steps read a table of their own without texts, whose small files share tasks
    steps, _ = fit_rates(staged(rows.select("tokens", "p")), np.array([targets[d] for d in domains]))

    def rate(batches):
        for batch in batches:
            tokens, p = _columns(batch, ("tokens", "p"))
            r = rates_after(tokens, p, steps) if len(tokens) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], names=[*batch.schema.names, "rate"])

    rated = rows.mapInArrow(rate, f"{_schema(rows)}, rate double")
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return rated.select("doc_id", "text", *(keep or {}), "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate", copies.alias("copies"))
