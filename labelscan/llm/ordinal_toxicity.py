"""Toxicity as a severity grade, by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w . x - t_k) with one weight vector for all ordered thresholds t_1 < t_2 < ... ; x has
a 1 for every word of the document. The model is fitted on a bounded sample of labelled documents by proximal
gradient steps with an L1 penalty, so that few words keep a weight. The output is the expected severity, the
sum of P(grade >= k) over the thresholds.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscan.llm.common import pick

#: Labelled documents that the model is fitted on (those with the smallest hashes of their ids), words that a
#: document may give to the fit (those with the smallest hashes), documents that must hold a word, grades.
SAMPLE, SAMPLE_WORDS, LEAST_DOCS, GRADES = 6000, 2000, 8, 3
#: Strength of the L1 penalty and steps of the fit.
PENALTY, STEPS = 1e-3, 400

#: Severity from which a document counts as toxic (chosen on held-out labels, many of which are noise).
TOXIC = 0.25

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """The features of a text: its lower-cased runs of letters."""
    return set(_WORD.findall(text.lower())) if text else set()


def _features(batches):
    for batch in batches:
        texts = [sorted(words(t), key=lambda w: (hash_of(w), w))[:SAMPLE_WORDS] for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.list_(pa.string())), batch.column(1)], names=["words", "grade"])


def hash_of(word: str) -> int:
    """A hash that does not change between processes."""
    out = 0
    for c in word:
        out = (out * 1_000_003 ^ ord(c)) & 0xFFFFFFFF
    return out * 2_654_435_761 & 0xFFFFFFFF


class Model:
    def __init__(self, weights: dict[str, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def severity(self, texts: list[str | None]) -> np.ndarray:
        """Expected severity of each text, from 0 to the number of thresholds."""
        w = self.weights
        score = np.array([sum(w[x] for x in words(t) if x in w) for t in texts], float)
        return (1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))).sum(axis=1)


def fit(rows: list[tuple[list[str], int]], grades: int = GRADES, penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """The model of (words, grade) rows."""
    count = Counter(w for found, _ in rows for w in found)
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in count.items() if n >= LEAST_DOCS))}
    pairs = [(r, vocabulary[w]) for r, (found, _) in enumerate(rows) for w in found if w in vocabulary]
    grade = np.array([g for _, g in rows], int)
    thresholds = np.arange(1, grades, dtype=float) * 2
    if not rows or not vocabulary:
        return Model({}, thresholds)
    row, col = (np.array(x) for x in zip(*pairs, strict=True))
    n, m = len(rows), len(vocabulary)
    above = (grade[:, None] >= np.arange(1, grades)[None, :]).astype(float)
    # word columns are scaled so that steps of one size suit rare and frequent words
    scale = np.sqrt(n / np.bincount(col, minlength=m))
    w = v = np.zeros(m)
    t = u = thresholds.copy()
    # the largest curvature, by power iteration
    x = np.ones(m) / np.sqrt(m)
    for _ in range(30):
        y = scale * np.bincount(col, weights=np.bincount(row, weights=(x * scale)[col], minlength=n)[row], minlength=m) / n
        bound = np.linalg.norm(y)
        x = y / max(bound, 1e-12)
    size = 1.0 / ((grades - 1) * 0.25 * bound + 1)
    for k in range(steps):
        score = np.bincount(row, weights=(v * scale)[col], minlength=n)
        p = 1 / (1 + np.exp(np.clip(u[None, :] - score[:, None], -50, 50)))
        wrong = (p - above) / n
        step_w = v - size * scale * np.bincount(col, weights=wrong.sum(axis=1)[row], minlength=m)
        new_w = np.sign(step_w) * np.maximum(np.abs(step_w) - size * penalty * scale, 0)
        new_t = np.maximum.accumulate(u + size * wrong.sum(axis=0))  # ordered
        momentum = k / (k + 3)
        v, u = new_w + momentum * (new_w - w), new_t + momentum * (new_t - t)
        w, t = new_w, new_t
    return Model({x: float(w[i] * scale[i]) for x, i in vocabulary.items() if w[i]}, t)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled documents: grade 0 not toxic, 1 toxic, 2 toxic and of poor quality.

    Labels with a null doc_id or toxic take no part; several labels of one document count as the worst.
    """
    marks = pick(labels, doc_id="long", quality="int", toxic="int").where("doc_id is not null and toxic is not null")
    grade = F.when(F.col("toxic") > 0, F.when(F.col("quality") == 0, 2).otherwise(1)).otherwise(0)
    graded = marks.groupBy("doc_id").agg(F.max(grade).alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` ids and grades: small by construction
    rows = pick(docs, doc_id="long", text="string").join(F.broadcast(graded), "doc_id").select("text", "grade")
    found = rows.mapInArrow(_features, "words array<string>, grade int").limit(2 * sample).collect()
    return fit(sorted((r.words, r.grade) for r in found))


def severity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, severity double, toxic boolean (severity of TOXIC or more) of every row of ``docs`` (doc_id, text).

    Null and empty texts have the severity of a text without known words. Without labels all severities come
    from the first thresholds and nothing is toxic. Repeated rows are judged row by row.
    """
    model = train(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # at most the sample's frequent words

    def run(batches):
        judge = Model(*shared.value)
        for batch in batches:
            found = judge.severity(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array(found >= TOXIC)], names=["doc_id", "severity", "toxic"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, severity double, toxic boolean")
