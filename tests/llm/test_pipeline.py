"""Stages of the corpus pipeline against brute force."""

import random

import corpus_pipeline


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_dedup_removes_copies_from_a_similarity_of_080(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    rows, planted = [], 0
    for i in range(40):
        base = [word() for _ in range(200)]
        copy = list(base)
        for k in range(3 + i % 3):  # similarity 0.858, 0.815 and 0.774
            copy[20 + 30 * k] = word()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    sets = [shingles(t) for _, t in rows]
    root = {d: d for d, _ in rows}
    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 100 * both >= 80 * either:
                root = {d: min(root[i], root[j]) if x in (root[i], root[j]) else x for d, x in root.items()}
                planted += 100 * both < 85 * either
    assert planted == 13
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == [d for d in root if root[d] == d]
