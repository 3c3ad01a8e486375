"""Runs of words against brute force: the numbers alone, whole tables, awkward rows, very long texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelscan.llm import periodic_runs as pr


def brute(words):
    """(start, length, period) by walking every period, sorted by start and period."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, z, p) for (s, z), p in found.items()), key=lambda x: (x[0], x[2]))


def some_words(r):
    k = r.choice([1, 2, 2, 3, 40])
    out = [r.randrange(k) for _ in range(r.randint(0, 90))]
    if r.random() < 0.6:
        unit = [r.randrange(k) for _ in range(r.randint(1, 60))]
        out += unit * r.randint(2, 9) + unit[: r.randint(0, len(unit))] + [r.randrange(k) for _ in range(r.randint(0, 30))]
    return out


def test_find_runs_equals_brute_force():
    r = random.Random(3)
    for _ in range(150):
        texts = [some_words(r) for _ in range(r.randint(0, 6))]
        text, start, size, period = pr.find_runs([np.array(x, np.int32) for x in texts])
        got = [[] for _ in texts]
        for k, *run in zip(text, start, size, period, strict=True):
            got[k].append(tuple(map(int, run)))
        assert got == [brute(x) for x in texts]


def test_extensions_equal_direct_comparison():
    r = random.Random(4)
    unit = [r.randrange(3) for _ in range(50)]
    words = np.array([*unit * 6, *[r.randrange(2) for _ in range(200)], *unit * 4, -7], np.int32)
    pairs = np.array([(i, j) for i, j in ((r.randrange(len(words)), r.randrange(len(words))) for _ in range(3000)) if i != j])
    got = pr.Extensions(words)(pairs[:, 0], pairs[:, 1])
    for (i, j), n in zip(pairs, got, strict=True):
        want = 0
        while max(i, j) + want < len(words) and words[i + want] == words[j + want]:
            want += 1
        assert n == want


def test_members_are_a_difference_cover():
    assert (pr.SHIFTS >= 0).all()


def test_texts_shorter_than_the_cover_use_no_sorted_place():
    assert [int(x[0]) for x in pr.find_runs([np.zeros(7, np.int32)])] == [0, 0, 7, 1]


def expected(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, z, p in runs for i in range(s + p, s + z)}
    top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{z},{p}\n" for s, z, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    texts = [None, "", " \n\t\x0b ", "a", "x " * 5, "x " * 6, "Ab c d\x85e " * 8, "one two " * 3 + "one", "a b a b a b a b a a a a a a", "日本 語 " * 9 + "。"]
    texts += [" ".join(map(str, some_words(r))) for _ in range(90)]
    # doc_ids whose CRC ends in 0 plant a period
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, out[6], out[6], (7, "other text of seven"), (None, "z " * 9), (None, None), (-5, "k " * 12)]


def key(row):
    return tuple((x is not None, x) for x in row)


def test_whole_table_equals_brute_force(spark, rows):
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("q").alias("TEXT"), F.lit(1).alias("runs"), F.lit(2).alias("words"), F.lit(3).alias("start"))
    got = pr.run_digests(pr.periodic_runs(pr.plant(docs)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(*x) for x in rows), key=key)
    assert pr.run_digests(pr.periodic_runs(pr.plant(docs.limit(0)))).count() == 0


def test_a_very_long_text(spark):
    unit = " ".join(f"w{i}" for i in range(20_000))
    text = "start " + " ".join([unit] * 5) + " end"
    (row,) = pr.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(x) for x in row.runs] == [(1, 100_000, 20_000)]
    assert row.collapsed == f"start {unit} end" and row.n_words == 100_002
