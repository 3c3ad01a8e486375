"""Near-duplicate documents by bottom-k sketches of one hash function.

Every document's shingle set is sketched by its ``k`` smallest 64-bit hashes. Documents of one set form a class;
classes are compared. Retained values are ordered by their number of classes; a class is listed under its rarest
values only, as many as a pair with ``least_common`` of its retained values in common must share one of (such a
pair is found with certainty; a pair at the threshold has fewer in common with probability below MISS). The classes of a short list are compared with one another. A long list is not expanded into pairs: its
classes are compared with one pivot, the class with the largest share of shingles that others have too, and only
classes that are still in different components are compared again. There the numbers of shingles that
both classes share with anyone, by bins of the hash, bound what they can have in common, which rules most pairs
of a large group out.
The sketch of the union of both sets (its k smallest values) estimates the similarity of a pair; pairs well
below the threshold go, the others are decided on the full sets.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscan.llm.common import components, mix, pick, row_slices, staged, text_bytes, window_hashes, word_bounds, word_hashes

#: Words of a shingle, retained hashes of a sketch.
SHINGLE, K = 5, 32
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Largest chance that a pair at the threshold has fewer retained values in common than it is found by.
MISS = 1e-6
#: Classes of a short list; rounds of pivots in long lists, whose open pairs are compared in full after them.
SHORT, ROUNDS = 64, 3
#: Bins of the hash by which the shingles that a class shares are counted.
BINS = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array):
    """(first row, last row, sorted distinct shingle hashes, n + 1 offsets) of slices of a text column."""
    data, offs = text_bytes(column)
    for i, j in row_slices(offs):
        part, local = _LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
        starts, ends, rows = word_bounds(part, local)
        hashes = word_hashes(part, starts, ends)
        found, at = window_hashes(hashes, rows, SHINGLE)
        owner = np.searchsorted(rows, at, side="right") - 1
        # a text with fewer words has one shingle, the whole sequence
        count = np.diff(rows)
        for n in range(1, SHINGLE):
            few = np.flatnonzero(count == n)
            if len(few):
                whole, begin = window_hashes(hashes, rows, n)
                keep = np.isin(begin, rows[few])
                found, owner = np.append(found, whole[keep]), np.append(owner, np.searchsorted(rows, begin[keep], side="right") - 1)
        order = np.lexsort((found, owner))
        found, owner = found[order], owner[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        found, owner = found[new], owner[new]
        yield i, j, found, np.searchsorted(owner, np.arange(j - i + 1))


def least_common(percent: int, k: int = K) -> int:
    """The most values of ``k`` that a pair of similarity ``percent`` has in common but for a chance of MISS."""
    p, below, m = percent / 100, 0.0, 0
    while m < k and (below := below + math.comb(k, m) * p**m * (1 - p) ** (k - m)) <= MISS:
        m += 1
    return max(m, 1)


def slack(percent: int, k: int = K) -> float:
    """A pair is dropped unverified if the union sketch puts it this far below the threshold (5 standard deviations)."""
    return 5 * (percent / 100 * (1 - percent / 100) / k) ** 0.5


def set_key(values: np.ndarray) -> bytes:
    """128 bits that stand for a set of hashes."""
    with np.errstate(over="ignore"):
        a, b = mix(values + np.uint64(1)).sum(dtype=np.uint64), mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def _sketches(k: int):
    def run(batches):
        for batch in batches:
            for i, j, values, offs in shingle_sets(batch.column(1)):
                keys = [set_key(values[a:b]) if b > a else None for a, b in zip(offs[:-1], offs[1:], strict=True)]
                # signed numbers in the same order
                signed = (values ^ np.uint64(1 << 63)).view(np.int64)
                lists = [signed[a : min(b, a + k)] for a, b in zip(offs[:-1], offs[1:], strict=True)]
                sizes = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                sketch = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offs)), pa.array(keys, pa.binary()), sketch], names=["doc_id", "n", "key", "sketch"])

    return run


def _full_sets(batches):
    for batch in batches:
        for i, j, values, offs in shingle_sets(batch.column(1)):
            keys, packed = [], []
            for a, b, wanted in zip(offs[:-1], offs[1:], batch.column(2).slice(i, j - i).to_pylist(), strict=True):
                if b > a and (key := set_key(values[a:b])) in wanted:
                    keys.append(key)
                    packed.append(values[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], names=["key", "hashes"])


def _similar(percent: int):
    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "linked"])

    return run


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n (shingles), key (of the set; null without words) and sketch of every row."""
    return pick(docs, doc_id="long", text="string").mapInArrow(_sketches(k), "doc_id long, n long, key binary, sketch array<long>")


def _lists(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """(value, key, n): the classes listed under each of their rarest values, where another class shares it."""
    wanted = least_common(percent, k)
    values = classes.select("key", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = values.join(common, "value")
    # places 1 to kept - least + 1 in the order of rarity; values of this class alone come first
    per_class = shared.groupBy("key").agg(F.first("n").alias("n"), F.first("kept").alias("kept"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"))
    # a shorter sketch is a whole set: the same share of it
    least = F.ceil(F.col("kept") * wanted / k).cast("int")
    room = F.col("kept") - least + 1 - (F.col("kept") - F.size("found"))
    listed = per_class.where(room > 0).select("key", "n", F.explode(F.slice("found", 1, room)).alias("x"))
    return listed.select(F.col("x.value").alias("value"), "key", "n")


def _pairs(lists: DataFrame, others: DataFrame, percent: int, more=None) -> DataFrame:
    """Distinct pairs (a < b) of a class and another one (columns with a 2) of its list, if their sizes allow a link."""
    near = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent
    met = lists.join(others, "value").where((F.col("key") != F.col("key2")) & near & (F.lit(True) if more is None else more))
    return met.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct()


def _all_pairs(lists: DataFrame, percent: int, more=None) -> DataFrame:
    """Pairs (a < b) of classes that share a list, each made once: under the smallest value that lists both.

    Close classes share most of their lists, so this makes a small part of the rows that every list would.
    """
    by_class = lists.groupBy("key").agg(F.collect_set("value").alias("listed"))
    full = lists.join(by_class, "key")
    near = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent
    first = F.array_min(F.array_intersect("listed", "listed2")) == F.col("value")
    met = full.join(_second(full), "value").where((F.col("key") < F.col("key2")) & near & (F.lit(True) if more is None else more) & first)
    return met.select(F.col("key").alias("a"), F.col("key2").alias("b"))


def _second(lists: DataFrame) -> DataFrame:
    return lists.select("value", *[F.col(c).alias(f"{c}2") for c in lists.columns if c != "value"])


def _sets(docs: DataFrame, classes: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, hashes): full sets of the given classes, from their smallest documents."""
    # one id may stand for texts of several classes
    wanted = classes.join(keys, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    texts = pick(docs, doc_id="long", text="string").join(wanted, "doc_id").select("doc_id", "text", "keys")
    return staged(texts.mapInArrow(_full_sets, "key binary, hashes binary").dropDuplicates(["key"]))


def _likely(pairs: DataFrame, classes: DataFrame, percent: int, k: int = K) -> DataFrame:
    """Pairs that the union sketch does not rule out."""
    sketch = classes.select("key", "sketch")
    both = pairs.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    estimate = F.size(F.array_intersect(F.array_intersect(union, "sa"), "sb")) / F.size(union)
    return staged(both.where(estimate >= percent / 100 - slack(percent, k)).select("a", "b"))


def _links(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links on their full sets."""
    full = likely.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b").select("a", "b", "ha", "hb")
    return full.mapInArrow(_similar(percent), "a binary, b binary, linked boolean").where("linked").select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()


def _explode(batches):
    for batch in batches:
        lists = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        who = batch.column(0).take(pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists])))
        yield pa.RecordBatch.from_arrays([who, pa.array(np.concatenate([*lists, np.zeros(0, np.int64)]))], names=["key", "shingle"])


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, root) of components after more links (a, b), by the components of the roots that they join."""
    left, right = labels.toDF("a", "ra"), labels.toDF("b", "rb")
    ends = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = components(ends).toDF("old", "new")
    kept = labels.join(moved, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    return staged(kept.union(moved.join(labels, F.col("old") == F.col("node"), "left_anti").toDF("node", "root")))


def _long_labels(lists: DataFrame, classes: DataFrame, docs: DataFrame, labels: DataFrame, percent: int, rounds: int, k: int) -> DataFrame:
    """Labels (node, root) of components with the links between classes of long lists, beside the given ones.

    A round without a new link ends the pivots early; the open pairs are then compared in full.
    """
    sets = _sets(docs, classes, lists.select("key").distinct())
    shingles = sets.mapInArrow(_explode, "key binary, shingle long")
    common = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("shingle")
    # c: shingles that another class of long lists has too, and their numbers by bins of the hash; no more can be
    # common to a pair, in any bin
    in_bin = [F.count_if(F.pmod("shingle", F.lit(BINS)) == i).alias(f"b{i}") for i in range(BINS)]
    shared = shingles.join(common, "shingle").groupBy("key").agg(F.count(F.lit(1)).alias("c"), *in_bin)
    shared = shared.select("key", "c", F.struct(*[f"b{i}" for i in range(BINS)]).alias("bins"))
    lists = staged(lists.join(shared, "key").where(F.col("c") * 100 >= F.col("n") * percent))
    at_most = lambda both: both * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
    by_bins = reduce(operator.add, [F.least(f"bins.b{i}", f"bins2.b{i}") for i in range(BINS)])
    possible = at_most(F.least("c", "c2")) & at_most(by_bins)
    done, last = None, rounds == 0
    for r in range(rounds + 1):
        named = lists.join(labels, lists.key == labels.node, "left").select("value", "key", "n", "c", "bins", F.coalesce("root", "key").alias("comp"))
        open_ = named.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("value")
        named = staged(named.join(open_, "value"))
        if not named.limit(1).count():
            break
        others = named
        if not last:
            # the best class that was not the pivot of its list before
            fresh = named.join(done, ["value", "key"], "left_anti") if done is not None else named
            best = fresh.groupBy("value").agg(F.min(F.struct((-F.col("c") / F.col("n")).alias("x"), "key", "n", "c", "bins", "comp")).alias("p"))
            others = staged(best.select("value", "p.key", "p.n", "p.c", "p.bins", "p.comp"))
            now = others.select("value", "key")
            done = now if done is None else done.union(now)
        apart = possible & (F.col("comp") != F.col("comp2"))
        pairs = _all_pairs(named, percent, apart) if last else _pairs(named, _second(others), percent, apart)
        new = staged(_links(_likely(pairs, classes, percent, k), sets, percent))
        found = new.limit(1).count() > 0
        if found:
            labels = _joined(labels, new)
        if last:
            break
        last = not found or r + 1 == rounds
    return labels


def near_duplicates(docs: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links; kept where it equals doc_id. Null or empty
    texts have no shingles and are linked with nothing. Rows of one doc_id count as one document with several
    texts; exact repeats give one row each. A null doc_id takes no part: its component is null and it is kept.
    """
    rows = staged(sketches(docs, k))
    full = rows.where("key is not null and doc_id is not null")
    smallest = F.min(F.struct("doc_id", "n", "sketch")).alias("x")
    classes = staged(full.groupBy("key").agg(smallest).select("key", "x.doc_id", "x.n", "x.sketch"))
    lists = staged(_lists(classes, percent, k))
    sizes = lists.groupBy("value").agg(F.count(F.lit(1)).alias("classes"))
    short = lists.join(sizes.where(F.col("classes").between(2, SHORT)).select("value"), "value")
    likely = _likely(_all_pairs(short, percent), classes, percent, k)
    # texts of one doc_id are linked by it
    ids = full.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z").select("doc_id", "a")
    same = full.join(ids, "doc_id").where("key <> a").select("a", F.col("key").alias("b")).distinct()
    links = staged(_links(likely, _sets(docs, classes, _ends(likely)), percent).union(same).distinct())
    long_ = staged(lists.join(sizes.where(F.col("classes") > SHORT).select("value"), "value"))
    labels = components(links)
    if long_.limit(1).count():
        labels = _long_labels(long_, classes, docs, labels, percent, rounds, k)
    roots = classes.join(labels, classes.key == labels.node, "left").select("key", "doc_id", F.coalesce("root", "key").alias("comp"))
    least = roots.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = roots.join(least, "comp").select("key", "component_id")
    out = rows.join(named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
