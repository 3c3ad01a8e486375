"""Nearest neighbours: a neighbour graph by NN-descent, and greedy search on it.

Equal vectors form one node. The graph starts from random groups inside the cells of pivot vectors and from groups
of nodes of all cells; a few random edges of the latter also join in the first round and stay links of the search,
so that no cell is left to itself. It improves by joins: the neighbours of a node, in both directions, are candidates for one another, and every node keeps the
best it has met; a round compares only pairs with a new neighbour in it, and rounds go on until hardly a new one
turns up. Nodes are dealt to homes (parts of a
cell of bounded size), so that a round moves every vector once for each home that needs it.

A query starts at its own node or, if it is none, at the nearest pivots; each round opens the closest unopened nodes it
knows and meets their neighbours, until nothing nearer turns up. Nearness is computed again in double precision
on the original vectors at the end. An exact check follows: the distance of the last one found bounds what can be
missing, and every home that reaches into that distance is looked through for it.

At most PIVOTS vectors are sampled as pivots (documented bound); everything else covers every vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelscan.llm.common import mix, pick, staged

#: Neighbours of a node in the graph; reverse neighbours (a sample by hash) that join in a round.
DEGREE, REVERSE = 20, 20
#: Pivots (at most), nodes of a home, nodes of a starting group, random edges of a node, share of new neighbours that ends the rounds.
PIVOTS, HOME, GROUP, RANDOM, ENOUGH = 256, 1024, 128, 3, 0.005
#: Nodes that a search keeps, nodes that it opens in a round.
BEAM, OPEN = 64, 24


def vectors(table: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part, one for each id.

    Null ids and vectors, zero vectors and vectors with null or non-finite components go, and so do vectors
    of another length than the most common one (the shorter on a tie). Of several vectors with one id the
    smallest stays.
    """
    rows = pick(table, **{key: "long", column: "array<double>"}).toDF("id", "v")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("id is not null and v is not null").where(~bad & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    size = sizes[0].n if sizes else 1
    return rows.where(F.size("v") == size).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of a binary column as 32-bit rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def _pack(batches):
    for batch in batches:
        packed = [np.asarray(v, np.float32).tobytes() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["node", "x"])


def _cells(pivots: np.ndarray, near: int):
    """The ``near`` nearest pivots of every node."""

    def run(batches):
        norm = (pivots**2).sum(axis=1)
        for batch in batches:
            x = _matrix(batch.column(1))
            far = norm[None, :] - 2 * x @ pivots.T
            cells = np.argsort(far, axis=1, kind="stable")[:, :near]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells.tolist(), pa.list_(pa.int32()))], names=["node", "x", "cells"])

    return run


def _top(src: np.ndarray, dst: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` nearest distinct ``dst`` of every ``src``."""
    order = np.lexsort((dst, src))
    new = np.ones(len(order), bool)
    new[1:] = (src[order][1:] != src[order][:-1]) | (dst[order][1:] != dst[order][:-1])
    order = order[new]
    order = order[np.lexsort((dst[order], dist[order], src[order]))]
    s = src[order]
    rank = np.arange(len(s)) - np.searchsorted(s, s)
    return order[rank < k]


def _edges(src, dst, dist) -> pa.Table:
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "dist": pa.array(dist, pa.float32())})


def _group_pairs(k: int, random: int = 0):
    """The nearest inside one starting group (of bounded size); apart from them ``random`` edges of every node."""

    def run(group: pa.Table) -> pa.Table:
        ids, x = group.column("node").to_numpy(), _matrix(group.column("x"))
        far = _distances(x, x)
        a, b = np.nonzero(~np.eye(len(ids), dtype=bool))
        keep = _top(ids[a], ids[b], far[a, b], k)
        near = _edges(ids[a][keep], ids[b][keep], far[a, b][keep])
        if not random:
            return near
        # the next ones in an order by hash
        order = np.argsort(mix(ids.view(np.uint64)))
        a, b = (np.concatenate([np.roll(order, -i * side) for i in range(1, min(random, len(ids) - 1) + 1)] or [order[:0]]) for side in (0, 1))
        apart = _edges(ids[a], ids[b], far[a, b])
        return pa.concat_tables([t.append_column("random", pa.array([kind] * len(t), pa.bool_())) for t, kind in ((near, False), (apart, True))])

    return run


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(-1)[..., :, None] + (y**2).sum(-1)[..., None, :] - 2 * x @ np.swapaxes(y, -1, -2), 0)


def _local_join(k: int):
    """One home: candidates among the neighbours (u, fresh) of its nodes v; vectors and radii of all u come along."""

    def run(lists: pa.Table, points: pa.Table) -> pa.Table:
        v, u, fresh = lists.column("v").to_numpy(), lists.column("u").to_numpy(), lists.column("fresh").to_numpy(zero_copy_only=False)
        ids = points.column("node").to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], _matrix(points.column("x"))[order]
        radius = points.column("radius").to_numpy()[order]
        by_v = np.lexsort((u, v))
        v, u, fresh = v[by_v], np.searchsorted(ids, u[by_v]), fresh[by_v]
        starts = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(v)))
        found = []
        for size in np.unique(sizes).tolist():
            own = starts[sizes == size]
            for i in range(0, len(own), 256):
                at = own[i : i + 256, None] + np.arange(size)[None, :]
                members, new = u[at], fresh[at]
                far = _distances(x[members], x[members])
                good = (far < radius[members][:, :, None]) & (new[:, :, None] | new[:, None, :]) & (members[:, :, None] != members[:, None, :])
                r, a, b = np.nonzero(good)
                found.append((members[r, a], members[r, b], far[r, a, b]))
        if not found:
            return _edges([], [], [])
        src, dst, dist = (np.concatenate(c) for c in zip(*found, strict=True))
        keep = _top(src, dst, dist, k)
        return _edges(ids[src[keep]], ids[dst[keep]], dist[keep])

    return run


class Graph:
    """nodes: (node, x, home), members: (node, id), edges and random_edges: (src, dst, dist), pivots: their ids and vectors."""

    def __init__(self, nodes: DataFrame, members: DataFrame, edges: DataFrame, random_edges: DataFrame, pivot_ids: np.ndarray, pivots: np.ndarray):
        self.nodes, self.members, self.edges, self.random_edges, self.pivot_ids, self.pivots = nodes, members, edges, random_edges, pivot_ids, pivots


def build(points: DataFrame, k: int = DEGREE) -> Graph:
    """The neighbour graph of (id, v), by NN-descent."""
    points = staged(points)
    equal = points.groupBy("v").agg(F.min("id").alias("node"))
    members = staged(points.join(equal, "v").select("node", "id", "v"))
    packed = staged(equal.select("node", "v").mapInArrow(_pack, "node long, x binary"))
    chosen = packed.orderBy(F.xxhash64("node"), "node").limit(PIVOTS).collect()  # a bounded sample
    if not chosen:
        empty = packed.select("node", "x", F.lit(0).alias("home"))
        none = packed.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).cast("float").alias("dist"))
        return Graph(empty, members, none, none, np.zeros(0, np.int64), np.zeros((0, 1), np.float32))
    pivot_ids, pivots = np.array([r.node for r in chosen]), np.stack([np.frombuffer(r.x, np.float32) for r in chosen])
    placed = staged(packed.mapInArrow(_cells(pivots, min(2, len(pivots))), "node long, x binary, cells array<int>"))
    # homes and starting groups: cells, in random parts where they are large
    counts = placed.groupBy(F.col("cells")[0].alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    part = lambda size, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.ceil(F.col("n") / size))
    by_cell = placed.withColumn("cell", F.col("cells")[0]).join(counts, "cell")
    nodes = staged(by_cell.select("node", "x", F.xxhash64("cell", part(HOME, 1)).alias("home")))
    both = placed.select("node", "x", F.explode("cells").alias("cell"))
    totals = both.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    groups = both.join(totals, "cell").select("node", "x", F.xxhash64("cell", part(GROUP, 2)).alias("group"))
    met = groups.groupBy("group").applyInArrow(_group_pairs(k), "src long, dst long, dist float")
    total = nodes.count()
    mixed = packed.withColumn("group", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(-(-total // GROUP))))
    mixed = staged(mixed.groupBy("group").applyInArrow(_group_pairs(k, RANDOM), "src long, dst long, dist float, random boolean"))
    apart = mixed.where("random").drop("random")
    met = met.union(mixed.where("not random").drop("random"))
    edges = staged(_best(met.select("src", "dst", "dist", F.lit(True).alias("fresh")), k))
    more = apart.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("u")), F.struct(F.col("dst").alias("v"), F.col("src").alias("u")))).alias("e"))
    more = more.select("e.*", F.lit(True).alias("fresh"))
    # a list only ever gets nearer, so the rounds end
    while True:
        radius = edges.groupBy(F.col("src").alias("node")).agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("n"))
        reach = nodes.join(radius, "node", "left").select("node", "x", F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf"))).cast("float").alias("radius"))
        back = edges.select(F.col("dst").alias("v"), F.col("src").alias("u"), "fresh")
        order = Window.partitionBy("v").orderBy(F.desc("fresh"), F.xxhash64("u", "v"))
        back = back.withColumn("r", F.row_number().over(order)).where(F.col("r") <= REVERSE).drop("r")
        lists = edges.select(F.col("src").alias("v"), F.col("dst").alias("u"), "fresh").union(back)
        lists, more = (lists if more is None else lists.union(more)), None
        lists = lists.groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
        lists = staged(lists.join(nodes.select(F.col("node").alias("v"), "home"), "v"))
        needed = lists.select(F.col("home").alias("at"), F.col("u").alias("node")).distinct().join(reach, "node")
        met = lists.groupBy("home").cogroup(needed.groupBy("at")).applyInArrow(_local_join(k), "src long, dst long, dist float")
        joined = edges.select("src", "dst", "dist", F.lit(False).alias("fresh")).union(met.select("src", "dst", "dist", F.lit(True).alias("fresh")))
        edges = staged(_best(joined, k))
        if edges.where("fresh").count() <= ENOUGH * k * total:
            break
    return Graph(nodes, members, edges.select("src", "dst", "dist"), apart, pivot_ids, pivots)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of every node; an edge that was there before is not fresh."""
    once = edges.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("src").orderBy("dist", "dst")
    return once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def _measure(batches):
    """(q, node, far): distances of pairs whose vectors are side by side."""
    for batch in batches:
        x, y = _matrix(batch.column(2)), _matrix(batch.column(3))
        far = ((x - y) ** 2).sum(axis=1) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.float32())], names=["q", "node", "far"])


def _starts(pivot_ids: np.ndarray, pivots: np.ndarray, near: int = 4):
    def run(batches):
        norm = (pivots**2).sum(axis=1)
        for batch in batches:
            far = norm[None, :] - 2 * _matrix(batch.column(1)) @ pivots.T
            at = np.argsort(far, axis=1, kind="stable")[:, :near]
            who = batch.column(0).take(pa.array(np.repeat(np.arange(len(at)), at.shape[1])))
            yield pa.RecordBatch.from_arrays([who, pa.array(pivot_ids[at.ravel()], pa.int64())], names=["q", "node"])

    return run


def search(graph: Graph, queries: DataFrame, k: int = 10, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found of every query (id, v), its own id left out.

    Greedy search: nodes are opened nearest first; the search of a query ends when its nearest ``beam`` nodes
    are all open.
    """
    wanted = queries.select(F.col("id").alias("q"), F.col("v").alias("qv"))
    packed = staged(wanted.mapInArrow(_pack, "node long, x binary").toDF("q", "qx"))
    if not len(graph.pivot_ids):
        return wanted.select(F.col("q").alias("query_id"), F.lit(1).alias("rank"), F.col("q").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    own = wanted.join(graph.members.select("node", F.col("id").alias("q")), "q").select("q", "node")
    starts = packed.mapInArrow(_starts(graph.pivot_ids, graph.pivots), "q long, node long").union(own).distinct()
    x = graph.nodes.select("node", "x")
    measured = lambda pairs: pairs.join(x, "node").join(packed, "q").select("q", "node", "x", "qx").mapInArrow(_measure, "q long, node long, far float")
    state = staged(measured(starts).withColumn("open", F.lit(False)))
    # links both ways: a node is reached from its neighbours and from those that have it as neighbour
    order = Window.partitionBy("b").orderBy("dist", "a")
    back = graph.edges.select(F.col("dst").alias("b"), F.col("src").alias("a"), "dist").withColumn("r", F.row_number().over(order)).where(F.col("r") <= REVERSE)
    apart = graph.random_edges.select("src", "dst").union(graph.random_edges.select("dst", "src"))
    links = staged(graph.edges.select("src", "dst").union(back.select("b", "a")).union(apart).distinct())
    nearest = Window.partitionBy("q").orderBy("far", "node")
    while True:
        ranked = state.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= beam)
        closed = staged(ranked.where("not open").withColumn("o", F.row_number().over(nearest)).where(F.col("o") <= OPEN).select("q", "node"))
        if not closed.limit(1).count():
            break
        met = closed.join(links, F.col("node") == F.col("src")).select("q", F.col("dst").alias("node")).distinct()
        met = met.join(state.select("q", "node"), ["q", "node"], "left_anti")
        opened = state.join(closed.withColumn("now", F.lit(True)), ["q", "node"], "left").select("q", "node", "far", (F.col("open") | F.coalesce("now", F.lit(False))).alias("open"))
        state = staged(opened.union(measured(met).withColumn("open", F.lit(False))))
    found = state.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= beam).select("q", "node")
    best = staged(_ranked(graph, found, wanted, k))
    far = best.groupBy(F.col("query_id").alias("q")).agg(F.max("score").alias("far"), F.count(F.lit(1)).alias("n"))
    bound = F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf")))
    missed = _nearer(graph, packed.join(far, "q", "left").select("q", "qx", bound.alias("bound")), k)
    return _ranked(graph, found.union(missed).distinct(), wanted, k)


def _ranked(graph: Graph, found: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest ids of the found nodes (q, node), measured on the original vectors."""
    # of equal vectors the k + 1 smallest ids can be wanted
    first = Window.partitionBy("node").orderBy("id")
    least = graph.members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    pairs = found.join(least, "node").where("q <> id").join(wanted, "q")
    score = F.sqrt(F.aggregate(F.zip_with("v", "qv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    scored = pairs.select("q", "id", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


#: What the rounding of vectors to 32 bits can move a distance by, as a share of the lengths involved.
ROUNDING = 1e-6


def _ball(home: pa.Table) -> pa.Table:
    """Centre of one home and the distance of its farthest node."""
    x = _matrix(home.column("x")).astype(np.float64)
    centre = x.mean(axis=0)
    return pa.table({"home": home.column("home")[:1], "centre": pa.array([centre.tobytes()], pa.binary()), "reach": [float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())]})


def _reached(batches):
    """(q, qx, bound, home) of the pairs of a query and a home that can hold a node within its bound."""
    for batch in batches:
        q = _matrix(batch.column(1)).astype(np.float64)
        centre = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float64).reshape(q.shape)
        bound, reach = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
        slack = ROUNDING * (np.sqrt((q**2).sum(axis=1)) + np.sqrt((centre**2).sum(axis=1)) + reach)
        # what is not known to be too far is kept
        kept = ~(np.sqrt(((q - centre) ** 2).sum(axis=1)) - reach > bound + slack)
        yield batch.select([0, 1, 2, 3]).filter(pa.array(kept))


def _within(k: int):
    """One home: its nodes within the bounds of the queries that reach it, the nearest of each."""

    def run(points: pa.Table, asked: pa.Table) -> pa.Table:
        ids, x = points.column("node").to_numpy(), _matrix(points.column("x")).astype(np.float64)
        q, y = asked.column("q").to_numpy(), _matrix(asked.column("qx")).astype(np.float64)
        bound = asked.column("bound").to_numpy()
        # the query itself may be one of them, and rounding may change places
        most, found = min(2 * (k + 1), len(ids)), []
        for i in range(0, len(q) if most else 0, 256):
            far = np.sqrt(_distances(y[i : i + 256], x))
            slack = ROUNDING * (np.sqrt((y[i : i + 256] ** 2).sum(axis=1))[:, None] + np.sqrt((x**2).sum(axis=1)))
            near = np.argpartition(far, most - 1, axis=1)[:, :most]
            good = ~(np.take_along_axis(far - slack, near, 1) > bound[i : i + 256, None])
            found.append((np.broadcast_to(q[i : i + 256, None], near.shape)[good], ids[near[good]]))
        at, node = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (q[:0], ids[:0])
        return pa.table({"q": pa.array(at, pa.int64()), "node": pa.array(node, pa.int64())})

    return run


def _nearer(graph: Graph, bounded: DataFrame, k: int) -> DataFrame:
    """(q, node): every node that may be nearer than the bound of a query (q, qx, bound) and among its ``k`` nearest.

    Queries meet the balls of the homes first; a home is one group of bounded size. How many homes are left depends on
    the vectors: with none ruled out it is the distance of every query to every node.
    """
    balls = graph.nodes.groupBy("home").applyInArrow(_ball, "home long, centre binary, reach double")
    asked = bounded.crossJoin(F.broadcast(balls)).select("q", "qx", "bound", "home", "centre", "reach")
    asked = asked.mapInArrow(_reached, "q long, qx binary, bound double, home long")
    return graph.nodes.groupBy("home").cogroup(asked.groupBy("home")).applyInArrow(_within(k), "q long, node long")


def neighbours(table: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of the rows whose vec_id is divisible by ``every``.

    Vectors that take no part (see ``vectors``) are neither queries nor candidates. Fewer than ``k`` other
    vectors give as many rows. Equal distances go by vec_id. An empty table gives no rows.
    """
    points = staged(vectors(table))
    graph = build(points)
    return search(graph, points.where(F.col("id") % every == 0), k)
