"""Recall of the neighbour graph on tables with few distinct vectors, and on clusters smaller than the result."""

import numpy as np
import pytest

from labelscan.llm import nn_descent


def pairs_far_apart(r):
    return np.concatenate([c + r.normal(0, 0.01, (2, 16)) for c in r.normal(0, 10, (6, 16))])


def small_clusters(r):
    return np.concatenate([c + r.normal(0, 0.05, (5, 16)) for c in r.normal(0, 1, (60, 16))])


CASES = {"pairs": pairs_far_apart, "few": lambda r: r.normal(0, 1, (50, 64)), "pivots": lambda r: r.normal(0, 1, (200, 64)), "clusters": small_clusters}


@pytest.mark.parametrize("name", CASES)
def test_recall(spark, name):
    x = CASES[name](np.random.default_rng(7))
    found = nn_descent.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), every=1).collect()
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)
    best = np.argsort(far, axis=1)[:, :10]
    mine = [{s.vec_id for s in found if s.query_id == q} for q in range(len(x))]
    assert all(len(m) == 10 for m in mine)
    recall = sum(len(m & set(b.tolist())) for m, b in zip(mine, best, strict=True)) / best.size
    assert recall >= (1 if len(x) <= nn_descent.GROUP else 0.97), recall


def test_exact_without_a_graph(spark):
    """What the search misses the check finds: of a graph whose nodes have no links all nearest come back."""
    x = np.random.default_rng(5).normal(0, 1, (1500, 64))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    nodes = points.mapInArrow(nn_descent._pack, "node long, x binary").selectExpr("node", "x", "node % 3 as home")
    members = points.selectExpr("id as node", "id", "v")
    edges = points.selectExpr("id as src", "id as dst", "cast(0 as float) as dist").where("false")
    graph = nn_descent.Graph(nodes, members, edges, edges, np.arange(2), x[:2].astype(np.float32))
    found = nn_descent.search(graph, points.where("id % 100 = 0"), 10).collect()
    far = np.sqrt(((x[::100, None] - x[None]) ** 2).sum(axis=2))
    far[np.arange(15), np.arange(0, 1500, 100)] = np.inf
    best = np.argsort(far, axis=1)[:, :10]
    mine = [[s.vec_id for s in sorted(found, key=lambda s: s.rank) if s.query_id == q] for q in range(0, 1500, 100)]
    assert mine == best.tolist()
