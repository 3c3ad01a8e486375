"""The nearest value below a label against brute force, and its join rows on a tall image."""

import random

import pytest

from labelscan.operators import spatial as SP

SCHEMA = "scan_id string, image_idx int, field string, block_idx int, x_min int, y_min int, x_max int, y_max int"


def _best(label, values):
    _, _, field, i, x0, _, x1, y1 = label
    found = [
        (float(v[5] - y1), abs((v[4] + v[6]) / 2 - (x0 + x1) / 2), v[3])
        for v in values if v[:3] == label[:3] and v[3] != i and v[4] is not None and v[5] >= y1 and v[6] >= x0 and v[4] <= x1
    ]
    return min(found) if found else None


@pytest.mark.parametrize("seed, width, height, flat", [(1, 400, 600, 0.1), (2, 60, 40, 0.5), (3, 30_000, 500, 0.1), (4, 5, 5, 0.5)])
def test_nearest_below_equals_brute_force(spark, seed, width, height, flat):
    rnd = random.Random(seed)
    rows = []
    for image in range(4):
        for i in range(60):
            x, y = rnd.randint(-width // 4, width), rnd.randint(-5, height)
            w = rnd.choice([0, 1, 7, rnd.randint(0, width)])
            h = 0 if rnd.random() < flat else rnd.randint(1, 30)
            rows.append((f"s{image % 2}", image // 2, rnd.choice("ab"), i, x, y, x + w, y + h))
    rows.append(("s0", 0, "a", 99, None, None, None, None))
    labels = [r for r in rows if r[3] % 3 == 0]
    got = SP.nearest_below(spark.createDataFrame(labels, SCHEMA), spark.createDataFrame(rows, SCHEMA)).collect()
    found = {(r.scan_id, r.image_idx, r.field, r.l_block_idx): (r.gap, r.dcx, r.v_block_idx) for r in got}
    want = {r[:4]: _best(r, rows) for r in labels if r[4] is not None}
    assert len(got) == len(found)
    assert found == {k: v for k, v in want.items() if v}


def test_no_labels_and_no_values(spark):
    empty, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("s", 0, "a", 0, 0, 0, 9, 9)], SCHEMA)
    assert SP.nearest_below(empty, one).count() == 0
    assert SP.nearest_below(one, empty).count() == 0
    assert SP.nearest_below(one, one).count() == 0


def _rows_of_joins(plan) -> int:
    """Largest number of rows that a join of the executed plan put out."""
    rows, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "AdaptiveSparkPlan" in name:
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            rows = max(rows, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_join_rows_grow_with_the_blocks_only(spark):
    """Labels and values of one column on one image: all pairs would be n * n / 4."""
    made = {}
    for n in (200, 800):
        rows = [("s", 0, "a", i, 0, 30 * i, 100, 30 * i + 20) for i in range(n)]
        found = SP.nearest_below(spark.createDataFrame(rows[::2], SCHEMA), spark.createDataFrame(rows, SCHEMA))
        assert {(r.l_block_idx, r.v_block_idx) for r in found.collect()} == {(i, i + 1) for i in range(0, n, 2)}
        made[n] = _rows_of_joins(found._jdf.queryExecution().executedPlan())
    assert 0 < made[800] <= 5 * made[200] and made[800] < 800 * 30


def test_pairs_with_the_nearest_keep_the_best(spark):
    rnd = random.Random(5)
    rows = [("s", 0, "a", i, rnd.randint(0, 300), rnd.randint(0, 900)) for i in range(80)]
    rows = [(*r, r[4] + rnd.randint(1, 80), r[5] + rnd.randint(1, 25)) for r in rows]
    values = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "concat('v', block_idx) AS t")
    labels = values.where("block_idx % 4 = 0").selectExpr("*", "'row_below' AS rel", "150 AS dist")
    rank = ["n1", "n2", "n3", "n4", "n5"]

    def best(nearest):
        found = {}
        for r in SP.pairs(labels, values, ["t"], ["t"], nearest=nearest).collect():
            key = (tuple(r[c] for c in rank), r.v_block_idx, r.v_t, r.l_t, r.l_y_min)
            found[r.l_block_idx] = min(found.get(r.l_block_idx, key), key)
        return found

    assert best(True) == best(False)


@pytest.mark.parametrize("few, least, most", [(0, 1, None), (64, 0, 0)])
def test_few_values_are_met_without_a_sweep(spark, few, least, most):
    """Both ways find the same; an image of few blocks takes no dyadic cells."""
    rnd = random.Random(7)
    rows = []
    for i in range(60):
        x, y = rnd.randint(0, 300), rnd.randint(0, 400)
        rows.append(("s", i // 30, "a", i, x, y, x + rnd.choice([0, 40, 200]), y + rnd.choice([0, 20])))
    frame = spark.createDataFrame(rows, SCHEMA)
    found = SP.nearest_below(frame, frame, few=few)
    got = {(r.scan_id, r.image_idx, r.field, r.l_block_idx): (r.gap, r.dcx, r.v_block_idx) for r in found.collect()}
    assert got == {r[:4]: best for r in rows if (best := _best(r, rows))}
    sweeps = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Window")
    assert sweeps >= least and (most is None or sweeps <= most)
