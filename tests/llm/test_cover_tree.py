import math
import random

import numpy as np
import pytest

from tripmill.llm import cover_tree as ct

SCHEMA = "vec_id long, embedding array<float>, label int, mark string, cell string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "m", "c", 1) for i, v in rows], SCHEMA)


def expected(rows, k=10, every=100):
    points = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            points.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    out = []
    for at, (i, v) in enumerate(points):
        if i % every == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), j) for other, (j, w) in enumerate(points) if other != at]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def got(frame, **how):
    return sorted(map(tuple, ct.nearest(frame, **how).collect()))


def clusters(n, dims, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(20, dims)) * 3
    return middles[rng.integers(0, 20, n)] + rng.normal(size=(n, dims)) * 0.05


@pytest.mark.parametrize("points", [clusters(300, 5, 1), np.zeros((40, 3)), np.ones((1, 2)), clusters(100, 0, 1)])
def test_a_tree_covers_and_nests(points):
    tree = ct.cover_tree(points)
    assert sorted(tree.order) == list(range(len(points)))
    rows = points[tree.order]
    assert (tree.nodes[0]["low"], tree.nodes[0]["high"]) == (0, len(points))
    for node in tree.nodes:
        beneath = rows[node["low"] : node["high"]]
        assert np.linalg.norm(beneath - rows[node["row"]], axis=1).max(initial=0) <= node["radius"] + 1e-9
        children = tree.nodes[node["begin"] : node["end"]]
        if len(children):
            assert children[0]["low"] == node["low"] and children[-1]["high"] == node["high"]
            assert all(a["high"] == b["low"] for a, b in zip(children, children[1:]))
            assert node["row"] in children["row"]


def sides(points, ids, leaf=ct.LEAF):
    tree = ct.cover_tree(points, leaf)
    ids = np.asarray(ids)
    return ct.side({
        "marks": ids[tree.order].astype("<i8").tobytes(), "ids": ids[tree.order].astype("<i8").tobytes(),
        "points": points[tree.order].astype("<i4").tobytes(), "nodes": tree.nodes.tobytes(),
    })


def test_far_nodes_are_pruned(monkeypatch):
    points = np.floor(clusters(2000, 8, 4) * 1024)
    block, queries = sides(points, range(2000)), sides(points[:30], range(30), 1)
    multiplied = []
    real = ct._products
    monkeypatch.setattr(ct, "_products", lambda q, low, high, b, rows: multiplied.append((high - low) * len(rows)) or real(q, low, high, b, rows))
    best = ct.Best(30, 10)
    list(ct.search(queries, block, best))
    assert sum(multiplied) < 0.5 * 30 * 2000
    for at, mark in enumerate(queries.marks):
        scores = (points @ points[mark]).astype(int)
        wanted = sorted(((-s, i) for i, s in enumerate(scores) if i != mark))[:10]
        assert [(-s, i) for s, i in zip(best.scores[at], best.ids[at])] == wanted


def test_equals_brute_force(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(clusters(3000, 6, 2))]
    # A vector that a third of all rows has: its ties go by id.
    rows += [(i, [0.25, -0.5, 0.125, 1.0, 2.0, 0.0]) for i in range(3000, 4500)]
    random.Random(1).shuffle(rows)
    assert got(table(spark, rows)) == expected(rows)
    assert got(table(spark, rows[:400]), k=3, query_every=7) == expected(rows[:400], 3, 7)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf"), 1.0]),
        (500, []), (600, [1.0]), (700, [1.0, 2.0]), (700, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [-0.0001, 0.0]),
        (-100, [-1.5, 0.5, 2.0]), (3, [1.0, 2.0]),
    ]
    assert got(table(spark, rows)) == expected(rows)
    assert got(table(spark, [])) == []
    assert got(table(spark, rows[:1])) == []
    assert got(table(spark, [(5, [1.0]), (6, [2.0])])) == []


def test_large_components_are_exact_or_refused(spark):
    rows = [(100 * i, [1e6 + i, 7.0, 1e6]) for i in range(30)]
    assert got(table(spark, rows)) == expected(rows)
    with pytest.raises(Exception, match="32 bits"):
        got(table(spark, [(0, [1e30]), (1, [1.0])]))
