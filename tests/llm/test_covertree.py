"""Exact top-k search against brute force."""

import numpy as np
import pytest

from newsflow.llm import covertree
from newsflow.llm.common import ready
from newsflow.llm.queries import ORACLES, QUERIES
from newsflow.registry.check import compare, duck

SCHEMA = "vec_id long, embedding array<double>, score string, rank int, part string"


def expected(queries, vectors, k, scale=64):
    def whole(rows):
        return [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows
                if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]

    out = []
    for i, q in dict(whole(queries)).items():
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole(vectors) if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "s", 1, "p") for i, v in rows], SCHEMA)


def test_tree_covers(monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", 4)
    points = np.random.default_rng(1).normal(size=(300, 5))
    points[50:120] = points[0]
    seen = []

    def walk(node):
        gaps = np.linalg.norm(points[node.rows] - node.centre, axis=1)
        assert gaps.max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            for c in node.children:
                walk(c)
        else:
            seen.extend(node.rows)

    walk(covertree.cover_tree(points))
    assert sorted(seen) == list(range(300))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, monkeypatch, seed):
    ready(spark)
    monkeypatch.setattr(covertree, "PIVOTS", 6)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 6)) * 3
    rows = [(i, (centres[i % 5] + rng.normal(size=6) * 0.2).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)]  # many equal vectors
    rows += [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (7, rows[7][1]), (504, [0.0] * 6),
             (-20, [-1e3] * 6)]
    queries = [r for r in rows if r[0] is not None and r[0] % 7 == 0] + [(504, [0.0] * 6)]
    got = covertree.top_k(frame(spark, queries), frame(spark, rows), 20, block_vectors=64, group_queries=16).collect()
    assert sorted(map(tuple, got)) == expected(queries, rows, 20)


def test_large_parts_are_exact():
    rng = np.random.default_rng(3)
    points = rng.integers(-2 ** 27, 2 ** 27, size=(50, 4)).astype(float)
    search = covertree.Search(points[:1], np.array([0]), 5, -np.inf)
    search.meet(covertree.cover_tree(points[:1]), covertree.cover_tree(points), points, np.arange(50))
    want = sorted((-sum(int(a) * int(b) for a, b in zip(points[0], p)), i) for i, p in enumerate(points) if i)[:5]
    assert [(-s, i) for s, i in zip(search.scores[0].tolist(), search.ids[0].tolist())] == want


def test_few_and_none(spark):
    ready(spark)
    rows = [(1, [1.0, 2.0]), (2, [0.5, 0.5]), (3, [-1.0, 0.0])]
    got = covertree.top_k(frame(spark, rows[:1]), frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == expected(rows[:1], rows, 20)
    assert covertree.top_k(frame(spark, []), frame(spark, rows)).count() == 0
    assert covertree.top_k(frame(spark, rows), frame(spark, [])).count() == 0
    assert covertree.top_k(frame(spark, rows[:1]), frame(spark, rows[:1])).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    ok, message = compare(spark, duck(folder), "op1_top_k_search", folder, QUERIES["op1_top_k_search"], ORACLES["op1_top_k_search"])
    assert ok, message
