"""Whitening against numpy and exact fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from newsflow.llm import whitening
from newsflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def whole(vector):
    return [math.floor(1024 * float(c)) + 100_000 for c in vector]


def takes_part(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


def check(rows, given, components=8):
    """Rows of one vector length against numpy's covariance."""
    kept = [(i, whole(v)) for i, v in given if takes_part(v)]
    x = np.array([v for _, v in kept], dtype=np.int64)
    n, d = x.shape
    sums = [sum(v[k] for _, v in kept) for k in range(d)]
    cov = np.cov(x.astype(float).T, bias=True).reshape(d, d)
    values = np.linalg.eigvalsh(cov)[::-1]
    k = min(components, d)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, []).append(r)
    assert set(by_id) == {i for i, _ in kept} and len(rows) == n * k
    w = {}
    for i, v in kept:
        want = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        for r in by_id[i]:
            assert r.n == n and r.deviation == want
            w[i, r.component] = r.whitened
    for r in rows:
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) <= 1e-9
        assert r.identity_error <= 1e-4
    if len(by_id) == n:
        white = np.array([[w[i, c] for c in range(1, k + 1)] for i, _ in kept])
        assert np.abs(np.cov(white.T, bias=True).reshape(k, k) - np.eye(k)).max() < 1e-9
        # Each whitened component is the centred data on a unit eigenvector: its own covariance with the data gives it back.
        centred = x - np.array([float(Fraction(s, n)) for s in sums])
        for c in range(k):
            v = centred.T @ white[:, c] / n / math.sqrt(values[c])
            assert abs(np.linalg.norm(v) - 1) < 1e-9 and np.abs(cov @ v - values[c] * v).max() < 1e-6 * values[0]


def random_vectors(n, d, seed=3):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d))
    return [(i, (rng.normal(size=d) @ mix).tolist()) for i in range(n)]


@pytest.mark.parametrize("n,d", [(50, 3), (400, 12)])
def test_against_numpy(spark, n, d):
    given = random_vectors(n, d)
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>").repartition(5)
    check(whitening.whiten(df).collect(), given)


def test_covariances_are_exact():
    rng = random.Random(1)
    for size in (10, 1 << 19, 1 << 40):
        x = [[rng.randrange(-size, size) for _ in range(4)] for _ in range(30)]
        n, sums = len(x), [sum(v[k] for v in x) for k in range(4)]
        centres = [s // n for s in sums]
        squares = whitening.square_sums(np.array(x) - np.array(centres))
        cov, own = whitening.covariances(n, sums, centres, [int(q) for q in squares])
        for i in range(4):
            assert own[i] == sum((n * v[i] - sums[i]) ** 2 for v in x)
            for j in range(4):
                exact = sum(Fraction(n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in x) / n ** 3
                assert cov[i, j] == float(exact)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = random_vectors(20, 3, 8)
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, nan, 2.0]), (104, [inf, 1.0, 2.0]), (105, [1e300, 0.0, 0.0])]
    short = [(i + 200, [float(i % 3), 1.0]) for i in range(6)]
    rows = [(i, v, "z", 1) for i, v in [*good, *good[:4], *odd, *short, (None, good[0][1])]]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n int")).collect()
    three = [r for r in got if r.vec_id is None or r.vec_id < 100]
    check(three, [*good, *good[:4], (None, good[0][1])])
    two = [r for r in got if r.vec_id is not None and r.vec_id >= 100]
    assert {r.vec_id for r in two} == {i for i, _ in short} and {r.n for r in two} == {6}
    # The second dimension does not vary: its component has no scale.
    assert all((r.whitened is None) == (r.component == 2) and abs(r.explained - (r.component == 1)) < 1e-12 for r in two)


def test_alone_and_empty(spark):
    df = spark.createDataFrame([(1, [0.5, 2.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert len(got) == 2 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in got)
    assert whitening.whiten(df.limit(0)).collect() == []


def test_query(spark):
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    df = QUERIES["op11_embedding_whitening"](spark, SF)
    assert dict(df.dtypes)["deviation"] == "bigint"
    check(df.collect(), given)
