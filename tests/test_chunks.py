"""Order over a whole table in many small chunks, over several levels of chunks."""

import random

import pytest
from pyspark.sql import functions as F

from newsflow.operators import order


@pytest.fixture
def frame(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(500), rng.choice("ab"), rng.randrange(10) if rng.random() < 0.02 else None) for i in range(4_000)]
    return rows, spark.createDataFrame(rows, "id long, t int, k string, v long")


@pytest.mark.parametrize("by", [(), ("k",)])
def test_three_levels(spark, monkeypatch, frame, by):
    monkeypatch.setattr(order, "FAN_OUT", 4)
    rows, df = frame
    chunks = order.ordered_chunks(df, [*by, "t", "id"], parts=50)
    assert chunks.select(order.CHUNK).distinct().count() > 40
    run = order.running_totals(chunks, ["t", "id"], {"v": "total"}, by=by)
    got = {r.id: (r.total, r.last) for r in order.carry_forward(run, ["t", "id"], ["v"], by=by, prefix="last_").withColumnRenamed("last_v", "last").collect()}
    totals, lasts = {}, {}
    for i, _, k, v in sorted(rows, key=lambda r: (r[1], r[0])):
        key = k if by else 0
        totals[key] = totals.get(key, 0) + (v or 0)
        lasts[key] = lasts.get(key) if v is None else v
        assert (got[i][0] or 0, got[i][1]) == (totals[key], lasts[key]), i


def test_chunks_follow_the_rows(spark, frame):
    _, df = frame
    for rows, least in ((1_000, 4), (100, 35), (10 ** 6, 1)):
        sizes = [r["count"] for r in order.ordered_chunks(df, ["t", "id"], chunk_rows=rows).groupBy(order.CHUNK).count().collect()]
        assert least <= len(sizes) <= -(-4_000 // rows) and max(sizes) <= 2 * rows


def test_search_that_the_sketch_missed(spark, frame):
    """Borders that lie on one side of the rank narrow the search all the same."""
    s = order._Search("v", 50, 100)
    s.narrow(60, 70, 60, 1, 8, 1)
    assert (s.low, s.high, s.below, s.inside, s.done) == (None, 60, 0, 60, False)
    s.narrow(10, 20, 10, 1, 8, 1)
    assert (s.low, s.high, s.below, s.inside, s.done) == (20, 60, 20, 40, False)
    s.narrow(40, 60, 20, 10, 9, 1)
    assert (s.low, s.high, s.below, s.inside, s.done) == (40, 60, 50, 9, False)


def test_values_of_any_rank(spark, frame):
    rows, df = frame
    values = sorted(t for _, t, _, _ in rows)
    ranks = [0, 1, 777, 2_000, 3_999]
    assert order.kth_values(df, [("t", k) for k in ranks], {"t": 4_000}, exact_rows=20) == [values[k] for k in ranks]
    assert df.agg(F.count("t")).first()[0] == 4_000
