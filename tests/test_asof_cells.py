"""As-of join where nearly all rows of a series lie in one day."""

import datetime as dt
import random

from pyspark.sql import functions as F

from newsflow.operators import asof

ZERO = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def frames(spark, n=20_000):
    """90 % of the ticks in the third day, most of them in one hour; left rows everywhere, some without a time."""
    rng = random.Random(6)
    seconds = [2 * 86_400 + (rng.randrange(3_600) if rng.random() < 0.8 else rng.randrange(86_400)) + rng.random() for _ in range(n * 9 // 10)]
    seconds += [float(rng.randrange(10 * 86_400)) for _ in range(n // 10)]
    ticks = [("x", ZERO + dt.timedelta(seconds=s), s) for s in seconds]
    left = [(i, "x", ZERO + dt.timedelta(seconds=rng.choice([rng.uniform(0, 864_000), rng.choice(seconds)]))) for i in range(2_000)]
    left += [(i, "x", None) for i in range(2_000, 2_010)] + [(2_010, None, None), (2_011, None, ZERO)]
    return (spark.createDataFrame(left, "id long, k string, t timestamp"), spark.createDataFrame(ticks, "k string, rt timestamp, v double"))


def test_cells_are_bounded_and_nothing_changes(spark):
    left, ticks = frames(spark)

    def joined(target):
        out = asof.asof_join(left, ticks, "t", "rt", ["id"], ["v"], ["k"], "nearest", target_rows=target, match_ts="m")
        return sorted((r.id, r.v, r.m) for r in out.collect())

    whole, cut = joined(10 ** 9), joined(500)
    assert cut == whole and len(cut) == 2_012
    assert all(v is None for i, v, _ in cut if i >= 2_000)


def test_rows_per_cell(spark):
    _, ticks = frames(spark)
    width = 86_400 * 1_000_000
    points = ticks.select("k", F.unix_micros("rt").alias("_t")).withColumn(asof.BUCKET, F.floor(F.col("_t") / width))
    most = {}
    for target in (10 ** 9, 500):
        cells = asof._in_cells(points, asof.cell_borders(points, ["k", asof.BUCKET], width, target), ["k"])
        most[target] = cells.groupBy("k", asof.BUCKET, asof.CELL).count().agg(F.max("count")).first()[0]
    assert most[10 ** 9] > 17_000 and most[500] < 600
