"""The search of settings: its defaults, that it does not depend on how many trials run at once, and one curve for all trials."""

import inspect
import random
import threading

import pytest
from pyspark.sql import functions as F

from newsflow.operators import evaluate
from newsflow.plans import train


def test_defaults_are_the_full_search():
    for fn in (train.train_classifier, train.fit_classifier):
        own = {k: p.default for k, p in inspect.signature(fn).parameters.items()}
        assert (own["trials"], own["most_features"], own["fit_on_all"], own["draw"]) == (15, 15, False, train.draw_trial)
    drawn = [train.draw_trial(random.Random(k)) for k in range(300)]
    for name, (low, high) in train.SEARCH_RANGES.items():
        assert all(low <= d[name] <= high for d in drawn) and max(d[name] for d in drawn) - min(d[name] for d in drawn) > 0.8 * (high - low)


def test_at_once(spark):
    """Results in order, several at a time, the caller's job settings in every thread, an error comes out."""
    meet = threading.Barrier(4, timeout=20)
    spark.sparkContext.setLocalProperty("own", "x")

    def work(k):
        meet.wait()
        return k, spark.range(k).count(), spark.sparkContext.getLocalProperty("own")

    assert train.at_once(spark, work, [1, 2, 3, 4], 4) == [(k, k, "x") for k in (1, 2, 3, 4)]
    assert train.at_once(spark, lambda k: -k, [1, 2], 1) == [-1, -2]
    with pytest.raises(ZeroDivisionError):
        train.at_once(spark, lambda k: 1 // k, [1, 0], 2)


def test_curves_by_key_equal_single_curves(spark):
    rng = random.Random(3)
    rows = [(k, round(rng.random(), 2), int(rng.random() < 0.3)) for k in range(3) for _ in range(200)] + [(3, 0.5, 0)]
    df = spark.createDataFrame(rows, "trial int, score double, label int")
    both = evaluate.precision_recall(df, by=["trial"])
    best = {r["trial"]: r["best_f1"] for r in evaluate.best_f1(both, by=["trial"]).collect()}
    for k in range(4):
        one = evaluate.precision_recall(df.where(F.col("trial") == k))
        assert sorted(map(tuple, both.where(F.col("trial") == k).drop("trial").collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
        assert best[k] == evaluate.best_f1(one).first()[0]


def test_search_does_not_depend_on_parallelism(spark):
    rng = random.Random(2)
    rows = [(i, f"2024-01-{1 + i % 28:02d} 10:00:00", rng.gauss(i % 2, 1.0), rng.random(), i % 2) for i in range(240)]
    frame = spark.createDataFrame(rows, "id long, t string, a double, b double, label int").withColumn("datetime", F.col("t").cast("timestamp"))

    def draw(r):
        return {**train.draw_trial(r), "maxIter": r.randint(2, 4)}

    one, many = (train.fit_classifier(frame, ["a", "b"], trials=3, draw=draw, parallelism=p) for p in (1, 3))
    assert one.trial == many.trial and one.best_f1 == many.best_f1 and one.best_f1 > 0.5
