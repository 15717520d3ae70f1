"""Index of known URLs and update of few keys: what is read and written, and what an attempt that failed leaves behind."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from newsflow.operators import known
from newsflow.sources import sinks
from newsflow.streaming import jobs

KINDS = "url string, datetime timestamp, headline string"
DAY = dt.datetime(2024, 1, 1)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def urls(spark, path):
    return sorted(r.url for r in spark.read.parquet(path).collect())


def test_batches_read_their_buckets_only(spark, tmp_path):
    path, index = str(tmp_path / "news"), str(tmp_path / "news_urls")
    store = spark.range(4_000).select(
        F.concat(F.lit("u"), "id").alias("url"), F.lit(DAY).cast("timestamp").alias("datetime"), F.lit("h").alias("headline"))
    jobs.append_new(store, path)
    whole = known.read_index(spark, index)
    assert whole.count() == 4_000 and len(whole.inputFiles()) == known.BUCKETS
    for k in range(6):
        rows = [(f"u{4_000 + 3 * k + i}", DAY + dt.timedelta(days=k), "n") for i in range(3)] + [(f"u{k}", DAY + dt.timedelta(days=60), "again")]
        batch = spark.createDataFrame(rows, KINDS)
        buckets = known.touched(batch.select(*known.key_hashes("url")))
        read = known.read_index(spark, index, buckets)
        assert len(buckets) <= 4 and {f.split("/b=")[1].split("/")[0] for f in read.inputFiles()} == {str(b) for b in buckets}
        jobs.append_new(batch, path)
    assert urls(spark, path) == sorted(f"u{i}" for i in range(4_000 + 18))


def test_attempts_that_failed(spark, tmp_path, monkeypatch):
    """Killed before the index, after the index, and after the rows: the next attempt stores each URL once."""
    path = str(tmp_path / "news")
    batch = spark.createDataFrame([(f"u{i}", DAY + dt.timedelta(days=i), "h") for i in range(5)], KINDS)
    jobs.append_new(batch.where("url = 'u0'"), path, "earlier")

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(jobs, "record", stop)
        with pytest.raises(KeyboardInterrupt):
            jobs.append_new(batch, path, "b1")
    with monkeypatch.context() as m:
        m.setattr(jobs, "stored_layout", stop)
        with pytest.raises(KeyboardInterrupt):
            jobs.append_new(batch, path, "b1")
    assert urls(spark, path) == ["u0"]
    for _ in range(2):
        jobs.append_new(batch, path, "b1")
        assert urls(spark, path) == [f"u{i}" for i in range(5)]
    jobs.append_new(batch.withColumn("datetime", F.expr("datetime + interval 90 days")), path, "b2")
    assert urls(spark, path) == [f"u{i}" for i in range(5)]


def test_table_without_index_gets_one(spark, tmp_path):
    path = str(tmp_path / "news")
    batch = spark.createDataFrame([("a", DAY, "h"), ("b", None, "h")], KINDS)
    sinks.stored_layout(sinks.with_ids(batch)).write.partitionBy("dt").parquet(path)
    jobs.append_new(spark.createDataFrame([("a", DAY + dt.timedelta(days=9), "h"), ("b", DAY, "h"), ("c", None, "h"), (None, DAY, "h")], KINDS), path)
    assert sorted(map(str, (r.url for r in spark.read.parquet(path).collect()))) == ["None", "a", "b", "c"]


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "index")
    keys = spark.range(60).select(F.col("id").cast("string").alias("k"))
    for n in range(4):
        known.record(keys.where(F.col("k").cast("int") % 4 <= n).select(*known.key_hashes("k", 3)), path, "w")
    before = sorted(map(tuple, known.read_index(spark, path).distinct().collect()))
    assert known.compact(spark, path, 4) == [0, 1, 2] and known.compact(spark, path, 4) == []
    assert sorted(map(tuple, known.read_index(spark, path).collect())) == before and len(files(path)) == 3
    assert known.unknown(keys, "k", path, "other", 3).count() == 0 and known.unknown(keys, "k", path, "w", 3).count() == 60


def test_update_writes_the_days_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "articles")
    rows = spark.range(3_000).select(
        "id", F.when(F.col("id") % 30 != 29, F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, id % 30)")).alias("datetime"),
        F.lit("old").alias("label"), F.lit(0.5).alias("p"))
    sinks.write_version(rows, path)
    before = files(path)
    updates = spark.createDataFrame([(3, "new", 1.0), (33, None, None), (4, "new", 0.1), (10 ** 9, "stray", 0.0)], "id long, label string, p double")
    assert sinks.update_stored(spark, path, updates, ["label", "p"]) == [dt.date(2024, 1, 4), dt.date(2024, 1, 5)]
    after = files(path)
    assert {f.split("dt=")[1].split("/")[0] for f in before ^ after} == {"2024-01-04", "2024-01-05"}
    got = {r.id: (r.label, r.p) for r in spark.read.parquet(path).collect()}
    want = {i: ("old", 0.5) for i in range(3_000)} | {3: ("new", 1.0), 33: (None, None), 4: ("new", 0.1)}
    assert got == want
    assert sinks.update_stored(spark, path, updates.where("id > 5000"), ["label", "p"]) == [] and files(path) == after
    # The days without a date are a partition like others; repeated keys need an order.
    again = spark.createDataFrame([(29, "b", 2), (29, "a", 1)], "id long, label string, n int")
    assert sinks.update_stored(spark, path, again, ["label"], order=["n"]) == [None]
    assert spark.read.parquet(path).where("id = 29").first().label == "a"
