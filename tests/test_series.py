import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsflow.operators import order, skew
from newsflow.operators.asof import asof_join
from newsflow.operators.indicators import INDICATORS, indicator_table
from newsflow.operators.series import densify, relative_change


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=int(n))


def seeded_ewm(x, n, alpha):
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        y = np.mean(x[:n])
        out[n - 1] = y
        for i in range(n, len(x)):
            y = alpha * x[i] + (1 - alpha) * y
            out[i] = y
    return out


def brute_indicators(pdf):
    """Indicators by plain loops; nulls follow the definitions of indicator_table."""
    close = pdf["close"]
    out = pd.DataFrame(index=pdf.index)
    mean, std, sma = close.rolling(20).mean(), close.rolling(20).std(), close.rolling(50).mean()
    out["std_upper"], out["std_lower"] = mean + 2 * std, mean - 2 * std
    out["std_channel_width"] = np.where(close == 0, 0.0, (out["std_upper"] - out["std_lower"]) / close)
    out["price_vs_sma50"] = (close - sma) / sma
    x = close.dropna().to_numpy()
    move = np.diff(x)
    gain = seeded_ewm(np.maximum(move, 0), 14, 1 / 14)
    loss = seeded_ewm(np.maximum(-move, 0), 14, 1 / 14)
    with np.errstate(invalid="ignore", divide="ignore"):
        rsi = np.where(gain + loss > 0, 100 * gain / (gain + loss), np.nan)
    macd = seeded_ewm(x, 12, 2 / 13) - seeded_ewm(x, 26, 2 / 27)
    signal = np.concatenate([np.full(25, np.nan), seeded_ewm(macd[25:], 9, 0.2)]) if len(x) > 25 else np.full(len(x), np.nan)
    idx = close.dropna().index
    out.loc[idx, "rsi_14"] = np.concatenate([[np.nan], rsi])
    out.loc[idx, "macd"] = macd
    out.loc[idx, "macd_hist"] = macd - signal
    out.loc[close.isna(), :] = np.nan
    return out[list(INDICATORS)]


@pytest.mark.parametrize("block,halo", [(2048, 640), (700, 640)], ids=["one block", "many blocks"])
def test_indicators_equal_brute_force(spark, block, halo):
    rng = np.random.default_rng(7)
    frames = []
    for ticker, n in (("AAA", 2000), ("BBB", 60), ("CCC", 15), ("DDD", 14)):
        close = 400 + np.cumsum(rng.normal(0, 3, n))
        days = np.cumsum(rng.integers(1, 4, n))
        frames.append(pd.DataFrame({"ticker": ticker, "date": [day(d) for d in days], "close": close}))
    frames[0].loc[[5, 900, 901, 1500], "close"] = np.nan
    frames[1].loc[55, "close"] = 0.0
    bars = pd.concat(frames, ignore_index=True)
    rows = [(t, d, None if pd.isna(c) else float(c)) for t, d, c in bars.itertuples(index=False)]
    table = spark.createDataFrame(rows, "ticker string, date date, close double")
    got = indicator_table(table, block=block, halo=halo).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    assert set(got["ticker"]) == {"AAA", "BBB", "CCC"}
    want = pd.concat([brute_indicators(f.reset_index(drop=True)) for f in frames[:3]], ignore_index=True)
    for c in INDICATORS:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_flat_and_rising_series(spark):
    rows = [("F", day(i), 5.0) for i in range(40)] + [("R", day(i), 1.0 + i) for i in range(40)]
    table = indicator_table(spark.createDataFrame(rows, "ticker string, date date, close double"))
    flat = table.where("ticker = 'F'").orderBy(F.desc("date")).first()
    rise = table.where("ticker = 'R'").orderBy(F.desc("date")).first()
    assert flat["rsi_14"] is None and flat["std_channel_width"] == 0
    assert rise["rsi_14"] == pytest.approx(100)


BARS = [("A", dt.date(2024, 1, 4), 10.0), ("A", dt.date(2024, 1, 5), 11.0), ("A", dt.date(2024, 1, 8), None),
        ("A", dt.date(2024, 1, 9), 12.0), ("B", dt.date(2024, 1, 31), 1.0), ("B", dt.date(2024, 3, 2), None)]


def test_densify(spark):
    df = spark.createDataFrame(BARS, "ticker string, date date, close double")
    out = densify(df, ["ticker"], "date", ["close"], F.lit("2024-01-10").cast("date")).toPandas()
    a = out[out.ticker == "A"].sort_values("date")
    assert list(a["close"]) == [10, 11, 11, 11, 11, 12, 12]
    b = out[out.ticker == "B"].sort_values("date")
    assert len(b) == 32 and set(b["close"]) == {1.0}
    assert not out.duplicated(["ticker", "date"]).any()


def test_relative_change_fills_first(spark):
    df = spark.createDataFrame([(0, day(0), 1.0), (0, day(40), None), (0, day(80), 3.0)], "k int, d date, x double")
    got = [r["c"] for r in relative_change(df, ["k"], "d", "x", "c").orderBy("d").collect()]
    assert got == [None, 0.0, 2.0]


def ts(seconds):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("target_rows", [10**6, 7], ids=["whole", "split"])
def test_asof_equals_search(spark, direction, target_rows):
    rng = random.Random(3)
    right = {k: sorted(rng.sample(range(0, 400_000), 80) + rng.sample(range(1_500_000, 1_700_000), 40)) for k in "xy"}
    left = [(i, rng.choice("xyz"), rng.choice([rng.randint(-50_000, 2_000_000), rng.choice(right["x"])])) for i in range(600)]
    ldf = spark.createDataFrame([(i, k, ts(s)) for i, k, s in left], "id long, k string, t timestamp")
    rdf = spark.createDataFrame([(k, ts(s), float(s)) for k in right for s in right[k]], "k string, rt timestamp, v double")
    got = {r["id"]: r["v"] for r in asof_join(ldf, rdf, "t", "rt", ["id"], ["v"], ["k"], direction,
                                             target_rows=target_rows).collect()}
    assert len(got) == len(left)
    for i, k, s in left:
        points = right.get(k, [])
        back = max((p for p in points if p <= s), default=None)
        ahead = min((p for p in points if p >= s), default=None)
        if direction == "backward":
            want = back
        elif direction == "forward":
            want = ahead
        elif back is None or ahead is None:
            want = ahead if back is None else back
        else:
            want = ahead if ahead - s <= s - back else back
        assert got[i] == want, (i, k, s)


def test_asof_tie_tolerance_range(spark):
    ticks = spark.createDataFrame([(ts(0), 1.0), (ts(120), 2.0), (ts(10_000), 3.0)], "rt timestamp, v double")
    left = spark.createDataFrame([(1, ts(60)), (2, ts(420)), (3, ts(419)), (4, ts(-1)), (5, ts(10_001))], "id long, t timestamp")
    near = asof_join(left, ticks, "t", "rt", ["id"], ["v"], direction="nearest", tolerance_seconds=300, strict=True)
    assert {r["id"]: r["v"] for r in near.collect()} == {1: 2.0, 2: None, 3: 2.0, 4: 1.0, 5: 3.0}
    inside = asof_join(left, ticks, "t", "rt", ["id"], ["v"], direction="nearest", within_range=True)
    assert {r["id"]: r["v"] for r in inside.collect()} == {1: 2.0, 2: 2.0, 3: 2.0, 4: None, 5: None}


@pytest.mark.parametrize("exact_rows", [10**6, 50])
def test_order_statistics(spark, exact_rows):
    rng = np.random.default_rng(1)
    n = 5000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 3, n).astype(float), "c": np.arange(n) % 2 * 1.0})
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.itertuples(index=False)],
                               "a double, b double, c double")
    counts = {c: int(pdf[c].notna().sum()) for c in pdf}
    got = order.exact_medians(df, list(pdf), counts, exact_rows)
    assert got == pytest.approx(pdf.median().to_dict())
    assert order.exact_medians(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double"), ["x"], {"x": 4}) == {"x": 2.5}


@pytest.mark.parametrize("exact_rows", [10**6, 20])
def test_split_point(spark, exact_rows):
    rng = random.Random(5)
    rows = [(i, ts(rng.choice([7, 7, 7, rng.randint(0, 50)]))) for i in range(997)]
    df = spark.createDataFrame(rows, "id long, t timestamp")
    point = order.split_point(df, "t", "id", 0.8, exact_rows)
    early = {r["id"] for r in df.where(order.is_before(point, "t", "id")).collect()}
    assert early == {i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))[: int(0.8 * 997)]}


def test_chunked_fill_and_totals(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("aab"), rng.randint(0, 30), rng.random() if rng.random() < 0.05 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, t int, x double")
    pdf = pd.DataFrame(rows, columns=["id", "k", "t", "x"]).sort_values(["t", "id"])
    chunks = order.ordered_chunks(df, ["t", "id"], 6)
    assert chunks.groupBy("_chunk").count().agg(F.max("count")).first()[0] < 1000
    glob = order.carry_forward(chunks, ["t", "id"], ["x"], suffix="_f").toPandas().sort_values(["t", "id"])
    np.testing.assert_array_equal(glob["x_f"].to_numpy(float), pdf["x"].astype(float).ffill().to_numpy())
    keyed = order.carry_forward(order.ordered_chunks(df, ["k", "t", "id"], 6), ["t", "id"], ["x"], by=["k"], suffix="_f")
    keyed = keyed.toPandas().sort_values(["t", "id"])
    np.testing.assert_array_equal(keyed["x_f"].to_numpy(float), pdf.groupby("k")["x"].ffill().to_numpy(float))
    ones = chunks.withColumn("one", F.lit(1))
    total = order.running_totals(ones, ["t", "id"], {"one": "n"}).toPandas().sort_values(["t", "id"])
    assert list(total["n"]) == list(range(1, 3001))


def test_salted_join_splits_hot_keys(spark):
    left = spark.range(1000).withColumn("k", F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 50))
    right = spark.range(60).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted(tuple(r) for r in left.join(right, "k").select("id", "k", "v").collect())
    got = skew.salted_join(left, right, ["k"], ["id"], target_rows=100)
    assert sorted(tuple(r) for r in got.select("id", "k", "v").collect()) == want
    hot = skew.hot_groups(left, ["k"], 100).collect()
    assert [tuple(r) for r in hot] == [(1, 8)]


def test_rows_with_null_keys_stay(spark):
    from newsflow.operators.order import running_totals
    from newsflow.operators.prepare import carry_market
    from newsflow.operators.series import densify, relative_change, with_positions

    rows = [(1, "a", "2024-01-01", 1.0), (2, None, "2024-01-01", None), (3, None, "2024-01-02", 5.0), (4, None, "2024-01-03", None), (5, "a", None, None),
            (6, None, None, 7.0)]
    df = spark.createDataFrame(rows, "id int, ticker string, d string, vix_close double").select(
        "id", "ticker", F.col("d").cast("date").alias("date"), F.col("d").cast("timestamp").alias("datetime"), "vix_close")
    carried = {r["id"]: r["vix_close"] for r in carry_market(df).collect()}
    assert carried.keys() == {1, 2, 3, 4, 5, 6} and carried[4] == 5.0
    totals = running_totals(df.withColumn("b", F.col("date")), ["id"], {"vix_close": "s"}, ["ticker"], "b")
    assert totals.count() == 6
    assert with_positions(df, ["id"], "date", ["ticker"]).count() == 6
    assert {r["id"] for r in relative_change(df, ["ticker"], "date", "vix_close", "change").collect()} == {1, 2, 3, 4, 5, 6}
    dense = densify(df, ["ticker"], "date", ["vix_close"], F.lit("2024-01-03").cast("date"))
    assert dense.where("ticker IS NULL AND date IS NOT NULL").count() == 3 and dense.where("date IS NULL").count() == 2


def test_hot_null_key_is_split(spark):
    from newsflow.operators import skew

    left = spark.range(1000).select("id", F.when(F.col("id") >= 900, F.col("id")).alias("k"))
    hot = skew.hot_groups(left, ["k"], 100)
    salted = skew.salt_rows(left, ["k"], hot, ["id"])
    assert salted.where("k IS NULL").select(skew.SALT).distinct().count() == 9
    right = left.select("k", F.lit(1).alias("x")).where("k = 950")
    assert skew.salted_join(left, right, ["k"], ["id"], "left", 100).count() == 1000
