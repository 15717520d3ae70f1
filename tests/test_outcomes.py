"""Outcomes by the horizon table against a search over the closes, and the as-of join with dense days."""

import datetime as dt
import random

import pytest

from newsflow.plans import enrich
from newsflow.registry import load

SF = "/root/testdata/sf0.001"
DAY = dt.timedelta(days=1)


def close_at(closes, day, last):
    """Close of the last known day up to `day`; none before the first day or after the calendar's end."""
    known = [d for d in closes if d <= day]
    return closes[max(known)] if known and day <= last else None


def expected(rows, closes, as_of, by):
    first, last = min(d for c in closes.values() for d in c), max([as_of + DAY, *[d for c in closes.values() for d in c]])
    out = {}
    for i, ticker, at in rows:
        own = closes.get(ticker if by else "x", {})
        day = at.date()
        eod = day + DAY * (at.hour >= 16)
        friday = (4 - day.weekday()) % 7
        eow = day + DAY * (7 if friday == 0 and at.hour >= 16 else friday)
        now = close_at(own, min(day, last), last)
        d, w = close_at(own, max(eod, first), last), close_at(own, max(eow, first), last)

        def change(p):
            return None if p is None or not now else round((p - now) / now * 100, 9)

        out[i] = (change(d), change(w)) if now is not None and d is not None else (None, None)
    return out


@pytest.mark.parametrize("by", [(), ("ticker",)])
def test_outcomes_equal_search(spark, by):
    rng = random.Random(4)
    start = dt.date(2024, 1, 1)
    tickers = ["a", "b", "c"] if by else ["x"]
    closes = {t: {start + DAY * d: rng.randrange(0, 9) + 0.5 * rng.randrange(3) for d in rng.sample(range(9 * k, 60), 25)} for k, t in enumerate(tickers)}
    rows = [(i, rng.choice([*tickers, None, "unknown"]), dt.datetime(2024, 1, 1) + DAY * rng.randrange(-12, 90) + dt.timedelta(hours=rng.randrange(24)))
            for i in range(900)]
    articles = spark.createDataFrame(rows, "id long, ticker string, datetime timestamp_ntz").selectExpr("id", "ticker", "cast(datetime as timestamp) datetime")
    daily = spark.createDataFrame([(t, d, c) for t, cs in closes.items() for d, c in cs.items()], "ticker string, date date, close double")
    as_of = dt.date(2024, 3, 10)
    got = enrich.add_outcomes(articles, daily if by else daily.drop("ticker"), as_of, by=list(by), target_rows=50).collect()
    want = expected(rows, closes, as_of, by)
    assert len(got) == len(rows)
    found = 0
    for r in got:
        have = tuple(None if v is None else round(v, 9) for v in (r.pct_change_eod, r.pct_change_eow))
        assert have == pytest.approx(want[r.id], abs=1e-8), r
        found += r.pct_change_eow is not None
    assert found > 100


def test_known_outcomes_and_rows_without_time_stay(spark):
    rows = [(1, "2024-01-02 10:00:00", 5.0), (2, "2024-01-02 10:00:00", None), (3, None, None)]
    articles = spark.createDataFrame(rows, "id long, t string, pct_change_eod double").selectExpr("id", "cast(t as timestamp) datetime", "pct_change_eod")
    daily = spark.createDataFrame([(dt.date(2024, 1, 2), 10.0), (dt.date(2024, 1, 5), 11.0)], "date date, close double")
    got = {r.id: (r.pct_change_eod, r.pct_change_eow) for r in enrich.add_outcomes(articles, daily, "2024-02-01").collect()}
    assert got == {1: (5.0, None), 2: (0.0, pytest.approx(10.0)), 3: (None, None)}


def test_one_lookup_per_article(spark):
    """Articles meet the horizon once, whatever the number of outcomes: one join on (ticker, day)."""
    plan = load()[0]["q_outcome_ticker"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_salt" in line]  # others only meet the few hot keys
    assert len(joins) == 1
