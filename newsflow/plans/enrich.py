"""Enrichment of articles: prices and indicators, calendar features, market context, outcomes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.functions import temporal
from newsflow.functions.urls import price_ticker
from newsflow.operators import skew
from newsflow.operators.asof import asof_join
from newsflow.operators.indicators import INDICATORS, indicator_table
from newsflow.operators.keys import guarded_update
from newsflow.operators.series import densify, relative_change
from newsflow.schema import CONTEXT, INDICATORS as INDICATOR_TYPES, OUTCOME, PRICE, TEMPORAL, ensure_columns

# A daily table has one row per day; up to this span it is small enough to send to every executor.
MAX_CALENDAR_DAYS = 200_000
CONTEXT_TOLERANCE_DAYS = 5
TICK_TOLERANCE_SECONDS = 300
# Days ahead of an article that its outcomes may need: from a Friday after the close to the next Friday.
HORIZON_DAYS = 7
BARS = ("open", "high", "low", "close", "volume")


def lit_date(day: dt.date | str) -> Column:
    return F.lit(str(day)).cast("date")


def is_unpriced() -> Column:
    """Articles of a named ticker that lack a price or an indicator."""
    named = F.col("ticker").isNotNull() & (F.col("ticker") != "")
    return named & (F.col("price_close").isNull() | F.col("rsi_14").isNull())


def lacks_temporal() -> Column:
    return F.col("hour_sin").isNull() & F.col("datetime").isNotNull()


def lacks_outcome() -> Column:
    return F.col("pct_change_eod").isNull() & F.col("datetime").isNotNull()


def named_tickers(articles: DataFrame) -> DataFrame:
    return articles.where(F.col("ticker").isNotNull() & (F.col("ticker") != "")).select("ticker").distinct()


def dates_without_context(articles: DataFrame) -> DataFrame:
    """Days with an article that lacks context: one row per day, combined before the shuffle."""
    return articles.where(F.col("vix_close").isNull()).select(F.to_date("datetime").alias("date")).distinct()


def daily_indicators(bars: DataFrame, as_of: dt.date | str, min_bars: int = 15) -> DataFrame:
    """Bars with indicators, computed on trading days and then filled to every day up to as_of + 1."""
    table = indicator_table(bars, min_bars=min_bars)
    return densify(table, ["ticker"], "date", [*BARS, *INDICATORS], F.date_add(lit_date(as_of), 1))


def _with_daily(pending: DataFrame, daily: DataFrame, how: str, target_rows: int) -> tuple[DataFrame, dict[str, Column]]:
    """Rows joined to the daily row of their ticker and Eastern day, and the columns that gives."""
    keyed = pending.withColumns({"_tk": price_ticker(F.col("_ticker")), "_day": temporal.market_date(F.col("datetime"))})
    right = daily.select(
        F.col("ticker").alias("_tk"), F.col("date").alias("_day"), F.lit(True).alias("_hit"),
        *[F.col(c).alias(f"_d_{c}") for c in (*BARS, *INDICATORS)],
    )
    new = {
        "price_close": F.col("_d_close"), "price_open": F.col("_d_open"), "price_high": F.col("_d_high"),
        "price_low": F.col("_d_low"), "volume": F.col("_d_volume").cast("bigint"),
        **{c: F.col(f"_d_{c}") for c in INDICATORS},
    }
    return skew.salted_join(keyed, right, ["_tk", "_day"], ["id"], how, target_rows), new


def _priceable(articles: DataFrame) -> DataFrame:
    prices = {c: PRICE[c] for c in ("price_close", "price_open", "price_high", "price_low", "volume")}
    return ensure_columns(articles, {**prices, **INDICATOR_TYPES})


def price_updates(articles: DataFrame, daily: DataFrame, target_rows: int = skew.TARGET_ROWS) -> DataFrame:
    """Price record (id and twelve columns) of each unpriced article that has a daily row.

    Only id, ticker, time and two price columns are read and shuffled, never the text. The record can be
    merged into the table, or kept beside it.
    """
    pending = _priceable(articles).where(is_unpriced()).select("id", "datetime", F.col("ticker").alias("_ticker"))
    joined, new = _with_daily(pending, daily, "inner", target_rows)
    return joined.select("id", *[value.alias(c) for c, value in new.items()])


def enrich_prices(articles: DataFrame, daily: DataFrame, target_rows: int = skew.TARGET_ROWS) -> DataFrame:
    """The table with price and indicator columns filled for unpriced articles.

    Unpriced articles meet the daily rows in one left join on (ticker, day); days with very many of them are split.
    Articles without a daily row keep what they have, and those already priced pass by without a shuffle. A NULL in the
    daily row overwrites. Where the text is not needed, prefer `price_updates`.
    """
    table = _priceable(articles)
    names = table.columns
    pending = table.where(is_unpriced()).withColumn("_ticker", F.col("ticker"))
    joined, new = _with_daily(pending, daily, "left", target_rows)
    priced = guarded_update(joined, F.coalesce("_hit", F.lit(False)), new).select(*names)
    return table.where(~is_unpriced()).select(*names).unionByName(priced)


def add_temporal(articles: DataFrame) -> DataFrame:
    """Fill the cyclic hour and the weekday where they are missing. Narrow."""
    table = ensure_columns(articles, TEMPORAL)
    ts = F.col("datetime")
    flagged = table.withColumn("_todo", lacks_temporal())
    return guarded_update(flagged, F.col("_todo"), {
        "hour_sin": temporal.hour_sin(ts), "hour_cos": temporal.hour_cos(ts), "day_of_week": temporal.day_of_week(ts),
    }).drop("_todo")


def calendar_span(series: DataFrame, date_col: str = "date") -> tuple[dt.date, dt.date] | None:
    """First and last day of a daily series: two numbers, from one aggregate."""
    row = series.agg(F.min(date_col).alias("a"), F.max(date_col).alias("b")).first()
    return None if row["a"] is None else (row["a"], row["b"])


def broadcast_calendar(daily: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Broadcast a table with one row per day if its span is bounded; else leave the join to the optimizer."""
    return F.broadcast(daily) if (last - first).days < MAX_CALENDAR_DAYS else daily


def _day(value: dt.date | str) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def context_calendar(vix: DataFrame, spy: DataFrame, as_of: dt.date | str) -> tuple[DataFrame, dt.date, dt.date] | None:
    """One row per day from the first VIX day to as_of + 1: VIX close and index return, filled forward.

    `vix` and `spy` are (date, close). Returns before the first one known count as 0. Also returns the span.
    """
    span = calendar_span(vix)
    if span is None:
        return None
    first, last = span[0], max(span[1], _day(as_of) + dt.timedelta(days=1))
    one = F.lit(0).alias("_s")
    returns = relative_change(spy.select(one, "date", "close"), ["_s"], "date", "close", "ret")
    none = F.lit(None).cast("double")
    both = (
        vix.select("date", F.col("close").alias("vix_close"), none.alias("spy_daily_return"))
        .unionByName(returns.select("date", none.alias("vix_close"), F.col("ret").alias("spy_daily_return")))
        .where(F.col("date").between(lit_date(first), lit_date(last)))
        .groupBy("date").agg(F.max("vix_close").alias("vix_close"), F.max("spy_daily_return").alias("spy_daily_return"))
        .select(one, "*")
    )
    filled = densify(both, ["_s"], "date", list(CONTEXT), lit_date(last))
    daily = filled.select("date", "vix_close", F.coalesce("spy_daily_return", F.lit(0.0)).alias("spy_daily_return"))
    return daily, first, last


def add_context(articles: DataFrame, vix: DataFrame, spy: DataFrame, as_of: dt.date | str,
                tolerance_days: int = CONTEXT_TOLERANCE_DAYS) -> DataFrame:
    """Set VIX level and index return of every article on a day where some article lacks them.

    The value is that of the first index day on or after the article's UTC day, at most five days later. The
    calendar has no holes, so only days before its start look ahead.
    """
    table = ensure_columns(articles, CONTEXT)
    found = context_calendar(vix, spy, as_of)
    if found is None:
        return table
    daily, first, last = found
    names = table.columns

    def index_day(day: Column) -> Column:
        early = (day < lit_date(first)) & (F.date_diff(lit_date(first), day) <= tolerance_days)
        return F.when(early, lit_date(first)).otherwise(day)

    todo = dates_without_context(table).select(F.col("date").alias("_day"), index_day(F.col("date")).alias("date"))
    values = daily.join(todo, "date").select(
        "_day", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_d_{c}") for c in CONTEXT])
    keyed = table.withColumn("_day", F.to_date("datetime"))
    joined = keyed.join(broadcast_calendar(values, first, last), "_day", "left")
    return guarded_update(joined, F.coalesce("_hit", F.lit(False)), {c: F.col(f"_d_{c}") for c in CONTEXT}).select(*names)


def tick_lookups(articles: DataFrame, ticks: DataFrame, bucket_seconds: int = 86_400,
                 target_rows: int = skew.TARGET_ROWS) -> DataFrame:
    """Index price at the article time (inside the span of the ticks) and near +1 h and +4 h, one row per id.

    The three times of an article are looked up in one as-of pass and then put side by side.
    """
    kinds = F.array(*[
        F.struct(F.lit(k).alias("kind"), (F.col("datetime") + F.expr(f"INTERVAL {h} HOURS")).alias("at"))
        for k, h in (("now", 0), ("1h", 1), ("4h", 4))
    ])
    asked = articles.select("id", F.explode(kinds).alias("q")).select("id", "q.kind", "q.at")
    got = asof_join(asked, ticks, "at", "ts", ["id", "kind"], ["close"], direction="nearest", match_ts="_mts",
                    bucket_seconds=bucket_seconds, target_rows=target_rows)
    spanned = asof_join_span(ticks)
    near = F.abs(F.unix_micros("_mts") - F.unix_micros("at")) < TICK_TOLERANCE_SECONDS * 1_000_000
    inside = F.col("at").between(*spanned) if spanned else F.lit(False)
    return got.groupBy("id").agg(
        F.max(F.when((F.col("kind") == "now") & inside, F.col("close"))).alias("tick_now"),
        F.max(F.when((F.col("kind") == "1h") & near, F.col("close"))).alias("tick_1h"),
        F.max(F.when((F.col("kind") == "4h") & near, F.col("close"))).alias("tick_4h"),
    )


def asof_join_span(ticks: DataFrame) -> tuple[Column, Column] | None:
    """First and last tick as literals."""
    row = ticks.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    return None if row["a"] is None else (F.timestamp_micros(F.lit(row["a"])), F.timestamp_micros(F.lit(row["b"])))


def horizon_table(
    closes: DataFrame, by: Sequence[str], end: Column, days: int = HORIZON_DAYS, date_col: str = "date",
) -> DataFrame:
    """One row per key and calendar day with `_ahead`: the closes of the day and of each of the `days` days after it.

    Closes are filled forward to `end` and NULL after it. Days ahead of a key's first close are there as well, as far as that
    close lies within the horizon. A key has one row per day, so its window is a calendar, whatever the number of articles.
    """
    by = list(by)
    # A key's calendar starts early, so that a day before the first close sees it ahead.
    starts = closes.groupBy(*by).agg(F.date_sub(F.min(date_col), days).alias(date_col)).withColumn("close", F.lit(None).cast("double"))
    dense = densify(closes.select(*by, date_col, "close").unionByName(starts), by, date_col, ["close"], end)
    order = Window.partitionBy(*by).orderBy(date_col)
    ahead = [F.col("close"), *[F.lead("close", k).over(order) for k in range(1, days + 1)]]
    return dense.select(*by, date_col, F.array(*ahead).alias("_ahead"))


def add_outcomes(
    articles: DataFrame, index_daily: DataFrame, as_of: dt.date | str, ticks: DataFrame | None = None,
    by: Sequence[str] = (), target_rows: int = skew.TARGET_ROWS,
) -> DataFrame:
    """Percent changes 1 h, 4 h, to the end of the day and of the week for articles without an outcome.

    `index_daily` is (date, close) of one index, or with `by=["ticker"]` (ticker, date, close) to measure each
    article against its own ticker. The price at the article time is the nearest tick inside the span of the
    ticks, else the close of the article's day. Rows without an end-of-day outcome are not touched.

    All daily closes of an article come from one row of the horizon table, so there is one join on (key, day), and only
    rows that still lack an outcome take part in it.
    """
    table = ensure_columns(articles, {c: OUTCOME[c] for c in (
        "pct_change_1h", "pct_change_4h", "pct_change_eod", "pct_change_eow")})
    names = table.columns
    span = calendar_span(index_daily)
    if span is None:
        return table
    by = list(by)
    first, last = span[0], max(span[1], _day(as_of) + dt.timedelta(days=1))
    keyed_daily = index_daily.select(*by, "date", "close") if by else index_daily.select(
        F.lit(0).alias("_s"), "date", "close")
    horizon = horizon_table(keyed_daily, by or ["_s"], lit_date(last)).drop("_s").withColumnRenamed("date", "_key")

    todo = table.where(lacks_outcome())
    if ticks is None:
        todo = todo.withColumns({c: F.lit(None).cast("double") for c in ("tick_now", "tick_1h", "tick_4h")})
    else:
        looked = tick_lookups(todo.select("id", "datetime"), ticks, target_rows=target_rows)
        todo = todo.join(looked, "id", "left")
    day = F.to_date("datetime")
    todo = todo.withColumn("_key", F.greatest(F.least(day, lit_date(last)), lit_date(first)))
    if by:
        todo = skew.salted_join(todo, horizon, [*by, "_key"], ["id"], "left", target_rows)
    else:
        todo = todo.join(broadcast_calendar(horizon, first, last), "_key", "left")

    def close_on(target: Column) -> Column:
        """Close on a day; days before the calendar count as its first day."""
        place = F.date_diff(F.greatest(target, lit_date(first)), F.col("_key"))
        return F.when((place >= 0) & (place <= HORIZON_DAYS), F.get("_ahead", place))

    own = F.when(day >= lit_date(first), F.get("_ahead", F.lit(0)))
    todo = todo.withColumns({
        "_now": F.coalesce("tick_now", own), "_p_eod": close_on(temporal.eod_date(F.col("datetime"))),
        "_p_eow": close_on(temporal.eow_date(F.col("datetime")))})
    now = F.col("_now")
    changes = {
        "pct_change_1h": temporal.pct_change(F.col("tick_1h"), now),
        "pct_change_4h": temporal.pct_change(F.col("tick_4h"), now),
        "pct_change_eod": temporal.pct_change(F.col("_p_eod"), now),
        "pct_change_eow": temporal.pct_change(F.col("_p_eow"), now),
    }
    settled = now.isNotNull() & F.col("_p_eod").isNotNull()
    done = guarded_update(todo, settled, changes).select(*names)
    return table.where(~lacks_outcome()).select(*names).unionByName(done)
