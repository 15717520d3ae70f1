"""Queries on bars, indicators, calendars, as-of joins, enrichment and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.functions import temporal
from newsflow.functions.urls import partition_key, price_ticker
from newsflow.operators.indicators import INDICATORS, indicator_table
from newsflow.operators.order import is_before, split_point
from newsflow.operators.prepare import carry_market
from newsflow.operators.series import densify, relative_change, series_lengths
from newsflow.plans import enrich, report
from newsflow.registry import views
from newsflow.registry.base import SQL_DAY, SQL_STAMP, day, query, rounded, stamp
from newsflow.sources import tables

DAY, STAMP = SQL_DAY.format("date"), SQL_STAMP.format("dt")
PRICE_DIGITS = 3

# Recursive means by recursion over the row number, one step per row.
V_STEPS = """
rows0 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS rn, count(*) OVER (PARTITION BY ticker) AS total,
  close - lag(close) OVER (PARTITION BY ticker ORDER BY date) AS move FROM v_bars),
rows1 AS (SELECT *, avg(close) OVER w12 AS m12, avg(close) OVER w26 AS m26,
  avg(greatest(move, 0.0)) OVER w14 AS mg, avg(greatest(-move, 0.0)) OVER w14 AS ml FROM rows0 WHERE total >= 15
  WINDOW w12 AS (PARTITION BY ticker ORDER BY date ROWS 11 PRECEDING), w26 AS (PARTITION BY ticker ORDER BY date ROWS 25 PRECEDING),
    w14 AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING)),
steps(ticker, rn, e12, e26, g, l, macd, msum, sig) AS (
  SELECT ticker, rn, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
    CAST(NULL AS DOUBLE), 0.0::DOUBLE, CAST(NULL AS DOUBLE) FROM rows1 WHERE rn = 0
  UNION ALL
  SELECT ticker, rn, e12, e26, g, l, e12 - e26, msum + coalesce(e12 - e26, 0),
    CASE WHEN rn = 33 THEN (msum + e12 - e26) / 9 WHEN rn > 33 THEN (e12 - e26) * 0.2::DOUBLE + sig * 0.8::DOUBLE END FROM (
    SELECT r.ticker, r.rn,
      CASE WHEN r.rn = 11 THEN m12 WHEN r.rn > 11 THEN r.close * (2 / 13.0::DOUBLE) + s.e12 * (1 - 2 / 13.0::DOUBLE) END AS e12,
      CASE WHEN r.rn = 25 THEN m26 WHEN r.rn > 25 THEN r.close * (2 / 27.0::DOUBLE) + s.e26 * (1 - 2 / 27.0::DOUBLE) END AS e26,
      CASE WHEN r.rn = 14 THEN mg WHEN r.rn > 14 THEN greatest(r.move, 0.0) / 14 + s.g * (13 / 14.0::DOUBLE) END AS g,
      CASE WHEN r.rn = 14 THEN ml WHEN r.rn > 14 THEN greatest(-r.move, 0.0) / 14 + s.l * (13 / 14.0::DOUBLE) END AS l,
      s.msum, s.sig
    FROM steps s JOIN rows1 r ON r.ticker = s.ticker AND r.rn = s.rn + 1))"""
V_IND = V_STEPS + """,
v_ind AS (SELECT r.ticker, r.date, r.open, r.high, r.low, r.close, r.volume, s.macd, s.macd - s.sig AS macd_hist, s.g, s.l,
  CASE WHEN s.g + s.l > 0 THEN 100 * s.g / (s.g + s.l) END AS rsi_14,
  CASE WHEN count(*) OVER w20 = 20 THEN avg(close) OVER w20 + 2 * stddev_samp(close) OVER w20 END AS std_upper,
  CASE WHEN count(*) OVER w20 = 20 THEN avg(close) OVER w20 - 2 * stddev_samp(close) OVER w20 END AS std_lower,
  CASE WHEN count(*) OVER w20 = 20 THEN CASE WHEN close = 0 THEN 0 ELSE 4 * stddev_samp(close) OVER w20 / close END END AS std_channel_width,
  CASE WHEN count(*) OVER w50 = 50 THEN (close - avg(close) OVER w50) / avg(close) OVER w50 END AS price_vs_sma50
  FROM rows1 r JOIN steps s ON s.ticker = r.ticker AND s.rn = r.rn
  WINDOW w20 AS (PARTITION BY r.ticker ORDER BY r.date ROWS 19 PRECEDING), w50 AS (PARTITION BY r.ticker ORDER BY r.date ROWS 49 PRECEDING))"""
WITH_IND = f"WITH RECURSIVE {views.V_BARS}, {V_IND}"

_DIGITS = {"std_upper": 3, "std_lower": 3, "std_channel_width": 6, "price_vs_sma50": 6, "rsi_14": 6, "macd": 3, "macd_hist": 3}


def _sql_rounded(names, prefix=""):
    return ", ".join(f"round({prefix}{c}, {_DIGITS[c]}) AS {c}" for c in names)


def _indicators(spark, sf_dir, names) -> DataFrame:
    table = indicator_table(views.bars(spark, sf_dir))
    return rounded(table.select("ticker", day("date").alias("date"), *names), {c: _DIGITS[c] for c in names})


def _register(name: str, *names: str):
    @query(name, f"{WITH_IND} SELECT ticker, {DAY} AS date, {_sql_rounded(names)} FROM v_ind")
    def run(spark, sf_dir):
        return _indicators(spark, sf_dir, names)


_register("q_bollinger", "std_upper", "std_lower", "std_channel_width")
_register("q_sma50", "price_vs_sma50")
_register("q_rsi", "rsi_14")
_register("q_macd", "macd", "macd_hist")
_register("q_indicator_table", *INDICATORS)


@query("q_returns", f"""WITH {views.V_INDEX} SELECT {DAY} AS date,
  round(close / lag(close) OVER (ORDER BY date) - 1, 9) AS change FROM v_index""")
def returns(spark, sf_dir):
    one = views.index_daily(spark, sf_dir).select(F.lit(0).alias("s"), "date", "close")
    changed = relative_change(one, ["s"], "date", "close", "change")
    return changed.select(day("date").alias("date"), F.round("change", 9).alias("change"))


# Bars whose last order is pending have no close.
V_GAPS = views.V_BARS + """,
v_gaps AS (SELECT ticker, date, CASE WHEN last_status <> 'P' THEN close END AS close, volume FROM v_bars)"""


def gap_bars(spark, sf_dir) -> DataFrame:
    return views.bars(spark, sf_dir).select(
        "ticker", "date", F.when(F.col("last_status") != "P", F.col("close")).alias("close"), "volume")


@query("q_densify", f"""WITH {V_GAPS}, span AS (SELECT ticker, min(date) AS a, greatest(max(date), DATE '2002-01-01') AS b FROM v_gaps GROUP BY 1),
  days AS (SELECT ticker, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span)
  SELECT d.ticker, {SQL_DAY.format('d.date')} AS date,
    last_value(close IGNORE NULLS) OVER w AS close, CAST(last_value(volume IGNORE NULLS) OVER w AS BIGINT) AS volume
  FROM days d LEFT JOIN v_gaps g ON g.ticker = d.ticker AND g.date = d.date
  WINDOW w AS (PARTITION BY d.ticker ORDER BY d.date ROWS UNBOUNDED PRECEDING)""")
def densified(spark, sf_dir):
    out = densify(gap_bars(spark, sf_dir), ["ticker"], "date", ["close", "volume"], enrich.lit_date("2002-01-01"))
    return out.withColumn("date", day("date"))


# Some tickers are written with a dot, as news does; some articles already have a price.
PRICED = "CASE WHEN lang = 'de' THEN 1.5 END"
V_PRICED = f"""{views.V_ARTICLES}, {views.V_BARS}, {V_IND},
daily AS (SELECT v.*, CASE WHEN lang = 'de' THEN NULL ELSE d END AS m FROM (
  SELECT a.*, CAST(timezone('America/New_York', timezone('UTC', dt)) AS DATE) AS ny FROM v_articles a) v
  ASOF LEFT JOIN v_ind d ON d.ticker = v.ticker AND v.ny >= d.date),
v_priced AS (SELECT *, CASE WHEN ny <= DATE '2002-01-01' THEN m END AS p FROM daily)"""


def priced_articles(spark, sf_dir) -> DataFrame:
    docs = views.articles(spark, sf_dir)
    done = F.when(F.col("lang") == "de", 1.5)
    docs = docs.withColumns({"price_close": done, "rsi_14": done})
    daily = enrich.daily_indicators(views.bars(spark, sf_dir), views.AS_OF)
    return enrich.enrich_prices(docs, daily)


@query("q_price_enrich", f"""WITH RECURSIVE {V_PRICED} SELECT id, coalesce({PRICED}, p.close) AS price_close, p.open AS price_open,
  p.high AS price_high, p.low AS price_low, CAST(p.volume AS DOUBLE) AS volume, coalesce({PRICED}, round(p.rsi_14, 6)) AS rsi_14,
  {_sql_rounded([c for c in INDICATORS if c != 'rsi_14'], 'p.')} FROM v_priced""")
def price_enrich(spark, sf_dir):
    out = priced_articles(spark, sf_dir).withColumn("volume", F.col("volume").cast("double"))
    names = ["price_close", "price_open", "price_high", "price_low", "volume", *INDICATORS]
    return rounded(out.select("id", *names), _DIGITS)


@query("q_price_updates", f"""WITH RECURSIVE {V_PRICED} SELECT id, p.close AS price_close, p.open AS price_open, p.high AS price_high,
  p.low AS price_low, CAST(p.volume AS DOUBLE) AS volume, {_sql_rounded(INDICATORS, 'p.')} FROM v_priced WHERE p.close IS NOT NULL""")
def price_updates(spark, sf_dir):
    done = F.when(F.col("lang") == "de", 1.5)
    docs = views.articles(spark, sf_dir).withColumns({"price_close": done, "rsi_14": done})
    daily = enrich.daily_indicators(views.bars(spark, sf_dir), views.AS_OF)
    updates = enrich.price_updates(docs, daily)
    return rounded(updates.withColumn("volume", F.col("volume").cast("double")), _DIGITS)


@query("q_ticker_series", f"""WITH RECURSIVE {V_PRICED} SELECT id, {STAMP} AS datetime, p.open AS price_open, p.high AS price_high,
  p.low AS price_low, coalesce({PRICED}, p.close) AS price_close, round(p.std_upper, 3) AS std_upper, round(p.std_lower, 3) AS std_lower,
  coalesce({PRICED}, round(p.rsi_14, 6)) AS rsi_14, round(p.macd, 3) AS macd, round(p.macd_hist, 3) AS macd_hist
  FROM v_priced WHERE ticker = '1'""")
def ticker_series(spark, sf_dir):
    out = report.ticker_series(priced_articles(spark, sf_dir), "1").withColumn("datetime", stamp("datetime"))
    return rounded(out, {c: _DIGITS[c] for c in ("std_upper", "std_lower", "rsi_14", "macd", "macd_hist")})


@query("q_temporal", f"""WITH {views.V_ARTICLES} SELECT id, round(sin(2 * pi() * hour(dt) / 24), 9) AS hour_sin,
  round(cos(2 * pi() * hour(dt) / 24), 9) AS hour_cos, CAST(isodow(dt) - 1 AS INT) AS day_of_week FROM v_articles""")
def temporal_features(spark, sf_dir):
    out = enrich.add_temporal(views.articles(spark, sf_dir)).select("id", "hour_sin", "hour_cos", "day_of_week")
    return rounded(out, {"hour_sin": 9, "hour_cos": 9})


# The volatility series starts late, so that articles before it look ahead, up to five days.
@query("q_context", f"""WITH {views.V_ARTICLES}, {views.V_VIX}, {views.V_INDEX},
  late AS (SELECT * FROM v_vix WHERE date >= DATE '1995-03-06'),
  ret AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS ret FROM v_index),
  span AS (SELECT CAST(unnest(generate_series(min(date), greatest(max(date), DATE '2002-01-01'), INTERVAL 1 DAY)) AS DATE) AS date FROM late),
  cal AS (SELECT s.date, last_value(v.close IGNORE NULLS) OVER w AS vix, coalesce(last_value(r.ret IGNORE NULLS) OVER w, 0) AS ret
    FROM span s LEFT JOIN late v ON v.date = s.date LEFT JOIN ret r ON r.date = s.date
    WINDOW w AS (ORDER BY s.date ROWS UNBOUNDED PRECEDING))
  SELECT id, CASE WHEN c.date - CAST(dt AS DATE) <= 5 THEN round(vix, 6) END AS vix_close,
    CASE WHEN c.date - CAST(dt AS DATE) <= 5 THEN round(ret, 9) END AS spy_daily_return
  FROM v_articles a ASOF LEFT JOIN cal c ON CAST(a.dt AS DATE) <= c.date""")
def context(spark, sf_dir):
    vix = views.vix_daily(spark, sf_dir).where("date >= '1995-03-06'")
    out = enrich.add_context(views.articles(spark, sf_dir), vix, views.index_daily(spark, sf_dir), views.AS_OF)
    return rounded(out.select("id", "vix_close", "spy_daily_return"), {"vix_close": 6, "spy_daily_return": 9})


def _sql_near(at: str) -> str:
    """Nearest tick: the later one unless the earlier one is strictly closer."""
    return f"""(SELECT q.id, CASE WHEN b.ts IS NULL OR (f.ts IS NOT NULL AND f.ts - {at} <= {at} - b.ts) THEN f.close ELSE b.close END AS close,
    CASE WHEN b.ts IS NULL OR (f.ts IS NOT NULL AND f.ts - {at} <= {at} - b.ts) THEN f.ts - {at} ELSE {at} - b.ts END AS gap
    FROM v_news_ticks q ASOF LEFT JOIN v_ticks b ON {at} >= b.ts ASOF LEFT JOIN v_ticks f ON {at} <= f.ts)"""


@query("q_outcome_intraday", f"""WITH {views.V_TICKS}, now AS {_sql_near('q.dt')}, h1 AS {_sql_near("(q.dt + INTERVAL 1 HOUR)")},
  h4 AS {_sql_near("(q.dt + INTERVAL 4 HOUR)")}
  SELECT q.id, CASE WHEN q.dt BETWEEN (SELECT min(ts) FROM v_ticks) AND (SELECT max(ts) FROM v_ticks) THEN now.close END AS tick_now,
    CASE WHEN h1.gap < INTERVAL 300 SECOND THEN h1.close END AS tick_1h, CASE WHEN h4.gap < INTERVAL 300 SECOND THEN h4.close END AS tick_4h
  FROM v_news_ticks q JOIN now USING (id) JOIN h1 USING (id) JOIN h4 USING (id)""")
def outcome_intraday(spark, sf_dir):
    return enrich.tick_lookups(views.tick_news(spark, sf_dir), views.ticks(spark, sf_dir))


EOW = "CAST(dt AS DATE) + CAST(CASE WHEN isodow(dt) = 5 AND hour(dt) >= 16 THEN 7 ELSE (12 - isodow(dt)) % 7 END AS INT)"


@query("q_outcome_daily", f"""WITH {views.V_ARTICLES}, {views.V_INDEX},
  k AS (SELECT id, CAST(dt AS DATE) AS d0, CAST(dt AS DATE) + CASE WHEN hour(dt) >= 16 THEN 1 ELSE 0 END AS d1, {EOW} AS d2 FROM v_articles WHERE lang <> 'de')
  SELECT k.id, round((b.close - a.close) / a.close * 100, 6) AS pct_change_eod, round((c.close - a.close) / a.close * 100, 6) AS pct_change_eow
  FROM k ASOF JOIN v_index a ON k.d0 >= a.date ASOF JOIN v_index b ON k.d1 >= b.date ASOF JOIN v_index c ON k.d2 >= c.date
  UNION ALL SELECT id, 9.0, NULL FROM v_articles WHERE lang = 'de'""")
def outcome_daily(spark, sf_dir):
    # Articles in German have an outcome already.
    docs = views.articles(spark, sf_dir).withColumn("pct_change_eod", F.when(F.col("lang") == "de", 9.0))
    out = enrich.add_outcomes(docs, views.index_daily(spark, sf_dir), "2003-01-31")
    return rounded(out.select("id", "pct_change_eod", "pct_change_eow"), {"pct_change_eod": 6, "pct_change_eow": 6})


@query("q_outcome_ticker", f"""WITH {views.V_ARTICLES}, {views.V_BARS},
  k AS (SELECT id, ticker, CAST(dt AS DATE) AS d0, CAST(dt AS DATE) + CASE WHEN hour(dt) >= 16 THEN 1 ELSE 0 END AS d1, {EOW} AS d2 FROM v_articles)
  SELECT k.id, round((b.close - a.close) / a.close * 100, 6) AS pct_change_eod, round((c.close - a.close) / a.close * 100, 6) AS pct_change_eow
  FROM k ASOF LEFT JOIN v_bars a ON k.ticker = a.ticker AND k.d0 >= a.date
    ASOF LEFT JOIN v_bars b ON CASE WHEN a.close IS NOT NULL THEN k.ticker END = b.ticker AND k.d1 >= b.date
    ASOF LEFT JOIN v_bars c ON CASE WHEN a.close IS NOT NULL THEN k.ticker END = c.ticker AND k.d2 >= c.date""")
def outcome_ticker(spark, sf_dir):
    bars = views.bars(spark, sf_dir).select("ticker", "date", "close")
    out = enrich.add_outcomes(views.articles(spark, sf_dir), bars, "2003-01-31", by=["ticker"])
    return rounded(out.select("id", "pct_change_eod", "pct_change_eow"), {"pct_change_eod": 6, "pct_change_eow": 6})


# Every event is an article here; its outcomes take ticks where there are any near, and the closes of the index.
V_JOB_TICKS = views.V_TICKS.replace("WHERE event_type = 'signup'", "")


@query("q_outcome_job", f"""WITH {V_JOB_TICKS}, {views.V_EVENT_INDEX}, now AS {_sql_near('q.dt')}, h1 AS {_sql_near("(q.dt + INTERVAL 1 HOUR)")},
  h4 AS {_sql_near("(q.dt + INTERVAL 4 HOUR)")},
  k AS (SELECT id, dt, CAST(dt AS DATE) AS d0, CAST(dt AS DATE) + CASE WHEN hour(dt) >= 16 THEN 1 ELSE 0 END AS d1, {EOW} AS d2 FROM v_news_ticks),
  p AS (SELECT k.id, coalesce(CASE WHEN k.dt BETWEEN (SELECT min(ts) FROM v_ticks) AND (SELECT max(ts) FROM v_ticks) THEN now.close END, a.close) AS p0,
    CASE WHEN h1.gap < INTERVAL 300 SECOND THEN h1.close END AS p1, CASE WHEN h4.gap < INTERVAL 300 SECOND THEN h4.close END AS p4,
    coalesce(b.close, (SELECT arg_min(close, date) FROM v_event_index)) AS pd, coalesce(c.close, (SELECT arg_min(close, date) FROM v_event_index)) AS pw
    FROM k JOIN now USING (id) JOIN h1 USING (id) JOIN h4 USING (id)
    ASOF LEFT JOIN v_event_index a ON k.d0 >= a.date ASOF LEFT JOIN v_event_index b ON k.d1 >= b.date ASOF LEFT JOIN v_event_index c ON k.d2 >= c.date)
  SELECT id, round(CASE WHEN p0 <> 0 THEN (p1 - p0) / p0 * 100 END, 6) AS pct_change_1h, round(CASE WHEN p0 <> 0 THEN (p4 - p0) / p0 * 100 END, 6) AS pct_change_4h,
    round(CASE WHEN p0 <> 0 THEN (pd - p0) / p0 * 100 END, 6) AS pct_change_eod, round(CASE WHEN p0 <> 0 THEN (pw - p0) / p0 * 100 END, 6) AS pct_change_eow FROM p""")
def outcome_job(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("datetime"))
    out = enrich.add_outcomes(events, views.event_index(spark, sf_dir), "2035-01-31", views.ticks(spark, sf_dir))
    return rounded(out, {c: 6 for c in ("pct_change_1h", "pct_change_4h", "pct_change_eod", "pct_change_eow")}).drop("datetime")


V_PATCH = views.V_ARTICLES + """,
v_patch AS (SELECT id, ticker, dt, CASE WHEN n_chars % 3 = 0 THEN n_chars / 10.0::DOUBLE END AS rsi_14,
  CASE WHEN lang = 'de' THEN n_chars / 100.0::DOUBLE END AS vix_close FROM v_articles)"""


def patch_frame(spark, sf_dir) -> DataFrame:
    n = F.col("n_chars")
    return views.articles(spark, sf_dir).select(
        "id", "ticker", "datetime", F.when(n % 3 == 0, n / 10.0).alias("rsi_14"),
        F.when(F.col("lang") == "de", n / 100.0).alias("vix_close"))


def _sql_patch(partition: str) -> str:
    return f"""WITH {V_PATCH} SELECT id, round(last_value(rsi_14 IGNORE NULLS) OVER w, 6) AS rsi_14,
      round(last_value(vix_close IGNORE NULLS) OVER w, 6) AS vix_close FROM v_patch
      WINDOW w AS ({partition} ORDER BY dt, id ROWS UNBOUNDED PRECEDING)"""


@query("q_weekend_patch", _sql_patch("PARTITION BY ticker"))
def weekend_patch(spark, sf_dir):
    out = carry_market(patch_frame(spark, sf_dir))
    return rounded(out.select("id", "rsi_14", "vix_close"), {"rsi_14": 6, "vix_close": 6})


@query("q_weekend_patch_global", _sql_patch(""))
def weekend_patch_global(spark, sf_dir):
    out = carry_market(patch_frame(spark, sf_dir), by=())
    return rounded(out.select("id", "rsi_14", "vix_close"), {"rsi_14": 6, "vix_close": 6})


@query("q_split", f"""WITH {views.V_ARTICLES} SELECT id, row_number() OVER (ORDER BY dt, id) <= floor(0.8 * count(*) OVER ()) AS is_train
  FROM v_articles""")
def split(spark, sf_dir):
    docs = views.articles(spark, sf_dir).select("id", "datetime")
    return docs.select("id", is_before(split_point(docs, "datetime", "id"), "datetime", "id").alias("is_train"))


# --- price source: two snapshots with capitalised names, of which one is stale for some tickers -----------------

@query("q_price_source", f"""WITH {views.V_BARS}, snaps AS (
    SELECT ticker, date, open, high, low, close, volume, TIMESTAMP '2001-12-31 06:00:00' AS taken FROM v_bars WHERE ticker <> '5'
    UNION ALL SELECT ticker, date, open, high, low, close + 1, volume, TIMESTAMP '2001-12-31 10:00:00' FROM v_bars WHERE ticker IN ('1', '2')
    UNION ALL SELECT ticker, date, open, high, low, close, volume, TIMESTAMP '2001-12-01 10:00:00' FROM v_bars WHERE ticker = '5'),
  fresh AS (SELECT * FROM snaps WHERE taken > TIMESTAMP '2001-12-31 12:00:00' - INTERVAL 24 HOUR)
  SELECT 'T-' || ticker AS ticker, {DAY} AS date, open, high, low, close, CAST(volume AS DOUBLE) AS volume, 'T_' || ticker AS file_key FROM fresh f
  WHERE taken = (SELECT max(taken) FROM fresh g WHERE g.ticker = f.ticker) AND date >= DATE '1996-01-01' AND date < DATE '2000-01-01'
    AND ticker <> '3'""")
def price_source(spark, sf_dir):
    bars = views.bars(spark, sf_dir)
    raw = bars.select(
        F.concat(F.lit("t."), "ticker").alias("Ticker"), F.col("date").cast("timestamp").alias("Date"), F.col("open").alias("Open"),
        F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))

    def snapshot(rows: DataFrame, at: str) -> DataFrame:
        return tables.normalise_bars(rows.withColumn("Fetched At", F.lit(at).cast("timestamp")))

    snaps = (
        snapshot(raw.where("Ticker <> 't.5'"), "2001-12-31 06:00:00")
        .unionByName(snapshot(raw.where("Ticker IN ('t.1', 't.2')").withColumn("Close", F.col("Close") + 1), "2001-12-31 10:00:00"))
        .unionByName(snapshot(raw.where("Ticker = 't.5'"), "2001-12-01 10:00:00"))
    )
    fresh = tables.fresh_bars(snaps, F.lit("2001-12-31 12:00:00").cast("timestamp"), 24)
    history = tables.price_history(fresh, ["t.1", "t.2", "t.4", "t.5"], "1996-01-01", "2000-01-01")
    return history.select(
        F.upper(price_ticker(F.col("ticker"))).alias("ticker"), day("date").alias("date"), "open", "high", "low", "close",
        F.col("volume").cast("double").alias("volume"),
        partition_key(F.translate("ticker", ".", "/")).alias("file_key"))


@query("q_series_bounds", f"""WITH {views.V_BARS} SELECT ticker, {SQL_DAY.format('min(date)')} AS first_day, {SQL_DAY.format('max(date)')} AS last_day,
  count(*) AS n, count(*) >= 15 AS long_enough FROM v_bars GROUP BY ticker""")
def series_bounds(spark, sf_dir):
    bounds = series_lengths(views.bars(spark, sf_dir))
    return bounds.withColumns({c: day(c) for c in ("first_day", "last_day")})


@query("q_zone_dates", f"""WITH {views.V_ARTICLES} SELECT id,
  {SQL_DAY.format("timezone('America/New_York', timezone('UTC', dt))")} AS market_date,
  {SQL_DAY.format("CAST(dt AS DATE) + CASE WHEN hour(dt) >= 16 THEN 1 ELSE 0 END")} AS eod_date, {SQL_DAY.format(EOW)} AS eow_date FROM v_articles""")
def zone_dates(spark, sf_dir):
    ts = F.col("datetime")
    return views.articles(spark, sf_dir).select(
        "id", day(temporal.market_date(ts)).alias("market_date"), day(temporal.eod_date(ts)).alias("eod_date"),
        day(temporal.eow_date(ts)).alias("eow_date"))


