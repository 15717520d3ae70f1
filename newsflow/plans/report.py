"""Reports: status, export statistics, dashboard datasets. Each returns a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.operators.evaluate import histogram

UNPROCESSED = "Unprocessed"
LATEST = 2000
DASHBOARD_COLUMNS = [
    "id", "ticker", "datetime", "headline", "url", "sentiment_combined", "sentiment_category", "ml_confidence",
    "price_close", "price_open", "price_high", "price_low", "volume", "pct_change_eod", "rsi_14", "vix_close",
    "std_upper", "std_lower", "macd", "macd_hist",
]
WATCHLIST_COLUMNS = ["ticker", "datetime", "headline", "sentiment_combined", "ml_confidence", "sentiment_category"]


def pct_of(part: Column | str, total: Column | str) -> Column:
    """Percentage to one decimal; 0 for an empty table."""
    return F.coalesce(F.round(F.try_divide(part, total) * 100, 1), F.lit(0.0))


def status(articles: DataFrame) -> DataFrame:
    """One row: size, tickers, coverage by job and time span; one pass."""
    counts = articles.agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("ticker").alias("tickers"),
        F.count("sentiment_combined").alias("with_sentiment"), F.count("price_close").alias("with_price"),
        F.count("std_upper").alias("with_bands"), F.min("datetime").alias("earliest"), F.max("datetime").alias("latest"),
    )
    return counts.withColumns({
        f"pct_{c}": pct_of(f"with_{c}", "total") for c in ("sentiment", "price", "bands")})


def recent_sample(articles: DataFrame, n: int = 15) -> DataFrame:
    """Short form of the last priced rows by id."""
    return (
        articles.where(F.col("price_close").isNotNull()).orderBy(F.desc("id")).limit(n)
        .select(
            "id", "ticker", F.date_format("datetime", "yyyy-MM-dd").alias("date"),
            F.left("headline", F.lit(25)).alias("headline_short"), F.round("sentiment_combined", 3).alias("sent"),
            F.round("price_close", 2).alias("price"), F.round("pct_change_eod", 2).alias("chg_pct"),
            F.round("std_upper", 2).alias("upper"), F.round("std_lower", 2).alias("lower"),
            F.round("std_channel_width", 3).alias("width"),
        )
    )


def export_stats(articles: DataFrame) -> DataFrame:
    """Counts of the export report with percentages; one pass."""
    sentiment, price = F.col("sentiment_combined").isNotNull(), F.col("price_close").isNotNull()
    counts = articles.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(sentiment).alias("with_sentiment"),
        F.count_if(price).alias("with_price"), F.count_if(sentiment & price).alias("complete"),
        F.count_if(F.col("sentiment_category").isNotNull()).alias("with_predictions"),
    )
    return counts.withColumns({f"pct_{c}": pct_of(c, "total") for c in ("with_sentiment", "with_price", "complete")})


def backlog(articles: DataFrame) -> DataFrame:
    """Rows each job still has to fill, and rows with an outcome."""
    return articles.agg(
        F.count("pct_change_eod").alias("with_outcome"),
        F.count_if(F.col("pct_change_eod").isNull() & F.col("datetime").isNotNull()).alias("lacks_outcome"),
        F.count_if(F.col("vix_close").isNull()).alias("lacks_context"),
        F.count_if(F.col("hour_sin").isNull() & F.col("datetime").isNotNull()).alias("lacks_temporal"),
        F.count_if(F.col("sentiment_combined").isNull() | F.col("sentiment_category").isNull()).alias("unscored"),
    )


# --- dashboard ------------------------------------------------------------------------------------------------

def latest(articles: DataFrame, n: int = LATEST, columns: Sequence[str] = tuple(DASHBOARD_COLUMNS)) -> DataFrame:
    """The newest n rows (each task keeps n, then they are merged)."""
    return articles.select(*columns).orderBy(F.desc("datetime"), F.desc("id")).limit(n)


def labelled(df: DataFrame) -> DataFrame:
    """NULL labels under a name of their own."""
    return df.withColumn("sentiment_category", F.coalesce("sentiment_category", F.lit(UNPROCESSED)))


def choices(df: DataFrame) -> DataFrame:
    """Values the filters offer: (field, value), sorted."""
    tickers = df.where(F.col("ticker").isNotNull()).select(F.lit("ticker").alias("field"), F.col("ticker").alias("value"))
    labels = labelled(df).select(F.lit("category").alias("field"), F.col("sentiment_category").alias("value"))
    return tickers.union(labels).distinct().orderBy("field", "value")


def filtered(df: DataFrame, ticker: str = "All", category: str = "All", min_confidence: float = 0.5) -> DataFrame:
    """Rows that pass the three filters; a missing confidence counts as 0."""
    out = labelled(df)
    if ticker != "All":
        out = out.where(F.col("ticker") == ticker)
    if category != "All":
        out = out.where(F.col("sentiment_category") == category)
    return out.where(F.coalesce("ml_confidence", F.lit(0.0)) >= min_confidence)


def tiles(df: DataFrame) -> DataFrame:
    """Numbers at the top of the dashboard."""
    newest = F.struct("datetime", "id")
    return df.agg(
        F.count(F.lit(1)).alias("articles"), F.count_if(F.col("sentiment_category") == "Signal").alias("signals"),
        F.coalesce(F.avg("sentiment_combined"), F.lit(0.0)).alias("avg_sentiment"),
        F.coalesce(F.max_by("vix_close", newest), F.lit(0.0)).alias("latest_vix"),
    )


def watchlist(df: DataFrame, n: int = 20) -> DataFrame:
    """The most confident rows that wait for their outcome."""
    waiting = df.where(F.col("pct_change_eod").isNull())
    return waiting.orderBy(F.desc_nulls_last("ml_confidence"), F.desc("datetime"), F.desc("id")).limit(n).select(
        "id", *WATCHLIST_COLUMNS)


def sentiment_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(df, "sentiment_combined", bins)


def confidence_points(df: DataFrame) -> DataFrame:
    """Points of confidence against sentiment, with label and hover text."""
    return df.select("id", "sentiment_combined", "ml_confidence", "sentiment_category", "ticker", "headline")


def ticker_series(df: DataFrame, ticker: str) -> DataFrame:
    """Candles, bands, RSI and MACD of one ticker in time order."""
    return df.where(F.col("ticker") == ticker).orderBy("datetime", "id").select(
        "id", "datetime", "price_open", "price_high", "price_low", "price_close", "std_upper", "std_lower", "rsi_14",
        "macd", "macd_hist")
