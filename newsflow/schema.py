"""The articles table: one row per news item, enriched in place by each job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column groups, in export order. Types are Spark DDL.
IDENTITY = {
    "id": "bigint", "ticker": "string", "datetime": "timestamp", "headline": "string",
    "url": "string", "text": "string",
}
TEXT_FEATURES = {
    "tokens": "string", "mentions": "string", "pos_keywords": "string", "neg_keywords": "string",
    "total_keywords": "int", "text_length": "int", "keyword_density": "double",
}
SENTIMENT = {
    "sentiment_combined": "double", "sentiment_dynamic": "double", "sentiment_ml": "double",
    "sentiment_keyword": "double", "headline_sentiment": "double", "sentiment_vader": "double",
    "sentiment_strength": "double", "sentiment_score": "double", "sentiment_gpt": "double",
    "gpt_reasoning": "string", "sentiment_finbert_tone": "double", "sentiment_finbert_prosus": "double",
}
PRICE = {
    "price_close": "double", "price_open": "double", "price_high": "double", "price_low": "double",
    "volume": "bigint", "adj_close": "double",
}
OUTCOME = {
    "pct_change_eod": "double", "pct_change_eow": "double", "pct_change_1h": "double", "pct_change_4h": "double",
    "direction_1h": "string", "direction_4h": "string", "direction_eod": "string", "direction_eow": "string",
}
INDICATORS = {
    "rsi_14": "double", "macd": "double", "macd_hist": "double", "price_vs_sma50": "double",
    "std_upper": "double", "std_lower": "double", "std_channel_width": "double",
}
CONTEXT = {"vix_close": "double", "spy_daily_return": "double"}
TEMPORAL = {"hour_sin": "double", "hour_cos": "double", "day_of_week": "int"}
PREDICTION = {"sentiment_category": "string", "ml_confidence": "double", "prediction_confidence": "double"}
AUDIT = {"created_at": "timestamp"}

DERIVED = {**TEXT_FEATURES, **SENTIMENT, **PRICE, **OUTCOME, **INDICATORS, **CONTEXT, **TEMPORAL, **PREDICTION}
ARTICLES = {**IDENTITY, **DERIVED, **AUDIT}

# Columns the price job adds to a table that lacks them.
HEALED = {
    **{c: PRICE[c] for c in ("price_close", "price_open", "price_high", "price_low", "volume")},
    **INDICATORS, **CONTEXT, **TEMPORAL,
    **{c: OUTCOME[c] for c in ("pct_change_1h", "pct_change_4h", "pct_change_eod", "pct_change_eow")},
}

# Columns of the export, by group.
EXPORT_COLUMNS = [
    "id", "ticker", "datetime", "headline", "url",
    "sentiment_combined", "sentiment_dynamic", "sentiment_ml", "sentiment_keyword", "headline_sentiment",
    "sentiment_vader",
    "price_close", "price_open", "price_high", "price_low", "volume",
    "pct_change_eod", "pct_change_eow", "pct_change_1h", "pct_change_4h",
    *INDICATORS, *CONTEXT, *TEMPORAL, "sentiment_category", "ml_confidence",
]

# Feature lists of the two models (fixed names).
CLASSIFIER_FEATURES = [
    "sentiment_combined", "sentiment_dynamic", "sentiment_ml", "sentiment_keyword", "headline_sentiment",
    "sentiment_vader", "total_keywords", "keyword_density", "std_channel_width", "rsi_14", "macd", "macd_hist",
    "price_vs_sma50",
]
REGRESSOR_FEATURES = [
    "sentiment_combined", "sentiment_dynamic", "sentiment_ml", "sentiment_keyword", "headline_sentiment",
    "sentiment_vader", "std_channel_width", "rsi_14", "macd", "macd_hist", "price_vs_sma50",
    "vix_close", "spy_daily_return", "hour_sin", "hour_cos", "day_of_week",
]
# Columns carried forward over days without trading.
MARKET_COLUMNS = [
    "price_vs_sma50", "rsi_14", "macd", "macd_hist", "vix_close", "spy_daily_return", "std_channel_width",
    "hour_sin", "hour_cos",
]
HORIZONS = {"1hr": "pct_change_1h", "4hr": "pct_change_4h", "eod": "pct_change_eod"}
MIN_FEATURES = 5
MIN_TRAINING_ROWS = 100


def struct_type(columns: dict[str, str]) -> T.StructType:
    return T.StructType.fromDDL(articles_ddl(columns))


def articles_ddl(columns: dict[str, str] = ARTICLES) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())


def create_articles_table(spark: SparkSession, name: str = "articles", path: str | None = None) -> None:
    """Create the table if it is missing, clustered the way the jobs read it (by date)."""
    where = f" LOCATION '{path}'" if path else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({articles_ddl()}, `dt` date) USING parquet PARTITIONED BY (`dt`){where}"
    )


def refresh_articles_table(spark: SparkSession, name: str = "articles") -> None:
    """Make days that were appended below the table's path known to it."""
    spark.sql(f"MSCK REPAIR TABLE {name}")


def ensure_columns(df: DataFrame, columns: dict[str, str] = HEALED) -> DataFrame:
    """Add the columns the frame lacks, as NULL of the right type; names compare without case."""
    have = {c.lower() for c in df.columns}
    missing = {c: F.lit(None).cast(t) for c, t in columns.items() if c.lower() not in have}
    return df.withColumns(missing) if missing else df


def available_features(df: DataFrame, wanted: list[str]) -> tuple[list[str], list[str]]:
    """Wanted features split into those the frame has and those it lacks (metadata only)."""
    have = set(df.columns)
    return [c for c in wanted if c in have], [c for c in wanted if c not in have]


def require_features(df: DataFrame, wanted: list[str], minimum: int = MIN_FEATURES) -> list[str]:
    found, missing = available_features(df, wanted)
    if len(found) < minimum:
        raise ValueError(f"only {len(found)} features found, {minimum} needed; missing: {missing}")
    return found


def pad_articles(new: DataFrame, columns: dict[str, str] = ARTICLES) -> DataFrame:
    """New rows in the table's column order, with NULL for whatever is not filled yet."""
    return ensure_columns(new, columns).select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])


def reset_derived(df: DataFrame) -> DataFrame:
    """Keep the identity columns, set every derived column to NULL."""
    return df.select(*[
        F.lit(None).cast(DERIVED[c]).alias(c) if c in DERIVED else F.col(c) for c in df.columns
    ])


def target_column(horizon: str = "eod") -> str:
    """Horizon name to outcome column; an unknown name means end of day."""
    return HORIZONS.get(horizon.lower(), HORIZONS["eod"])

