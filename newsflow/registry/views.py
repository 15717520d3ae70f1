"""The driver's tables seen as news, prices and indexes, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions.lexicon_data import FINANCE_LEXICON, parse

AS_OF = "2001-12-31"

# Words and phrases that do occur in the documents; the finance entries are rare there.
TEST_ENTRIES = [
    ("the", 1.4), ("with", -1.3), ("from", 1.2), ("ha", -1.5), ("er", 1.3), ("of the", 1.7), ("in-that", -1.6),
    ("to it", 1.5),
]


def lexicon_entries() -> list[tuple[str, float]]:
    finance = [(k, s if p == "positive" else -s) for k, p, s in parse(FINANCE_LEXICON)]
    return sorted([*TEST_ENTRIES, *finance])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_of(table(spark, sf_dir, "documents"))


def articles_of(documents: DataFrame) -> DataFrame:
    """Documents as news: the first line is the headline, the other lines are the body."""
    head = F.substring_index("text", "\n", 1)
    n = F.col("doc_id")
    hours = (n % 1000) * 57
    at = F.timestamp_seconds(F.unix_seconds(F.lit("1995-02-01 00:00:00").cast("timestamp")) + hours * 3600 + (n % 1440) * 60)
    return documents.select(
        n.alias("id"), (F.lit(1) + n % 5).cast("string").alias("ticker"), at.alias("datetime"), head.alias("headline"),
        F.concat(F.lit("https://x/"), n.cast("string")).alias("url"),
        F.substring(F.col("text"), F.length(head) + 2, F.length("text")).alias("text"), "lang", "n_chars",
    )


V_ARTICLES = r"""
v_articles AS (
  SELECT doc_id AS id, CAST(1 + doc_id % 5 AS VARCHAR) AS ticker,
    TIMESTAMP '1995-02-01 00:00:00' + to_minutes(CAST((doc_id % 1000) * 57 * 60 + doc_id % 1440 AS BIGINT)) AS dt,
    split_part(text, chr(10), 1) AS headline, 'https://x/' || doc_id AS url,
    substr(text, length(split_part(text, chr(10), 1)) + 2) AS body, lang, n_chars
  FROM documents)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as daily bars of five tickers; one row per ticker and day."""
    o = table(spark, sf_dir, "orders").select(
        F.left("o_orderpriority", F.lit(1)).alias("ticker"), F.to_date("o_orderdate").alias("date"), "o_totalprice",
        "o_orderkey", "o_orderstatus")
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return o.groupBy("ticker", "date").agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, key).alias("close"), F.count(F.lit(1)).alias("volume"),
        F.max_by("o_orderstatus", key).alias("last_status"),
    )


V_BARS = """
v_bars AS (
  SELECT left(o_orderpriority, 1) AS ticker, CAST(o_orderdate AS DATE) AS date,
    arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
    arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume, arg_max(o_orderstatus, o_orderkey) AS last_status
  FROM orders GROUP BY 1, 2)"""


def index_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average order price by working day: stands for the market index."""
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return o.where(F.weekday(day) < 5).groupBy(day.alias("date")).agg(F.avg("o_totalprice").alias("close"))


V_INDEX = """
v_index AS (
  SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close
  FROM orders WHERE isodow(CAST(o_orderdate AS DATE)) < 6 GROUP BY 1)"""


def vix_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of discounts by working ship day: stands for the volatility index."""
    li = table(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    spread = F.stddev_samp("l_discount") * 100
    return li.where(F.weekday(day) < 5).groupBy(day.alias("date")).agg(spread.alias("close")).where("close is not null")


V_VIX = """
v_vix AS (
  SELECT date, close FROM (
    SELECT CAST(l_shipdate AS DATE) AS date, stddev_samp(l_discount) * 100 AS close
    FROM lineitem WHERE isodow(CAST(l_shipdate AS DATE)) < 6 GROUP BY 1) WHERE close IS NOT NULL)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'view'").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("close"))


def tick_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'signup'").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("datetime"))


def event_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average event value by working day: stands for the index the ticks belong to."""
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").where(F.weekday(at) < 5).groupBy(F.to_date(at).alias("date")).agg(F.avg("value").alias("close"))


V_EVENT_INDEX = """
v_event_index AS (SELECT CAST(ts AS DATE) AS date, avg(value) AS close FROM events WHERE isodow(ts) < 6 GROUP BY 1)"""

V_TICKS = """
v_ticks AS (SELECT ts, max(value) AS close FROM events WHERE event_type = 'view' GROUP BY ts),
v_news_ticks AS (SELECT event_id AS id, ts AS dt FROM events WHERE event_type = 'signup')"""

FEATURES = ["n_chars", "n_words", "n_lines", "n_the", "spread"]


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels joined to numeric text features; some are missing, one is constant, one is always missing."""
    docs = articles(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic"), "id")
    whole = F.concat_ws("\n", "headline", "text")
    words = F.size(F.split(whole, " "))
    return docs.select(
        "id", "ticker", "datetime", F.col("quality").alias("label"), "toxic",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.when(F.col("lang") != "de", words.cast("double")).alias("n_words"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
        F.when(F.col("lang") == "en", (F.size(F.split(F.lower(whole), "the")) - 1).cast("double")).alias("n_the"),
        (F.length("headline") / F.greatest(F.length("text"), F.lit(1))).alias("spread"),
        F.lit(7.0).alias("constant"), F.lit(None).cast("double").alias("empty"),
    )


V_TRAIN = V_ARTICLES + r""",
v_train AS (
  SELECT id, ticker, dt, quality AS label, toxic, CAST(n_chars AS DOUBLE) AS n_chars,
    CASE WHEN lang <> 'de' THEN CAST(len(string_split(headline || chr(10) || body, ' ')) AS DOUBLE) END AS n_words,
    CAST(len(string_split(body, chr(10))) AS DOUBLE) AS n_lines,
    CASE WHEN lang = 'en' THEN CAST(len(string_split(lower(headline || chr(10) || body), 'the')) - 1 AS DOUBLE) END AS n_the,
    length(headline) / greatest(length(body), 1) AS spread, 7.0::DOUBLE AS constant, CAST(NULL AS DOUBLE) AS empty
  FROM v_articles JOIN labels ON labels.doc_id = v_articles.id)"""


def sql_lexicon() -> str:
    """The lexicon as a DuckDB table expression."""
    rows = ", ".join("('{}', {}::DOUBLE)".format(k.replace("'", "''"), w) for k, w in lexicon_entries())
    return f"v_lexicon(keyword, weight) AS (VALUES {rows})"
