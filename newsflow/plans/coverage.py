"""Coverage: which tickers have news, which are still to be checked, and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.functions.html import block_counts
from newsflow.functions.temporal import age_days

# Text signs of news and of dates, in order of search.
NEWS_SIGNS = ["news-table", "fullview-news", "latest news", "news content", "breaking news", "company news"]
DATE_SIGNS = [
    "today", "yesterday", "hours ago", "minutes ago",
    "jan-", "feb-", "mar-", "apr-", "may-", "jun-", "jul-", "aug-", "sep-", "oct-", "nov-", "dec-",
]
DEFAULT_RECHECK_DAYS = 30


# The function is that of the parser's module, which travels with the task.
_block_rows = F.pandas_udf(block_counts, T.IntegerType())


def news_check(html: Column) -> Column:
    """struct<has_news, reason> of a page, its blocks read by the HTML parser. NULL html gives NULL: unknown, to be asked again."""
    low = F.lower(html)
    n_rows = _block_rows(html)
    sign = F.try_element_at(F.filter(F.array(*[F.lit(s) for s in NEWS_SIGNS]), lambda s: F.contains(low, s)), F.lit(1))
    dated = F.exists(F.array(*[F.lit(d) for d in DATE_SIGNS]), lambda d: F.contains(low, d))
    yes = n_rows.isNotNull() | (sign.isNotNull() & dated)
    reason = (
        F.when(n_rows.isNotNull(), F.concat(F.lit("news_table_"), n_rows.cast("string"), F.lit("_rows")))
        .when(sign.isNotNull() & dated, F.concat(F.lit("news_pattern_"), sign))
        .otherwise(F.lit("no_news_found"))
    )
    return F.when(html.isNotNull(), F.struct(yes.alias("has_news"), reason.alias("reason")))


def processed(with_news: DataFrame, without: DataFrame, as_of: Column, recheck_days: int | None = None) -> DataFrame:
    """Tickers that need no check. With `recheck_days` a no-news entry older than that, or without a valid
    time, is checked again; without it an entry counts for ever."""
    old = without
    if recheck_days is not None:
        old = without.where(age_days(F.col("checked_at"), as_of) < recheck_days)
    return with_news.select("ticker").union(old.select("ticker")).distinct()


def remaining(universe: DataFrame, done: DataFrame) -> DataFrame:
    return universe.join(done, "ticker", "left_anti")


def check_pages(tickers: DataFrame, pages: DataFrame, as_of: Column) -> DataFrame:
    """Coverage rows (ticker, has_news, reason, checked_at) of the tickers that have a readable page, one per ticker.

    Only pages of these tickers are searched, each once; of several pages of one ticker one with news counts.
    """
    wanted = pages.select("ticker", "html").join(tickers.select("ticker"), "ticker", "left_semi")
    checked = wanted.where("html IS NOT NULL").select("ticker", news_check(F.col("html")).alias("c"))
    best = checked.groupBy("ticker").agg(F.max("c").alias("c"))
    return best.select("ticker", "c.has_news", "c.reason", as_of.alias("checked_at"))


def coverage_job(universe: DataFrame, with_news: DataFrame, without: DataFrame, pages: DataFrame, as_of: Column,
                 recheck_days: int | None = None) -> DataFrame:
    """Coverage after a run: earlier entries plus those of the tickers checked now, which replace older ones."""
    todo = remaining(universe, processed(with_news, without, as_of, recheck_days))
    now = check_pages(todo, pages, as_of)
    kept = with_news.select("ticker", F.lit(True).alias("has_news"), F.lit("cached").alias("reason"),
                            F.lit(None).cast("timestamp").alias("checked_at"))
    old = without.select("ticker", F.lit(False).alias("has_news"), F.lit("cached").alias("reason"), "checked_at")
    either = now.withColumn("_now", F.lit(1)).unionByName(old.withColumn("_now", F.lit(0)))
    latest = either.groupBy("ticker").agg(F.max(F.struct("_now", "has_news", "reason", "checked_at")).alias("c"))
    return kept.unionByName(latest.select("ticker", "c.has_news", "c.reason", "c.checked_at"))


def summary(coverage: DataFrame, universe: DataFrame) -> DataFrame:
    """Counts with and without news, processed, and the share of the universe done."""
    have = coverage.agg(
        F.count_if("has_news").alias("with_news"), F.count_if(~F.col("has_news")).alias("without_news"),
        F.count(F.lit(1)).alias("processed"),
    )
    # One row on either side; the union keeps them apart until the final sum.
    size = universe.agg(F.count(F.lit(1)).alias("universe"))
    zero = F.lit(0).cast("bigint")
    both = have.withColumn("universe", zero).unionByName(
        size.select(zero.alias("with_news"), zero.alias("without_news"), zero.alias("processed"), "universe"))
    total = both.agg(*[F.sum(c).alias(c) for c in ("with_news", "without_news", "processed", "universe")])
    rate = F.coalesce(F.round(F.try_divide("processed", "universe") * 100, 1), F.lit(0.0))
    return total.withColumn("completion_pct", rate)


def by_first_letter(coverage: DataFrame) -> DataFrame:
    return (
        coverage.where("has_news").groupBy(F.left("ticker", F.lit(1)).alias("letter"))
        .agg(F.count(F.lit(1)).alias("n")).orderBy("letter")
    )


def sample_tickers(coverage: DataFrame, n: int = 20) -> DataFrame:
    return coverage.where("has_news").select("ticker").orderBy("ticker").limit(n)
