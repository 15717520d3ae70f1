"""Sinks: append with insert-ignore, keyed rewrite, CSV export, coverage caches, prediction check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from newsflow.operators.keys import first_per_key, insert_ignore, keyed_update
from newsflow.schema import ARTICLES, EXPORT_COLUMNS, pad_articles, struct_type
from newsflow.session import scratch_path, stored

EXPORT_MODES = ("all", "complete", "predicted")


def with_ids(new: DataFrame, url: str = "url") -> DataFrame:
    """Row ids from the natural key, the same on every run and retry."""
    return new.withColumn("id", F.xxhash64(url))


def stored_layout(rows: DataFrame) -> DataFrame:
    """Rows with their day `dt`, brought together by day: few files a day, and a day with very many rows is split."""
    return rows.withColumn("dt", F.to_date("datetime")).hint("rebalance", "dt")


def append_articles(table: DataFrame, new: DataFrame, path: str, order: Sequence[Column | str]) -> int:
    """Append the rows an insert-ignore would add, in the layout of the stored table, and return their number."""
    rows = pad_articles(with_ids(insert_ignore(table, new, "url", order))).withColumn("created_at", F.current_timestamp())
    written = Observation()
    stored_layout(rows).observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("dt").parquet(path)
    return written.get["n"]


def write_version(df: DataFrame, path: str, by_date: bool = True) -> None:
    """Write a new version of the table, partitioned by day so that date filters prune files."""
    if not by_date:
        df.write.mode("errorifexists").parquet(path)
        return
    stored_layout(df).write.mode("errorifexists").partitionBy("dt").parquet(path)


def update_stored(
    spark: SparkSession, path: str, updates: DataFrame, columns: Sequence[str], key: str = "id",
    order: Sequence[Column | str] = (),
) -> list:
    """Set `columns` of stored rows by key, a NULL in the update overwrites; returns the days that were written anew.

    Only the days of the keys that are there are read in full and written: their rows are completed in the shared folder
    and then take the place of these partitions, so a job that fails changes nothing before that and may run again
    after it. Keys the table lacks are ignored. With `order` the first update of a key counts, else keys are unique.
    """
    table = spark.read.parquet(path)
    names = table.columns
    updates = stored(first_per_key(updates, [key], order) if order else updates)
    # Of the whole table only keys and days are read; there is one day per day of the calendar.
    days = [r["dt"] for r in table.select(key, "dt").join(updates.select(key), key, "left_semi").select("dt").distinct().collect()]
    if not days:
        return []
    known = [d for d in days if d is not None]
    inside = F.col("dt").isin(known) if known else F.lit(False)
    touched = table.where(inside | F.col("dt").isNull() if None in days else inside)
    staged = scratch_path(spark, "update")
    keyed_update(touched, updates, columns, key).select(*names).hint("rebalance", "dt").write.partitionBy("dt").parquet(staged)
    fresh = spark.read.schema(table.schema).parquet(staged)
    fresh.hint("rebalance", "dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)
    return sorted(known) + [None] * (None in days)


def export_filter(mode: str = "all") -> Column:
    """Rows of an export mode."""
    if mode not in EXPORT_MODES:
        raise ValueError(f"unknown export mode {mode!r}, use one of {EXPORT_MODES}")
    if mode == "complete":
        return F.col("sentiment_combined").isNotNull() & F.col("price_close").isNotNull()
    return F.col("sentiment_category").isNotNull() if mode == "predicted" else F.lit(True)


def export_frame(articles: DataFrame, mode: str = "all") -> DataFrame:
    """Export columns of an export mode, newest first (a range-partitioned sort, not one task)."""
    return articles.where(export_filter(mode)).select(*EXPORT_COLUMNS).orderBy(F.desc("datetime"), F.desc("id"))


def export_csv(articles: DataFrame, path: str, mode: str = "all") -> None:
    """CSV files with header, in order from part to part. Quotes are doubled and line breaks kept."""
    export_frame(articles, mode).write.mode("errorifexists").options(
        header=True, escape='"', timestampFormat="yyyy-MM-dd HH:mm:ss").csv(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An export read back with its types."""
    schema = struct_type({c: ARTICLES[c] for c in EXPORT_COLUMNS})
    return spark.read.schema(schema).options(
        header=True, escape='"', multiLine=True, timestampFormat="yyyy-MM-dd HH:mm:ss").csv(path)


def write_coverage(coverage: DataFrame, path: str) -> None:
    """Coverage table as JSON lines; it replaces both ticker caches."""
    coverage.select("ticker", "has_news", "checked_at", "reason").write.mode("errorifexists").json(path)


def write_prediction_check(check: DataFrame, path: str) -> None:
    """The short table of recent predictions and errors."""
    check.write.mode("errorifexists").options(header=True, escape='"').csv(path)
