"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.operators.keys import null_safe_join

# Rows of one key a single task should handle. Keys above it are split.
TARGET_ROWS = 4_000_000
SALT = "_salt"
PARTS = "_parts"


def group_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key, combined before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def hot_groups(
    df: DataFrame, keys: Sequence[str], target_rows: int = TARGET_ROWS, counts: DataFrame | None = None,
) -> DataFrame:
    """Keys with more than `target_rows` rows and the number of parts to split each into.

    There are at most rows / target_rows such keys, so the result of
    a table of 10^12 rows has at most 250,000 rows: small enough to broadcast whatever the distribution.
    """
    counts = group_counts(df, keys) if counts is None else counts
    return counts.where(F.col("_n") > target_rows).select(
        *keys, F.ceil(F.col("_n") / target_rows).cast("int").alias(PARTS)
    )


def salt_rows(df: DataFrame, keys: Sequence[str], hot: DataFrame, row_id: Sequence[str]) -> DataFrame:
    """Give each row of a hot key one of its parts, by a hash of the row's own id (same on every retry)."""
    part = F.pmod(F.xxhash64(*row_id), F.coalesce(F.col(PARTS), F.lit(1)).cast("bigint")).cast("int")
    return null_safe_join(df, F.broadcast(hot), keys).withColumn(SALT, part).drop(PARTS)


def spread_rows(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Copy the rows of a hot key into each of its parts."""
    parts = F.sequence(F.lit(0), F.coalesce(F.col(PARTS), F.lit(1)) - 1)
    return null_safe_join(df, F.broadcast(hot), keys).withColumn(SALT, F.explode(parts)).drop(PARTS)


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], row_id: Sequence[str], how: str = "inner",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Equi join where `left` may be skewed on the key and `right` has few rows per key.

    A hot NULL key is split as well: its rows match nothing, but an outer join still moves them.
    """
    keys = list(on)
    hot = hot_groups(left, keys, target_rows)
    salted = salt_rows(left, keys, hot, row_id)
    spread = spread_rows(right, keys, hot)
    return salted.join(spread, [*keys, SALT], how).drop(SALT)

