"""Series tables: one row per key and time, stored as rows; positions, blocks, calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.operators.keys import null_safe_join
from newsflow.operators.order import carry_forward

MONTH = "_month"


def series_lengths(bars: DataFrame, by: Sequence[str] = ("ticker",), date_col: str = "date", min_rows: int = 15) -> DataFrame:
    """(keys, first_day, last_day, n, long_enough): span and length of each series, combined before the shuffle."""
    n = F.count(F.lit(1))
    return bars.groupBy(*by).agg(
        F.min(date_col).alias("first_day"), F.max(date_col).alias("last_day"), n.alias("n"), (n >= min_rows).alias("long_enough"))


def by_month(df: DataFrame, date_col: str) -> DataFrame:
    """Bucket of a daily series: at most 31 rows per key, since a key has one row per day."""
    return df.withColumn(MONTH, F.trunc(F.col(date_col), "month"))


def with_positions(
    df: DataFrame, order: Sequence[str], bucket: str, by: Sequence[str], flag: Column | None = None,
) -> DataFrame:
    """Add `_pos`, the 0-based row number in the series, `_rows`, the length of the series, and `_vpos`, the
    number of earlier rows with `flag`.

    Row numbers are taken inside each bucket and shifted by the size of the earlier buckets, so a long series
    is never sorted by one task.
    """
    keys = [*by, bucket]
    mark = (flag if flag is not None else F.lit(True)).cast("bigint")
    df = df.withColumn("_flag", F.coalesce(mark, F.lit(0).cast("bigint")))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("_flag").alias("_v"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = sizes.select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_on"),
        F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_ov"),
        F.sum("_n").over(whole).alias("_rows"),
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        null_safe_join(df, offsets, keys)
        .withColumns({
            "_pos": F.col("_on") + F.row_number().over(inside) - 1,
            "_vpos": F.col("_ov") + F.sum("_flag").over(upto) - F.col("_flag"),
        })
        .drop("_on", "_ov", "_flag")
    )


def halo_blocks(df: DataFrame, pos: str, block: int, halo: int) -> DataFrame:
    """Cut each series into blocks of `block` rows and give each block the `halo` rows before it.

    Adds `_blk` and `_own` (false for halo rows). A window over (key, _blk) then sees all it needs, and the
    longest series is spread over many tasks. A series of at most `block` rows is not copied at all.
    """
    if halo > block:
        raise ValueError("halo must not exceed the block")
    own = F.floor(F.col(pos) / block)
    feeds_next = F.pmod(F.col(pos), F.lit(block)) >= block - halo
    blocks = F.when(feeds_next, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_blk", F.explode(blocks)).withColumn("_own", F.col("_blk") == own)


def densify(
    df: DataFrame, by: Sequence[str], date_col: str, cols: Sequence[str], end: Column,
) -> DataFrame:
    """One row per calendar day from the first bar of each key to `end`, filled forward.

    `df` has one row per key and day. Each row is repeated up to the day before the next one, so no calendar
    has to be joined. Nulls in existing rows are filled as well. Days after `end` that have bars are kept,
    and so are rows with a NULL key or day.
    """
    keys = [*by, MONTH]
    df = by_month(df.select(*by, date_col, *cols), date_col)
    months = df.groupBy(*keys).agg(
        F.min(date_col).alias("_first"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(date_col))).alias(f"_l_{c}") for c in cols],
    )
    ahead = Window.partitionBy(*by).orderBy(MONTH)
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    carried = months.select(
        *keys, F.lead("_first").over(ahead).alias("_next"),
        *[F.last(f"_l_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in cols],
    )
    inside = Window.partitionBy(*keys).orderBy(date_col)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    following = F.coalesce(F.lead(date_col).over(inside), F.col("_next"))
    filled = null_safe_join(df, carried, keys).select(
        *by, F.col(date_col).alias("_day"), following.alias("_until"),
        *[F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_c_{c}")).alias(c) for c in cols],
    )
    last_day = F.coalesce(F.date_sub("_until", 1), F.greatest(F.col("_day"), end))
    return filled.select(*by, F.explode_outer(F.sequence("_day", last_day, F.expr("INTERVAL 1 DAY"))).alias(date_col), *cols)


def relative_change(df: DataFrame, by: Sequence[str], date_col: str, col: str, out: str) -> DataFrame:
    """One-step relative change of a daily series; a null counts as the value before it."""
    df = by_month(df, date_col)
    now = carry_forward(df, [date_col], [col], by, MONTH, prefix="_now_")
    both = carry_forward(now, [date_col], [col], by, MONTH, prefix="_was_", strict=True)
    change = F.try_divide(F.col(f"_now_{col}"), F.col(f"_was_{col}")) - 1
    return both.withColumn(out, change).drop(f"_now_{col}", f"_was_{col}", MONTH)
