"""Technical indicators of daily bars: bands, moving averages, RSI, MACD."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from newsflow.operators.series import MONTH, by_month, halo_blocks, with_positions

# Block and halo of the windows. Rows further back than the halo weigh less than 1e-20 in every average used
# here, and block + halo rows keep the powers of the slowest-growing closed form below the double range.
BLOCK = 2048
HALO = 640
MIN_BARS = 15
INDICATORS = ("rsi_14", "macd", "macd_hist", "price_vs_sma50", "std_upper", "std_lower", "std_channel_width")


def rolling_mean(col: Column, n: int, order: WindowSpec) -> Column:
    """Mean of the last n rows; NULL until n values are there."""
    frame = order.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col).over(frame) == n, F.avg(col).over(frame))


def rolling_std(col: Column, n: int, order: WindowSpec) -> Column:
    """Sample deviation of the last n rows; NULL until n values are there."""
    frame = order.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col).over(frame) == n, F.stddev_samp(col).over(frame))


def band_columns(close: Column, mean: Column, std: Column, width: float = 2.0) -> dict[str, Column]:
    upper, lower = mean + std * width, mean - std * width
    return {
        "std_upper": upper, "std_lower": lower,
        "std_channel_width": F.when(close == 0, 0.0).otherwise((upper - lower) / close),
    }


def exponential_mean(
    x: Column, n: int, alpha: float, part: Sequence[str], index: str = "_vpos", local: str = "_i", start: int = 0,
) -> Column:
    """Recursive mean y = alpha*x + (1-alpha)*y_before over a block, seeded with the mean of the first n values.

    `index` is the row number in the series, `local` the row number in the block; the first value of `x` is at
    row `start`. In closed form y is a running sum of weighted inputs, so it is one window function. A block
    that does not begin the series starts from its first halo value, whose weight has died out where the
    block's own rows begin.
    """
    upto = Window.partitionBy(*part).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    growth = -math.log(1.0 - alpha)
    k, i = F.col(index) - start, F.col(local)
    begins_series = F.col(index) == i
    # The seed is the mean of n values, all placed at the last of their rows.
    seeded = F.when(k < n, x / n * math.exp((n - 1 + start) * growth)).otherwise(x * alpha * F.exp(i * growth))
    carried = F.when(i == start, x * F.exp(i * growth)).when(i > start, x * alpha * F.exp(i * growth))
    summed = F.sum(F.when(begins_series, seeded).otherwise(carried)).over(upto) * F.exp(-i * growth)
    return F.when(k >= n - 1, summed)


def indicator_table(
    bars: DataFrame, by: Sequence[str] = ("ticker",), date_col: str = "date", close: str = "close",
    min_bars: int = MIN_BARS, block: int = BLOCK, halo: int = HALO,
) -> DataFrame:
    """Bars with all indicator columns. `bars` has one row per key and day; keys with fewer than `min_bars`
    rows are left out.

    Definitions: bands are mean +- 2 sample deviations of 20 rows; EMA(n) has alpha 2/(n+1) and is seeded with
    the mean of its first n values; MACD is EMA 12 - EMA 26, its signal EMA 9 of it from its first value on;
    RSI(14) uses means with alpha 1/14 seeded with the mean of the first 14 changes, NULL when nothing moved.
    A row without close has no indicators, and neither has a band whose frame holds such a row. Recursive means
    skip rows without close.

    Two shuffles by (key, month) number the rows, one by (key, block) serves every window.
    """
    by = list(by)
    has_close = F.col(close).isNotNull()
    numbered = with_positions(by_month(bars, date_col), [date_col], MONTH, by, has_close).where(F.col("_rows") >= min_bars)
    numbered = numbered.drop(MONTH, "_rows")
    empty = numbered.where(~has_close).drop("_pos", "_vpos").withColumns(
        {c: F.lit(None).cast("double") for c in INDICATORS}
    )
    blocks = halo_blocks(numbered.where(has_close), "_vpos", block, halo)
    part = [*by, "_blk"]
    order = Window.partitionBy(*part).orderBy("_vpos")
    c = F.col(close)

    step1 = blocks.withColumns({
        "_i": F.row_number().over(order).cast("double") - 1,
        "_move": c - F.lag(c).over(order),
        "_span20": F.col("_pos") - F.min("_pos").over(order.rowsBetween(-19, 0)),
        "_span50": F.col("_pos") - F.min("_pos").over(order.rowsBetween(-49, 0)),
        "_mean20": rolling_mean(c, 20, order),
        "_std20": rolling_std(c, 20, order),
        "_mean50": rolling_mean(c, 50, order),
    })
    step2 = step1.withColumns({
        # A frame that spans more rows than it has values holds a row without close.
        "_mean20": F.when(F.col("_span20") == 19, F.col("_mean20")),
        "_mean50": F.when(F.col("_span50") == 49, F.col("_mean50")),
        "_gain": exponential_mean(F.greatest(F.col("_move"), F.lit(0.0)), 14, 1 / 14, part, start=1),
        "_loss": exponential_mean(F.greatest(-F.col("_move"), F.lit(0.0)), 14, 1 / 14, part, start=1),
        "macd": exponential_mean(c, 12, 2 / 13, part) - exponential_mean(c, 26, 2 / 27, part),
    })
    signal = exponential_mean(F.col("macd"), 9, 2 / 10, part, start=25)
    moved = F.col("_gain") + F.col("_loss")
    done = step2.withColumns({
        **band_columns(c, F.col("_mean20"), F.col("_std20")),
        "price_vs_sma50": F.try_divide(c - F.col("_mean50"), F.col("_mean50")),
        "rsi_14": F.when(moved > 0, F.col("_gain") * 100.0 / moved),
        "macd_hist": F.col("macd") - signal,
    })
    out = done.where("_own").select(*bars.columns, *INDICATORS)
    return out.unionByName(empty.select(*bars.columns, *INDICATORS))
