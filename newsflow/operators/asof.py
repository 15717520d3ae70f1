"""As-of joins: backward, forward and nearest, over series of any length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.operators import skew
from newsflow.operators.keys import null_safe_join

BUCKET = "_bucket"
CELL = "_cell_no"
# Equal parts of a bucket its cells are made of: seconds of a day.
SLICES = 86_400


def _micros(col: str | Column) -> Column:
    return F.unix_micros(F.col(col) if isinstance(col, str) else col)


def cell_borders(times: DataFrame, keys: Sequence[str], width: int, target_rows: int) -> DataFrame:
    """(keys, _starts): for each bucket with more than `target_rows` rows the starts of its cells, without the bucket's own.

    A bucket has SLICES equal slices. They are counted, and a cell begins where the running count passes a multiple of the
    target; a bucket of n rows has at most n / target_rows + 1 cells, so all lists together stay as short as the list of
    hot keys.
    """
    hot = skew.hot_groups(times, keys, target_rows).drop(skew.PARTS)
    step = max(1, width // SLICES)
    named = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
    inside = times.join(F.broadcast(named), same, "left_semi")
    slices = inside.groupBy(*keys, (F.floor(F.col("_t") / step) * step).alias("_from")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    cells = slices.withColumn("_no", F.floor(F.coalesce(F.sum("_n").over(upto), F.lit(0)) / target_rows))
    starts = cells.groupBy(*keys, "_no").agg(F.min("_from").alias("_from"))
    return starts.where("_no > 0").groupBy(*keys).agg(F.sort_array(F.collect_list("_from")).alias("_starts"))


def _in_cells(rows: DataFrame, borders: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the number of their cell in its bucket."""
    found = null_safe_join(rows, F.broadcast(borders), [*by, BUCKET])
    passed = F.size(F.filter("_starts", lambda s: s <= F.col("_t")))
    return found.withColumn(CELL, F.when(F.col("_starts").isNull(), F.lit(0)).otherwise(passed)).drop("_starts")


def asof_join(
    left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, row_id: Sequence[str], payload: Sequence[str],
    by: Sequence[str] = (), direction: str = "backward", tolerance_seconds: float | None = None,
    strict: bool = False, within_range: bool = False, bucket_seconds: int = 86_400,
    target_rows: int = skew.TARGET_ROWS, match_ts: str | None = None,
) -> DataFrame:
    """Add to each left row the payload of the right row that is nearest in time.

    direction: "backward" (last right row at or before), "forward" (first at or after) or "nearest" (a tie
    goes to the later row). A match further away than `tolerance_seconds` is dropped (`strict`: as far away
    as that, too). `within_range` drops matches of left rows outside the span of the right series. `match_ts`
    names a column for the time of the match. Left rows without a match get NULL.

    Both sides are put in one list per key and time cell and read in order by a window. A cell is a time bucket, or
    where a bucket holds very many rows of either side a run of its slices, so that a cell has about `target_rows` of
    both. Left rows that crowd in one slice are split once more, each part with its own copy of the slice's right rows,
    which have different times. Each cell also gets the last right row before it and the first one after it; they
    are found on the table of cells. Left rows without a time pass by.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    by, keys = list(by), [*by, BUCKET, CELL]
    width = bucket_seconds * 1_000_000
    cell = F.struct(F.col("_rt"), *[F.col(c) for c in payload])

    # One right row per key and time; of several the one with the greatest payload.
    single = len(payload) == 1
    points = (
        right.where(F.col(right_ts).isNotNull())
        .select(*by, _micros(right_ts).alias("_rt"), *payload)
        .groupBy(*by, "_rt")
        .agg(*([F.max(payload[0]).alias(payload[0])] if single else [F.max(F.struct(*payload)).alias("_p")]))
        .select(*by, "_rt", *(payload if single else [F.col("_p")[c].alias(c) for c in payload]))
        .withColumn(BUCKET, F.floor(F.col("_rt") / width))
        .select(*by, BUCKET, F.col("_rt").alias("_t"), cell.alias("_cell"))
    )
    timed = left.withColumn("_t", _micros(left_ts)).withColumn(BUCKET, F.floor(F.col("_t") / width))
    rows = timed.where(F.col("_t").isNotNull())
    borders = cell_borders(rows.select(*by, BUCKET, "_t").unionByName(points.select(*by, BUCKET, "_t")), [*by, BUCKET], width, target_rows)
    rows, points = _in_cells(rows, borders, by), _in_cells(points, borders, by)
    counts = skew.group_counts(rows, keys)
    hot = skew.hot_groups(rows, keys, target_rows, counts)

    # Buckets: what each holds, and what its neighbours pass on to it.
    ends = points.groupBy(*keys).agg(
        F.min_by("_cell", "_t").alias("_head"), F.max_by("_cell", "_t").alias("_tail"),
    )
    none = F.lit(None).cast(ends.schema["_head"].dataType)
    listed = (
        ends.select(*keys, "_head", "_tail", F.lit(0).cast("bigint").alias("_n"))
        .unionByName(counts.select(*keys, none.alias("_head"), none.alias("_tail"), "_n"))
        .groupBy(*keys)
        .agg(F.first("_head", True).alias("_head"), F.first("_tail", True).alias("_tail"), F.max("_n").alias("_n"))
    )
    order = Window.partitionBy(*by).orderBy(BUCKET, CELL)
    carried = listed.select(
        *keys, "_n",
        F.last("_tail", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev"),
        F.first("_head", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_next"),
    ).where("_n > 0")
    carry = carried.select(*keys, F.explode(F.array("_prev", "_next")).alias("_cell")).where("_cell is not null")
    carry = carry.select(*keys, F.col("_cell._rt").alias("_t"), "_cell")

    # One list per bucket: right rows, carried rows and left rows, right before left at equal times.
    lefts = skew.salt_rows(rows, keys, hot, row_id)
    rights = skew.spread_rows(points.unionByName(carry), keys, hot)
    whole = F.struct(*[F.col(c) for c in left.columns])
    merged = (
        rights.select(*keys, skew.SALT, "_t", "_cell", F.lit(0).alias("_side"))
        .withColumn("_row", F.lit(None).cast(lefts.select(whole.alias("r")).schema["r"].dataType))
        .unionByName(
            lefts.select(*keys, skew.SALT, "_t", none.alias("_cell"), F.lit(1).alias("_side"), whole.alias("_row"))
        )
    )
    part = Window.partitionBy(*keys, skew.SALT)
    back = F.last("_cell", True).over(part.orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("_cell", True).over(
        part.orderBy(F.col("_t").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    )
    want_back, want_ahead = direction != "forward", direction != "backward"
    read = merged.withColumns({
        **({"_b": back} if want_back else {}), **({"_f": ahead} if want_ahead else {}),
    }).where("_side = 1")
    if direction == "nearest":
        b, f = F.col("_b._rt"), F.col("_f._rt")
        later = b.isNull() | ((f - F.col("_t")) <= (F.col("_t") - b))
        hit = F.when(f.isNotNull() & later, F.col("_f")).otherwise(F.col("_b"))
    else:
        hit = F.col("_b") if want_back else F.col("_f")
    read = read.withColumn("_hit", hit)
    keep = F.col("_hit").isNotNull()
    if within_range and direction == "nearest":
        keep = keep & F.col("_b").isNotNull() & F.col("_f").isNotNull()
    if tolerance_seconds is not None:
        gap, limit = F.abs(F.col("_hit._rt") - F.col("_t")), F.lit(int(tolerance_seconds * 1_000_000))
        keep = keep & ((gap < limit) if strict else (gap <= limit))
    out = read.withColumn("_hit", F.when(keep, F.col("_hit")))
    extra = [F.timestamp_micros("_hit._rt").alias(match_ts)] if match_ts else []
    out = out.select("_row.*", *[F.col(f"_hit.{c}").alias(c) for c in payload], *extra)
    timeless = timed.where(F.col("_t").isNull()).select(
        *left.columns, *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in (*payload, *([match_ts] if match_ts else []))])
    return out.union(timeless)
