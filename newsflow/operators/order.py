"""Order over a whole table without a one-task sort: chunks, running totals, exact order statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.operators.keys import null_safe_join
from newsflow.session import cut_lineage

CHUNK = "_chunk"
# Values one task may sort when a search has narrowed down to them.
EXACT_ROWS = 100_000
# Rows of a chunk; chunks summed up by one window, and levels of such windows: 10^9 chunks in all.
CHUNK_ROWS = 1_000_000
FAN_OUT = 1_000
LEVELS = 3


def ordered_chunks(df: DataFrame, order: Sequence[str], parts: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add `_chunk`, a number that grows with `order`, with about the same number of rows in each chunk.

    `parts` is the number of chunks; by default there is one for every `chunk_rows` rows, so their size does not grow with
    the table. Range partitioning samples the keys, so the chunks are even for any distribution as long as `order` ends
    in a unique column. The ranged rows are checkpointed: a second pass must see the same borders.
    """
    if parts is None:
        df = cut_lineage(df)
        parts = max(1, -(-df.count() // chunk_rows))
    ranged = cut_lineage(df.repartitionByRange(parts, *[F.col(c) for c in order]))
    return ranged.withColumn(CHUNK, F.spark_partition_id())


def _above(by: Sequence[str], bucket: str, level: int) -> tuple[str, Column, Sequence[str]]:
    """The next level over chunks: its column, and the chunks it takes together; at the top there is one group of all."""
    name = f"_level{level}"
    return name, F.floor(F.col(bucket) / FAN_OUT) if level < LEVELS else F.lit(0), [*by, name]


def _plus(a: Column, b: Column) -> Column:
    """Sum of what is known of two sums; NULL if neither is."""
    return F.coalesce(a + b, a, b)


def _sums_before(totals: DataFrame, sums: Sequence[str], by: Sequence[str], bucket: str, level: int = 1) -> DataFrame:
    """(keys, _o_x): for each bucket the sums of the earlier ones. Chunks are summed level by level, FAN_OUT at a time."""
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    if bucket != CHUNK and not bucket.startswith("_level"):
        return totals.select(*by, bucket, *[F.sum(c).over(before).alias(f"_o_{c}") for c in sums])
    group, number, keys = _above(by, bucket, level)
    grouped = totals.withColumn(group, number)
    inside = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    own = grouped.select(*keys, bucket, *[F.sum(c).over(inside).alias(f"_i_{c}") for c in sums])
    if level == LEVELS:
        return own.select(*by, bucket, *[F.col(f"_i_{c}").alias(f"_o_{c}") for c in sums])
    upper = _sums_before(grouped.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]), sums, by, group, level + 1)
    return null_safe_join(own, upper, keys).select(
        *by, bucket, *[_plus(F.col(f"_i_{c}"), F.col(f"_o_{c}")).alias(f"_o_{c}") for c in sums])


def _last_before(lasts: DataFrame, cols: Sequence[str], by: Sequence[str], bucket: str, level: int = 1) -> DataFrame:
    """(keys, x): for each bucket the last value of each column in the earlier ones, level by level like the sums."""
    if bucket != CHUNK and not bucket.startswith("_level"):
        before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        return lasts.select(*by, bucket, *[F.last(c, ignorenulls=True).over(before).alias(c) for c in cols])
    group, number, keys = _above(by, bucket, level)
    grouped = lasts.withColumn(group, number)
    inside = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    own = grouped.select(*keys, bucket, *[F.last(c, ignorenulls=True).over(inside).alias(f"_i_{c}") for c in cols])
    if level == LEVELS:
        return own.select(*by, bucket, *[F.col(f"_i_{c}").alias(c) for c in cols])
    upper = _last_before(
        grouped.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(bucket))).alias(c) for c in cols]), cols, by, group, level + 1)
    return null_safe_join(own, upper, keys).select(*by, bucket, *[F.coalesce(f"_i_{c}", c).alias(c) for c in cols])


def running_totals(
    df: DataFrame, order: Sequence[str], sums: dict[str, str], by: Sequence[str] = (), bucket: str = CHUNK,
) -> DataFrame:
    """Running sum of each column of `sums` (name -> new name) in `order`, the current row included.

    A window inside each bucket, plus the total of the earlier buckets. The table of buckets has one row per bucket; the one of
    chunks is summed in levels of FAN_OUT, so none of its windows is wide either.
    """
    keys = [*by, bucket]
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    offsets = _sums_before(totals, list(sums), by, bucket)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = null_safe_join(df, offsets, keys).withColumns(
        {new: _plus(F.sum(c).over(inside), F.col(f"_o_{c}")) for c, new in sums.items()}
    )
    return out.drop(*[f"_o_{c}" for c in sums])


def carry_forward(
    df: DataFrame, order: Sequence[str], cols: Sequence[str], by: Sequence[str] = (), bucket: str = CHUNK,
    prefix: str = "", suffix: str = "", strict: bool = False,
) -> DataFrame:
    """Last non-null value of each column up to the current row (`strict`: before it), in `order`.

    Inside a bucket it is a window; across buckets the last value of each bucket is carried over the table of
    buckets, that of chunks in levels.
    """
    keys = [*by, bucket]
    place = F.struct(*[F.col(c) for c in order])
    lasts = df.groupBy(*keys).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"_c_{c}") for c in cols]
    )
    carried = _last_before(lasts, [f"_c_{c}" for c in cols], by, bucket)
    end = -1 if strict else 0
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    filled = {
        f"{prefix}{c}{suffix}": F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_c_{c}")) for c in cols
    }
    return null_safe_join(df, carried, keys).withColumns(filled).drop(*[f"_c_{c}" for c in cols])


@dataclass
class _Search:
    """State of one search: the answer lies strictly between `low` and `high`; `below` values do not exceed `low`."""

    column: str
    rank: int
    inside: int
    below: int = 0
    low: object = None
    high: object = None
    answer: object = None
    done: bool = False

    def holds(self) -> Column:
        c = F.col(self.column)
        cond = c.isNotNull()
        if self.low is not None:
            cond = cond & (c > F.lit(self.low))
        if self.high is not None:
            cond = cond & (c < F.lit(self.high))
        return cond

    def narrow(self, low: object, high: object, less: int, at_low: int, between: int, at_high: int) -> None:
        """Keep the part that holds the rank, given the counts around the proposed borders."""
        place = self.rank - self.below - less
        if 0 <= place < at_low:
            self.answer, self.done = low, True
        elif at_low <= place < at_low + between:
            self.below += less + at_low
            self.low, self.high, self.inside = low, high, between
        elif at_low + between <= place < at_low + between + at_high:
            self.answer, self.done = high, True
        else:
            # The sketch missed the rank: what lies beyond the border it should have passed is searched next.
            if place < 0:
                self.high, self.inside = low, less
            else:
                passed = less + at_low + between + at_high
                self.below, self.low, self.inside = self.below + passed, high, self.inside - passed


def kth_values(
    df: DataFrame, targets: Sequence[tuple[str, int]], counts: dict[str, int], exact_rows: int = EXACT_ROWS,
) -> list:
    """Exact order statistics: for each (column, rank) the value at that 0-based rank among the non-nulls.

    Each pass lets the built-in quantile sketch propose borders just around the rank and then counts exactly
    what lies below, at and between them; values equal to a border end the search, so heavy ties do no harm.
    A range of at most `exact_rows` values is sorted at last. No pass shuffles rows: each is one aggregate
    over the table, and a trillion rows take three.
    """
    searches = [_Search(c, k, counts[c]) for c, k in targets]
    while wide := [s for s in searches if not s.done and s.inside > exact_rows]:
        # The sketch is right to 1e-4 of the rows, so twice that on either side always holds the rank.
        probes = []
        for i, s in enumerate(wide):
            share = (s.rank - s.below + 0.5) / s.inside
            ends = [max(share - 2e-4, 0.0), min(share + 2e-4, 1.0)]
            probes.append(F.percentile_approx(F.when(s.holds(), F.col(s.column)), ends, 10_000).alias(f"q{i}"))
        borders = df.agg(*probes).first()
        counted = []
        for i, s in enumerate(wide):
            c, (low, high) = F.col(s.column), borders[f"q{i}"]
            counted += [
                F.count_if(s.holds() & (c < F.lit(low))).alias(f"a{i}"),
                F.count_if(s.holds() & (c == F.lit(low))).alias(f"b{i}"),
                F.count_if(s.holds() & (c > F.lit(low)) & (c < F.lit(high))).alias(f"c{i}"),
                F.count_if(s.holds() & (c == F.lit(high)) & F.lit(low != high)).alias(f"d{i}"),
            ]
        row = df.agg(*counted).first()
        for i, s in enumerate(wide):
            s.narrow(*borders[f"q{i}"], row[f"a{i}"], row[f"b{i}"], row[f"c{i}"], row[f"d{i}"])
    left = [s for s in searches if not s.done]
    if left:
        row = df.agg(*[
            F.sort_array(F.collect_list(F.when(s.holds(), F.col(s.column)))).getItem(s.rank - s.below).alias(f"v{i}")
            for i, s in enumerate(left)
        ]).first()
        for i, s in enumerate(left):
            s.answer = row[f"v{i}"]
    return [s.answer for s in searches]


def exact_medians(df: DataFrame, cols: Sequence[str], counts: dict[str, int], exact_rows: int = EXACT_ROWS) -> dict:
    """Interpolating median of each column with at least one value; `counts` are the non-null counts."""
    named = [c for c in cols if counts[c]]
    targets = [(c, k) for c in named for k in ((counts[c] - 1) // 2, counts[c] // 2)]
    if not targets:
        return {}
    values = kth_values(df, targets, counts, exact_rows)
    return {c: (values[2 * i] + values[2 * i + 1]) / 2 for i, c in enumerate(named)}


def split_point(df: DataFrame, ts: str, row_id: str, share: float = 0.8, exact_rows: int = EXACT_ROWS):
    """(time, id) of the first row of the later part when the table, in time order, is cut at int(share * n).

    Found by order statistics, so the split itself is a plain filter: nothing is sorted or numbered. None if
    the later part is empty.
    """
    micros = F.unix_micros(F.col(ts))
    keyed = df.select(micros.alias("_ts"), F.col(row_id).alias("_id"))
    n = keyed.count()
    rank = int(share * n)
    if rank >= n:
        return None
    at = kth_values(keyed, [("_ts", rank)], {"_ts": n}, exact_rows)[0]
    row = keyed.agg(F.count_if(F.col("_ts") < F.lit(at)).alias("less"), F.count_if(F.col("_ts") == F.lit(at)).alias("ties")).first()
    tied = keyed.where(F.col("_ts") == F.lit(at))
    first_id = kth_values(tied, [("_id", rank - row["less"])], {"_id": row["ties"]}, exact_rows)[0]
    return at, first_id


def is_before(point, ts: str, row_id: str) -> Column:
    """Whether a row lies before a split point."""
    if point is None:
        return F.lit(True)
    at, first_id = point
    micros = F.unix_micros(F.col(ts))
    return (micros < F.lit(at)) | ((micros == F.lit(at)) & (F.col(row_id) < F.lit(first_id)))
