"""Feature preparation: null counts, medians, scaling, selection by class means. All fits are aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.operators.order import EXACT_ROWS, carry_forward, exact_medians, ordered_chunks
from newsflow.schema import MARKET_COLUMNS


def value_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Number of values (neither NULL nor NaN) per column, in one pass."""
    row = df.agg(*[F.count_if(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).alias(c) for c in cols]).first()
    return row.asDict()


def null_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows (column, nulls, rows): one row per column."""
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), (F.col("_n") - F.col(c)).alias("nulls"), F.col("_n").alias("rows")) for c in cols])
    return counted.select(F.explode(pairs).alias("p")).select("p.*")


@dataclass
class Preparation:
    """Fitted feature preparation: which columns, their medians, means and deviations."""

    features: list[str]
    medians: dict[str, float]
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)

    def imputed(self, c: str) -> Column:
        value = F.col(c).cast("double")
        return F.coalesce(F.when(~F.isnan(value), value), F.lit(float(self.medians[c])))

    def scaled(self, c: str) -> Column:
        # A constant column has no deviation; it is centred and left at 0.
        return (self.imputed(c) - F.lit(float(self.means[c]))) / F.lit(float(self.deviations[c] or 1.0))

    def missing(self, df: DataFrame) -> list[str]:
        return [c for c in self.features if c not in df.columns]

    def check(self, df: DataFrame) -> None:
        """A frame without a trained feature is an error: nothing is refitted in silence."""
        if missing := self.missing(df):
            raise ValueError(f"features of the model are missing: {missing}")

    def to_dict(self) -> dict:
        return asdict(self)


def drop_empty(df: DataFrame, cols: Sequence[str]) -> tuple[list[str], dict[str, int]]:
    """Columns with at least one value, and the counts."""
    counts = value_counts(df, cols)
    return [c for c in cols if counts[c] > 0], counts


def fit_imputer(df: DataFrame, cols: Sequence[str], exact_rows: int = EXACT_ROWS) -> Preparation:
    """Drop all-null columns and take the interpolating median of the others."""
    kept, counts = drop_empty(df, cols)
    clean = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in kept])
    return Preparation(kept, exact_medians(clean, kept, counts, exact_rows))


def fit_scaler(df: DataFrame, prep: Preparation, cols: Sequence[str] | None = None) -> Preparation:
    """Mean and population deviation of the imputed columns."""
    cols = list(cols or prep.features)
    row = df.agg(
        *[F.avg(prep.imputed(c)).alias(f"m_{c}") for c in cols],
        *[F.stddev_pop(prep.imputed(c)).alias(f"s_{c}") for c in cols],
    ).first()
    return Preparation(
        cols, {c: prep.medians[c] for c in cols}, {c: row[f"m_{c}"] for c in cols}, {c: row[f"s_{c}"] for c in cols})


def anova_scores(df: DataFrame, cols: Sequence[str], label: str, value=None) -> DataFrame:
    """One-way F of each column over the classes of `label`, undefined ones as 0: (feature, f_score).

    One aggregate per class and column: count, mean and variance; the rest is arithmetic on one row per class.
    """
    value = value or (lambda c: F.col(c).cast("double"))
    per = df.groupBy(label).agg(
        *[x for c in cols for x in (
            F.count(value(c)).alias(f"n_{c}"), F.avg(value(c)).alias(f"m_{c}"), F.var_pop(value(c)).alias(f"v_{c}"))])
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").cast("double").alias("n"), F.col(f"m_{c}").alias("m"),
                 F.col(f"v_{c}").alias("v")) for c in cols])
    long = per.select(F.explode(rows).alias("r")).select("r.*").where("n > 0")
    sums = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.collect_list(F.struct("n", "m")).alias("classes"),  # one entry per class
    )
    mean = F.col("s") / F.col("n")
    between = F.aggregate(
        F.transform("classes", lambda c: c["n"] * (c["m"] - mean) * (c["m"] - mean)), F.lit(0.0), lambda a, b: a + b)
    f = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k")))
    return sums.select("feature", F.coalesce(F.when(~F.isnan(f), f), F.lit(0.0)).alias("f_score"))


def select_features(df: DataFrame, prep: Preparation, label: str, most: int = 15) -> list[str]:
    """The features with the greatest F, weakest first; ties by name."""
    scores = anova_scores(df, prep.features, label, prep.imputed).collect()
    ranked = sorted((r["f_score"], r["feature"]) for r in scores)
    return [name for _, name in ranked[-most:]]


def carry_market(df: DataFrame, by: Sequence[str] = ("ticker",), cols: Sequence[str] = tuple(MARKET_COLUMNS),
                 ts: str = "datetime", row_id: str = "id") -> DataFrame:
    """Fill the market columns forward in time order, so items on days without trading see the last values.

    By default within each ticker; `by=()` carries over the whole table in time order.
    """
    have = [c for c in cols if c in df.columns]
    if not have:
        return df
    chunks = ordered_chunks(df, [*by, ts, row_id])
    filled = carry_forward(chunks, [ts, row_id], have, by=by, prefix="_f_")
    return filled.select(*[F.col(f"_f_{c}").alias(c) if c in have else F.col(c) for c in df.columns])
