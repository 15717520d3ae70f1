"""Evaluation: class balance, reports, precision-recall, regression errors, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.operators.keys import null_safe_join
from newsflow.operators.order import ordered_chunks, running_totals


def label_rate(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.avg(F.col(label).cast("double")).alias("label_rate"), F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str = "label") -> dict[int, float]:
    """Balanced weight n / (classes * n_class) of each class; one small aggregate."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    return {c: n / (len(counts) * k) for c, k in counts.items()}


def weight_column(weights: dict[int, float], label: str = "label") -> Column:
    out = F.lit(1.0)
    for value, weight in weights.items():
        out = F.when(F.col(label) == value, F.lit(weight)).otherwise(out)
    return out


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the macro and weighted means.

    Works on the table of (label, prediction) counts, which has classes^2 rows whatever the data.
    """
    cells = df.groupBy(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p")).agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    both = cells.select(F.explode(F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0.0).alias("predicted"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0.0).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0.0).alias("support"), F.col("n").alias("predicted"), F.lit(0.0).alias("hit")),
    )).alias("s")).select("s.*")
    per = both.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    per = per.withColumns({"precision": share("hit", "predicted"), "recall": share("hit", "support")})
    f1 = F.coalesce(F.try_divide(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")), F.lit(0.0))
    per = per.withColumn("f1", f1)
    names = ("precision", "recall", "f1")
    total = per.agg(
        F.sum("support").alias("support"), F.sum("hit").alias("hit"),
        *[F.avg(c).alias(f"m_{c}") for c in names],
        *[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"w_{c}") for c in names],
    )
    accuracy = F.try_divide("hit", "support")
    rows = F.array(
        F.struct(F.lit("accuracy").alias("row"), *[accuracy.alias(c) for c in names], F.col("support")),
        F.struct(F.lit("macro avg").alias("row"), *[F.col(f"m_{c}").alias(c) for c in names], F.col("support")),
        F.struct(F.lit("weighted avg").alias("row"), *[F.col(f"w_{c}").alias(c) for c in names], F.col("support")),
    )
    lines = per.select(F.col("class").cast("string").alias("row"), *names, "support")
    return lines.unionByName(total.select(F.explode(rows).alias("r")).select("r.*"))


def precision_recall(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at every distinct score used as a cut (score >= cut); with `by` a curve per key.

    Rows are first summed per score, so ties are one row; the running sums over falling scores are two-level.
    """
    by = list(by)
    per = df.where(F.col(score).isNotNull()).groupBy(*by, (-F.col(score)).alias("_neg")).agg(
        F.sum(F.col(label).cast("bigint")).alias("tp"), F.count(F.lit(1)).alias("n"))
    run = running_totals(ordered_chunks(per, [*by, "_neg"]), ["_neg"], {"tp": "_tp", "n": "_n"}, by=by)
    # One row per chunk or key remains in this total.
    positives = per.groupBy(*by).agg(F.sum("tp").cast("double").alias("_pos"))
    run = null_safe_join(run, positives, by) if by else run.withColumn("_pos", F.lit(float(positives.first()["_pos"] or 0.0)))
    return run.select(
        *by, (-F.col("_neg")).alias("threshold"), F.try_divide(F.col("_tp").cast("double"), F.col("_n")).alias("precision"),
        F.try_divide(F.col("_tp").cast("double"), F.col("_pos")).alias("recall"),
    )


def best_f1(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest F1 of a curve, or of each curve, with the small constant that keeps it defined."""
    p, r = F.col("precision"), F.coalesce("recall", F.lit(0.0))
    return curve.groupBy(*by).agg(F.max(p * r * 2 / (p + r + 1e-8)).alias("best_f1"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """MAE, R2, share of right signs, and the range of the target; one aggregate."""
    y, p = F.col(label), F.col(prediction)
    e = p - y
    spread = F.var_pop(y) * F.count(y)
    return df.where(y.isNotNull() & p.isNotNull()).agg(
        F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), spread)).alias("r2"),
        F.avg((F.signum(p) == F.signum(y)).cast("double")).alias("direction_acc"),
        F.min(y).alias("target_min"), F.max(y).alias("target_max"), F.count(F.lit(1)).alias("n"),
    )


def histogram(df: DataFrame, col: str, bins: int = 20, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Counts in equal bins on [low, high]; the upper end falls in the last bin and empty bins are kept.

    Rows are counted per bin first; the bin list is then added as zeros, so nothing is joined.
    """
    inside = df.where(F.col(col).between(low, high))
    # width_bucket puts the upper end in a bin of its own.
    bin_no = F.least(F.width_bucket(F.col(col), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int")
    counts = inside.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    empty = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"), F.lit(0).cast("bigint").alias("n"))
    width = (high - low) / bins
    return (
        counts.unionByName(empty).groupBy("bin").agg(F.sum("n").alias("n"))
        .select("bin", (F.lit(low) + (F.col("bin") - 1) * width).alias("bin_low"), "n")
    )
