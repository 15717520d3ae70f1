"""Evaluate costly columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated exactly once per row, whatever is built on them.

    A plain projection may be merged into every expression and filter that uses it, so an expensive column is
    evaluated again for each use, and inside a lambda for each element. A generator of one row is not merged.
    It stays narrow and on the JVM.
    """
    keep = [c for c in df.columns if c not in columns]
    made = F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))
    return df.select(*keep, made)


# Input per core below which a scan gives some cores nothing to do.
SMALL_PER_CORE = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """Give costly work at least one task per core when the input is small.

    The estimated size of the plan decides, so nothing is run for it. A large input has more tasks than cores
    and is left as it is: nothing is shuffled at scale.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_PER_CORE else df
