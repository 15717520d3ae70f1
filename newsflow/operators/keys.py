"""Keyed operators: de-duplication, anti joins, keyed updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row of each key in `order`.

    Spark limits the window group before the shuffle as well, so a key with very many copies sends at most one
    row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def without_known(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the known ones. `new` has one row per key, so the join is even."""
    return new.join(known.select(key), key, "left_anti")


def insert_ignore(table: DataFrame, new: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """Rows of `new` an insert-ignore would add: one per key, the first in `order`, none already stored."""
    return without_known(first_per_key(new, [key], order), table, key).select(*new.columns)


def keyed_update(
    table: DataFrame, updates: DataFrame, columns: Sequence[str], key: str = "id", order: Sequence[Column | str] = (),
) -> DataFrame:
    """Table with `columns` taken from the update of the same key; a NULL in the update overwrites.

    Keys the table lacks are ignored. With `order` the first update of a key counts, else keys are unique.
    """
    if order:
        updates = first_per_key(updates, [key], order)
    u = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_u_{c}") for c in columns])
    joined = table.join(u, F.col(key) == F.col("_key"), "left")
    chosen = {c: F.when(F.col("_key").isNotNull(), F.col(f"_u_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.select(*[chosen[c].alias(c) if c in chosen else F.col(c) for c in table.columns])


def guarded_update(df: DataFrame, when: Column, columns: dict[str, Column]) -> DataFrame:
    """Set columns where a condition holds, leave them as they are elsewhere. No join."""
    return df.withColumns({c: F.when(when, new).otherwise(F.col(c)) for c, new in columns.items()})


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on columns of equal names in which NULL equals NULL; the columns of `left` stay, then the others of `right`."""
    keys = list(keys)
    named = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"_k_{k}" for k in keys])
