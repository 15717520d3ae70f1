"""Query registry: a name, a Spark plan over the given tables and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is its DuckDB form."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def stamp(col: str | Column) -> Column:
    """Time as text, the same in both engines."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def day(col: str | Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


SQL_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
SQL_DAY = "strftime({}, '%Y-%m-%d')"
