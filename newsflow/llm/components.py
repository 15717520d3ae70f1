"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.operators.skew import TARGET_ROWS, salted_join
from newsflow.session import stored


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _with_lowest(edges: DataFrame, low: DataFrame, rows: int) -> DataFrame:
    """Edges with their node's row of `low`; hot nodes are looked for where there are rows enough for one."""
    return salted_join(edges, low, ["u"], ["v"]) if rows > TARGET_ROWS else edges.join(low, "u")


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).select("u", F.least("u", "m").alias("m"))
    return _with_lowest(both, low, 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. `edges` have u > v."""
    joined = _with_lowest(edges, _lowest(edges), rows)
    down = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(joined.select("u", F.col("m").alias("v"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"),
                    F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1_000_003))).alias("s")).first()
    return row["n"], row["x"], row["s"]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for every node with a link to another one, the smallest node it can reach.

    Links with a null end and links of a node to itself are left out; repeated links count once; no links
    give an empty table. Each round is a few joins on the node, hot nodes split; the number of rounds grows
    with the logarithm of the longest chain. Rounds are written tables.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = stored(edges)
    before = _signature(edges)
    while before[0]:
        # A star may add a row for every edge it reads.
        edges = stored(_small_star(_large_star(edges, before[0]), 2 * before[0]))
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
