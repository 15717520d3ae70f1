"""Exact top-k inner products by dual-tree search over cover trees.

Candidates are dealt into blocks around pivots, and queries into groups around the same pivots. Every block and every
query group is one cover tree: nodes hold a centre, a covering radius and their points. For a query
node and a candidate node, centre product plus radii bounds every product between them; a pair is left out when that
bound is below the worst k-th score of the query node. A first round meets each group with the blocks of its
best bounds and fixes a k-th score per group; the second meets the other blocks, and only those whose bound reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.common import batch, parts_for
from newsflow.session import cut_lineage

# Pivots are drawn by hash from the candidates, about so many; they only decide which vectors lie together.
PIVOTS = 64
BLOCK_VECTORS = 8_192
GROUP_QUERIES = 512
LEAF = 256
FANOUT = 8
# Above this product of norms, sums leave the exact range of doubles and are made in 64-bit integers.
EXACT = 2.0 ** 52


@dataclass
class Node:
    """Part of a set of points: centre, covering radius, rows, children."""

    centre: np.ndarray
    radius: float
    rows: np.ndarray
    children: list["Node"] = field(default_factory=list)
    worst: float = -np.inf  # of a query node: lowest k-th score of its queries


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """Cover tree: the children of a node are centres far from each other, with all points near one of them."""
    rows = np.arange(len(points)) if rows is None else rows
    own = points[rows]
    centre = own[0]
    gaps = ((own - centre) ** 2).sum(axis=1)
    node = Node(centre, float(np.sqrt(gaps.max())) if len(rows) else 0.0, rows)
    if len(rows) <= LEAF or node.radius == 0.0:
        return node
    # Centres one after another, each the point farthest from those before it, until they cover at half the radius.
    owner, nearest, count = np.zeros(len(rows), dtype=np.int64), gaps.copy(), 1
    while count < FANOUT and nearest.max() > (node.radius / 2) ** 2:
        far = int(nearest.argmax())
        gap = ((own - own[far]) ** 2).sum(axis=1)
        closer = gap < nearest
        owner[closer], nearest[closer] = count, gap[closer]
        count += 1
    if count == 1:
        owner = (np.arange(len(rows)) * 2 // len(rows)).astype(np.int64)
        count = 2
    for k in range(count):
        part = rows[owner == k]
        if len(part):
            node.children.append(cover_tree(points, part))
    return node


class Search:
    """k best candidates of each query, by descending score, then ascending id."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int, worst: float) -> None:
        self.queries, self.query_ids, self.k = queries, query_ids, k
        self.floor = worst
        self.scores = [np.empty(0, np.int64) for _ in query_ids]
        self.ids = [np.empty(0, np.int64) for _ in query_ids]
        self.kth = np.full(len(query_ids), worst)
        self.norm = np.abs(queries).sum(axis=1).max() if len(queries) else 0.0

    def bound(self, q: Node, r: Node) -> float:
        """No product of a query in q and a candidate in r is above this (rounding included)."""
        top = q.centre @ r.centre + r.radius * np.linalg.norm(q.centre) + q.radius * np.linalg.norm(r.centre) + q.radius * r.radius
        return float(top + 1e-9 * (abs(top) + np.linalg.norm(q.centre) * np.linalg.norm(r.centre)) + 1e-6)

    def products(self, q: np.ndarray, points: np.ndarray) -> np.ndarray:
        own = self.queries[q]
        if self.norm * (np.abs(points).max() if points.size else 0.0) < EXACT:
            return (own @ points.T).astype(np.int64)
        return own.astype(np.int64) @ points.astype(np.int64).T

    def meet(self, q: Node, r: Node, points: np.ndarray, ids: np.ndarray) -> None:
        """Dual-tree walk: the larger node is opened, best bounds first."""
        q.worst = float(self.kth[q.rows].min())
        if self.bound(q, r) < q.worst:
            return
        if not q.children and not r.children:
            self.base(q, r, points, ids)
        elif r.children and (not q.children or r.radius >= q.radius):
            for child in sorted(r.children, key=lambda c: -self.bound(q, c)):
                self.meet(q, child, points, ids)
        else:
            for child in q.children:
                self.meet(child, r, points, ids)

    def base(self, q: Node, r: Node, points: np.ndarray, ids: np.ndarray) -> None:
        made, own = self.products(q.rows, points[r.rows]), ids[r.rows]
        for i, row in enumerate(q.rows):
            score = made[i]
            use = np.flatnonzero((score >= self.kth[row]) & (own != self.query_ids[row]))
            if not len(use):
                continue
            score, found = np.concatenate([self.scores[row], score[use]]), np.concatenate([self.ids[row], own[use]])
            best = np.lexsort((found, -score))[:self.k]
            self.scores[row], self.ids[row] = score[best], found[best]
            if len(best) == self.k:
                self.kth[row] = max(self.floor, float(score[best[-1]]))


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors that are null or hold null or non-finite parts are left out."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("v"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _dealt(rows: DataFrame, pivots: np.ndarray, per_part: int, kind: str) -> DataFrame:
    """Rows packed as (part, low ids...) blocks: each the vectors nearest one pivot, cut by a hash where they are many."""
    centres = rows.sparkSession.sparkContext.broadcast(pivots)  # at most a few hundred vectors

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = centres.value
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column("v"))
                nearest = (((p * p).sum(axis=1)[None] - 2 * m @ p.T)).argmin(axis=1)
                yield batch(vec_id=b.column("vec_id"), v=b.column("v"), pivot=nearest)

    dealt = rows.mapInArrow(near, "vec_id long, v array<long>, pivot long")
    sizes = {r["pivot"]: r["n"] for r in dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = F.create_map(*[x for p, n in sizes.items() for x in (F.lit(p), F.lit(-(-n // per_part)))]) if sizes else F.lit(None)
    cut = F.pmod(F.xxhash64("vec_id"), cuts[F.col("pivot")].cast("long")) if sizes else F.lit(0).cast("long")
    placed = dealt.select((F.col("pivot") * F.lit(1 << 32) + cut).alias("part"), "vec_id", "v")

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("vec_id").to_numpy(), kind="stable")
        points = _matrix(t.column("v").combine_chunks())[order]
        centre = points.mean(axis=0)
        radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1).max()))
        return pa.table({"part": [key[0].as_py()], "ids": [t.column("vec_id").to_numpy()[order].tobytes()], "points": [points.tobytes()],
                         "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius]},
                        schema=pa.schema([("part", pa.int64()), ("ids", pa.binary()), ("points", pa.binary()),
                                          ("centre", pa.list_(pa.float64())), ("radius", pa.float64())]))

    return placed.groupBy("part").applyInArrow(pack, "part long, ids binary, points binary, centre array<double>, radius double").select(
        *[F.col(c).alias(f"{kind}_{c}") for c in ("part", "ids", "points", "centre", "radius")])


def _meet(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """k best of each query within each (group, block) pair of `pairs` (q_part, r_part, worst)."""
    met = pairs.join(groups.select("q_part", "q_ids", "q_points"), "q_part").join(blocks.select("r_part", "r_ids", "r_points"), "r_part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[tuple, tuple] = {}

        def tree(side: str, part: int, ids: bytes, points: bytes) -> tuple:
            if (side, part) not in trees:
                if len(trees) > 8:
                    trees.clear()
                own = np.frombuffer(ids, np.int64)
                matrix = np.frombuffer(points).reshape(len(own), -1)
                trees[side, part] = own, matrix, cover_tree(matrix)
            return trees[side, part]

        for b in batches:
            for row in b.to_pylist():
                query_ids, queries, q = tree("q", row["q_part"], row["q_ids"], row["q_points"])
                ids, points, r = tree("r", row["r_part"], row["r_ids"], row["r_points"])
                search = Search(queries, query_ids, k, -np.inf if row["worst"] is None else row["worst"])
                search.meet(q, r, points, ids)
                counts = [len(x) for x in search.ids]
                yield batch(q_part=np.full(sum(counts), row["q_part"]), query_id=np.repeat(query_ids, counts),
                            vec_id=np.concatenate(search.ids), score=np.concatenate(search.scores))

    spread = met.repartition(parts_for(pairs), "r_part", "q_part")
    return spread.mapInArrow(run, "q_part long, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64,
    block_vectors: int = BLOCK_VECTORS, group_queries: int = GROUP_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the highest inner product for each query, its own id left out.

    Components are floor(scale * x). Ties go to the smaller id; a query with fewer candidates gets all. Rows without an id,
    null vectors and vectors with null or non-finite parts take no part; all vectors must have one length. Repeated
    queries count once, repeated candidates each. Other columns are ignored.

    A vector that fills a third of the table is many blocks around one pivot. Group and block summaries, one short row
    per some thousand vectors, are paired; full vectors travel only for pairs whose bound is not below the group's
    worst k-th score.
    """
    every = quantized(vectors, id_col, vec_col, scale)
    asked = quantized(queries, id_col, vec_col, scale).dropDuplicates(["vec_id"])
    total = every.count()
    rate = min(1.0, PIVOTS / max(1, total))
    drawn = every.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < F.lit(int(np.ceil(rate * 1_000_000)))).limit(4 * PIVOTS).collect()
    out = "query_id long, rank int, vec_id long, score long"
    pivots = np.unique(np.array([r["v"] for r in drawn], dtype=np.float64), axis=0) if drawn else None
    if pivots is None:
        first = every.limit(1).collect()
        if not first:
            return queries.sparkSession.createDataFrame([], out)
        pivots = np.array([first[0]["v"]], dtype=np.float64)
    blocks = cut_lineage(_dealt(every, pivots, block_vectors, "r"))
    groups = cut_lineage(_dealt(asked, pivots, group_queries, "q"))
    # Blocks of the query set against blocks of all rows: summaries only.
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(F.col(a), F.col(a)))
    short_q = groups.select("q_part", "q_centre", "q_radius", norm("q_centre").alias("q_norm"))
    short_r = blocks.select("r_part", "r_centre", "r_radius", norm("r_centre").alias("r_norm"), (F.octet_length("r_ids") / 8).alias("r_n"))
    top = dot(F.col("q_centre"), F.col("r_centre")) + F.col("r_radius") * F.col("q_norm") + F.col("q_radius") * F.col("r_norm") + F.col("q_radius") * F.col("r_radius")
    paired = short_q.crossJoin(F.broadcast(short_r) if blocks.count() < 100_000 else short_r).select(
        "q_part", "r_part", "r_n", (top * (1 + 1e-9) + 1e-6 + 1e-9 * F.col("q_norm") * F.col("r_norm")).alias("bound"))
    by_bound = Window.partitionBy("q_part").orderBy(F.col("bound").desc(), "r_part")
    ranked = cut_lineage(paired.withColumn("_at", F.row_number().over(by_bound)))
    # First round: the block of the best bound for each group.
    near = cut_lineage(_best(_meet(ranked.where("_at = 1").select("q_part", "r_part", F.lit(None).cast("double").alias("worst")), groups, blocks, k), k))
    per_query = near.groupBy("q_part", "query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    sizes = groups.select("q_part", (F.octet_length("q_ids") / 8).alias("n_queries"))
    worst = per_query.groupBy("q_part").agg(
        F.min(F.when(F.col("n") >= k, F.col("kth"))).alias("kth"), F.min("n").alias("least"), F.count(F.lit(1)).alias("seen")).join(sizes, "q_part").select(
        "q_part", F.when((F.col("least") >= k) & (F.col("seen") == F.col("n_queries")), F.col("kth").cast("double")).alias("worst"))
    rest = ranked.where("_at > 1").join(worst, "q_part", "left").where(F.col("worst").isNull() | (F.col("bound") >= F.col("worst")))
    far = _meet(rest.select("q_part", "r_part", "worst"), groups, blocks, k)
    return _best(near.select("query_id", "vec_id", "score").union(far.select("query_id", "vec_id", "score")), k).select(
        "query_id", "rank", "vec_id", "score")
