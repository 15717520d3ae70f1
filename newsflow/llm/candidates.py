"""Groups of linked nodes from candidates that share a key: signatures tell what is worth a judgement, the judge decides.

A node has a size, keys of which linked nodes share at least one as a rule, and a packed signature. No key's members are
compared pair by pair with the judge. A first round links each node to one leader it seems to be like. The second looks at the
members of a key outside its largest group, and takes of each other group the member most like them. What joins groups
is found by then, as a rule. The third takes what is left: nodes of different groups that still seem alike are brought together,
each once, and judged where they meet, unless they have been joined meanwhile. So pairs that are nearly alike, however many,
are never rows of a table. Keys and groups with many members are cut into parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import batch, grouped_rows, local_components, parts_for, ragged
from newsflow.llm.components import components
from newsflow.operators.skew import SALT, TARGET_ROWS, hot_groups, salt_rows, spread_rows
from newsflow.session import stored

# Members of a key one task compares; keys with more are split.
PART_MEMBERS = 20_000
# Nodes that may be linked and meet in one task; more are cut into parts.
PART_SETTLED = 4_000
# Pairs of one node one task judges; the pairs of nodes with more are split.
PART_PAIRS = 20_000
# Pairs taken in one array step.
STEP_PAIRS = 200_000


@dataclass(frozen=True)
class Rule:
    """What makes a pair a candidate: signatures of `words` 64-bit words at most `most` apart, sizes at least `percent` of each other.

    `keys` is the number of places of a node's key list; a key of 0 is none. Pairs up to `clear` apart count as clearly alike.
    """

    keys: int
    words: int
    apart: Callable[[np.ndarray, np.ndarray], np.ndarray]
    most: int
    clear: int
    percent: int


def _signatures(t: pa.Table, rule: Rule) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(len(t), rule.words)


def _near_sizes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _leaders(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """(a, b, different): of each cell's members the first is a leader, members like it follow it, and so on with the others.

    All cells of a table go through a step together. Rows come sorted by cell and place.
    """
    for t in grouped_rows(batches, "cell"):
        cell, name, n = (t.column(c).to_numpy() for c in ("cell", "name", "n"))
        sig = _signatures(t, rule)
        left = np.arange(len(cell))
        while len(left):
            new = np.r_[True, cell[left][1:] != cell[left][:-1]]
            leader = left[np.flatnonzero(new)[np.cumsum(new) - 1]]
            apart = np.zeros(len(left), dtype=np.int64)
            for i in range(0, len(left), STEP_PAIRS):
                apart[i:i + STEP_PAIRS] = rule.apart(sig[left[i:i + STEP_PAIRS]], sig[leader[i:i + STEP_PAIRS]])
            follows = ~new & (apart <= rule.most) & _near_sizes(n[left], n[leader], rule.percent) & (name[left] != name[leader])
            if follows.any():
                yield batch(a=name[left[follows]], b=name[leader[follows]], different=apart[follows])
            left = left[~new & ~follows]


def _foreign(batches: Iterator[pa.RecordBatch], rule: Rule, nearest: bool) -> Iterator[pa.RecordBatch]:
    """(a, b): pairs of a left and a right member of a cell that are in different groups, seem alike and share no key before.

    With `nearest` of each other group only the member most like the left one, else stars that join all these pairs. Rows come sorted by cell and side (0 left, 1 right).
    """
    for t in grouped_rows(batches, "cell"):
        cell, side, name, n, comp, band = (t.column(c).to_numpy() for c in ("cell", "side", "name", "n", "comp", "band"))
        keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, rule.keys)
        sig = _signatures(t, rule)
        lefts, rights = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        first = np.searchsorted(cell[rights], cell[lefts], side="left")
        count = np.searchsorted(cell[rights], cell[lefts], side="right") - first
        ends = np.cumsum(count)
        done = 0
        while done < len(lefts):
            base = ends[done] - count[done]
            upto = max(done + 1, int(np.searchsorted(ends, base + STEP_PAIRS, side="right")))
            owner, place = ragged(count[done:upto])
            i, j = lefts[done:upto][owner], rights[first[done:upto][owner] + place]
            keep = (comp[i] != comp[j]) & _near_sizes(n[i], n[j], rule.percent)
            i, j = i[keep], j[keep]
            apart = np.concatenate([rule.apart(sig[i[k:k + STEP_PAIRS]], sig[j[k:k + STEP_PAIRS]])
                                    for k in range(0, len(i), STEP_PAIRS)] or [np.empty(0, np.int64)])
            near = apart <= rule.most
            i, j, apart = i[near], j[near], apart[near]
            met = (keys[i] == keys[j]) & (keys[i] != 0) & (np.arange(rule.keys) < band[i][:, None])
            new = ~met.any(axis=1)
            i, j, apart = i[new], j[new], apart[new]
            if nearest and len(i):
                order = np.lexsort((name[j], apart, comp[j], i))
                i, j = i[order], j[order]
                lead = np.r_[True, (i[1:] != i[:-1]) | (comp[j][1:] != comp[j][:-1])]
                i, j = i[lead], j[lead]
            if len(i) and nearest:
                yield batch(a=np.maximum(name[i], name[j]), b=np.minimum(name[i], name[j]))
            elif len(i):
                a, b = local_components(name[i], name[j])
                yield batch(a=a[a != b], b=b[a != b])
            done = upto


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("name"), parts.cast("long")).cast("int")


def _by_key(rows: DataFrame, per_key: DataFrame, size: str, count: int) -> DataFrame:
    """Rows joined to one row per key; keys with very many rows are salted, if `count`, a bound of their rows, allows for any."""
    if count <= TARGET_ROWS:
        return rows.join(per_key, "key")
    hot = per_key.where(F.col(size) > TARGET_ROWS).select("key", F.ceil(F.col(size) / TARGET_ROWS).cast("int").alias("_parts"))
    return salt_rows(rows, ["key"], hot, ["name"]).join(spread_rows(per_key, ["key"], hot), ["key", SALT]).drop(SALT)


def _cells(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition(parts_for(rows), "cell").sortWithinPartitions("cell", *order)


def leader_pairs(met: DataFrame, keyed: DataFrame, sigs: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): for each node one other it seems to be like, the smallest of the clearly similar ones or else the most similar.

    `met` are the members (key, name, members) of shared keys, `keyed` one row (key, members, head) for each. A value with
    many members is cut into parts, and its head is a leader in all of them.
    """
    parts = F.ceil(F.col("members") / PART_MEMBERS).cast("int")
    rows = met.select("key", _part(parts).alias("part"), "name", F.lit(1).alias("place"))
    heads = keyed.where(F.col("members") > PART_MEMBERS).select(
        "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("head").alias("name"), F.lit(0).alias("place"))
    cells = rows.unionByName(heads).join(sigs.select("name", "n", "sig"), "name").select(F.xxhash64("key", "part").alias("cell"), "place", "name", "n", "sig")
    found = _cells(cells, "place", "name").mapInArrow(lambda b: _leaders(b, rule), "a long, b long, different long")
    clear = F.col("different") <= F.lit(rule.clear)
    best = F.min(F.struct((~clear).alias("far"), F.when(~clear, F.col("different")).alias("different"), "b")).alias("best")
    return found.groupBy("a").agg(best).select("a", "best.b")


def foreign_pairs(met: DataFrame, members: int, labels: DataFrame, sigs: DataFrame, rule: Rule, nearest: bool) -> DataFrame:
    """(a, b): pairs of different groups that share a key and seem alike; with `nearest` the nearest, else stars that join all.

    Of a key the members outside its largest group are held against all its members. Both are cut into parts where they
    are many, so a cell is bounded and most rows are sent once. `members` is the number of rows of `met`.
    """
    rows = met.select("key", "band", "name").join(labels, "name", "left").withColumn("comp", F.coalesce("comp", "name"))
    groups = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    per_key = stored(groups.groupBy("key").agg(
        F.sum("c").alias("members"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("c", "comp")).alias("top")).where("comps > 1").select(
        "key", "members", (F.col("members") - F.col("top.c")).alias("strays"), F.col("top.comp").alias("top")))
    cut = _by_key(rows, per_key, "members", members).join(sigs, "name").withColumns({
        "_s": F.ceil(F.col("strays") / PART_MEMBERS).cast("int"), "_m": F.ceil(F.col("members") / PART_MEMBERS).cast("int")})
    # Two strays are held against each other from both sides: once is enough.
    sides = F.when(F.col("comp") != F.col("top"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    both = cut.withColumn("side", F.explode(sides))
    own, other = _part(F.when(F.col("side") == 0, F.col("_s")).otherwise(F.col("_m"))), F.when(F.col("side") == 0, F.col("_m")).otherwise(F.col("_s"))
    both = both.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), other - 1))})
    left = F.col("side") == 0
    cells = both.select(
        F.xxhash64("key", F.when(left, F.col("own")).otherwise(F.col("other")), F.when(left, F.col("other")).otherwise(F.col("own"))).alias("cell"),
        "side", "name", "n", "comp", "band", "keys", "sig")
    return _cells(cells, "side", "name").mapInArrow(lambda b: _foreign(b, rule, nearest), "a long, b long").distinct()


def with_bodies(pairs: DataFrame, side: str, bodies: DataFrame, count: int) -> DataFrame:
    """Pairs with the body of one end; pairs of a node that has very many are split, if there are so many."""
    named = bodies.select(F.col("name").alias(side), F.col("body").alias(f"body_{side}"))
    if count <= PART_PAIRS:
        return pairs.join(named, side)
    hot = hot_groups(pairs.select(side), [side], PART_PAIRS)
    other = "b" if side == "a" else "a"
    return salt_rows(pairs, [side], hot, [other]).join(spread_rows(named, [side], hot), [side, SALT]).drop(SALT)


def _judged(pairs: DataFrame, bodies: DataFrame, alike: Callable) -> DataFrame:
    """(a, b, linked): pairs decided on the bodies of their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = [alike(x, y) for x, y in zip(b.column("body_a").to_pylist(), b.column("body_b").to_pylist())]
            yield batch(a=b.column("a"), b=b.column("b"), linked=pa.array(linked, pa.bool_()))

    count = pairs.count()
    both = with_bodies(with_bodies(pairs.select("a", "b"), "a", bodies, count), "b", bodies, count)
    return both.select("a", "b", "body_a", "body_b").mapInArrow(run, "a long, b long, linked boolean")


def _settled(batches: Iterator[pa.RecordBatch], rule: Rule, alike: Callable) -> Iterator[pa.RecordBatch]:
    """(a, b): links between the groups of a cell's members, as many as join them. A cell of two parts compares across them."""
    for t in grouped_rows(batches, "cell"):
        cell, side, name, n, comp = (t.column(c).to_numpy() for c in ("cell", "side", "name", "n", "comp"))
        sig, bodies = _signatures(t, rule), t.column("body")
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        far, near = [], []
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)]):
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while (up := root.get(c, c)) != c:
                    c = up
                return c

            held = bodies.slice(low, high - low).to_pylist()
            across = bool(side[low:high].any())
            for i in range(low, high - 1):
                right = np.arange(i + 1, high)
                right = right[(comp[right] != comp[i]) & _near_sizes(n[right], n[i], rule.percent) & (not across or side[right] != side[i])]
                if not len(right):
                    continue
                right = right[rule.apart(sig[right], np.broadcast_to(sig[i], (len(right), rule.words))) <= rule.most]
                for j in right.tolist():
                    x, y = find(int(comp[i])), find(int(comp[j]))
                    if x != y and alike(held[i - low], held[j - low]):
                        root[max(x, y)] = min(x, y)
                        far.append(i)
                        near.append(j)
        if far:
            yield batch(a=name[far], b=name[near])


def settled_links(stars: DataFrame, labels: DataFrame, sigs: DataFrame, bodies_of: Callable, rule: Rule, alike: Callable) -> DataFrame:
    """(a, b): links among the nodes of `stars`, which join what may still be linked. Each node travels once with its body;
    what may be linked with very many is cut into parts, which meet in pairs."""
    around = components(stars, "a", "b").withColumnRenamed("node", "name")
    around = stored(around.select("name", F.col("root").alias("around")).unionByName(around.select(F.col("root").alias("name"), F.col("root").alias("around"))).distinct())
    hot = hot_groups(around, ["around"], PART_SETTLED)
    cut = F.coalesce("_parts", F.lit(1))
    members = around.join(F.broadcast(hot), "around", "left").select("around", "name", cut.alias("cut"), _part(cut).alias("own"))
    rows = members.join(sigs.select("name", "n", "sig"), "name").join(labels, "name", "left").join(bodies_of(around.select("name")), "name")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("other"))
    cells = rows.select(
        F.xxhash64("around", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), (F.col("own") > F.col("other")).cast("int").alias("side"),
        "name", "n", F.coalesce("comp", "name").alias("comp"), "sig", "body")
    return _cells(cells, "side", "name").mapInArrow(lambda b: _settled(b, rule, alike), "a long, b long")


def shared_keys(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(met, keyed) of nodes (name, keys): keys that at least two nodes have, and their members."""
    banded = nodes.select("name", F.posexplode("keys").alias("band", "key")).where("key != 0")
    keyed = stored(banded.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("name").alias("head")).where("members > 1"))
    met = stored(_by_key(banded, keyed, "members", keyed.agg(F.max("members")).first()[0] or 0).select("key", "band", "name", "members"))
    return met, keyed


def groups(
    nodes: DataFrame, met: DataFrame, keyed: DataFrame, rule: Rule, bodies_of: Callable[[DataFrame], DataFrame], alike: Callable,
) -> DataFrame:
    """(name, comp): the group of every node that is linked to another one.

    `nodes` are (name, n, keys, sig), `met` the members (key, band, name, members) of keys that different nodes share, band the place
    in the key list, `keyed` a row (key, members, head) for each of these. `bodies_of` gives (name, body) of a table of names, and
    `alike` decides on two bodies.
    """
    members = keyed.agg(F.sum("members")).first()[0] or 0
    sigs = stored(nodes.select("name", "n", "keys", "sig").join(met.select("name").distinct(), "name", "left_semi"))

    def judged(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
        return stored(_judged(pairs, bodies_of(ends), alike)).where("linked").select("a", "b")

    def labelled(links: DataFrame) -> DataFrame:
        return components(links, "a", "b").select(F.col("node").alias("name"), F.col("root").alias("comp"))

    links = judged(stored(leader_pairs(met, keyed, sigs, rule)))
    labels = labelled(links)
    nearest = stored(foreign_pairs(met, members, labels, sigs, rule, True))
    if nearest.isEmpty():
        return labels
    found = judged(nearest)
    if not found.isEmpty():
        links = links.unionByName(found)
        labels = labelled(links)
    rest = stored(foreign_pairs(met, members, labels, sigs, rule, False))
    if rest.isEmpty():
        return labels
    found = stored(settled_links(rest, labels, sigs, bodies_of, rule, alike))
    return labels if found.isEmpty() else labelled(links.unionByName(found))
