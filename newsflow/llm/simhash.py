"""SimHash near-duplicates by anchor-point covering.

Anchors are the code words of the direct sum of two perfect Golay codes (23 bits each, covering radius 3 each,
6 together); the last 18 bits of a fingerprint are free. Every fingerprint has one home anchor, the code word
nearest to it. It is also sent to every anchor within covering radius plus threshold, bit differences counted
per half: if x and y differ in a1 bits of the first half and a2 of the second, y lies within 3 + a1 and 3 + a2
of the halves of x's home. So every link is met at the home of either end, with about 61 copies per
fingerprint for a threshold of 2, over 2^24 anchors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import batch, grouped_rows, local_components, parts_for, ragged, texts_of
from newsflow.llm.components import components
from newsflow.operators.skew import hot_groups
from newsflow.session import cut_lineage

# Fixed values of the code: length, generator polynomial, covering radius.
CODE_BITS = 23
GENERATOR = 0b110001110101
RADIUS = 3
# Home fingerprints one task compares with the members of an anchor; anchors with more are split.
HOMES_PER_PART = 32_768
# Pairs compared in one step inside a task.
STEP_PAIRS = 2_000_000


# ---- fingerprints

def fingerprint(text: str, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*[words[i:] for i in range(width)])))
    return vote(list(map(xxhash.xxh64_intdigest, shingles, repeat(42))))


def vote(hashes: list[int]) -> int:
    """Number whose bit is 1 where more than half of the hashes have a 1."""
    ones = np.zeros(64, dtype=np.int64)
    array = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(array), 65_536):
        ones += np.unpackbits(array[i:i + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, h, fp): hash of the text and signed 64-bit form of the fingerprint. Null and blank texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in texts_of(b.column(2))], dtype=np.uint64).astype(np.int64)
            yield batch(doc_id=b.column(0), h=b.column(1), fp=fps)

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").alias("t"))
    return narrow.mapInArrow(run, f"doc_id {kind}, h long, fp long")


# ---- anchors

def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial: equal for words with the same error patterns."""
    rest = words.astype(np.int64)
    for bit in range(CODE_BITS - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@cache
def error_patterns(extra: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each excess 0..extra over the covering radius: (starts, counts, patterns) by syndrome.

    Excess 0 holds the one pattern of weight 3 or less, excess e those of weight 3 + e.
    """
    out = []
    for excess in range(extra + 1):
        weights = range(RADIUS + 1) if excess == 0 else [RADIUS + excess]
        found = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(CODE_BITS), w)], dtype=np.int64)
        of = syndrome(found)
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=2048)
        out.append((np.cumsum(counts) - counts, counts, found[order]))
    return out


def halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = fps.astype(np.uint64)
    return (bits >> np.uint64(41)).astype(np.int64), (bits >> np.uint64(18)).astype(np.int64) & (2 ** 23 - 1)


def anchors_of(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of every anchor each fingerprint is sent to."""
    table = error_patterns(threshold)
    first, second = halves(fps)
    s1, s2 = syndrome(first), syndrome(second)
    rows, anchors, homes = [], [], []
    for e1 in range(threshold + 1):
        for e2 in range(threshold + 1 - e1):
            (at1, n1, p1), (at2, n2, p2) = table[e1], table[e2]
            c2 = n2[s2]
            row, place = ragged(n1[s1] * c2)
            i, j = place // c2[row], place % c2[row]
            w1 = first[row] ^ p1[at1[s1[row]] + i]
            w2 = second[row] ^ p2[at2[s2[row]] + j]
            rows.append(row)
            anchors.append((w1 >> 11) << 12 | w2 >> 11)
            homes.append(np.full(len(row), e1 == 0 and e2 == 0))
    return np.concatenate(rows), np.concatenate(anchors), np.concatenate(homes)


def _home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        _, anchor, _ = anchors_of(b.column("fp").to_numpy(zero_copy_only=False), 0)
        yield batch(anchor=anchor)


def _links(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Stars of the linked fingerprints of each anchor."""
    for t in grouped_rows(batches, "bucket"):
        bucket = t.column("bucket").to_numpy()
        fp = t.column("fp").to_numpy()
        home = np.flatnonzero(t.column("home").to_numpy(zero_copy_only=False))
        if not len(home):
            continue
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[starts, len(bucket)])
        group = np.searchsorted(starts, home, side="right") - 1
        keep = sizes[group] > 1
        home, group = home[keep], group[keep]
        counts = sizes[group]
        ends = np.cumsum(counts)
        found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        kept, done = 0, 0
        while done < len(home):
            base = ends[done - 1] if done else 0
            upto = max(done + 1, int(np.searchsorted(ends, base + STEP_PAIRS, side="right")))
            owner, place = ragged(counts[done:upto])
            x = fp[home[done:upto]][owner]
            y = fp[starts[group[done:upto]][owner] + place]
            near = (np.bitwise_count((x ^ y).view(np.uint64)) <= threshold) & (x != y)
            found_a.append(x[near])
            found_b.append(y[near])
            kept += int(near.sum())
            done = upto
            if kept > STEP_PAIRS:
                a, b = local_components(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b, kept = [a], [b], 0
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        if len(a):
            a, b = local_components(a, b)
            far = a != b
            yield batch(a=a[far], b=b[far])


def fingerprint_links(fps: DataFrame, threshold: int = 2, homes_per_part: int = HOMES_PER_PART) -> DataFrame:
    """(a, b): links that join all fingerprints at `threshold` or fewer differing bits, as stars per anchor.

    `fps` has one row per different fingerprint, column fp. Stars span the same components as all links do, with at
    most one row per fingerprint and anchor, whatever the size of a group.
    """
    hot = hot_groups(fps.mapInArrow(_home, "anchor long"), ["anchor"], homes_per_part)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("fp").to_numpy(zero_copy_only=False)
            row, anchor, home = anchors_of(values, threshold)
            yield batch(anchor=anchor, fp=values[row], home=home)

    sent = fps.mapInArrow(spread, "anchor long, fp long, home boolean").join(F.broadcast(hot), "anchor", "left")
    parts = F.coalesce("_parts", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), parts.cast("long"))
    # A member meets the home fingerprints of every part; it counts as a home only in its own.
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    sent = sent.select(
        (F.col("anchor") * F.lit(1 << 20) + F.col("part")).alias("bucket"), "fp", (F.col("home") & (F.col("part") == own)).alias("home"))
    sent = sent.repartition(parts_for(fps), "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(lambda batches: _links(batches, threshold), "a long, b long")


def groups(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """(fp, first): for every different fingerprint the first document of its component, by id (null last) and text hash.

    Equal fingerprints are one node, so thousands of copies cost one comparison. Nodes, links and components are
    tables; the driver sees counts only.
    """
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "h")
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min(first).alias("first")))
    # Few wide rows become many: spread them first.
    roots = components(fingerprint_links(nodes.select("fp").repartition(parts_for(fps)), threshold), "a", "b")
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("lowest"))
    return cut_lineage(named.join(lowest, "root").select("fp", F.col("lowest").alias("first")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, threshold: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per document.

    Words are runs of other bytes than blanks and control blanks, ASCII letters lower-cased. Null, empty and blank
    texts have fingerprint zero and are linked like any other. component_id is the smallest id of the
    component, null if all its ids are null; repeated rows are kept. Other columns are ignored.
    """
    fps = cut_lineage(fingerprints(docs, id_col, text_col, width))
    return fps.join(groups(fps, threshold), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, threshold: int = 2) -> DataFrame:
    """`docs` with one document of each component left, the one with the smallest id; equal rows are one document.

    Among equal ids the text with the smaller hash stays; null ids only stay where a component has no other.
    """
    fps = fingerprints(docs, id_col, text_col, width)
    firsts = groups(cut_lineage(fps), threshold).select("first.doc_id", "first.h").distinct()
    firsts = firsts.select(F.col("doc_id").alias("_first"), F.col("h").alias("_h"))
    keyed = docs.withColumn("_text_hash", F.xxhash64(F.col(f"`{text_col}`")))
    kept = keyed.join(firsts, keyed[id_col].eqNullSafe(F.col("_first")) & (F.col("_text_hash") == F.col("_h")), "left_semi")
    return kept.dropDuplicates([id_col, "_text_hash"]).drop("_text_hash")
