"""Near-duplicates by b-bit MinHash: bands of minima for candidates, packed low bits for an estimate, full sets for the decision.

A set of word shingles gets MINIMA minima. Bands of the first of them, whole, name the candidates; of each minimum only the low
BITS bits are kept, packed into words. Low bits agree with probability C + (1 - C) J, C = 2 ** -BITS, so the share of agreeing
lanes, counted by bits, estimates the similarity J. Candidates whose estimate is SIGMAS deviations or more below the
threshold are left out; all others that could still join two groups are confirmed on their full sets.

A linked pair shares no band with probability (1 - 0.8 ** 4) ** 32, 5 in 10 ** 8 at the threshold, and less if it is more alike;
the estimate leaves one out with probability 3 in 10 ** 7.

No group is compared pair by pair (`candidates`). Equal sets are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.llm.candidates import Rule, groups, shared_keys
from newsflow.llm.common import batch, texts_of
from newsflow.operators.skew import SALT, TARGET_ROWS, salt_rows, spread_rows
from newsflow.session import stored

SHINGLE_WORDS = 2
PERCENT = 80
BANDS = 32
BAND_ROWS = 4
BITS = 4
MINIMA = 256
LANES = 64 // BITS
SIGMAS = 5.0
# Texts whose sets are wanted are broadcast by name (24 bytes each) up to this count, joined beyond it.
BROADCAST_NODES = 1_000_000
# Hashes taken through all minima in one array step.
STEP_HASHES = 4_096


# ---- sets and signatures

def shingles(text: str, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted different hashes of the word shingles of a text; a text of fewer words is one shingle, one without words none."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    found = set(map(b" ".join, zip(*[words[i:] for i in range(width)]))) or {b" ".join(words)}
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))


@cache
def _factors() -> np.ndarray:
    """Odd factors of the minima, the same in every task."""
    return np.random.default_rng(12).integers(0, 2 ** 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of each set, none of which is empty; short sets go through the array steps together."""
    out = np.full((len(sets), MINIMA), np.iinfo(np.uint64).max, dtype=np.uint64)
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    ends = np.cumsum(lengths)
    low = 0
    while low < len(sets):
        base = ends[low] - lengths[low]
        high = max(low + 1, int(np.searchsorted(ends, base + STEP_HASHES, side="right")))
        flat = np.concatenate(sets[low:high])
        if high > low + 1:
            starts = ends[low:high] - lengths[low:high] - base
            out[low:high] = np.minimum.reduceat(flat[:, None] * _factors(), starts, axis=0)
        else:
            for i in range(0, len(flat), STEP_HASHES):
                np.minimum(out[low], (flat[i:i + STEP_HASHES, None] * _factors()).min(axis=0), out=out[low])
        low = high
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """Signed key of each band; keys of different bands differ."""
    rows = low[:, :BANDS * BAND_ROWS].reshape(len(low), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for r in range(BAND_ROWS):
        key = (key ^ rows[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        key = key ^ key >> np.uint64(29)
    return key.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """Low bits of the minima, LANES of them in each 64-bit word."""
    lanes = (low ^ low >> np.uint64(32)) & np.uint64((1 << BITS) - 1)
    lanes = lanes.reshape(len(low), MINIMA // LANES, LANES) << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(lanes, axis=2)


def different_lanes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of minima whose low bits differ, row by row."""
    x = a ^ b
    step = BITS // 2
    while step:
        x = x | x >> np.uint64(step)
        step //= 2
    ones = np.uint64(sum(1 << (BITS * k) for k in range(LANES)))
    return np.bitwise_count(x & ones).sum(axis=1, dtype=np.int64)


def estimate(different: np.ndarray) -> np.ndarray:
    """Similarity by the number of different lanes, corrected for low bits that agree by chance."""
    chance = 2.0 ** -BITS
    return (1.0 - different / MINIMA - chance) / (1.0 - chance)


def most_different(percent: int = PERCENT) -> int:
    """Different lanes of a pair whose estimate lies SIGMAS deviations below the threshold."""
    chance = 2.0 ** -BITS
    agree = chance + (1 - chance) * percent / 100
    return math.ceil(MINIMA * (1 - agree) + SIGMAS * math.sqrt(MINIMA * agree * (1 - agree)))


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether the intersection of two sets is `percent` or more of their union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _text_keys(text: Column) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, h1, h2, n, digest, keys, sig): names of text and set, size of the set, band keys, packed bits; null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [shingles(t, width) for t in texts_of(b.column("t"))]
            full = np.flatnonzero([len(s) > 0 for s in sets])
            low = minima([sets[i] for i in full])
            digests, keys, sigs = ([None] * len(sets) for _ in range(3))
            for i, k, s in zip(full.tolist(), band_keys(low), packed(low)):
                digests[i], keys[i], sigs[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), k, s.tobytes()
            yield batch(
                doc_id=b.column("doc_id"), h1=b.column("h1"), h2=b.column("h2"), n=pa.array([len(s) for s in sets], pa.int64()),
                digest=pa.array(digests, pa.binary()), keys=pa.array(keys, pa.list_(pa.int64())), sig=pa.array(sigs, pa.binary()))

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *_text_keys(text), text.alias("t"))
    return narrow.mapInArrow(run, f"doc_id {kind}, h1 long, h2 long, n long, digest binary, keys array<long>, sig binary")


def set_table(docs: DataFrame, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """(name, body): sorted shingle hashes of the wanted texts (name, h1, h2), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(name=b.column("name"), body=pa.array([shingles(t, width).tobytes() for t in texts_of(b.column("t"))], pa.binary()))

    text = F.col(f"`{text_col}`")
    found = docs.select(*_text_keys(text), text.alias("t")).join(wanted, ["h1", "h2"])
    return found.groupBy("name").agg(F.first("t").alias("t")).mapInArrow(run, "name long, body binary")


# ---- decision

def sets_of(names: DataFrame, docs: DataFrame, nodes: DataFrame, text_col: str, width: int) -> DataFrame:
    """(name, body): full sets of the names, each made once."""
    wanted = stored(nodes.select("name", "text").join(names, "name", "left_semi").select("name", "text.h1", "text.h2"))
    few = wanted.count() <= BROADCAST_NODES
    return stored(set_table(docs, text_col, width, F.broadcast(wanted) if few else wanted))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of `docs`.

    Words are runs of other bytes than blanks and control blanks, ASCII letters lower-cased; a document's set holds its different
    shingles of `width` words, the whole sequence if it has fewer words. Documents are linked if the intersection of their
    sets is `percent` or more of the union. Null, empty and blank texts have empty sets and are linked with nothing.
    component_id is the smallest id a document reaches, itself included, null if it only reaches null ids; kept says
    that it is the document's own id (null equals null), so all rows of repeated ids of one group are kept. Other
    columns are ignored; an empty table gives an empty result.
    """
    sketched = stored(sketches(docs, id_col, text_col, width))
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id")
    nodes = sketched.where("n > 0").groupBy("digest").agg(
        F.min(first).alias("first"), F.min(F.struct("h1", "h2")).alias("text"), F.count(F.lit(1)).alias("copies"),
        F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    nodes = stored(nodes.withColumn("name", F.monotonically_increasing_id()))
    rule = Rule(BANDS, MINIMA // LANES, different_lanes, most_different(percent), most_different(percent) // 2, percent)
    labels = groups(nodes, *shared_keys(nodes), rule, lambda names: sets_of(names, docs, nodes, text_col, width),
                    lambda x, y: alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
    named = nodes.select("digest", "first", "copies", "name").join(labels, "name", "left").withColumn("comp", F.coalesce("comp", "name"))
    lowest = named.groupBy("comp").agg(F.min("first").alias("lowest"))
    ids = stored(named.join(lowest, "comp").select("digest", "copies", F.col("lowest.doc_id").alias("component_id")))
    hot = ids.where(F.col("copies") > TARGET_ROWS).select("digest", F.ceil(F.col("copies") / TARGET_ROWS).cast("int").alias("_parts"))
    rows = sketched.where("n > 0").select("doc_id", "h1", "n", "digest")
    salted = salt_rows(rows, ["digest"], hot, ["doc_id", "h1"]).join(spread_rows(ids, ["digest"], hot), ["digest", SALT])
    alone = sketched.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = salted.select("doc_id", "n", "component_id").unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
