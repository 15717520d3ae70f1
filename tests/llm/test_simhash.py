"""SimHash near-duplicates against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from newsflow.llm import simhash
from newsflow.llm.common import ready

SCHEMA = "doc_id long, text string, fp string, a int, root string"


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, threshold=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= threshold:
            root[find(i)] = find(j)
    lowest = {}
    for i, d in enumerate(ids):
        r = find(i)
        lowest[r] = min((x for x in (lowest.get(r), d) if x is not None), default=None)
    return sorted((str(d), f"{fps[i]:016x}", str(lowest[find(i)])) for i, d in enumerate(ids))


def rows_of(df):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in df.collect())


def test_fingerprint():
    for text in ["", None, "  \n", "One", "Ä B", "a b c", "A b c a b c a b c\td e", "x " * 5000, "ß" * 3]:
        assert simhash.fingerprint(text or "") == slow_fingerprint(text)


def test_anchors_meet_at_home():
    rng = random.Random(1)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randint(0, 2)):
            y ^= 1 << bit
        pair = np.array([x, y], dtype=np.uint64).astype(np.int64)
        row, anchor, home = simhash.anchors_of(pair, 2)
        home_of_x = anchor[(row == 0) & home]
        assert len(home_of_x) == 1 and home_of_x[0] in anchor[row == 1]
        assert len(set(anchor[row == 1].tolist())) == (row == 1).sum()


@pytest.mark.parametrize("per_part", [2, 32_768])
def test_links_against_all_pairs(spark, per_part):
    ready(spark)
    rng = random.Random(2)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for bit in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << bit
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from newsflow.llm.components import components

    got = {r["node"]: r["root"] for r in components(simhash.fingerprint_links(df, 2, per_part), "a", "b").collect()}
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(fps, 2):
            if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 2 and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert {f: got.get(f, f) for f in fps} == label


def test_query_against_brute_force(spark):
    ready(spark)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(9001, None), (9002, ""), (9003, " \n "), (9003, " \n "), (None, docs[0][1]), (9004, docs[0][1] + " end"), (None, "alone one")]
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in docs], SCHEMA)
    want = slow_components([d for d, _ in docs], [slow_fingerprint(t) for _, t in docs])
    assert rows_of(simhash.near_duplicates(df)) == want


def test_empty(spark):
    ready(spark)
    out = simhash.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["doc_id", "fingerprint", "component_id"]
    assert dict(out.dtypes)["doc_id"] == "bigint"


def test_blank_is_component_of_zero(spark):
    ready(spark)
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert {(r[1], r[2]) for r in simhash.near_duplicates(df).collect()} == {("0" * 16, 0)}
