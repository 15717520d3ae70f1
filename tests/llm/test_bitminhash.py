"""b-bit MinHash near-duplicates against all pairs, and its estimate against the similarity."""

import random
from collections import defaultdict

import numpy as np
import pytest

from newsflow.llm import bitminhash, candidates
from newsflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingle_set(text, width=2):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x1c", "~").split(" ")
    words = [w for w in words for w in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1)) or frozenset([tuple(words)])


def expected(docs):
    """(doc_id, n, component, kept) per row, by comparing all different sets that share a shingle."""
    sets = [shingle_set(t) for _, t in docs]
    distinct = sorted(set(sets), key=sorted)
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    having = defaultdict(list)
    for k, s in enumerate(distinct):
        for g in s:
            having[g].append(k)
    links = 0
    for k, s in enumerate(distinct):
        shared = defaultdict(int)
        for g in s:
            for j in having[g]:
                if j < k:
                    shared[j] += 1
        for j, both in shared.items():
            if 100 * both >= 80 * (len(s) + len(distinct[j]) - both):
                links += 1
                root[find(s)] = find(distinct[j])
    lowest = {}
    for (i, _), s in zip(docs, sets):
        if s:
            r = find(s)
            lowest[r] = i if lowest.get(r) is None else lowest[r] if i is None else min(lowest[r], i)
    out = []
    for (i, _), s in zip(docs, sets):
        c = lowest[find(s)] if s else i
        out.append((i, len(s), c, i == c))
    return out, links


def got(df):
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in bitminhash.near_duplicates(df).collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def edited_docs(seed=3, bases=30, copies=12):
    """Near copies by few and by many edits, so that many pairs lie around the threshold; chains; copies; odd texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for b in range(bases):
        base = rng.choices(words, k=rng.randint(3, 250))
        texts.append(" ".join(base))
        for _ in range(copies):
            copy = list(base)
            for _ in range(max(1, int(len(base) * rng.choice([0.01, 0.04, 0.055, 0.06, 0.1])))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
            if b % 5 == 0:
                base = copy  # a chain: each copy of the one before
    texts += texts[:40] + [t.upper() for t in texts[40:60]]
    texts += ["", " \t", "one", "One", "one\x0bone", "one one", "a b c d e", "a b c d e f", "a b c d e f g", "é È", "É È", "x y", "x\x1cy z"]
    rng.shuffle(texts)
    return list(enumerate([*texts, None, None]))


@pytest.mark.parametrize("part", [20_000, 4])
def test_against_all_pairs(spark, monkeypatch, part):
    """Also with small parts, where every band value and every node is hot."""
    for name in ("PART_MEMBERS", "PART_PAIRS", "PART_SETTLED", "TARGET_ROWS"):
        monkeypatch.setattr(candidates, name, min(part, getattr(candidates, name)))
    docs = edited_docs()
    want, links = expected(docs)
    assert links > 300 and sum(not r[3] for r in want) > 100
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert order(got(df)) == order(want)


def test_null_and_repeated_ids(spark):
    docs = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "z y"), (7, None), (7, ""), (None, None), (9, "q r s t")]
    want, _ = expected(docs)
    want = [(i, n, c, i == c) for i, n, c, _ in want]
    rows = [(i, t, 1, "k", b"s") for i, t in docs]
    assert order(got(spark.createDataFrame(rows, "doc_id long, text string, n int, name string, sig binary"))) == order(want)
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


def test_long_text(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(200_000))
    docs = [(1, long), (2, long + " and more"), (3, "x" * 1_000_000)]
    assert order(got(spark.createDataFrame(docs, "doc_id long, text string"))) == order(expected(docs)[0])


def pairs_of(similarity, count, rng):
    for _ in range(count):
        a = rng.integers(0, 2 ** 63, 400, dtype=np.uint64)
        # j = s / (800 - s)
        shared = round(800 * similarity / (1 + similarity))
        b = np.r_[a[:shared], rng.integers(0, 2 ** 63, 400 - shared, dtype=np.uint64)]
        yield np.sort(a), np.sort(b)


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.8, 0.95])
def test_estimate(similarity):
    """The corrected estimate is right on average, with the spread its bound is built on."""
    pairs = list(pairs_of(similarity, 300, np.random.default_rng(4)))
    a, b = (bitminhash.packed(bitminhash.minima([p[k] for p in pairs])) for k in (0, 1))
    found = bitminhash.estimate(bitminhash.different_lanes(a, b))
    agree = 1 / 16 + 15 / 16 * similarity
    spread = (agree * (1 - agree) / bitminhash.MINIMA) ** 0.5 * 16 / 15
    assert abs(found.mean() - similarity) < 4 * spread / 300 ** 0.5 + 0.003
    assert 0.8 * spread < found.std() < 1.25 * spread


def test_candidates_at_the_threshold():
    """Pairs right at the threshold share a band and pass the estimate."""
    pairs = list(pairs_of(0.8, 2000, np.random.default_rng(6)))
    a, b = (bitminhash.minima([p[k] for p in pairs]) for k in (0, 1))
    met = (bitminhash.band_keys(a) == bitminhash.band_keys(b)).any(axis=1)
    apart = bitminhash.different_lanes(bitminhash.packed(a), bitminhash.packed(b))
    assert met.all() and (apart <= bitminhash.most_different()).all()


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [tuple(r) for r in QUERIES["op12_minhash_near_dedup"](spark, SF).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert order(rows) == order(expected(docs)[0])
