"""Fuzzy line deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest

from newsflow.llm import candidates, lines
from newsflow.llm.common import ready
from newsflow.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, n_lines string, keep int, k1 int"


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(600):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 30))) for _ in range(2))
        assert lines.edit_distance(a, b) == slow_distance(a, b)
    assert lines.similar("", "") and not lines.similar("", "a") and lines.similar("abcdefghij", "abcdefghix") and not lines.similar("abcdefghi", "abcdefghx")


def expected(docs):
    """{(id, text): (kept text, lines, removed)} by comparing all pairs of lines: a common block, bits, edit similarity."""
    order = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, d[2]))
    places = {}
    for k, (_, text, _) in enumerate(order):
        for at, line in enumerate((text or "").split("\n")):
            if plain := lines.normal(line):
                places.setdefault(plain, (k, at))
    names = list(places)
    prints = lines.line_prints(names)
    keys = lines.block_keys(prints)
    root = list(range(len(names)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(names) - 1):
        apart = lines.print_distance(prints[i + 1:], np.broadcast_to(prints[i], prints[i + 1:].shape))
        shared = ((keys[i + 1:] == keys[i]) & (keys[i] != 0)).any(axis=1)
        for j in (np.flatnonzero(shared & (apart <= lines.MAX_BITS)) + i + 1).tolist():
            if lines.similar(names[i], names[j]):
                root[find(i)] = find(j)
    first = {}
    for i, n in enumerate(names):
        r = find(i)
        first[r] = min(first.get(r, places[n]), places[n])
    keep = set(first.values())
    out = {}
    for k, (doc_id, text, _) in enumerate(order):
        every = [] if text is None else text.split("\n")
        left = [x for at, x in enumerate(every) if not lines.normal(x) or (k, at) in keep]
        out[doc_id, text] = (None if text is None else "\n".join(left), len(every), len(every) - len(left))
    return out


def with_key(spark, docs):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in docs], SCHEMA)
    return df, [tuple(r) for r in df.select("doc_id", "text", F.xxhash64("text")).collect()]


@pytest.mark.parametrize("part", [4, 20_000])
def test_groups_against_brute_force(spark, monkeypatch, part):
    """Also with small parts, where every block and every line is hot."""
    ready(spark)
    for name in ("PART_MEMBERS", "PART_PAIRS", "PART_SETTLED", "TARGET_ROWS"):
        monkeypatch.setattr(candidates, name, min(part, getattr(candidates, name)))
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi") for b in ("rt", "nel", "stom", "k", "")]
    base = [" ".join(rng.choices(words, k=25)) for _ in range(6)]

    def variant(line):
        parts = line.split()
        for _ in range(rng.randint(0, 2)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        return " ".join(parts)

    docs = [(i, "\n".join(rng.choice([variant(rng.choice(base)), " ".join(rng.choices(words, k=4)), "", f"No. {rng.randint(1, 99)}!", "***"]) for _ in range(8)))
            for i in range(40)]
    docs += [(5, None), (None, "BA rt\n\n!!"), (None, ""), (7, docs[7][1]), (900, "w " * 20_000), (-1, docs[3][1].upper())]
    df, keyed = with_key(spark, docs)
    want = expected(keyed)
    rows = lines.dedupe(df).collect()
    assert len(rows) == len(docs) and rows[0].asDict().keys() >= {"doc_id", "text", "keep", "k1", "n_removed"}
    want_rows = sorted(map(str, (want[d, t] for d, t in docs)))
    got_rows = sorted(str((r["text"], r[-2], r[-1])) for r in rows)
    assert got_rows == want_rows
    assert sum(r[-1] for r in rows) > 100


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    from pyspark.sql import functions as F

    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", F.xxhash64("text")).collect()]
    want = expected(docs)
    rows = {r["doc_id"]: r for r in QUERIES["op8_line_dedup"](spark, folder).collect()}
    assert len(rows) == len(docs)
    for doc_id, text, _ in docs:
        kept, n, gone = want[doc_id, text]
        r = rows[doc_id]
        assert (r["n_lines"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_empty(spark):
    ready(spark)
    assert lines.dedupe(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _varied(seed, count, words):
    """Lines of words of a small vocabulary, half of them with a word changed."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("aeioustrn", k=rng.randint(2, 6))) for _ in range(150)]
    out = []
    for _ in range(count // 2):
        line = rng.choices(vocabulary, k=rng.randint(*words))
        out.append(" ".join(line))
        line[rng.randrange(len(line))] = rng.choice(vocabulary)
        out.append(" ".join(line))
    return out


def test_cells_in_parts(spark, monkeypatch):
    """Lines of a cell that is cut into parts, and lines around its border, are linked as without cells."""
    ready(spark)
    monkeypatch.setattr(lines, "CELL_BYTES", 9_000)
    found = _varied(3, 300, (6, 40))
    df, keyed = with_key(spark, [(i, "\n".join(found[i::30])) for i in range(30)])
    assert max(lines.cell_parts(lines._keys(df, "doc_id", "text")).values()) > 2
    want = expected(keyed)
    rows = lines.dedupe(df).collect()
    assert sorted((r["text"], r[-2], r[-1]) for r in rows) == sorted(want.values()) and sum(r[-1] for r in rows) > 50


def test_tables_written(spark):
    """What is written for lines that share blocks by chance stays in proportion to the text."""
    import pathlib

    from newsflow.session import shared_folder

    ready(spark)
    found = _varied(4, 3_000, (20, 40))
    df = spark.createDataFrame([(i, "\n".join(found[i::100])) for i in range(100)], "doc_id long, text string")

    def written():
        return sum(p.stat().st_size for p in pathlib.Path(shared_folder(spark).removeprefix("file:")).rglob("*.parquet"))

    before = written()
    assert sum(r["n_removed"] for r in lines.dedupe(df).collect()) > 1_000
    assert written() - before < sum(map(len, found))


def test_similar_against_distance():
    found = _varied(5, 400, (8, 60))
    for a, b in zip(found, found[1:]):
        most = 10 * max(len(a), len(b)) // 100
        assert lines.similar(a, b) == (lines.edit_distance(a, b) <= most)
    a, b = found[:2]
    for q, counters in ((2, 128), (4, 1024)):
        x, y = lines.gram_counts([a, b], q, counters).astype(int)
        assert 0 < abs(x - y).sum() <= 2 * q * lines.edit_distance(a, b) and x.sum() == len(a) - q + 1
