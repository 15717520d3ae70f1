"""Packing: every piece once, no overlap, few rows; tokens against the library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newsflow.llm import packing
from newsflow.llm.common import ready
from newsflow.llm.queries import QUERIES


def check_rows(rows, size):
    """Rows are gapless from 0 and not too long."""
    rows_of = defaultdict(list)
    for r in rows:
        rows_of[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in rows_of.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= size
    return len(rows_of)


def first_fit_rows(lengths, size):
    bins = []
    for x in sorted(lengths, reverse=True):
        for i, left in enumerate(bins):
            if left >= x:
                bins[i] -= x
                break
        else:
            bins.append(size - x)
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_the_histogram(seed):
    rng = random.Random(seed)
    size = rng.choice([16, 128, 2048])
    histogram = {rng.randint(1, size): rng.choice([1, 3, 50, 4000]) for _ in range(rng.randint(1, 400))}
    plan = packing.make_plan(histogram, size)
    got = Counter()
    for pattern, n in plan.rows:
        assert sum(pattern) <= size and n > 0
        for x in pattern:
            got[x] += n
    assert got == histogram
    rows, total = sum(n for _, n in plan.rows), sum(x * n for x, n in histogram.items())
    if sum(histogram.values()) < 3000:
        assert rows <= 1.02 * first_fit_rows([x for x, n in histogram.items() for _ in range(n)], size) + 1
    assert rows >= -(-total // size)


def test_empty_plan():
    assert packing.make_plan({}, 8).rows == []


def test_fit_finds_exact_repeats():
    counts = np.zeros(9)
    counts[[8, 5, 3]] = [4, 7, 7]
    rows = packing.patterns(np.array([8, 5, 3]), 8, 2)
    assert sorted(map(tuple, rows)) == [(5, 3, 0), (8, 0, 0)]
    assert np.allclose(packing.fit(rows, counts), [7, 4])


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op9_best_fit_packing"](spark, folder).collect()
    total = 0
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == set(docs)
    for doc_id, text in docs.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for k, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r["piece"])):
            part = ids[2048 * k:2048 * (k + 1)]
            assert (r["piece"], r["start"], r["length"]) == (k, 2048 * k, len(part))
            assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        assert k == (len(ids) - 1) // 2048
    assert check_rows(rows, 2048) <= -(-total // 2048) + 1


def test_odd_rows(spark):
    ready(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = [(1, None, 5), (1, None, 5), (None, "", 5), (2, "one two three " * 2000, 6), (3, "x", 1), (3, "x", 1)]
    out = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, length int"), path, size=256).collect()
    assert Counter(r["doc_id"] for r in out) == {1: 2, None: 1, 3: 2, 2: -(-6001 // 256)}
    check_rows(out, 256)
    empty = packing.pack(spark.createDataFrame([], "doc_id long, text string"), path)
    assert empty.count() == 0 and empty.columns[-2:] == ["sequence_id", "offset"]


def test_ids_are_kept(spark):
    ready(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pieces(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), path, with_ids=True).collect()
    want = Tokenizer.from_file(path).encode("one two", add_special_tokens=False).ids
    assert rows[0]["ids"] == [*want, 0]
