"""Language ID: forward-backward against enumeration, held-out accuracy, odd rows."""

from itertools import product
from zlib import crc32

import numpy as np

from newsflow.llm import langid
from newsflow.llm.common import ready
from newsflow.llm.queries import QUERIES


def enumerated(emission, move, start):
    """(posteriors, expected transitions) over all label paths."""
    n, labels = emission.shape
    post, steps, total = np.zeros((n, labels)), np.zeros((labels, labels)), 0.0
    for path in product(range(labels), repeat=n):
        w = np.exp(start[path[0]] + sum(emission[t, k] for t, k in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        total += w
        for t, k in enumerate(path):
            post[t, k] += w
        for a, b in zip(path, path[1:]):
            steps[a, b] += w
    return post / total, steps / total


def test_forward_backward(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 3)
    rng = np.random.default_rng(1)
    for lengths in ([1], [3], [4, 0, 7], [2, 6, 1, 5], [0, 0, 2]):
        lengths = np.array(lengths)
        emission, move, start = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
        chain = langid.Chain(emission, lengths, move, start)
        want, steps = [], np.zeros((3, 3))
        for part in np.split(emission, np.cumsum(lengths)[:-1]):
            if len(part):
                p, s = enumerated(part, move, start)
                want.append(p)
                steps += s
        assert np.allclose(chain.posteriors(), np.concatenate(want)) and np.allclose(chain.transitions(), steps)


def test_query_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op10_language_id"](spark, folder).collect()
    assert len(rows) == len(docs)
    right = total = 0
    for r in rows:
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if r["held_out"] and any(c.isalpha() for c in docs[r["doc_id"]]["text"] or ""):
            total += 1
            right += r["lang_pred"] == docs[r["doc_id"]]["lang"]
    assert total > 150 and right / total > 0.95


TRAIN = [(i, t, lang, 0.5) for i, (t, lang) in enumerate([("the cat and the dog of it", "en"), ("le chat et la souris du roi", "fr")] * 40)]
SCHEMA = "doc_id long, text string, lang string, score double"


def test_code_switched_words(spark):
    ready(spark)
    model = langid.train(spark.createDataFrame(TRAIN, SCHEMA))
    rows = langid.label_words(spark.createDataFrame([(1, "the dog of it 12 le chat du roi", None, 1.0), (2, "...", "en", 0.0)], SCHEMA), model)
    got = [r["lang"] for r in sorted(rows.collect(), key=lambda r: r["place"])]
    assert got == ["en"] * 4 + ["fr"] * 4


def test_odd_rows(spark):
    ready(spark)
    odd = [(None, "le roi", "fr", 0.1), (900, None, "en", 0.1), (901, "", None, None), (902, "12 !!", "en", None), (903, "the " * 30_000, None, None),
           (903, "the " * 30_000, None, None), (904, "日本", "en", 0.0)]
    rows = langid.identify(spark.createDataFrame(TRAIN + odd, SCHEMA)).collect()
    assert len(rows) == len(TRAIN) + len(odd)
    got = {r["doc_id"]: r for r in rows}
    assert (got[None]["lang_pred"], got[None]["held_out"]) == ("fr", False)
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and got[900]["score"] == 0.0
    assert got[903]["lang_pred"] == "en" and got[903]["score"] > 0.9 and got[904]["lang_pred"] in ("en", "fr")


def test_without_labels(spark):
    ready(spark)
    df = spark.createDataFrame([(1, "some text", None, 1.0)], SCHEMA)
    assert [r["lang_pred"] for r in langid.identify(df).collect()] == ["und"]
    assert langid.identify(df.limit(0)).count() == 0
    one = spark.createDataFrame(TRAIN[::2], SCHEMA)
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(one).collect()} == {("en", 1.0)}
