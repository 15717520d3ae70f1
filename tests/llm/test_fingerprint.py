"""Multiset fingerprints: algebra, likeness, and the query against brute force."""

import hashlib
import random

import numpy as np

from newsflow.llm import fingerprint as fp
from newsflow.llm.common import ready
from newsflow.llm.queries import QUERIES


def test_order_does_not_matter_and_updates_do():
    parts = ["one two three four", "", "five", "six seven"]
    whole = fp.document_vector("\n".join(parts))
    random.Random(1).shuffle(parts)
    assert np.array_equal(whole, fp.document_vector("\n".join(parts)))
    assert np.array_equal(fp.remove(fp.insert(whole, "new", "new"), "new", "new"), whole)
    assert np.array_equal(fp.remove(whole, "five"), fp.vector([p for p in parts if p != "five"]))
    assert not np.array_equal(whole, fp.insert(whole, "five"))
    assert np.array_equal(fp.from_text(fp.text_form(whole)), whole)
    assert not fp.document_vector("").any() and fp.document_vector("\n").any()


def test_likeness_follows_shared_words():
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    whole = fp.document_vector(" ".join(words))
    for share in (0.9, 0.5, 0.1):
        cut = int(4000 * share)
        other = fp.document_vector(" ".join(words[:cut] + [f"v{rng.randrange(5000)}" for _ in range(4000 - cut)]))
        assert abs(fp.likeness(whole, other) - share) < 0.15
    assert fp.likeness(whole, whole) == 1.0 and fp.likeness(fp.document_vector(""), fp.document_vector("")) == 1.0
    assert fp.likeness(whole, fp.document_vector("")) < 0.3


def expected(docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode()))
    out = []
    for i, (doc_id, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = map(fp.document_vector, (text, edited, after))
        out.append((str(doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.text_form(a), fp.text_form(b),
                    fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out)


def rows_of(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert rows_of(QUERIES["op7_document_fingerprints"](spark, folder)) == expected(docs)


def test_odd_rows(spark):
    ready(spark)
    docs = [(5, None), (5, None), (5, "b\n\nb"), (-3, ""), (None, "lost one"), (None, None), (2 ** 62, "end 🙂🙂🙂 x"), (7, "p" * 9000), (8, "z q")]
    schema = "doc_id long, text string, chunk int, to string, guest string"
    for some in (docs, docs[:1], docs[4:5], docs[-1:], docs[2:4]):
        df = spark.createDataFrame([(*d, 1, "t", "g") for d in some], schema)
        assert rows_of(fp.compared_with_next(df)) == expected(some)
    assert fp.compared_with_next(spark.createDataFrame([], schema)).count() == 0
    got = {r[0]: r[1] for r in fp.fingerprints(spark.createDataFrame([(*d, 1, "t", "g") for d in docs[7:]], schema)).collect()}
    assert got[8] == fp.text_form(fp.document_vector("z q"))
