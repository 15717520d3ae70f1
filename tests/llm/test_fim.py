"""Fill-in-middle against its definition in plain Python."""

import hashlib
import random
import re

import pytest

from newsflow.llm import fim
from newsflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def expected(doc_id, text, fmt=fim.Format()):
    t = text or ""
    units = re.findall(fmt.unit, t)
    digest = hashlib.sha256(f"{fmt.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = fmt.sentinels
    if not t or any(k in t for k in fmt.sentinels) or h[2] % 100 >= 100 - fmt.plain:
        return n, "plain", None, None, t
    if h[3] % 100 < fmt.spm:
        return n, "spm", len(x), len(y), s + z + p + x + m + y
    return n, "psm", len(x), len(y), p + x + s + z + m + y


def odd_texts():
    rng = random.Random(5)
    texts = [None, "", " ", "a", "é", "abc", "<P>", "a<S>b", "x <M", "<", "<<S", "P><P", "$1 \\2 $", "日本語 text\r\n\tend", "😀a😀b", "a\x00b", " x\u0085y",
             "word " * 40_000, "9" * 100_000, "L" * 300_000, "ab" + "é9" * 50_000]
    return texts + ["".join(rng.choice("ab <>PSM$\\\n9é😀") for _ in range(rng.randrange(1, 60))) for _ in range(300)]


def run(spark, rows, fmt=fim.Format(), schema="doc_id long, text string"):
    out = fim.transform(spark.createDataFrame(rows, schema), fmt=fmt)
    return out.withColumn("back", fim.restored(out["output"], out["form"], fmt)).collect()


@pytest.mark.parametrize("fmt", [fim.Format(), fim.Format(unit=r"\w+|\W", prefix="[pre.]", suffix="{s$}", middle="\\m", plain=0, spm=50, seed=9)])
def test_against_definition(spark, fmt):
    texts = odd_texts()
    rows = list(enumerate(texts)) + [(None, "null id here"), (3, "a"), (3, "a")]
    got = run(spark, rows, fmt)
    forms = set()
    for r in got:
        if fmt == fim.Format():
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, r.text, fmt)
        assert r.back == (r.text or "")
        forms.add(r.form)
    assert len(got) == len(rows) and {"psm", "spm"} <= forms


def test_clashing_names_and_empty(spark):
    rows = [(1, "some text of words", 5, "x", "y", "z", 7)]
    schema = "doc_id long, text string, n long, form string, output string, row string, t int"
    r, = run(spark, rows, schema=schema)
    assert (r.n, r.form, r.output) == tuple(expected(1, rows[0][1])[k] for k in (0, 1, 4)) and (r.row, r.t) == ("z", 7)
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sentinels_must_be_safe():
    with pytest.raises(ValueError):
        fim.Format(prefix="<<", suffix="<S>")


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_fill_in_middle"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, a, b, out = expected(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, a, b)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
