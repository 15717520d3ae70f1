"""WARC round trip, splits at every place, damaged and foreign bytes."""

import gzip
import hashlib
import io
import random

import pytest

from newsflow.llm import warc
from newsflow.llm.common import ready
from newsflow.llm.queries import ORACLES, QUERIES
from newsflow.registry.check import compare, duck

SCHEMA = "page_id long, url string, html string, path string, revisit int, _digest string"


def archive(rng, n=40):
    data, places = b"", []
    for i in range(n):
        places.append(len(data))
        body = "".join(rng.choices("ab<>\x1f\x8b\x08é", k=rng.choice([0, 5, 400, 3000])))
        data += warc.page_record(i, f"http://h/{i}", body, i - 1, i % 5 == 4)
    return data, places


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 10 ** 9])
def test_every_record_has_one_owner(split):
    data, places = archive(random.Random(split))
    got = []
    for start in range(0, len(data), split):
        got += [at for at, _, _ in warc.records(io.BytesIO(data), start, min(start + split, len(data)), len(data))]
    assert got == places


def test_magic_inside_a_record_is_no_record():
    # A stored block that holds a whole member, and gzip data that is no WARC.
    inner = warc.MAGIC * 50 + gzip.compress(b"not a record " * 50)
    plain = warc.member([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:page:1>")], inner)
    stored = gzip.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner + b"\r\n\r\n", 0)
    data = plain + stored + b"junk" + warc.MAGIC + b"junk" + plain
    found = [at for start in range(0, len(data), 50) for at, _, _ in warc.records(io.BytesIO(data), start, min(start + 50, len(data)), len(data))]
    assert found == [0, len(plain), len(data) - len(plain)]


def test_members_are_plain_gzip():
    data, _ = archive(random.Random(1), 5)
    text = gzip.decompress(data)
    assert text.count(b"WARC/1.1\r\n") == 5


def test_query(spark):
    ok, message = compare(spark, duck("/root/testdata/sf0.001"), "op4_warc", "/root/testdata/sf0.001", QUERIES["op4_warc"], ORACLES["op4_warc"])
    assert ok, message


def test_odd_rows(spark):
    ready(spark)
    long = "é" * 700
    pages = [(1, "u", long), (9, None, long), (4, "a\r\nb", long), (None, "u", long), (5, "u", None), (6, "u", ""), (7, "u", "x" * 999), (8, "u", "x" * 999),
             (10, "u", "y" * 200_000), (11, "u", "y" * 200_000), (11, "u", "y" * 200_000)]
    df = spark.createDataFrame([(*p, "p", 1, "d") for p in pages], SCHEMA)
    rows = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark, df, 300).collect()), key=str)

    def row(i, text, kind="response", to=None):
        data = (text or "").encode()
        return i, len(data), hashlib.sha1(data).hexdigest(), kind, to

    refers = {1: 9, 4: 9, 10: 11}
    assert rows == sorted((row(i, t, *(("revisit", refers[i]) if i in refers else ())) for i, _, t in pages), key=str)


def test_empty(spark):
    ready(spark)
    assert warc.round_trip(spark, spark.createDataFrame([], SCHEMA)).count() == 0
