"""Streams over a table that is one file, and over one that is a folder of files."""

import pytest

from newsflow.registry import stream_queries, views


@pytest.fixture(params=["file", "folder"])
def sf_dir(request, spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [(i, None if i == 3 else f"of the {i}\nin that line", "en", "s", 20) for i in range(8)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    t = pa.table({n: list(c) for n, c in zip(names, zip(*rows))})
    path = tmp_path / "documents.parquet"
    if request.param == "file":
        pq.write_table(t, path)
    else:
        path.mkdir()
        for i in range(4):
            pq.write_table(t.slice(2 * i, 2), path / f"part-{i}.parquet")
    pq.write_table(t.slice(0, 1), tmp_path / "documents_old.parquet")
    return str(tmp_path)


def test_every_row_of_a_table_is_streamed_once(spark, sf_dir):
    got = stream_queries._drain(stream_queries._streamed(spark, sf_dir, "documents"), spark, "rows")
    assert sorted(got.collect()) == sorted(views.table(spark, sf_dir, "documents").collect())


def test_scored_stream_of_a_table(spark, sf_dir):
    got = stream_queries.stream_score(spark, sf_dir)
    assert sorted(r["id"] for r in got.collect()) == list(range(8))
