"""Pipeline stage by stage against brute force."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from newsflow.llm import langid  # noqa: E402
from newsflow.llm.common import ready  # noqa: E402

from tests_llm_helpers import line_want, simhash_want, suffix_want  # noqa: E402, I001

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    from pyspark.sql import functions as F

    ready(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before = {r["doc_id"]: r for r in docs.withColumn("_h", F.xxhash64("text")).collect()}
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns
            after = {r["doc_id"]: r for r in rows}
            assert len(after) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "language_id":
            gone = [before[i] for i in before if i not in after]
            model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
            label = langid.Labeller(model)
            for i, r in before.items():
                lang, score = label.predict(*label.label([r["text"] or ""])[0])
                assert (i in after) == (lang != "und" and score >= 0.5)
            assert len(gone) < 0.1 * len(before)
        elif name == "line_dedup":
            assert {i: r["text"] for i, r in after.items()} == line_want(before)
        elif name == "simhash_near_dedup":
            assert set(after) == simhash_want(before)
        elif name == "suffix_array_dedup":
            assert {i: r["text"] for i, r in after.items()} == suffix_want(before)
        else:
            assert {r["doc_id"] for r in rows} == set(before)
        kept[name] = len(rows)
    direct = corpus_pipeline.run(spark, SF)
    assert direct.count() == len(rows)
    assert direct.agg(F.sum("length")).first()[0] == sum(r["length"] for r in rows)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_odd_rows(spark):
    text = "one two three four five six seven and so on to the end of it"
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (None, text, "en", "s", 5), (3, text, None, "s", 5), (3, text, None, "s", 5), (4, "123 ...", "de", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
    left = docs.collect()
    assert {r["doc_id"] for r in left} <= {None, 3} and sum(r["text"] == text for r in left) == 1
