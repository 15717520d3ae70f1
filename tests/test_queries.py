"""Every registered query against its SQL, and the shape of its plan."""

import os
import re

import pytest

from newsflow.registry import check, load
from newsflow.registry.check import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()
MODELS = set(check.MODELS)
# The only queries that leave the JVM: the scorer job, by design, and the parser of pages.
PYTHON = {"q_scorer_job", "q_page_links", "q_news_rows", "q_ingest_job", "q_stored_table", "q_has_news", "q_coverage_summary", "q_coverage_letters",
          "q_coverage_sample"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_only_models_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {"q_text_model"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, SF, QUERIES[name], ORACLES.get(name))
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODELS))
def test_plan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name not in PYTHON:
        assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas", plan)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_a_key_are_cut_before_the_shuffle(spark):
    assert plan_of(QUERIES["q_news_dedupe"](spark, SF)).count("WindowGroupLimit") >= 2


def test_scan_pushes_filters_and_prunes_columns(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = plan_of(QUERIES["q_scan"](spark, SF))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):plan.index("ReadSchema")]
    assert "EqualTo(ticker,3)" in pushed and "IsNotNull(pct_change_eod)" in pushed
    read = plan[plan.index("ReadSchema"):]
    assert "headline" in read and "text" not in read and "sentiment_combined" not in read


def test_price_updates_do_not_move_texts(spark):
    assert "n_chars" not in plan_of(QUERIES["q_price_updates"](spark, SF))


def test_large_inputs_are_not_repartitioned(spark, monkeypatch):
    from newsflow.operators import stage

    df = spark.range(10)
    assert "Repartition" in plan_of(stage.spread(df)) or "Exchange" in plan_of(stage.spread(df))
    monkeypatch.setattr(stage, "SMALL_PER_CORE", 1)
    assert "Exchange" not in plan_of(stage.spread(df))
