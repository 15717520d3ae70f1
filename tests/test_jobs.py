import datetime as dt
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from newsflow import schema
from newsflow.functions import temporal
from newsflow.functions.urls import price_ticker, url_join
from newsflow.operators import evaluate, prepare
from newsflow.operators.keys import insert_ignore, keyed_update
from newsflow.plans import coverage, enrich, ingest, report, train
from newsflow.plans.scoring import score_articles
from newsflow.session import scratch_path
from newsflow.sources import sinks, tables
from newsflow.streaming import jobs

UTC = dt.timezone.utc


def utc(*parts):
    return dt.datetime(*parts, tzinfo=UTC)


def lit_ts(text):
    return F.lit(text).cast("timestamp")


def shown(df, col):
    return [r[0] for r in df.select(F.date_format(col, "yyyy-MM-dd HH:mm")).collect()]


# --- times ----------------------------------------------------------------------------------------------------

TIMES = [  # as_of (UTC), cell, UTC time
    ("2024-12-15 17:00:00", "Today 10:30AM", "2024-12-15 15:30"),
    ("2024-12-15 17:00:00", "Yesterday 10:30AM", "2024-12-14 15:30"),
    ("2024-12-15 17:00:00", "May-12-24 05:45PM", "2024-05-12 21:45"),
    ("2024-12-15 17:00:00", "Dec 11 04:50PM", "2024-12-11 21:50"),
    ("2024-03-01 17:00:00", "Dec 11 04:50PM", "2023-12-11 21:50"),
    ("2024-12-15 17:00:00", "04:50PM", None), ("2024-12-15 17:00:00", "", None), ("2024-12-15 17:00:00", "n/a", None),
    ("2024-12-15 17:00:00", None, None), ("2024-12-15 17:00:00", "Foo-12-24 05:45PM", None),
    ("2024-12-15 17:00:00", "today 9:05am", "2024-12-15 14:05"),
]


def test_news_time(spark):
    df = spark.createDataFrame([(i, a, c) for i, (a, c, _) in enumerate(TIMES)], "i int, a string, c string").coalesce(1)
    got = df.orderBy("i").select(F.date_format(temporal.news_time(F.col("c"), F.col("a").cast("timestamp")), "yyyy-MM-dd HH:mm"))
    assert [r[0] for r in got.collect()] == [w for _, _, w in TIMES]


def test_target_days(spark):
    rows = [("2024-01-05 15:59:00", "2024-01-05", "2024-01-05"), ("2024-01-05 16:00:00", "2024-01-06", "2024-01-12"),
            ("2024-01-06 12:00:00", "2024-01-06", "2024-01-12"), ("2024-01-07 10:00:00", "2024-01-07", "2024-01-12")]
    df = spark.createDataFrame(rows, "t string, a string, b string").withColumn("t", F.col("t").cast("timestamp"))
    for r in df.select("a", "b", temporal.eod_date(F.col("t")).alias("x"), temporal.eow_date(F.col("t")).alias("y")).collect():
        assert (str(r["x"]), str(r["y"])) == (r["a"], r["b"])
    zone = spark.range(1).select(temporal.market_date(lit_ts("2024-01-06 03:00:00")), temporal.day_of_week(lit_ts("2024-01-08 03:00:00")))
    assert tuple(zone.first()) == (dt.date(2024, 1, 5), 0)


def test_urls(spark):
    links = ["/a?b", "//c.d/e", "http://x/y", "rel/z", "", "mailto:q"]
    df = spark.createDataFrame([(x,) for x in links], "u string")
    got = [r[0] for r in df.select(url_join(F.col("u"), "https://h.org/")).collect()]
    assert got == ["https://h.org/a?b", "https://c.d/e", "http://x/y", "https://h.org/rel/z", "https://h.org/", "mailto:q"]
    assert spark.range(1).select(price_ticker(F.lit("BRK.B"))).first()[0] == "BRK-B"


# --- ingest ---------------------------------------------------------------------------------------------------

CELLS = [("Dec-14-24 09:00AM", "a"), ("08:00AM", "b"), ("Dec-13-24 07:00PM", "c"), ("06:00PM", "d"), ("n/a", "e"),
         ("Oct-01-24 01:00PM", "f"), ("Dec-12-24 01:00PM", "g")]


def page(rows):
    body = "".join(f'<TR class=x><td align=right>{c}</td><td><a href="/{u}" class=y>Head &amp; {u}</a></td></TR>' for c, u in rows)
    return f'<table><tr><td>1</td><td><a href="/no">no</a></td></tr></table><table class="z" id="news-table">{body}<tr><td>one</td></tr></table>'


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "AAA", page(CELLS)), (2, "BBB", page([("Dec-14-24 10:00AM", "a"), ("09:00AM", "h")])), (3, "CCC", "<p>no table</p>"), (4, "DDD", None)]
    return spark.createDataFrame(rows, "page_id long, ticker string, html string")


def test_ingest_twice_is_once(spark, pages):
    as_of = lit_ts("2024-12-15 17:00:00")
    stored = schema.pad_articles(spark.createDataFrame([("https://finviz.com/c", "old")], "url string, headline string"))
    new = ingest.new_articles(pages, stored, as_of)
    got = {r["url"][-1]: (r["ticker"], r["t"], r["headline"]) for r in
           new.select("url", "ticker", "headline", F.date_format("datetime", "yyyy-MM-dd HH:mm").alias("t")).collect()}
    assert got == {
        "a": ("AAA", "2024-12-14 14:00", "Head & a"), "b": ("AAA", "2024-12-14 13:00", "Head & b"),
        "d": ("AAA", "2024-12-13 23:00", "Head & d"), "h": ("BBB", "2024-12-14 14:00", "Head & h"),
    }
    once = ingest.ingest(pages, stored, as_of)
    assert ingest.new_articles(pages, once, as_of).count() == 0
    assert once.schema.names == list(schema.ARTICLES)


def test_append_counts_written_rows(spark, pages):
    path = scratch_path(spark, "t")
    found = ingest.parse_pages(pages, lit_ts("2024-12-15 17:00:00"))
    none = schema.pad_articles(spark.createDataFrame([], "url string"))
    assert sinks.append_articles(none, found, path, ["page_id", "pos"]) == 5
    assert sinks.append_articles(tables.read_articles(spark, path), found, path, ["page_id", "pos"]) == 0
    assert tables.read_articles(spark, path).select("id").distinct().count() == 5


def test_insert_ignore_order(spark):
    new = spark.createDataFrame([("u", 2, "x"), ("u", 1, "z"), ("u", 1, "y"), ("v", 0, "w"), ("k", 0, "q")], "url string, seen int, ticker string")
    old = spark.createDataFrame([("k",)], "url string")
    got = sorted(tuple(r) for r in insert_ignore(old, new, "url", ["seen", "ticker"]).collect())
    assert got == [("u", 1, "y"), ("v", 0, "w")]


def test_keyed_update(spark):
    table = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, x string, y double")
    up = spark.createDataFrame([(1, None, 9.0, 0), (1, "late", 8.0, 1), (7, "z", 7.0, 0)], "id long, x string, y double, n int")
    got = sorted(tuple(r) for r in keyed_update(table, up, ["x", "y"], order=["n"]).collect())
    assert got == [(1, None, 9.0), (2, "b", 2.0)]


# --- enrichment -----------------------------------------------------------------------------------------------

def test_prices_context_and_outcomes(spark):
    days = [dt.date(2023, 12, 1) + dt.timedelta(days=i) for i in range(39)]
    bars = spark.createDataFrame(
        [("BRK-B", d, 1.0, 2.0, 0.5, float(i + 1), 10) for i, d in enumerate(days) if d.weekday() < 5],
        "ticker string, date date, open double, high double, low double, close double, volume long")
    art = [(1, "BRK.B", utc(2024, 1, 6, 3)), (2, "BRK.B", utc(2023, 11, 30, 12)), (3, "", utc(2024, 1, 5, 12)), (4, "BRK.B", utc(2024, 1, 11, 3)), (5, "BRK.B", None)]
    df = spark.createDataFrame(art, "id long, ticker string, datetime timestamp")
    daily = enrich.daily_indicators(bars, "2024-01-09")
    got = {r["id"]: r for r in enrich.enrich_prices(df, daily).collect()}
    assert got[1]["price_close"] == 36.0 and got[1]["volume"] == 10 and got[1]["std_upper"] is not None
    assert got[2]["price_close"] is None and got[3]["price_close"] is None and got[5]["price_close"] is None
    assert got[4]["price_close"] == 39.0  # Eastern day is the last filled one

    vix = spark.createDataFrame([(dt.date(2024, 1, 8), 20.0), (dt.date(2024, 1, 10), 22.0)], "date date, close double")
    spy = spark.createDataFrame([(dt.date(2024, 1, 8), 100.0), (dt.date(2024, 1, 9), 110.0)], "date date, close double")
    art = [(1, utc(2024, 1, 3, 1)), (2, utc(2024, 1, 2, 1)), (3, utc(2024, 1, 9, 23)), (4, utc(2024, 1, 11, 1)), (5, utc(2024, 1, 12, 1))]
    df = spark.createDataFrame(art, "id long, datetime timestamp")
    got = {r["id"]: (r["vix_close"], r["spy_daily_return"]) for r in enrich.add_context(df, vix, spy, "2024-01-10").collect()}
    assert got == {1: (20.0, 0.0), 2: (None, None), 3: (20.0, pytest.approx(0.1)), 4: (22.0, pytest.approx(0.1)), 5: (None, None)}

    ticks = spark.createDataFrame([(utc(2024, 1, 8, 10, 0), 50.0), (utc(2024, 1, 8, 10, 2), 60.0), (utc(2024, 1, 8, 11, 0), 75.0)], "ts timestamp, close double")
    art = [(1, utc(2024, 1, 8, 10, 1)), (2, utc(2024, 1, 8, 17, 0)), (3, utc(2024, 1, 7, 9, 0)), (4, utc(2024, 1, 20, 9, 0))]
    df = spark.createDataFrame(art, "id long, datetime timestamp")
    out = enrich.add_outcomes(df, spy, "2024-01-10", ticks)
    got = {r["id"]: (r["pct_change_1h"], r["pct_change_4h"], r["pct_change_eod"], r["pct_change_eow"]) for r in out.collect()}
    assert got[1] == (pytest.approx(25.0), None, pytest.approx(100 * 40 / 60), None)
    assert got[2] == (None, None, pytest.approx(10.0), None)
    assert got[3] == (None, None, None, None) and got[4] == (None, None, None, None)


def test_temporal_keeps_known(spark):
    df = spark.createDataFrame([(1, utc(2024, 1, 8, 6), None), (2, utc(2024, 1, 8, 6), 0.3), (3, None, None)], "id int, datetime timestamp, hour_sin double")
    got = {r["id"]: (r["hour_sin"], r["day_of_week"]) for r in enrich.add_temporal(df).collect()}
    assert got == {1: (pytest.approx(1.0), 0), 2: (0.3, None), 3: (None, None)}


# --- scoring, reports, schema ---------------------------------------------------------------------------------

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Broken:
    def model(self, text):
        if "bad" in text:
            raise ValueError(text)
        return 0.5

    def vader(self, text):
        return None


def test_scoring_job(spark):
    rows = [(1, "Profit", None, None), (2, None, "profit", None), (3, " ", "", None), (4, "bad loss", "x", None), (5, "profit", "", 0.7)]
    df = spark.createDataFrame(rows, "id int, headline string, text string, sentiment_combined double").withColumn(
        "sentiment_category", F.when(F.col("id") == 5, "Noise"))
    got = {r["id"]: r for r in score_articles(df, [("profit", 1.4), ("loss", -1.3)], Broken).collect()}
    assert got[1]["sentiment_keyword"] == 1.4 and got[1]["sentiment_ml"] == 0.5 and got[1]["sentiment_vader"] == 0
    assert got[2]["sentiment_combined"] is None and got[3]["sentiment_category"] is None
    assert got[4]["sentiment_ml"] == 0 and got[4]["sentiment_keyword"] == -1.3
    assert got[5]["sentiment_combined"] == 0.7 and got[5]["sentiment_keyword"] is None
    again = score_articles(score_articles(df, [("profit", 1.4)]), [("profit", 9.9)]).where("id = 1").first()
    assert again["sentiment_keyword"] == 1.4


def test_empty_reports(spark):
    empty = schema.pad_articles(spark.createDataFrame([], "id long"))
    row = report.status(empty).first()
    assert row["total"] == 0 and row["pct_price"] == 0
    assert report.tiles(empty).first().asDict() == {"articles": 0, "signals": 0, "avg_sentiment": 0.0, "latest_vix": 0.0}
    assert report.export_stats(empty).first()["pct_complete"] == 0
    assert report.sentiment_histogram(empty).count() == 20


def test_schema_tools(spark):
    df = spark.createDataFrame([(1, "t", 0.5)], "id long, ticker string, sentiment_combined double")
    assert schema.reset_derived(df).first().asDict() == {"id": 1, "ticker": "t", "sentiment_combined": None}
    assert set(schema.HEALED) <= set(schema.ensure_columns(df).columns)
    with pytest.raises(ValueError):
        schema.require_features(df, schema.CLASSIFIER_FEATURES)
    assert schema.target_column("weekly") == "pct_change_eod" and schema.target_column("1HR") == "pct_change_1h"
    schema.create_articles_table(spark, "articles_t")
    assert spark.table("articles_t").columns == [*schema.ARTICLES, "dt"]
    assert tables.empty_bars(spark).count() == 0
    with pytest.raises(ValueError):
        sinks.export_filter("everything")


def test_lexicon_files(spark, tmp_path):
    path = tmp_path / "lex.csv"
    path.write_text('keyword,sentiment,strength\n Up ,Positive,1.5\r\nflat,neutral,2\ndown,negative,\nup,negative,1.1\n"a, b",positive,2\n')
    got = {r["keyword"]: r["weight"] for r in tables.read_lexicon(spark, str(path)).collect()}
    assert got == {"up": -1.1, "down": -1.0, "a, b": 2.0}
    assert tables.lexicon_from_block(spark).count() == 8


def test_coverage(spark, tmp_path):
    as_of = lit_ts("2024-06-30 00:00:00")
    (tmp_path / "no.json").write_text('{"A": "2024-06-01T00:00:00", "B": "2024-05-31T00:00:00.5", "C": "soon"}')
    without = tables.read_json_map(spark, str(tmp_path / "no.json"))
    have = tables.read_json_list(spark, str(tmp_path / "missing.json"), ["D"])
    done = {r["ticker"] for r in coverage.processed(have, without, as_of, 30).collect()}
    assert done == {"A", "D"}  # 29 days old is kept; 30 days old and an unreadable time are not
    assert coverage.processed(have, without, as_of).count() == 4
    universe = tables.universe(spark.createDataFrame([("b",), ("d",), ("e",), ("f",), (None,)], "Ticker string"))
    two = "<table class='fullview-news-outer'><tr><td><a href='x'>1</a></td></tr><tr><td>2</td></tr></table>"
    pages = spark.createDataFrame([("B", two), ("E", None), ("F", "nothing")], "ticker string, html string")
    out = {r["ticker"]: (r["has_news"], r["reason"]) for r in coverage.coverage_job(universe, have, without, pages, as_of, 30).collect()}
    assert out == {"A": (False, "cached"), "B": (True, "news_table_2_rows"), "C": (False, "cached"), "D": (True, "cached"), "F": (False, "no_news_found")}


def test_news_blocks(spark):
    """Blocks as the parser sees them: nested tables, early end tags, one row, no link, any quoting."""
    link = "<td><a href=x>x</a></td>"
    pages = [
        ("nested", f"<table class='a fullview-news-outer b'><tr><td><table><tr>{link}</tr></table></td></tr><tr>{link}</tr><tr></tr></table>", "news_table_4_rows"),
        ("early", f"<div id=\"news-table\"><div>head</div><table><tr>{link}</tr><tr></tr></table></div>", "news_table_2_rows"),
        ("upper", f"<TABLE CLASS=topnews><TR>{link}</TR><TR></TR></TABLE>", "news_table_2_rows"),
        ("second", f"<table class=fullview-news-outer><tr>{link}</tr></table><div class='x news-table-box'><p><tr>{link}</tr><tr></tr></div>", "news_table_2_rows"),
        ("one", f"<table class=my-news><tr>{link}</tr></table>", "no_news_found"),
        ("unlinked", "<table class=my-news><tr></tr><tr></tr></table>", "no_news_found"),
        ("other", f"<table class=fullview-news-outerx id=x><tr>{link}</tr></table> today", "news_pattern_fullview-news"),
        ("empty", "", "no_news_found"),
    ]
    df = spark.createDataFrame([(k, h) for k, h, _ in pages] + [("null", None)], "k string, html string")
    got = {r.k: r.c for r in df.select("k", coverage.news_check(F.col("html")).alias("c")).collect()}
    assert {k: got[k].reason for k, _, _ in pages} == {k: want for k, _, want in pages} and got["null"] is None


# --- models ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        s, r = rng.uniform(-1, 1), rng.uniform(0, 100)
        move = 3 * s + rng.gauss(0, 0.3)
        rows.append((i, rng.choice("AB"), utc(2024, 1, 1) + dt.timedelta(hours=7 * i), f"h{i}", s, rng.random(), rng.random(), r if i % 3 else None,
                     rng.gauss(0, 1), None, move if i % 10 else None))
    return spark.createDataFrame(rows, "id long, ticker string, datetime timestamp, headline string, sentiment_combined double, sentiment_ml double, "
                                       "sentiment_keyword double, rsi_14 double, macd double, keyword_density double, pct_change_eod double")


def short(rng):
    return {**train.draw_trial(rng), "maxIter": 5, "leaves": 8}


def test_classifier_regressor_and_reload(spark, history):
    trained = train.train_classifier(history, trials=1, draw=short)
    assert "keyword_density" not in trained.package.prep.features and trained.best_f1 > 0.7
    path = scratch_path(spark, "pkg")
    trained.package.save(spark, path)
    loaded = train.ModelPackage.load(spark, path)
    one = {r["id"]: r["ml_confidence"] for r in train.backfill(history, trained.package).collect()}
    two = {r["id"]: r["ml_confidence"] for r in train.backfill(history, loaded).collect()}
    assert len(one) == 400 and one == pytest.approx(two)
    reg = train.train_regressor(history, loaded, estimator=train.forest(trees=5, leaf=5))
    assert {r["part"] for r in reg.metrics.collect()} == {"train", "test"}
    check = train.prediction_check(reg)
    assert check.count() == 100 and check.columns[-1] == "prediction_error"
    assert reg.importance.first()["feature"] == "sentiment_combined"
    with pytest.raises(ValueError, match="missing"):
        train.backfill(history.drop("macd"), loaded)
    with pytest.raises(ValueError, match="needed"):
        train.train_classifier(history.limit(50), trials=1)


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0), (2.0, 5.0, 0), (3.0, 5.0, 0), (10.0, 5.0, 0), (None, 5.0, 0)], "x double, k double, label int").withColumn("e", F.lit(None).cast("double"))
    prep = prepare.fit_imputer(df, ["x", "k", "e"])
    assert prep.medians == {"x": 2.5, "k": 5.0}
    scaled = prepare.fit_scaler(df.where("x is not null"), prep)
    assert scaled.deviations["x"] == pytest.approx(3.535534) and scaled.deviations["k"] == 0
    assert df.select(scaled.scaled("k")).first()[0] == 0
    assert {r["f_score"] for r in prepare.anova_scores(df, ["x", "k"], "label").collect()} == {0.0}


def test_perfect_and_empty_reports(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 1)], "label int, prediction int")
    got = {r["row"]: r["f1"] for r in evaluate.classification_report(df).collect()}
    assert set(got.values()) == {1.0}


# --- streaming ------------------------------------------------------------------------------------------------

def test_stream_dedupe_equals_batch(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(f"u{i % 7}", utc(2024, 1, 1 + i), f"h{i}") for i in range(20)]
    spark.createDataFrame(rows, "url string, datetime timestamp, headline string").repartition(4).write.parquet(src)
    stream = jobs.read_stream(spark, src, spark.read.parquet(src).schema)
    jobs.run_ingest(stream, path, str(tmp_path / "cp")).awaitTermination()
    jobs.run_ingest(stream, path, str(tmp_path / "cp2")).awaitTermination()
    out = spark.read.parquet(path)
    assert out.count() == 7 and out.select("url").distinct().count() == 7


def test_text_model_is_usable_after_an_append(spark, tmp_path):
    from newsflow.plans.scoring import with_classifier_score
    from newsflow.plans.train import train_text_classifier
    from newsflow.sources.sinks import append_articles

    path = str(tmp_path / "articles")
    stored = schema.pad_articles(spark.createDataFrame([], "url string"))
    new = spark.createDataFrame([("u1", "good news", "2024-01-02 10:00:00")], "url string, headline string, datetime string")
    assert append_articles(stored, new, path, ["url"]) == 1
    docs = spark.createDataFrame([(i, "good good news" if i % 2 else "bad day", i % 2) for i in range(20)], "id int, text string, label int")
    model = train_text_classifier(docs)
    scores = {r["id"]: r["s"] for r in with_classifier_score(docs, model, "text", "s").collect()}
    assert scores[1] > 0 > scores[0]


PAGE = """<table id=news-table-head><tr><td>Today 09:00AM</td><td><a href="/no">no</a></td></tr></table>
<div id='news-table'><tr><td> Dec-14-24 04:00PM </td><td><a href="/it's/x y?a=1&amp;b=2">it&#x27;s <b>big</b> &mdash; don&rsquo;t</a></td></tr>
<tr><td>03:00PM</td><td><table><tr><td>inner</td></tr></table><a href=second>two</a></td></tr><tr><td>n/a</td><td><a href='/bad'>bad</a></td></tr>
<tr><td>only one cell</td></tr><tr><td>02:00PM</td><td>no link</td></tr><tr><td>Oct-01-24 02:00PM</td><td><a href="/old">old</a></td></tr>
<tr><td>Dec-14-24 01:00PM</td><td><a href="/after">after an old one</a></td></tr></div>"""


def test_pages_are_read_as_html(spark):
    pages = spark.createDataFrame([(1, "A", PAGE), (2, "B", None), (3, "C", ""), (4, "D", "<table id='news'>")], "page_id long, ticker string, html string")
    rows = ingest.parse_pages(pages, lit_ts("2024-12-15 17:00:00")).orderBy("pos").collect()
    assert [(r["url"], r["headline"]) for r in rows] == [
        ("https://finviz.com/it's/x y?a=1&b=2", "it'sbig— don’t"), ("https://finviz.com/second", "two")]
    assert [r["datetime"].hour for r in rows] == [21, 20]
    plan = ingest.parse_pages(pages, lit_ts("2024-12-15 17:00:00"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert [r["url"] for r in ingest.page_links(pages).orderBy("pos").collect()][:2] == ["https://finviz.com/no", "https://finviz.com/it's/x y?a=1&b=2"]
