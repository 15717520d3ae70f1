import pytest
from pyspark.sql import functions as F

from newsflow.functions import text as tx
from newsflow.functions.lexicon_data import FINANCE_LEXICON, parse
from newsflow.operators.lexicon import with_lexicon_hits, with_lexicon_score

FINANCE = sorted((k, (1 if p == "positive" else -1) * s) for k, p, s in parse(FINANCE_LEXICON))

# text, lexicon score, question score
CASES = [
    ("NVIDIA stock surges 10% on record revenue.", 1.6, 0),
    ("Company reports bankruptcy fears amid declining sales.", -1.8, 0),
    ("FDA approval granted for breakthrough drug treatment.", 1.85, 0),
    ("Brazil's largest private bank advises 3% Bitcoin allocation for clients.", 1.25, 0),
    ("US Navy bets $448M on Palantir AI to speed shipbuilding.", 1.4, 0),
    ("Is D-Wave Quantum one of the most overlooked tech stories?", 1.3, 0.3),
    ("Can Block shares keep running and reach $100 in 2026?", 1.3, 0.4),
    ("2 Stocks That Turned $1,000 Into $1 Million (or More)", 1.65, 0),
    ("What to know before buying The Metals Company stock.", 1.2, -0.2),
    ("Nvidia reports record breaking revenue, stock soars.", 1.633333, 0),
    ("Company files for bankruptcy amid mounting losses.", -1.8, 0),
    ("Best buying guide", 1.35, 0.4),
    ("All-time high", 1.6, 0),
    ("Profit profit loss", 0.5, 0),
    ("Canal boat is white", 0, 0.4),
    ("Enterprise will comprise assets", 0, 0.3),
    ("Growth\nlost cash\nburn", 1.4, 0),
]


@pytest.fixture(scope="module")
def headlines(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(CASES)] + [(100, None)]
    return spark.createDataFrame(rows, "id long, text string")


@pytest.mark.parametrize("limit", [2000, 0], ids=["literal", "joined"])
def test_lexicon_score(spark, headlines, limit):
    lexicon = spark.createDataFrame(FINANCE, "keyword string, weight double")
    got = {r["id"]: r["s"] for r in with_lexicon_score(headlines, "text", lexicon, out="s", limit=limit).collect()}
    assert got.pop(100) is None
    assert got == pytest.approx({i: kw for i, (_, kw, _) in enumerate(CASES)}, abs=1e-6)


def test_question_bias(headlines):
    got = {r["id"]: r["q"] for r in headlines.select("id", tx.question_bias(F.col("text")).alias("q")).collect()}
    assert got.pop(100) == 0.0
    assert got == pytest.approx({i: q for i, (_, _, q) in enumerate(CASES)})


def test_narrow_score_has_no_shuffle_and_no_python(headlines):
    plan = with_lexicon_score(headlines, "text", FINANCE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_joined_score_has_no_cross_join(spark, headlines):
    lexicon = spark.createDataFrame(FINANCE, "keyword string, weight double")
    plan = with_lexicon_score(headlines, "text", lexicon, limit=0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_unicode_words_and_newlines_agree_in_both_plans(spark):
    lexicon = [("über uns", 1.0), ("naïve", -1.0), ("s&p gain", 1.5), ("foo-", 2.0), ("x-y-z", 1.2), ("mis", 1.0),
               ("miss", -1.0), ("tokens s", 1.1)]
    texts = ["über\nuns", "über etwas uns", "rüber unserer", "Naïves naïve naïvess", "the s&p will gain", "foo bar",
             "x y z", "x, y - z", "miss misss mis", "tokens say", "", "gain s&p", "a" * 50 + " über " + "b " * 50 + "uns"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lex = spark.createDataFrame(lexicon, "keyword string, weight double")
    one = {r["id"]: r["s"] for r in with_lexicon_score(df, "text", lex, out="s").collect()}
    two = {r["id"]: r["s"] for r in with_lexicon_score(df, "text", lex, out="s", limit=0).collect()}
    assert one == pytest.approx(two)
    assert one == pytest.approx({0: 0, 1: 1.0, 2: 1.0, 3: -1.0, 4: 1.5, 5: 2.0, 6: 1.2, 7: 1.2, 8: -1 / 3, 9: 1.1,
                                 10: 0, 11: 0, 12: 1.0})


@pytest.mark.parametrize("entries", [1_999, 2_001, 50_000])
def test_size_of_the_lexicon_changes_nothing(spark, entries):
    lexicon = [("record revenue", 1.5), ("miss", -1.0), ("re", 0.5), ("x-y", 2.0)] + [(f"zq{i} zz" if i % 2 else f"zq{i}", 1.0) for i in range(entries - 4)]
    texts = ["Record revenue, no miss", "misses and zq8", "x y", None, "", "record\nrevenue"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lex = spark.createDataFrame(lexicon, "keyword string, weight double")
    score = {r["id"]: r["s"] for r in with_lexicon_score(df, "text", lex, out="s").collect()}
    hits = {r["id"]: [h["keyword"] for h in r["hits"]] for r in with_lexicon_hits(df, "text", lex).collect()}
    assert hits[0] == ["miss", "re", "record revenue"] and hits[1] == ["miss", "zq8"] and hits[2] == ["x-y"]
    assert hits[3] == [] and hits[4] == [] and hits[5] == ["re"]
    small = lexicon[:4] + [("zq8", 1.0)]
    assert score == {r["id"]: r["s"] for r in with_lexicon_score(df, "text", small, out="s").collect()}


def test_hits_for_audit(spark):
    df = spark.createDataFrame([(1, "Record-breaking revenue: a record!")], "id long, text string")
    hits = with_lexicon_hits(df, "text", FINANCE).first()["hits"]
    assert [h["keyword"] for h in hits] == ["record", "record breaking", "record revenue"]
    empty = with_lexicon_hits(df, "text", [("zzz", 1.0)]).first()["hits"]
    assert empty == []


@pytest.mark.parametrize("entries", [[("good news", 1.0)], [("good", 1.0)], []])
def test_one_sided_lexicons(spark, entries):
    df = spark.createDataFrame([(1, "good news")], "id long, text string")
    want = 1.0 if entries else 0.0
    assert with_lexicon_score(df, "text", entries, out="s").first()["s"] == want


# model, lexicon, question, vader, classifier -> combined, confidence, label
ENSEMBLE = [
    (0, 1.6, 0, 0, 0, 0.56, 0.368703, "Signal"),
    (0, 1.3, 0.3, 0, 0, 0.5, 0.428730, "Signal"),
    (0, 1.3, 0.4, 0, 0, 0.515, 0.535059, "Signal"),
    (0.9, 1.6, 0, 0.5, 0, 0.945, 0.613615, "Signal"),
    (-0.95, -1.8, 0, -0.6, 0, -1, 0.614752, "Signal"),
    (0, 0, 0, 0, 0, 0, 0.15, "Noise"),
    (0.1, 0, 0.1, 0.1, 0, 0.06, 0.151834, "Noise"),
    (0.15, 0, 0, 0, 0, 0.06, 0.295003, "Noise"),
    (0, 1.2, -0.2, 0, 0, 0.39, 0.382630, "Noise"),
    (0.2, 0, 0.4, 0.2, 0, 0.15, 0.400507, "Signal"),
    (0.9, 1.85, 0, 0.3, 0.2, 1, 0.565390, "Signal"),
]


def test_ensemble_confidence_label(spark):
    rows = [tuple(float(x) for x in r[:5]) + (i,) for i, r in enumerate(ENSEMBLE)]
    df = spark.createDataFrame(rows, "m double, k double, q double, v double, c double, i int")
    m, k, q, v, c = (F.col(x) for x in "mkqvc")
    df = df.withColumn("combined", tx.combine(m, k, q, v, c))
    df = df.withColumn("conf", tx.confidence(F.col("combined"), m, k, v, q))
    df = df.withColumn("label", tx.signal_label(F.col("conf"), F.col("combined")))
    for row in df.collect():
        want = ENSEMBLE[row["i"]]
        assert (row["combined"], row["conf"]) == pytest.approx(want[5:7], abs=1e-6)
        assert row["label"] == want[7]
        assert 0 <= row["conf"] <= 1


def test_calibration(spark):
    rows = [("positive", .9, .9), ("negative", .8, -.8), ("neutral", .69, .15), ("neutral", .7, .05),
            ("neutral", .85, 0.0), ("Positive", .5, .5)]
    df = spark.createDataFrame(rows, "label string, c double, want double")
    for r in df.select("want", tx.calibrate(F.col("label"), F.col("c")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["want"])


def test_full_text(spark):
    rows = [("a", "b"), ("a", None), ("a", ""), (None, "b"), ("  ", ""), (" x", "y \n")]
    df = spark.createDataFrame(rows, "h string, b string")
    got = [r[0] for r in df.select(tx.full_text(F.col("h"), F.col("b"))).collect()]
    assert got == ["a b", "a", "a", None, None, "x y"]


def test_clamp_keeps_null(spark):
    got = spark.range(1).select(tx.clamp(F.lit(None).cast("double"), -1, 1)).first()[0]
    assert got is None
