"""Queries on scoring, labels and the reports built on them."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions import text as tx
from newsflow.functions.lexicon_data import FALLBACK_LEXICON, parse
from newsflow.operators.lexicon import with_lexicon_hits, with_lexicon_score
from newsflow.operators.stage import spread
from newsflow.plans import report
from newsflow.plans.scoring import category_share, score_articles, score_columns
from newsflow.registry import views
from newsflow.registry.base import SQL_STAMP, query, rounded, stamp
from newsflow.session import scratch_path
from newsflow.sources.tables import lexicon_from_block, lexicon_weights, read_lexicon

LEXICON = views.lexicon_entries()

# --- SQL pieces -------------------------------------------------------------------------------------------------

V_TEXT = views.V_ARTICLES + r""",
v_text AS (
  SELECT *, lower(full_text) AS low FROM (
    SELECT *, nullif(regexp_replace(headline || ' ' || body, '^\s+|\s+$', '', 'g'), '') AS full_text FROM v_articles))"""


def sql_lexicon_score(lexicon: str) -> str:
    """CTEs from v_text and a lexicon table to v_kw(id, kw), by joins of tokens and phrases."""
    return rf"""
lex AS (SELECT keyword, weight, replace(keyword, '-', ' ') AS form,
  list_filter(string_split(replace(keyword, '-', ' '), ' '), lambda p: p <> '') AS parts,
  (contains(keyword, ' ') OR contains(keyword, '-')) AS is_phrase FROM {lexicon}),
phrases AS (SELECT *, CASE WHEN len(parts) >= 2 THEN '% ' || replace(array_to_string(parts, ' % '), '_', '\_') || ' %' END AS pattern
  FROM lex WHERE is_phrase),
spaced AS (SELECT id, '  ' || regexp_replace(unnest(string_split(low, chr(10))), '[^\p{{L}}\p{{N}}_]+', '  ', 'g') || '  ' AS line FROM v_text),
found AS (SELECT DISTINCT id, keyword, form, weight FROM (
  SELECT id, keyword, form, weight FROM v_text JOIN phrases ON contains(low, form)
  UNION ALL
  SELECT id, keyword, form, weight FROM spaced JOIN phrases
  ON contains(line, parts[1]) AND contains(line, parts[-1]) AND line LIKE pattern ESCAPE '\')),
tok AS (SELECT id, w, count(*) AS n FROM (
  SELECT id, unnest(regexp_extract_all(low, '[\p{{L}}\p{{N}}_]+')) AS w FROM v_text WHERE low IS NOT NULL) GROUP BY 1, 2),
hit AS (SELECT tok.id, tok.w, tok.n, coalesce(a.weight, b.weight) AS weight FROM tok
  LEFT JOIN lex a ON a.keyword = tok.w AND NOT a.is_phrase
  LEFT JOIN lex b ON b.keyword = tok.w[:-2] AND tok.w LIKE '%s' AND NOT b.is_phrase
  WHERE coalesce(a.weight, b.weight) <> 0
    AND NOT EXISTS (SELECT 1 FROM found f WHERE f.id = tok.id AND contains(f.form, tok.w))),
sums AS (SELECT id, sum(s) / sum(n) AS mean FROM (
  SELECT id, weight AS s, 1 AS n FROM found UNION ALL SELECT id, weight * n, n FROM hit) GROUP BY id),
v_kw AS (SELECT v_text.id, CASE WHEN low IS NOT NULL THEN CASE WHEN mean IS NULL THEN 0.0 ELSE greatest(-3.0, least(3.0, mean)) END END AS kw
  FROM v_text LEFT JOIN sums ON sums.id = v_text.id)"""


V_KW = V_TEXT + ",\n" + views.sql_lexicon() + "," + sql_lexicon_score("v_lexicon")

QUESTION = r"""CASE WHEN low IS NULL THEN 0.0
  WHEN contains(low, 'before buying') OR contains(low, 'before you buy') THEN -0.2
  WHEN contains(low, 'what to know') THEN 0.0
  WHEN contains(low, 'once-in-a-decade') OR contains(low, 'once in a decade') THEN 0.6
  WHEN contains(low, 'buying opportunity') THEN 0.5
  WHEN regexp_matches(low, '(can|will|could)[^\n]*(reach|hit|surge|soar|climb)') THEN 0.4
  WHEN regexp_matches(low, '(can|will|could)[^\n]*(keep running|keep rising|outperform)') THEN 0.4
  WHEN regexp_matches(low, '(could|will)[^\n]*(heading higher|go higher|rise)') THEN 0.3
  WHEN contains(low, 'best') AND (contains(low, 'buy') OR contains(low, 'stock')) THEN 0.4
  WHEN contains(low, 'overlooked') OR contains(low, 'undervalued') THEN 0.3
  WHEN contains(low, 'should you avoid') OR contains(low, 'don''t buy') THEN -0.5
  WHEN contains(low, 'overvalued') OR contains(low, 'bubble') THEN -0.4 ELSE 0.0 END"""


def sql_confidence(model: str, vader: str, classifier: str) -> str:
    """CTEs from v_text, v_kw to v_conf(id, kw, q, model, vader, combined, conf, label)."""
    return rf"""
v_in AS (SELECT v_text.id, v_text.dt, v_text.ticker, v_text.headline, v_text.lang, v_text.n_chars, low, kw,
  CAST({QUESTION} AS DOUBLE) AS q, CAST({model} AS DOUBLE) AS model, CAST({vader} AS DOUBLE) AS vader,
  CAST({classifier} AS DOUBLE) AS classifier
  FROM v_text JOIN v_kw ON v_kw.id = v_text.id),
v_comb AS (SELECT *, greatest(-1.0, least(1.0,
  model * 0.40::DOUBLE + kw * 0.35::DOUBLE + q * 0.15::DOUBLE + vader * 0.05::DOUBLE + classifier * 0.05::DOUBLE)) AS combined,
  CASE WHEN abs(q) > 0.1 THEN [model, kw, vader, q] ELSE [model, kw, vader] END AS parts FROM v_in),
v_score AS (SELECT *, greatest(0.0, least(1.0,
  ((1 - least(list_aggregate(parts, 'stddev_pop') / 0.816::DOUBLE, 1.0)) * 0.30::DOUBLE + abs(combined) * 0.35::DOUBLE
   + CASE WHEN abs(kw) > 0.8 THEN 0.15 ELSE 0 END + CASE WHEN abs(q) > 0.3 THEN 0.10 ELSE 0 END)
  * CASE WHEN list_max(list_transform(parts, lambda x: abs(x))) >= 0.15 THEN 1 ELSE 0.5 END)) AS conf FROM v_comb),
v_conf AS (SELECT *, CASE WHEN conf IS NOT NULL THEN CASE WHEN conf >= CASE WHEN abs(combined) > 0.45
  THEN 0.40::DOUBLE - 0.05::DOUBLE ELSE 0.40::DOUBLE END THEN 'Signal' ELSE 'Noise' END END AS label FROM v_score)"""


# Documents scored without models. Articles in Spanish are left unscored, those in French have an outcome.
V_SCORED = V_KW + "," + sql_confidence("0", "0", "0") + """,
v_scored AS (SELECT id, ticker, dt, headline, lang, n_chars,
  CASE WHEN lang <> 'es' THEN round(combined, 9) END AS sentiment_combined,
  CASE WHEN lang <> 'es' THEN label END AS sentiment_category,
  CASE WHEN lang <> 'es' THEN round(conf, 9) END AS ml_confidence,
  CASE WHEN lang = 'fr' THEN 0.0 END AS pct_change_eod, n_chars / 100.0::DOUBLE AS vix_close FROM v_conf)"""


def scored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.articles(spark, sf_dir)
    done = score_articles(docs, LEXICON)
    kept = F.col("lang") != "es"
    return done.select(
        "id", "ticker", "datetime", "headline", "url", "lang", "n_chars",
        F.when(kept, F.round("sentiment_combined", 9)).alias("sentiment_combined"),
        F.when(kept, F.col("sentiment_category")).alias("sentiment_category"),
        F.when(kept, F.round("ml_confidence", 9)).alias("ml_confidence"),
        F.when(F.col("lang") == "fr", 0.0).alias("pct_change_eod"), (F.col("n_chars") / 100.0).alias("vix_close"),
    )


def with_text(df: DataFrame) -> DataFrame:
    return spread(df).withColumn("full_text", tx.full_text(F.col("headline"), F.col("text")))


# --- queries ----------------------------------------------------------------------------------------------------

@query("q_lexicon_score", f"WITH {V_KW} SELECT id, round(kw, 9) AS score FROM v_kw")
def lexicon_score(spark, sf_dir):
    scored = with_lexicon_score(with_text(views.articles(spark, sf_dir)), "full_text", LEXICON, out="score")
    return scored.select("id", F.round("score", 9).alias("score"))


# A lexicon that grows with the documents: the first two words of each text, polarity and strength from its labels.
V_GROWN = r"""
v_lines AS (
  SELECT lower(CASE WHEN doc_id % 2 = 0 THEN array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+')[1:2], ' ')
    ELSE array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+')[1:2], '-') END) AS keyword,
    CASE WHEN toxic = 1 THEN 'neutral' WHEN quality = 1 THEN 'Positive ' ELSE 'negative' END AS sentiment,
    CASE WHEN n_chars % 4 > 0 THEN CAST(n_chars % 4 AS DOUBLE) END AS strength, doc_id AS line
  FROM documents JOIN labels USING (doc_id)
  UNION ALL
  SELECT lower(regexp_extract_all(text, '[\p{L}\p{N}_]+')[1]), CASE WHEN n_chars % 2 = 0 THEN 'positive' ELSE 'negative' END,
    1.0 + (n_chars % 10) / 10.0::DOUBLE, 1000000000000 + doc_id FROM documents
  WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) > 0),
v_grown AS (SELECT keyword, arg_max(weight, line) AS weight FROM (
  SELECT keyword, line, coalesce(strength, 1.0) * CASE trim(lower(sentiment)) WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 END AS weight
  FROM v_lines WHERE keyword <> '') WHERE weight IS NOT NULL GROUP BY keyword)"""


def grown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = views.table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "labels")
    # The first two words alone: the rest of a text is not searched.
    first, second = (F.regexp_extract("text", r"(?U)(\w+)(?:\W+(\w+))?", n) for n in (1, 2))
    sign = F.when(F.col("doc_id") % 2 == 0, " ").otherwise("-")
    pair = F.when(second == "", first).otherwise(F.concat(first, sign, second))
    labelled = docs.join(labels, "doc_id").select(
        pair.alias("keyword"),
        F.when(F.col("toxic") == 1, "neutral").when(F.col("quality") == 1, "Positive ").otherwise("negative").alias("sentiment"),
        F.when(F.col("n_chars") % 4 > 0, (F.col("n_chars") % 4).cast("double")).alias("strength"), F.col("doc_id").alias("line"))
    single = docs.where(first != "").select(
        first.alias("keyword"), F.when(F.col("n_chars") % 2 == 0, "positive").otherwise("negative").alias("sentiment"),
        (F.lit(1.0) + (F.col("n_chars") % 10) / 10.0).alias("strength"), (F.lit(1_000_000_000_000) + F.col("doc_id")).alias("line"))
    return labelled.unionByName(single).where("keyword <> ''")


def grown_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_weights(grown_lines(spark, sf_dir), "line")


SQL_FALLBACK = ", ".join(f"('{k}', {s if p == 'positive' else -s}::DOUBLE)" for k, p, s in parse(FALLBACK_LEXICON))


@query("q_lexicon_fallback", f"""WITH {V_TEXT}, v_fallback(keyword, weight) AS (VALUES {SQL_FALLBACK}),{sql_lexicon_score("v_fallback")}
  SELECT id, round(kw, 9) AS score FROM v_kw""")
def lexicon_fallback(spark, sf_dir):
    """Documents scored with the entries used where no lexicon file is given."""
    scored = with_lexicon_score(with_text(views.articles(spark, sf_dir)), "full_text", lexicon_from_block(spark), out="score")
    return scored.select("id", F.round("score", 9).alias("score"))


@query("q_lexicon_load", f"WITH {V_GROWN} SELECT keyword, round(weight, 6) AS weight FROM v_grown")
def lexicon_load(spark, sf_dir):
    return rounded(grown_lexicon(spark, sf_dir), {"weight": 6})


@query("q_lexicon_file", f"WITH {V_GROWN} SELECT keyword, round(weight, 6) AS weight FROM v_grown")
def lexicon_file(spark, sf_dir):
    """The lines as a CSV file with its columns in another order, read by their names."""
    path = scratch_path(spark, "lexicon")
    # A lexicon is one small file.
    lines = grown_lines(spark, sf_dir).repartition(1).sortWithinPartitions("line").select("strength", F.col("sentiment").alias("Sentiment"), "keyword")
    lines.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return rounded(read_lexicon(spark, path), {"weight": 6})


@query("q_lexicon_score_grown", f"WITH {V_TEXT},{V_GROWN},{sql_lexicon_score('v_grown')} SELECT id, round(kw, 9) AS score FROM v_kw")
def lexicon_score_grown(spark, sf_dir):
    # The lexicon grows with the data, so it is joined and never written into the plan.
    scored = with_lexicon_score(
        with_text(views.articles(spark, sf_dir)), "full_text", grown_lexicon(spark, sf_dir), out="score", limit=0)
    return scored.select("id", F.round("score", 9).alias("score"))


@query("q_lexicon_hits", rf"""WITH {V_TEXT}, {views.sql_lexicon()},
lex AS (SELECT keyword, weight, (contains(keyword, ' ') OR contains(keyword, '-')) AS is_phrase,
  '% ' || replace(replace(keyword, '-', ' '), ' ', ' % ') || ' %' AS pattern, string_split(replace(keyword, '-', ' '), ' ') AS parts FROM v_lexicon),
spaced AS (SELECT id, '  ' || regexp_replace(unnest(string_split(low, chr(10))), '[^\p{{L}}\p{{N}}_]+', '  ', 'g') || '  ' AS line FROM v_text)
SELECT id, keyword, weight FROM v_text JOIN lex ON NOT is_phrase AND contains(low, keyword)
UNION
SELECT id, keyword, weight FROM spaced JOIN lex ON is_phrase AND contains(line, parts[1]) AND contains(line, parts[-1]) AND line LIKE pattern""")
def lexicon_hits(spark, sf_dir):
    hits = with_lexicon_hits(with_text(views.articles(spark, sf_dir)), "full_text", LEXICON)
    return hits.select("id", F.explode("hits").alias("h")).select("id", "h.keyword", "h.weight")


@query("q_lexicon_hits_grown", rf"""WITH {V_TEXT},{V_GROWN},
lex AS (SELECT keyword, weight, (contains(keyword, ' ') OR contains(keyword, '-')) AS is_phrase,
  '% ' || replace(replace(keyword, '-', ' '), ' ', ' % ') || ' %' AS pattern, string_split(replace(keyword, '-', ' '), ' ') AS parts FROM v_grown),
spaced AS (SELECT id, '  ' || regexp_replace(unnest(string_split(low, chr(10))), '[^\p{{L}}\p{{N}}_]+', '  ', 'g') || '  ' AS line FROM v_text)
SELECT id, keyword, round(weight, 6) AS weight FROM v_text JOIN lex ON NOT is_phrase AND contains(low, keyword)
UNION
SELECT id, keyword, round(weight, 6) AS weight FROM spaced JOIN lex ON is_phrase AND contains(line, parts[1]) AND contains(line, parts[-1]) AND line LIKE pattern""")
def lexicon_hits_grown(spark, sf_dir):
    hits = with_lexicon_hits(with_text(views.articles(spark, sf_dir)), "full_text", grown_lexicon(spark, sf_dir))
    return hits.select("id", F.explode("hits").alias("h")).select("id", "h.keyword", F.round("h.weight", 6).alias("weight"))


@query("q_question_bias", f"WITH {V_TEXT} SELECT id, CAST({QUESTION} AS DOUBLE) AS bias FROM v_text")
def question_bias(spark, sf_dir):
    return with_text(views.articles(spark, sf_dir)).select("id", tx.question_bias(F.col("full_text")).alias("bias"))


@query("q_calibrate", """SELECT event_id, round(CASE event_type WHEN 'view' THEN c WHEN 'signup' THEN -c
  ELSE CASE WHEN c < 0.7 THEN 0.15 WHEN c < 0.85 THEN 0.05 ELSE 0 END END, 6) AS score
  FROM (SELECT event_id, event_type, least(value / 100, 1.0) AS c FROM events)""")
def calibrate(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    label = F.when(kind == "view", "Positive").when(kind == "signup", "negative").otherwise("Neutral")
    score = tx.calibrate(label, F.least(F.col("value") / 100, F.lit(1.0)))
    return e.select("event_id", F.round(score, 6).alias("score"))


MODEL = "((n_chars * 7) % 201 - 100) / 100.0::DOUBLE"
VADER = "((n_chars * 13) % 201 - 100) / 100.0::DOUBLE"
CLASSIFIER = "((n_chars * 3) % 101 - 50) / 50.0::DOUBLE"


@query("q_sentiment_confidence", f"""WITH {V_KW}, {sql_confidence(MODEL, VADER, CLASSIFIER)}
  SELECT id, round(combined, 9) AS combined, round(conf, 9) AS confidence, label FROM v_conf""")
def sentiment_confidence(spark, sf_dir):
    n = F.col("n_chars")
    scored = score_columns(
        with_text(views.articles(spark, sf_dir)), "full_text", LEXICON, ((n * 7) % 201 - 100) / 100.0,
        ((n * 13) % 201 - 100) / 100.0, ((n * 3) % 101 - 50) / 50.0)
    return scored.select("id", F.round("_combined", 9).alias("combined"), F.round("_confidence", 9).alias("confidence"),
                         F.col("_label").alias("label"))


@query("q_scoring_job", f"""WITH {V_KW}, {sql_confidence("0", "0", "0")}
  SELECT id, CASE WHEN lang = 'es' THEN 0.5 ELSE 0.0 END AS sentiment_ml,
    CASE WHEN lang = 'es' THEN NULL ELSE round(kw, 9) END AS sentiment_keyword,
    CASE WHEN lang = 'es' THEN 0.25 ELSE round(combined, 9) END AS sentiment_combined,
    CASE WHEN lang = 'es' THEN 'Signal' ELSE label END AS sentiment_category,
    CASE WHEN lang = 'es' THEN 0.9 ELSE round(conf, 9) END AS ml_confidence FROM v_conf""")
def scoring_job(spark, sf_dir):
    # Articles in Spanish have been scored before and must keep their values.
    es = F.col("lang") == "es"
    docs = views.articles(spark, sf_dir).withColumns({
        "sentiment_ml": F.when(es, 0.5), "sentiment_combined": F.when(es, 0.25),
        "sentiment_category": F.when(es, "Signal"), "ml_confidence": F.when(es, 0.9)})
    done = score_articles(docs, LEXICON)
    names = ("sentiment_ml", "sentiment_keyword", "sentiment_combined", "ml_confidence")
    return rounded(done.select("id", "sentiment_category", *names), {c: 9 for c in names})


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the scorer below travels with its task


class LengthScorer:
    """Deterministic stand-in for a language model: scores by text length."""

    def model(self, text: str) -> float:
        return ((len(text) * 7) % 201 - 100) / 100.0

    def vader(self, text: str) -> float:
        return ((len(text) * 13) % 201 - 100) / 100.0


@query("q_scorer_job", f"""WITH {V_TEXT} SELECT id,
  round(((length(full_text) * 7) % 201 - 100) / 100.0::DOUBLE, 6) AS sentiment_ml,
  round(((length(full_text) * 13) % 201 - 100) / 100.0::DOUBLE, 6) AS sentiment_vader,
  CASE WHEN trim(headline) = '' THEN 0.0 ELSE round(((length(headline) * 13) % 201 - 100) / 100.0::DOUBLE, 6) END AS headline_sentiment
  FROM v_text""")
def scorer_job(spark, sf_dir):
    done = score_articles(views.articles(spark, sf_dir), LEXICON, LengthScorer)
    names = ("sentiment_ml", "sentiment_vader", "headline_sentiment")
    return rounded(done.select("id", *names), {c: 6 for c in names})


@query("q_category_share", f"""WITH {V_SCORED} SELECT coalesce(sentiment_category, 'Unprocessed') AS category, count(*) AS n,
  round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM v_scored GROUP BY 1""")
def share(spark, sf_dir):
    return category_share(scored_articles(spark, sf_dir))


@query("q_watchlist", f"""WITH {V_SCORED} SELECT id, ticker, {SQL_STAMP.format('dt')} AS datetime, headline, sentiment_combined,
  ml_confidence, coalesce(sentiment_category, 'Unprocessed') AS sentiment_category FROM v_scored
  WHERE ticker = '2' AND coalesce(ml_confidence, 0) >= 0.3 AND coalesce(sentiment_category, 'Unprocessed') = 'Signal'
    AND pct_change_eod IS NULL
  ORDER BY ml_confidence DESC NULLS LAST, dt DESC, id DESC LIMIT 20""")
def watchlist(spark, sf_dir):
    rows = report.filtered(scored_articles(spark, sf_dir), "2", "Signal", 0.3)
    return report.watchlist(rows).withColumn("datetime", stamp("datetime"))


@query("q_tiles", f"""WITH {V_SCORED} SELECT count(*) AS articles, count(*) FILTER (sentiment_category = 'Signal') AS signals,
  round(coalesce(avg(sentiment_combined), 0), 6) AS avg_sentiment,
  round(coalesce(arg_max(vix_close, (dt, id)), 0), 6) AS latest_vix FROM v_scored WHERE coalesce(ml_confidence, 0) >= 0.2""")
def tiles(spark, sf_dir):
    return rounded(report.tiles(report.filtered(scored_articles(spark, sf_dir), min_confidence=0.2)),
                   {"avg_sentiment": 6, "latest_vix": 6})


@query("q_histogram", f"""WITH {V_SCORED}, counts AS (
  SELECT least(CAST(trunc(20 * (sentiment_combined + 1.0) / 2.0) AS INT) + 1, 20) AS bin, count(*) AS n
  FROM v_scored WHERE sentiment_combined IS NOT NULL GROUP BY 1)
  SELECT CAST(b.bin AS INT) AS bin, round(-1.0 + (b.bin - 1) * 0.1::DOUBLE, 6) AS bin_low, coalesce(n, 0) AS n
  FROM range(1, 21) b(bin) LEFT JOIN counts ON counts.bin = b.bin""")
def sentiment_histogram(spark, sf_dir):
    return rounded(report.sentiment_histogram(scored_articles(spark, sf_dir)), {"bin_low": 6})


@query("q_confidence_points", f"""WITH {V_SCORED} SELECT id, sentiment_combined, ml_confidence,
  coalesce(sentiment_category, 'Unprocessed') AS sentiment_category, ticker, headline FROM v_scored
  WHERE coalesce(ml_confidence, 0) >= 0.15""")
def points(spark, sf_dir):
    return report.confidence_points(report.filtered(scored_articles(spark, sf_dir), min_confidence=0.15))
