"""Queries on feature preparation, evaluation and models. Of trained models SQL checks what holds for any model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.operators import evaluate, prepare
from newsflow.plans import train
from newsflow.plans.scoring import with_classifier_score
from newsflow.registry import views
from newsflow.registry.base import query, rounded, stamp
from newsflow.session import scratch_path
from newsflow.sources import sinks

FEATURES = [*views.FEATURES, "constant", "empty"]
KEPT = [*views.FEATURES, "constant"]
WITH_TRAIN = f"WITH {views.V_TRAIN}"


@query("q_null_report", WITH_TRAIN + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count(*) AS rows FROM v_train" for c in FEATURES))
def null_report(spark, sf_dir):
    return prepare.null_report(views.training(spark, sf_dir), FEATURES)


@query("q_impute_scale", f"""{WITH_TRAIN}, filled AS (SELECT id, """ + ", ".join(
    f"coalesce({c}, (SELECT median({c}) FROM v_train)) AS {c}" for c in KEPT) + """ FROM v_train)
  SELECT id, """ + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 6) AS {c}" for c in KEPT)
    + " FROM filled")
def impute_scale(spark, sf_dir):
    df = views.training(spark, sf_dir)
    prep = prepare.fit_scaler(df, prepare.fit_imputer(df, FEATURES))
    return df.select("id", *[F.round(prep.scaled(c), 6).alias(c) for c in prep.features])


def _sql_anova(columns) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS feature, round(coalesce(
      (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / nullif(sum(n * v) / (sum(n) - count(*)), 0), 0), 4) AS f_score
    FROM (SELECT label, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM filled) AS g FROM filled GROUP BY label)"""
                              for c in columns)


V_FILLED = views.V_TRAIN + ", filled AS (SELECT id, label, " + ", ".join(
    f"coalesce({c}, (SELECT median({c}) FROM v_train)) AS {c}" for c in KEPT) + " FROM v_train)"


@query("q_anova", f"WITH {V_FILLED} {_sql_anova(KEPT)}")
def anova(spark, sf_dir):
    df = views.training(spark, sf_dir)
    prep = prepare.fit_imputer(df, FEATURES)
    return rounded(prepare.anova_scores(df, prep.features, "label", prep.imputed), {"f_score": 4})


@query("q_select_features", f"""WITH {V_FILLED}, scores AS ({_sql_anova(KEPT)})
  SELECT feature FROM scores ORDER BY f_score DESC, feature DESC LIMIT 3""")
def select_features(spark, sf_dir):
    df = views.training(spark, sf_dir)
    names = prepare.select_features(df, prepare.fit_imputer(df, FEATURES), "label", 3)
    # Three names at most, from a list the size of the feature set.
    return df.sparkSession.createDataFrame([(n,) for n in names], "feature string")


# A fixed score stands in for a model here: its errors are what is measured.
SCORE = "(n_chars % 1000) / 1000.0::DOUBLE"


def _scored(spark, sf_dir) -> DataFrame:
    df = views.training(spark, sf_dir)
    score = (F.col("n_chars") % 1000) / 1000.0
    return df.select("id", "label", score.alias("score"), (score > 0.5).cast("int").alias("prediction"))


V_SCORE = views.V_TRAIN + f""", s AS (SELECT id, label, {SCORE} AS score, CAST({SCORE} > 0.5 AS INT) AS prediction FROM v_train),
per AS (SELECT c, CAST(count(*) FILTER (label = c) AS DOUBLE) AS support,
  coalesce(count(*) FILTER (label = c AND prediction = c) / nullif(count(*) FILTER (prediction = c), 0), 0) AS precision,
  coalesce(count(*) FILTER (label = c AND prediction = c) / nullif(count(*) FILTER (label = c), 0), 0) AS recall
  FROM s, (VALUES (0), (1)) v(c) GROUP BY c),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM per)"""


@query("q_class_report", f"""WITH {V_SCORE} SELECT CAST(c AS VARCHAR) AS row, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(f1, 6) AS f1, support FROM f
  UNION ALL SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), n FROM (SELECT avg(CAST(label = prediction AS INT)) AS a, CAST(count(*) AS DOUBLE) AS n FROM s)
  UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
    round(sum(f1 * support) / sum(support), 6), sum(support) FROM f""")
def class_report(spark, sf_dir):
    out = evaluate.classification_report(_scored(spark, sf_dir))
    return rounded(out, {c: 6 for c in ("precision", "recall", "f1")})


V_CURVE = V_SCORE + """, cuts AS (SELECT score AS threshold, sum(label) AS tp, count(*) AS n FROM s GROUP BY 1),
curve AS (SELECT threshold, sum(tp) OVER w / sum(n) OVER w AS precision, sum(tp) OVER w / (SELECT sum(label) FROM s) AS recall FROM cuts
  WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""


@query("q_pr_curve", f"WITH {V_CURVE} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve")
def pr_curve(spark, sf_dir):
    return rounded(evaluate.precision_recall(_scored(spark, sf_dir)), {"precision": 6, "recall": 6})


@query("q_pr_f1", f"WITH {V_CURVE} SELECT round(max(2 * precision * recall / (precision + recall + 1e-8)), 6) AS best_f1 FROM curve")
def pr_f1(spark, sf_dir):
    return rounded(evaluate.best_f1(evaluate.precision_recall(_scored(spark, sf_dir))), {"best_f1": 6})


@query("q_label_stats", f"""{WITH_TRAIN} SELECT label, count(*) AS n, round((SELECT count(*) FROM v_train) / (2.0::DOUBLE * count(*)), 9) AS weight,
  round((SELECT avg(label) FROM v_train), 9) AS label_rate FROM v_train GROUP BY label""")
def label_stats(spark, sf_dir):
    df = views.training(spark, sf_dir)
    weight = evaluate.weight_column(evaluate.class_weights(df))
    rate = evaluate.label_rate(df).first()["label_rate"]
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(
        "label", "n", F.round(weight, 9).alias("weight"), F.round(F.lit(rate), 9).alias("label_rate"))


@query("q_reg_metrics", f"""{WITH_TRAIN}, e AS (SELECT greatest(-4.0, least(4.0, (n_chars % 11) - 5.0)) AS y, (n_chars % 13) - 6.0 AS p FROM v_train)
  SELECT round(avg(abs(p - y)), 6) AS mae, round(1 - sum((p - y) * (p - y)) / sum((y - g) * (y - g)), 6) AS r2,
    round(avg(CAST(sign(p) = sign(y) AS INT)), 6) AS direction_acc, min(y) AS target_min, max(y) AS target_max, count(*) AS n
  FROM (SELECT CAST(y AS DOUBLE) AS y, CAST(p AS DOUBLE) AS p, CAST((SELECT avg(y) FROM e) AS DOUBLE) AS g FROM e)""")
def reg_metrics(spark, sf_dir):
    from newsflow.functions.text import clamp

    n = F.col("n_chars")
    df = views.training(spark, sf_dir).select(clamp(n % 11 - 5.0, -4.0, 4.0).alias("label"), (n % 13 - 6.0).alias("prediction"))
    return rounded(evaluate.regression_metrics(df), {"mae": 6, "r2": 6, "direction_acc": 6})


# --- trained models -----------------------------------------------------------------------------------------------

# What the queries search: stated parameters, smaller than the defaults of train_classifier (15 trials of 100 to 500 rounds), whose
# figures are in the README. SQL cannot train, so it checks what must hold for any model: rows, labels, ranges, errors.
QUERY_TRIALS = 4
QUERY_ROUNDS = (10, 30)
FACTS = "true AS label_agrees, true AS in_range"


def query_trial(rng) -> dict:
    """A setting of the search ranges with the queries' number of rounds."""
    return {**train.draw_trial(rng), "maxIter": rng.randint(*QUERY_ROUNDS)}


def _classifier(spark, sf_dir, trials: int = 1) -> train.Trained:
    return train.fit_classifier(views.training(spark, sf_dir), FEATURES, trials=trials, draw=query_trial)


def _label_facts(label: str = "sentiment_category", confidence: str = "ml_confidence") -> list:
    p = F.col(confidence)
    return [((F.col(label) == "Signal") == (p > 0.6)).alias("label_agrees"), p.between(0.0, 1.0).alias("in_range")]


@query("q_train_score", f"{WITH_TRAIN} SELECT id, {FACTS} FROM v_train")
def train_score(spark, sf_dir):
    """Search, fit and score every labelled document."""
    trained = _classifier(spark, sf_dir, QUERY_TRIALS)
    scored = train.predict_signals(views.training(spark, sf_dir).drop("label"), trained.package)
    return scored.select("id", *_label_facts())


@query("q_backfill", f"{WITH_TRAIN} SELECT id, ticker, {FACTS}, true AS same_when_reloaded FROM v_train")
def backfill(spark, sf_dir):
    """The saved and reloaded model sets label and confidence of the whole history, as the model itself does."""
    trained = _classifier(spark, sf_dir)
    path = scratch_path(spark, "model")
    trained.package.save(spark, path)
    package = train.ModelPackage.load(spark, path)
    history = views.training(spark, sf_dir).drop("label")
    filled = train.backfill(history, package)
    own = train.predict_signals(history, trained.package).select("id", F.col("ml_confidence").alias("own"))
    same = F.abs(F.col("ml_confidence") - F.col("own")) < 1e-9
    return filled.join(own, "id").select("id", "ticker", *_label_facts(), same.alias("same_when_reloaded"))


def _both(spark, sf_dir) -> tuple[train.Trained, train.TrainedRegressor]:
    """The classifier and the regressor stacked on it."""
    gate = _classifier(spark, sf_dir)
    frame = views.training(spark, sf_dir).withColumns({
        "headline": F.lit(""), "pct_change_eod": (F.col("n_words") % 41 - 20.0) / 10.0})
    return gate, train.fit_regressor(frame, gate.package, views.FEATURES, "pct_change_eod")


V_TARGET = views.V_TRAIN + """, v_target AS (SELECT *, (n_words % 41 - 20.0) / 10.0::DOUBLE AS y FROM v_train WHERE n_words IS NOT NULL)"""


@query("q_regressor", f"""WITH {V_TARGET} SELECT ticker, strftime(dt, '%Y-%m-%d %H:%M:%S') AS datetime, y AS pct_change_eod, true AS gate_in_range,
    true AS inside_clip, true AS error_is_difference FROM v_target ORDER BY dt DESC, id DESC LIMIT 100""")
def regressor(spark, sf_dir):
    """Recent predictions of the stacked regressor with their errors, written and read back."""
    path = scratch_path(spark, "check")
    sinks.write_prediction_check(train.prediction_check(_both(spark, sf_dir)[1]), path)
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    p, y, e = (F.col(c).cast("double") for c in ("predicted_change", "pct_change_eod", "prediction_error"))
    return rows.select(
        "ticker", stamp(F.col("datetime").cast("timestamp")).alias("datetime"), y.alias("pct_change_eod"),
        F.col("gatekeeper_confidence").cast("double").between(0.0, 1.0).alias("gate_in_range"),
        p.between(-train.CLIP_PCT, train.CLIP_PCT).alias("inside_clip"), (F.abs(e - (p - y)) < 1e-9).alias("error_is_difference"))


@query("q_model_reports", f"""WITH {V_TARGET},
  late AS (SELECT label FROM (SELECT label, row_number() OVER (ORDER BY dt, id) > floor(0.8 * count(*) OVER ()) AS late FROM v_train) WHERE late),
  parts AS (SELECT CASE WHEN row_number() OVER (ORDER BY dt, id) > floor(0.8 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS part, y FROM v_target)
  SELECT 'classifier' AS report, CAST(label AS VARCHAR) AS name, CAST(count(*) AS DOUBLE) AS n, true AS in_range FROM late GROUP BY label
  UNION ALL SELECT 'classifier', name, CAST(count(*) AS DOUBLE), true FROM late, (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) v(name) GROUP BY name
  UNION ALL SELECT 'regressor', part, CAST(count(*) AS DOUBLE), true FROM parts GROUP BY part
  UNION ALL SELECT 'importance', name, NULL, true FROM (VALUES ('gatekeeper_confidence'), ('n_chars'), ('n_words'), ('n_lines'), ('n_the'), ('spread')) v(name)
  UNION ALL SELECT 'importance', 'all', 1.0, true""")
def model_reports(spark, sf_dir):
    """Reports of the trained models: classes of the validation part, errors of both parts, what the features weigh."""
    gate, trained = _both(spark, sf_dir)
    shares = [F.col(c).between(0.0, 1.0) for c in ("precision", "recall", "f1")]
    classes = gate.report.select(
        F.lit("classifier").alias("report"), F.col("row").alias("name"), F.col("support").alias("n"), (shares[0] & shares[1] & shares[2]).alias("in_range"))
    errors = trained.metrics.select(
        F.lit("regressor").alias("report"), F.col("part").alias("name"), F.col("n").cast("double").alias("n"),
        ((F.col("mae") >= 0) & (F.col("r2") <= 1) & F.col("direction_acc").between(0.0, 1.0)
         & (F.col("target_min") >= -train.CLIP_PCT) & (F.col("target_max") <= train.CLIP_PCT)).alias("in_range"))
    weight = F.col("importance")
    each = trained.importance.select(F.lit("importance").alias("report"), F.col("feature").alias("name"), F.lit(None).cast("double").alias("n"),
                                     weight.between(0.0, 1.0).alias("in_range"))
    whole = trained.importance.agg(F.round(F.sum(weight), 6).alias("n")).select(
        F.lit("importance").alias("report"), F.lit("all").alias("name"), "n", F.lit(True).alias("in_range"))
    return classes.unionByName(errors).unionByName(each).unionByName(whole)


@query("q_text_model")
def text_model(spark, sf_dir):
    """Text classifier trained on the labelled documents, applied to all of them."""
    docs = views.articles(spark, sf_dir).withColumn("whole", F.concat_ws(" ", "headline", "text"))
    labels = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = train.train_text_classifier(docs.join(labels, "id"), "whole")
    return with_classifier_score(docs.select("id", "whole"), model, "whole", "score").select("id", "score")


