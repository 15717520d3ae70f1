"""Models: signal classifier, return regressor, text classifier; training, saving, scoring, backfill."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions.text import clamp, model_label, plain_words
from newsflow.operators import evaluate, prepare
from newsflow.operators.keys import keyed_update
from newsflow.operators.order import is_before, split_point
from newsflow.operators.prepare import Preparation, carry_market
from newsflow.schema import (
    CLASSIFIER_FEATURES, HORIZONS, MIN_TRAINING_ROWS, REGRESSOR_FEATURES, ensure_columns, require_features, target_column,
)
from newsflow.session import cut_lineage, scratch_path

SEED = 42
# Trials of a search that are fitted at the same time, and rows of a task of a fit: a small frame is one task, so that the
# many short jobs of a boosted model do not start eight tasks each.
PARALLELISM = 8
FIT_ROWS = 50_000
# Moves in percent that count as significant, and the clip of the regression target. The alternatives are the
# same numbers read as fractions of a percent.
SIGNIFICANT_PCT = 1.5
SIGNIFICANT_PCT_STRICT = 0.015
CLIP_PCT = 10.0
CLIP_PCT_STRICT = 0.1
# Ranges of the search (fixed values): iterations, leaves, learning rate, row and feature shares.
SEARCH_RANGES = {
    "maxIter": (100, 500), "leaves": (20, 60), "stepSize": (0.01, 0.1), "subsamplingRate": (0.6, 1.0),
    "featureShare": (0.6, 1.0),
}


# --- frames ---------------------------------------------------------------------------------------------------

def training_rows(articles: DataFrame, target: str, features: Sequence[str], extra: Sequence[str] = ("ticker",)) -> DataFrame:
    """Rows with a known outcome. Order is left to the operators that need it."""
    return articles.where(F.col(target).isNotNull()).select("id", "datetime", *extra, *features, target)


def inference_rows(articles: DataFrame, target: str, features: Sequence[str], extra: Sequence[str] = ("ticker",)) -> DataFrame:
    """Scored rows whose outcome is not known yet."""
    known = F.col(target).isNull() & F.col("sentiment_combined").isNotNull()
    return articles.where(known).select("id", "datetime", *extra, *features)


def all_rows(articles: DataFrame, features: Sequence[str], extra: Sequence[str] = ("ticker",)) -> DataFrame:
    return articles.select("id", "datetime", *extra, *features)


def significant_move(target: Column, threshold: float = SIGNIFICANT_PCT) -> Column:
    return (F.abs(target) >= threshold).cast("int")


def require_rows(df: DataFrame, minimum: int = MIN_TRAINING_ROWS) -> int:
    n = df.count()
    if n < minimum:
        raise ValueError(f"{n} training rows, {minimum} needed")
    return n


def training_sizes(articles: DataFrame, minimum: int = MIN_TRAINING_ROWS) -> DataFrame:
    """(horizon, rows, enough): rows with a known outcome for each horizon, and whether they suffice to train; one aggregate."""
    counts = articles.agg(*[F.count(c).alias(h) for h, c in HORIZONS.items()])
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(h).alias("rows"), (F.col(h) >= minimum).alias("enough")) for h in HORIZONS])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


# --- packages -------------------------------------------------------------------------------------------------

@dataclass
class ModelPackage:
    """A trained model with its preparation; saved as a Spark ML directory plus one JSON line."""

    model: PipelineModel
    prep: Preparation
    available: list[str]

    def assembled(self, df: DataFrame) -> DataFrame:
        self.prep.check(df)
        return df.withColumns({f"_x_{c}": self.prep.scaled(c) for c in self.prep.features})

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        line = json.dumps({"prep": self.prep.to_dict(), "available": self.available})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/package")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ModelPackage":
        record = json.loads(spark.read.text(f"{path}/package").first()["value"])
        prep = Preparation(**record["prep"])
        # Packages written before the list was stored used the trained features.
        return ModelPackage(PipelineModel.load(f"{path}/model"), prep, record.get("available", prep.features))


def _fit(estimator, train: DataFrame, features: Sequence[str]) -> PipelineModel:
    assembler = VectorAssembler(inputCols=[f"_x_{c}" for c in features], outputCol="_features")
    return Pipeline(stages=[assembler, estimator]).fit(train)


# --- classifier -----------------------------------------------------------------------------------------------

def draw_trial(rng: random.Random) -> dict:
    """One random setting from the search ranges."""
    r = SEARCH_RANGES
    return {
        "maxIter": rng.randint(*r["maxIter"]), "leaves": rng.randint(*r["leaves"]),
        "stepSize": rng.uniform(*r["stepSize"]), "subsamplingRate": rng.uniform(*r["subsamplingRate"]),
        "featureShare": rng.uniform(*r["featureShare"]),
    }


def boosted_trees(trial: dict) -> GBTClassifier:
    """Boosted trees with a setting; a tree of depth d has up to 2^d leaves."""
    return GBTClassifier(
        featuresCol="_features", labelCol="label", weightCol="_weight", seed=SEED, maxIter=trial["maxIter"],
        maxDepth=max(1, min(10, (trial["leaves"] - 1).bit_length())), stepSize=trial["stepSize"],
        subsamplingRate=trial["subsamplingRate"], featureSubsetStrategy=str(round(trial["featureShare"], 4)),
    )


def at_once(spark: SparkSession, work: Callable, items: Sequence, parallelism: int = PARALLELISM) -> list:
    """`work` of every item, several at the same time; results in the order of the items.

    Each call runs its Spark jobs from a thread of its own, which has the caller's job settings and a fair pool of its own
    (pools count where spark.scheduler.mode is FAIR; otherwise jobs share free cores as they come).
    """
    sc = spark.sparkContext

    def run(numbered):
        sc.setLocalProperty("spark.scheduler.pool", f"trial-{numbered[0]}")
        try:
            return work(numbered[1])
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    if parallelism <= 1 or len(items) <= 1:
        return [work(i) for i in items]
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(run), list(enumerate(items)), chunksize=1)


def for_fit(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows of a frame in one task per FIT_ROWS, kept in memory for the passes of a fit; unpersist it afterwards."""
    kept = cut_lineage(df)
    return kept.coalesce(max(1, -(-(kept.count() if rows is None else rows) // FIT_ROWS))).persist()


def validation_f1s(later: DataFrame, packages: Sequence[ModelPackage]) -> list[float]:
    """Best F1 of each model on the validation rows, from one precision-recall curve with the model's number as a key."""
    scored = None
    for k, package in enumerate(packages):
        one = with_probability(later, package).select(F.lit(k).alias("trial"), "probability_1", "label")
        scored = one if scored is None else scored.unionByName(one)
    curve = evaluate.precision_recall(scored, "probability_1", "label", by=["trial"])
    found = {r["trial"]: r["best_f1"] for r in evaluate.best_f1(curve, by=["trial"]).collect()}  # one row per trial
    return [found.get(k) or 0.0 for k in range(len(packages))]


def with_probability(df: DataFrame, package: ModelPackage, out: str = "probability_1") -> DataFrame:
    """Add the probability of the positive class."""
    scored = package.model.transform(package.assembled(df))
    return scored.withColumn(out, vector_to_array(F.col("probability"))[1]).select(*df.columns, out)


@dataclass
class Trained:
    package: ModelPackage
    report: DataFrame
    best_f1: float
    trial: dict


def train_classifier(
    articles: DataFrame, horizon: str = "eod", features: Sequence[str] = tuple(CLASSIFIER_FEATURES),
    threshold: float = SIGNIFICANT_PCT, trials: int = 15, most_features: int = 15, by: Sequence[str] = ("ticker",),
    fit_on_all: bool = False, draw: Callable[[random.Random], dict] = draw_trial, minimum: int = MIN_TRAINING_ROWS,
    parallelism: int = PARALLELISM,
) -> Trained:
    """Train the signal classifier and search its settings.

    The label is a move of at least `threshold` percent. The earlier 80 % of the rows train, the later 20 %
    validate. Preparation is fitted on the training part (`fit_on_all`: on all rows). Each of `trials` random
    settings is scored by its best F1 on the validation part, and the best one is kept.
    """
    target = target_column(horizon)
    have = require_features(articles, list(features))
    rows = training_rows(articles, target, have)
    require_rows(rows, minimum)
    frame = carry_market(rows, by).withColumn("label", significant_move(F.col(target), threshold))
    return fit_classifier(frame, have, trials, most_features, fit_on_all, draw, parallelism)


def fit_classifier(
    frame: DataFrame, features: Sequence[str], trials: int = 15, most_features: int = 15, fit_on_all: bool = False,
    draw: Callable[[random.Random], dict] = draw_trial, parallelism: int = PARALLELISM,
) -> Trained:
    """Search and fit on a frame with `id`, `datetime`, the features and a 0/1 `label`.

    The settings are drawn first, so the search does not depend on `parallelism`. Of equal F1 the earlier trial is kept.
    """
    frame = cut_lineage(frame)  # read once per trial and pass
    point = split_point(frame, "datetime", "id")
    early = is_before(point, "datetime", "id")
    fit_rows = frame if fit_on_all else frame.where(early)
    imputer = prepare.fit_imputer(fit_rows, features)
    chosen = prepare.select_features(fit_rows, imputer, "label", min(most_features, len(imputer.features)))
    prep = prepare.fit_scaler(fit_rows, imputer, chosen)
    train = frame.where(early)
    weights = evaluate.class_weights(train)
    scaled = {f"_x_{c}": prep.scaled(c) for c in chosen}
    train = for_fit(train.withColumns(scaled).withColumn("_weight", evaluate.weight_column(weights)))
    later = frame.where(~early)

    rng = random.Random(SEED)
    drawn = [draw(rng) for _ in range(trials)]
    models = at_once(frame.sparkSession, lambda trial: _fit(boosted_trees(trial), train, chosen), drawn, parallelism)
    train.unpersist()
    packages = [ModelPackage(model, prep, list(features)) for model in models]
    scores = validation_f1s(later, packages)
    f1 = max(scores)
    package, trial = packages[scores.index(f1)], drawn[scores.index(f1)]
    judged = with_probability(later, package).withColumn("prediction", (F.col("probability_1") > 0.5).cast("int"))
    return Trained(package, evaluate.classification_report(judged), f1, trial)


def predict_signals(rows: DataFrame, package: ModelPackage, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """(id, sentiment_category, ml_confidence) of the rows, market columns carried forward first."""
    scored = with_probability(carry_market(rows, by), package)
    p = F.col("probability_1")
    return scored.select("id", model_label(p).alias("sentiment_category"), p.alias("ml_confidence"))


def backfill(articles: DataFrame, package: ModelPackage, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """The table with label and confidence of every row set by the model."""
    wanted = [c for c in package.available if c in articles.columns]
    rows = all_rows(articles, wanted)
    package.prep.check(rows)
    updates = predict_signals(rows, package, by)
    table = ensure_columns(articles, {"sentiment_category": "string", "ml_confidence": "double"})
    return keyed_update(table, updates, ["sentiment_category", "ml_confidence"])


# --- regressor ------------------------------------------------------------------------------------------------

@dataclass
class TrainedRegressor:
    package: ModelPackage
    gate: ModelPackage
    metrics: DataFrame
    importance: DataFrame
    frame: DataFrame
    target: str


def forest(trees: int = 200, depth: int = 8, leaf: int = 20) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="_features", labelCol="_y", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf,
        featureSubsetStrategy="all", seed=SEED)


def train_regressor(
    articles: DataFrame, gate: ModelPackage, horizon: str = "eod", features: Sequence[str] = tuple(REGRESSOR_FEATURES),
    clip: float = CLIP_PCT, by: Sequence[str] = ("ticker",), fit_on_all: bool = False,
    estimator: RandomForestRegressor | None = None, minimum: int = MIN_TRAINING_ROWS,
) -> TrainedRegressor:
    """Train the return regressor on the classifier's probability and the other features, target clipped."""
    target = target_column(horizon)
    have = [c for c in dict.fromkeys([*features, *gate.prep.features]) if c in articles.columns]
    extra = [c for c in ("ticker", "headline") if c in articles.columns]
    rows = training_rows(articles, target, have, extra)
    require_rows(rows, minimum)
    frame = carry_market(rows, by)
    return fit_regressor(frame, gate, [c for c in features if c in have], target, clip, fit_on_all, estimator)


def fit_regressor(
    frame: DataFrame, gate: ModelPackage, features: Sequence[str], target: str, clip: float = CLIP_PCT,
    fit_on_all: bool = False, estimator: RandomForestRegressor | None = None,
) -> TrainedRegressor:
    gated = with_probability(frame.dropna(subset=[target]), gate, "gatekeeper_confidence")
    gated = cut_lineage(gated.withColumn("_y", clamp(F.col(target), -clip, clip)))
    wanted = ["gatekeeper_confidence", *features]
    point = split_point(gated, "datetime", "id")
    early = is_before(point, "datetime", "id")
    fit_rows = gated if fit_on_all else gated.where(early)
    prep = prepare.fit_scaler(fit_rows, prepare.fit_imputer(fit_rows, wanted))
    package = ModelPackage(None, prep, wanted)
    fit_on = for_fit(package.assembled(gated.where(early)))
    package.model = _fit(estimator or forest(), fit_on, prep.features)
    fit_on.unpersist()
    judged = with_prediction(gated, package)
    parts = [
        evaluate.regression_metrics(judged.where(cond), "_y", "prediction").withColumn("part", F.lit(name))
        for name, cond in (("train", early), ("test", ~early))
    ]
    return TrainedRegressor(
        package, gate, parts[0].unionByName(parts[1]), importance(package, frame.sparkSession), gated, target)


def with_prediction(df: DataFrame, package: ModelPackage, out: str = "prediction") -> DataFrame:
    scored = package.model.transform(package.assembled(df))
    return scored.withColumn("_p", F.col("prediction")).select(*df.columns, F.col("_p").alias(out))


def importance(package: ModelPackage, spark: SparkSession, top: int = 10) -> DataFrame:
    """The features that matter most, from the trained trees (one number per feature)."""
    values = package.model.stages[-1].featureImportances.toArray()
    ranked = sorted(zip(package.prep.features, map(float, values)), key=lambda p: (-p[1], p[0]))[:top]
    return spark.createDataFrame(ranked, "feature string, importance double")


def prediction_check(trained: TrainedRegressor, n: int = 100) -> DataFrame:
    """The most recent n rows with prediction and error against the unclipped target."""
    recent = trained.frame.orderBy(F.desc("datetime"), F.desc("id")).limit(n)
    scored = with_prediction(recent, trained.package, "predicted_change")
    columns = [c for c in ("ticker", "datetime", "headline") if c in scored.columns]
    return scored.select(
        *columns, "gatekeeper_confidence", trained.target, "predicted_change",
        (F.col("predicted_change") - F.col(trained.target)).alias("prediction_error"))


# --- text classifier ------------------------------------------------------------------------------------------

def train_text_classifier(labelled: DataFrame, text_col: str = "text", label: str = "label", buckets: int = 1 << 16) -> PipelineModel:
    """Text classifier on hashed, weighted word counts; its input column is `_plain`.

    The model is returned as it is read back: a freshly fitted one keeps a training summary, and with it the session,
    which cannot be sent to tasks once the session has observed metrics.
    """
    rows = labelled.select(plain_words(F.col(text_col)).alias("_plain"), F.col(label).cast("double").alias("label"))
    stages = [
        RegexTokenizer(inputCol="_plain", outputCol="_tokens", pattern=r"(?U)\s+"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=buckets),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        LogisticRegression(featuresCol="_tfidf", labelCol="label", maxIter=50, regParam=0.01),
    ]
    path = scratch_path(labelled.sparkSession, "text-model")
    Pipeline(stages=stages).fit(rows).write().save(path)
    return PipelineModel.load(path)
