"""Boosted trees per target with grouped cross-validation.

Boosting goes on until the loss on the held rows has not improved for ``PATIENCE`` rounds and is then cut
back to its best round. A fit whose rows go into a task as bins is boosted there (``trees``), without a job for
every level. Of larger ones the learner cannot go on from an earlier fit, but draws the same rows and features
in the same round of a longer one; so the rounds are doubled until the best of them is old enough, which
costs at most twice the last fit. Targets and folds are independent fits and are submitted side by side.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketcast.operators.bayes import long_scores
from basketcast.operators.clean import fold_split
from basketcast.operators.evaluate import macro_auc
from basketcast.operators.trees import fit_in_tasks, fits_a_task

# Learner settings (the round limit is usually lowered by callers).
PARAMS = {"maxIter": 1000, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8,
          "featureSubsetStrategy": "0.3", "minInstancesPerNode": 3, "seed": 42}
# Rounds without a better loss before boosting ends, and the least total gain of a split.
PATIENCE = 50
GAMMA = 0.1
# Rounds of the first fit, of which the rest are doublings, and fits that are submitted at once.
FIRST_ROUNDS = 16
PARALLEL = 4
# Rows up to which folds are fitted side by side too: the learner caches the rows of each fit.
FEW_ROWS = 500_000
# Rows of one task while trees are grown.
TASK_ROWS = 100_000

Models = dict[str, GBTClassificationModel]


def vectorise(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature columns to one vector; missing features count 0."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(filled)


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """(rounds up to the best, whether ``patience`` rounds without a better one followed it)."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def cut(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model of the first ``rounds`` trees."""
    context = SparkContext._active_spark_context
    jvm, java = context._jvm, model._java_obj
    trees = context._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = context._gateway.new_array(jvm.double, rounds)
    all_trees, all_weights = java.trees(), java.treeWeights()
    for i in range(rounds):
        trees[i], weights[i] = all_trees[i], all_weights[i]
    made = jvm.org.apache.spark.ml.classification.GBTClassificationModel(model.uid, trees, weights, model.numFeatures, 2)
    out = GBTClassificationModel(made)
    out._resetUid(model.uid)
    for param, value in model.extractParamMap().items():
        out.set(out.getParam(param.name), value)
    out._transfer_params_to_java()
    return out


def fit_patiently(train: DataFrame, valid: DataFrame, target: str, settings: Mapping[str, object], patience: int) -> GBTClassificationModel:
    """Boost until ``valid`` shows no gain for ``patience`` rounds; the model ends at its best round."""
    most = int(settings["maxIter"])
    rounds = min(max(FIRST_ROUNDS, patience + patience // 5), most)
    while True:
        model = GBTClassifier(labelCol=target, featuresCol="features", **{**settings, "maxIter": rounds}).fit(train)
        best, ended = best_round(model.evaluateEachIteration(valid), patience)
        if ended or rounds == most:
            return cut(model, best)
        rounds = min(2 * rounds, most)


def fit_targets(train: DataFrame, valid: DataFrame | None, features: Sequence[str], targets: Sequence[str],
                params: Mapping[str, object] | None = None, patience: int = PATIENCE, gamma: float = GAMMA) -> Models:
    """One boosted classifier per target; ``valid`` stops the boosting early.

    ``gamma`` is the least gain of a split summed over the rows. The learner's own threshold is a mean
    over them, so that it is divided by their number.
    """
    kept_frames: list[DataFrame] = []

    def rows_of(df: DataFrame) -> tuple[DataFrame, int]:
        kept = vectorise(df, features).select("features", *[F.col(t).cast("double") for t in targets]).persist()
        kept_frames.append(kept)
        return kept, kept.count()

    def in_few_tasks(kept: DataFrame, n: int) -> DataFrame:
        # Every level of every tree is a job, so rows are kept in as few tasks as their number allows.
        return kept.coalesce(max(1, math.ceil(n / TASK_ROWS)))

    try:
        rows, n = rows_of(train)
        held, n_held = (None, 0) if valid is None else rows_of(valid)
        settings = {"minInfoGain": gamma / max(n, 1), **PARAMS, **(params or {})}
        if n and fits_a_task(n + n_held, len(features), settings):
            return fit_in_tasks(rows, held, len(features), targets, n + n_held, settings, None if held is None else partial(best_round, patience=patience))
        rows, held = in_few_tasks(rows, n), None if held is None else in_few_tasks(held, n_held)

        def fit(target: str) -> GBTClassificationModel:
            if held is None:
                return GBTClassifier(labelCol=target, featuresCol="features", **settings).fit(rows)
            return fit_patiently(rows, held, target, settings, patience)

        with ThreadPool(PARALLEL) as pool:
            return dict(zip(targets, pool.map(inheritable_thread_target(fit), targets)))
    finally:
        for frame in kept_frames:
            frame.unpersist()


def score_targets(df: DataFrame, models: Models, features: Sequence[str],
                  keep: Sequence[str] = ("session_id",)) -> DataFrame:
    """Purchase probability ``score_{t}`` of each target."""
    out = vectorise(df, features)
    for t, model in models.items():
        # A copy: the fitted model keeps its own column names.
        out = model.copy().setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_p").transform(out)
        out = out.withColumn(f"score_{t}", F.get(vector_to_array("_p"), F.lit(1))).drop("_p")
    return out.select(*keep, *[f"score_{t}" for t in models])


def cross_validate(df: DataFrame, features: Sequence[str], targets: Sequence[str], folds: int,
                   params: Mapping[str, object] | None = None, fold: str = "fold", patience: int = PATIENCE) -> tuple[DataFrame, list[Models]]:
    """(out-of-fold scores, models per fold). The loop runs over folds only; all scores come from one pass.

    A fit on few rows is a long row of one-task jobs, so that folds go side by side there.
    """
    def fit(k: int) -> Models:
        return fit_targets(*fold_split(df, k, fold), features, targets, params, patience)

    few = df.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    with ThreadPool(max(folds, 1) if few else 1) as pool:
        models = pool.map(inheritable_thread_target(fit), range(folds), 1)
    return score_own_fold(df, models, features, targets, fold), models


def score_own_fold(df: DataFrame, models: Sequence[Models], features: Sequence[str], targets: Sequence[str], fold: str = "fold") -> DataFrame:
    """Scores of each row by the models of its own fold, which have not seen it: one scan for all folds."""
    out = vectorise(df, features)
    for k, fitted in enumerate(models):
        for t, model in fitted.items():
            out = model.copy().setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"_p{k}_{t}").transform(out)
    def own(t: str):
        score = None
        for k in range(len(models)):
            hit, value = F.col(fold) == k, F.get(vector_to_array(f"_p{k}_{t}"), F.lit(1))
            score = F.when(hit, value) if score is None else score.when(hit, value)
        return score.alias(f"score_{t}")

    return out.select("session_id", fold, *targets, *[own(t) for t in targets])


def oof_macro_auc(oof: DataFrame, targets: Sequence[str]) -> DataFrame:
    return macro_auc(long_scores(oof, targets, "score_", ["session_id"]))


def average_folds(df: DataFrame, models: Sequence[Models], features: Sequence[str], targets: Sequence[str],
                  keep: Sequence[str] = ("session_id",)) -> DataFrame:
    """Mean of the fold models' scores of each session, all in one scan."""
    out = vectorise(df, features)
    for k, fitted in enumerate(models):
        for t, model in fitted.items():
            out = model.copy().setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"_p{k}_{t}").transform(out)
    means = [sum(F.get(vector_to_array(f"_p{k}_{t}"), F.lit(1)) for k in range(len(models))) / len(models) for t in targets]
    return out.select(*keep, *[m.alias(f"score_{t}") for m, t in zip(means, targets)])


def save_models(models: Sequence[Models], path: str) -> None:
    for k, fitted in enumerate(models):
        for t, model in fitted.items():
            model.write().overwrite().save(f"{path}/fold_{k}/{t}")


def load_models(path: str, folds: int, targets: Sequence[str]) -> list[Models]:
    return [{t: GBTClassificationModel.load(f"{path}/fold_{k}/{t}") for t in targets} for k in range(folds)]
