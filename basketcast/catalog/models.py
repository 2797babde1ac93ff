"""Factorisations, boosted trees and assembled tensors: checked by properties."""

from pyspark.sql import functions as F

from basketcast.catalog.registry import each, query, twin
from basketcast.constants import EMBED_DIM, FOLDS, TARGET_CATEGORIES, TARGETS
from basketcast.operators import stats
from basketcast.operators.bayes import model_blend
from basketcast.operators.boosting import average_folds, cross_validate, load_models, oof_macro_auc, save_models
from basketcast.operators.clean import filter_returns
from basketcast.operators.coordinates import sparse_rows
from basketcast.operators.factorise import nmf_fit, nmf_transform
from basketcast.plans import boosted
from basketcast.plans.bayes_score import production_scores
from basketcast.plans.session_tensors import session_tensors
from basketcast.session import run_folder, store
from basketcast.sources.sinks import write_predictions
from basketcast.sources.surrogate import BRANDS, MONEY
from basketcast.catalog.encoders import LEVELS
from basketcast.catalog.sequences import retail_calendar


@query("nmf")
def nmf(retail):
    train = retail.with_attributes(retail.visits_of("train"))
    codes = boosted.category_codes(retail.products)
    matrix = store(stats.session_categories(filter_returns(retail.purchases), retail.products, codes, ["quantity"]))
    rows = store(sparse_rows(stats.customer_categories(train, matrix, "quantity"), "customer_id", train))
    width = codes.count()
    factor, _ = nmf_fit(rows, width)
    return nmf_transform(rows, factor, "customer_id").select(
        "customer_id", *[F.get("nmf", F.lit(i)).alias(f"w{i}") for i in range(EMBED_DIM)])


def learning_parts(retail, folds):
    """(training frame, feature tables by key, features by session)."""
    train = retail.keep().history
    codes = boosted.category_codes(retail.products)
    matrix = boosted.session_matrix(retail.log, retail.products, codes)
    factors = boosted.fit_factors(retail.log, retail.products, train, matrix=matrix, codes=codes)
    tables = boosted.keyed_features(retail.log, retail.products, train, factors, list(BRANDS.values()), matrix)
    per_session = boosted.session_features(retail.sessions, LEVELS)
    return boosted.training_frame(retail.validation, tables, per_session, folds=folds), tables, per_session


def learning_frame(retail, folds):
    return learning_parts(retail, folds)[0]


@query("boosted_multi_target")
def boosted_multi_target(retail):
    oof, _, _ = boosted.boosted_scores(learning_frame(retail, FOLDS), None, folds=FOLDS)
    return oof.select("session_id", *[f"score_{t}" for t in TARGETS])


@query("oof_cv_loop")
def oof_cv_loop(retail):
    oof, _, _ = boosted.boosted_scores(learning_frame(retail, FOLDS), None, folds=FOLDS)
    return oof_macro_auc(oof, TARGETS)


@query("ensemble_scores")
def ensemble_scores(retail):
    """New sessions by the corrected Bayes score and by the fold models, blended, written as a submission and read back.

    The fold models go through their files, as in a run that scores later.
    """
    retail.keep()
    folder = run_folder(retail.spark, "ensemble")
    sessions = retail.facts.filter("split = 'test'")
    frame, tables, per_session = learning_parts(retail, FOLDS)
    features = boosted.feature_names(frame)
    _, _, models = boosted.boosted_scores(frame, None, folds=FOLDS)
    save_models(models, f"{folder}/models")
    loaded = load_models(f"{folder}/models", FOLDS, TARGETS)
    scoring = boosted.scoring_frame(sessions, retail.validation, tables, per_session)
    trees = average_folds(scoring, loaded, features, TARGETS)
    bayes = production_scores(retail.history, retail.validation, sessions)
    blended = model_blend(bayes.select("session_id", *[F.col(f"corrected_{t}").alias(t) for t in TARGETS]),
                          trees.select("session_id", *[F.col(f"score_{t}").alias(t) for t in TARGETS]), TARGETS)
    write_predictions(blended, f"{folder}/submission", TARGETS, labels=TARGET_CATEGORIES)
    columns = ["session_id long", *[f"`{TARGET_CATEGORIES[t]}` double" for t in TARGETS]]
    return retail.spark.read.option("header", True).schema(", ".join(columns)).csv(f"{folder}/submission").toDF("session_id", *TARGETS)


CALENDAR = ["hour", "month", "day", "weekday"]


@query("saved_models", twin("fact", f"SELECT session_id, {each('TRUE AS same_{t}')} FROM fact WHERE split = 'valid'"))
def saved_models(retail):
    """Fold models written, read back and compared on every validation session. A short fit: what is asked here is the files."""
    retail.keep()
    folder = run_folder(retail.spark, "models")
    rows = retail.history.select("session_id", *CALENDAR, *TARGETS, (F.col("session_id") % 2).cast("int").alias("fold"))
    _, models = cross_validate(rows, CALENDAR, TARGETS, 2, {"maxIter": 3, "maxDepth": 3})
    save_models(models, folder)
    before = average_folds(retail.validation, models, CALENDAR, TARGETS)
    after = average_folds(retail.validation, load_models(folder, 2, TARGETS), CALENDAR, TARGETS).withColumnsRenamed({f"score_{t}": f"again_{t}" for t in TARGETS})
    return before.join(after, "session_id").select("session_id", *[(F.col(f"score_{t}") == F.col(f"again_{t}")).alias(f"same_{t}") for t in TARGETS])


@query("session_tensors")
def tensors(retail):
    out = session_tensors(retail_calendar(retail), retail.targets, retail.log, retail.products, MONEY, ["category"])
    parts = [df.select(F.lit(name).alias("part"), "session_id", F.size("steps").alias("steps"), F.size(F.get("steps", F.lit(0))).alias("width"))
             for name, df in (("train", out.train), ("valid", out.valid), ("test", out.test))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
