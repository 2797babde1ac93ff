"""Features and cross-validated boosted trees."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketcast.constants import EMBED_DIM, FOLDS, TARGETS
from basketcast.functions.calendar import weekday1_dom
from basketcast.operators.assemble import assemble_features, split_long
from basketcast.operators.boosting import PATIENCE, Models, average_folds, cross_validate
from basketcast.operators.clean import filter_returns
from basketcast.operators.encode import one_hot, target_encode_full, target_encode_oof
from basketcast.operators.coordinates import rank_codes, sparse_rows
from basketcast.operators.factorise import nmf_fit, nmf_transform, project, spread, svd_fit
from basketcast.operators.folds import attach_fold, stratified_group_folds
from basketcast.operators.stats import (attribute_mean_embedding, customer_categories, purchase_indicators,
                                        purchase_ratio, session_categories)
from basketcast.session import materialise, store

KEYS = ("customer_id", "gender", "age_band", "store")
ENCODED = ("store", "gender", "age_band")
VALUES = ("amount", "quantity")


@dataclass
class Factors:
    """Fitted factorisations, one per value column: all of category size."""

    codes: DataFrame  # category, code
    width: int
    basis: dict[str, np.ndarray]
    factor: dict[str, np.ndarray]


def category_codes(products: DataFrame) -> DataFrame:
    return store(rank_codes(products, "category"))


def session_matrix(log: DataFrame, products: DataFrame, codes: DataFrame) -> DataFrame:
    """Kept lines as sessions by category with all values: one pass over the log, stored for every use."""
    return store(session_categories(filter_returns(log), products, codes, VALUES))


def matrix_rows(matrix: DataFrame, value: str) -> DataFrame:
    """Sparse rows of the sessions of a matrix."""
    return sparse_rows(matrix.select("session_id", "code", F.col(value).alias("value")), "session_id")


def fit_factors(log: DataFrame, products: DataFrame, window: DataFrame, dim: int = EMBED_DIM,
                rounds: int = 20, matrix: DataFrame | None = None, codes: DataFrame | None = None) -> Factors:
    """SVD of session by category and NMF of customer by category, on one window."""
    codes = codes or category_codes(products)
    matrix = matrix or session_matrix(log, products, codes)
    width = codes.count()

    def basis(value: str) -> np.ndarray:
        return svd_fit(matrix_rows(matrix, value), width, dim)[0]

    def factor(value: str) -> np.ndarray:
        people = sparse_rows(customer_categories(window, matrix, value), "customer_id", window)
        return nmf_fit(people, width, min(dim, width), rounds)[0]

    # Independent rows of short jobs, submitted side by side.
    with ThreadPool(2 * len(VALUES)) as pool:
        fits = [pool.apply_async(inheritable_thread_target(fit), (value,)) for fit in (basis, factor) for value in VALUES]
        found = [f.get() for f in fits]
    return Factors(codes, width, dict(zip(VALUES, found)), dict(zip(VALUES, found[len(VALUES):])))


def keyed_features(log: DataFrame, products: DataFrame, window: DataFrame, factors: Factors,
                   ratio_names: Sequence[str], matrix: DataFrame | None = None) -> dict[str, list[DataFrame]]:
    """Feature tables by customer, gender, age band and store over one window."""
    kinds = {k: window.schema[k].dataType.simpleString() for k in KEYS}
    tables: dict[str, list[DataFrame]] = {k: [] for k in KEYS}
    matrix = matrix or session_matrix(log, products, factors.codes)
    for value in VALUES:
        dim = factors.basis[value].shape[1]
        embeddings = project(matrix_rows(matrix, value), factors.basis[value], "session_id")
        means = store(spread(attribute_mean_embedding(window, embeddings, dim, KEYS), "embedding", dim, f"svd_{value}_"), ["dimension"])
        for k in KEYS:
            tables[k].append(split_long(means, [f"svd_{value}_{i}" for i in range(dim)], k, "", kinds[k]))
        people = sparse_rows(customer_categories(window, matrix, value), "customer_id", window)
        rank = factors.factor[value].shape[0]
        tables["customer_id"].append(spread(nmf_transform(people, factors.factor[value], "customer_id"),
                                            "nmf", rank, f"nmf_{value}_"))
    indicators = purchase_indicators(matrix.select("session_id", "category", "quantity"), ratio_names)
    # Four tables are cut from each long one: write it once, by dimension.
    ratios = store(purchase_ratio(window, indicators.withColumnsRenamed(
        {n: f"r{i}" for i, n in enumerate(ratio_names)}), [f"r{i}" for i in range(len(ratio_names))], KEYS), ["dimension"])
    for k in KEYS:
        tables[k].append(split_long(ratios, [f"r{i}" for i in range(len(ratio_names))], k, "ratio_", kinds[k]))
    return tables


def session_features(sessions: DataFrame, levels: Mapping[str, list[str]]) -> DataFrame:
    """Weekday, day, hour and attribute indicators of every session."""
    wide = one_hot(weekday1_dom(sessions.select("session_id", "sale_date", "hour", *ENCODED)), ENCODED, dict(levels))
    flags = {f"{c}_{level}": f"{c}_is_{i}" for c in ENCODED for i, level in enumerate(levels[c])}
    return wide.withColumnsRenamed(flags).select(
        "session_id", "hour", "weekday1", "day_of_month", *flags.values())


def training_frame(target_sessions: DataFrame, tables: Mapping[str, Sequence[DataFrame]],
                   per_session: DataFrame, targets: Sequence[str] = TARGETS, folds: int = FOLDS) -> DataFrame:
    """Sessions to learn from: folds, flags and all features."""
    base = target_sessions.select("session_id", *KEYS, *targets)
    dealt = materialise(attach_fold(base, stratified_group_folds(base, targets, folds)))
    encodings = {c: target_encode_oof(dealt, c, targets, folds=folds) for c in ENCODED}
    return assemble_features(dealt, tables, [per_session], encodings)


def scoring_frame(sessions: DataFrame, target_sessions: DataFrame, tables: Mapping[str, Sequence[DataFrame]],
                  per_session: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Sessions to score: encodings come from all training sessions."""
    encodings = {c: target_encode_full(target_sessions, c, targets) for c in ENCODED}
    return assemble_features(sessions.select("session_id", *KEYS), tables, [per_session], encodings, fold=None)


def feature_names(frame: DataFrame, targets: Sequence[str] = TARGETS) -> list[str]:
    """Everything but keys, raw categories, the fold and the targets."""
    skip = {"session_id", "fold", *KEYS, *targets}
    return [c for c in frame.columns if c not in skip]


def boosted_scores(frame: DataFrame, scoring: DataFrame | None, targets: Sequence[str] = TARGETS, folds: int = FOLDS,
                   params: Mapping[str, object] | None = None, patience: int = PATIENCE) -> tuple[DataFrame, DataFrame | None, list[Models]]:
    """(out-of-fold scores, averaged scores of new sessions, models)."""
    features = feature_names(frame, targets)
    stored = materialise(frame)
    oof, models = cross_validate(stored, features, targets, folds, params, patience=patience)
    averaged = None if scoring is None else average_folds(materialise(scoring), models, features, targets)
    return oof, averaged, models
