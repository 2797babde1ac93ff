"""The empirical-Bayes score from history to corrected probabilities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketcast.constants import ERROR_STRENGTH_PRODUCTION, PRODUCTION_CONFIDENCE, TARGETS
from basketcast.functions.scalars import nan_guard
from basketcast.operators.bayes import (bayes_posterior, correlation_correction, error_correction, error_model,
                                        lookup_marginals, marginal_counts, marginal_overall, marginal_table,
                                        weighted_blend)
from basketcast.operators.evaluate import confidence_grid
from basketcast.operators.sequences import latest_sequence, purchase_sequence, sequence_patterns, sequence_score
from basketcast.operators.skew import byte_sizes, heavy_keys
from basketcast.operators.stats import conditional_purchase
from basketcast.session import materialise, store


def blended_scores(history: DataFrame, sessions: DataFrame, targets: Sequence[str] = TARGETS,
                   confidence: Mapping[str, float] | DataFrame = PRODUCTION_CONFIDENCE) -> DataFrame:
    """Sessions with ``blend_{t}``: seven components, then the correlation step.

    Everything is learned from ``history`` alone. Group statistics are computed
    once, in one pass, and reach the sessions by map-side joins; only the
    customer's own counts and latest pair need a shuffle of the sessions.
    """
    table = marginal_table(history, targets)
    sizes = byte_sizes(table, "marginal")
    heavy = heavy_keys(sessions, "customer_id")
    patterns = sequence_patterns(purchase_sequence(history, targets), targets)
    scored = bayes_posterior(history, sessions, targets, confidence,
                             segment_counts=marginal_counts(table, "segment", targets), segment_size=sizes.get("segment", 0),
                             overall=marginal_overall(table, targets), heavy=heavy)
    scored = sequence_score(scored, latest_sequence(history, targets), patterns, targets, heavy=heavy)
    scored = lookup_marginals(scored, table, targets, sizes=sizes).withColumnsRenamed({f"p_{t}": f"sequence_{t}" for t in targets})
    blended = weighted_blend(scored, targets)
    corrected = correlation_correction(blended, conditional_purchase(history, targets), targets, prefix="blend_")
    return nan_guard(corrected, [f"blend_{t}" for t in targets]).select(
        *sessions.columns, *[f"blend_{t}" for t in targets])


def tuned_confidence(history: DataFrame, validation: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Best confidence per target on the validation sessions: one row, a column per target."""
    best = confidence_grid(history, validation, targets)
    return best.agg(*[F.max(F.when(F.col("target") == t, F.col("confidence"))).alias(t) for t in targets])


def tuned_scores(history: DataFrame, validation: DataFrame, sessions: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Posterior of new sessions from both periods, with the confidence that was best on ``validation``."""
    confidence = materialise(tuned_confidence(history, validation, targets))
    return bayes_posterior(history.unionByName(validation), sessions, targets, confidence)


def production_scores(history: DataFrame, validation: DataFrame, sessions: DataFrame,
                      targets: Sequence[str] = TARGETS,
                      confidence: Mapping[str, float] = PRODUCTION_CONFIDENCE,
                      strength: float = ERROR_STRENGTH_PRODUCTION) -> DataFrame:
    """Scores of new sessions, corrected by what went wrong in validation.

    Errors are learned by scoring ``validation`` from ``history``; the final
    scores then use both periods as history.
    """
    validated = store(blended_scores(history, validation, targets, confidence))
    model, edges = error_model(validated, targets, "blend_")
    final = blended_scores(history.unionByName(validation), sessions, targets, confidence)
    return error_correction(final, model, edges, targets, "blend_", strength)
