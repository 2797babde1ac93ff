"""Bayes posterior, blend and corrections."""

import re

from pyspark.sql import functions as F

from basketcast.catalog.encoders import BIN_SQL, EDGE_SQL, scored
from basketcast.catalog.joins import MARGINAL_JOINS, MARGINAL_SQL
from basketcast.catalog.registry import (CUSTOMER_SQL, DEFAULT_C, HISTORY_SQL, OVERALL_SQL, SCORED, SEGMENT_SQL, VALID_SQL, each,
                                         long_sql, posterior_sql, query, twin)
from basketcast.catalog.sequences import BASKET_SQL, LATEST_SQL, PATTERN_SQL
from basketcast.constants import (BLEND_WEIGHTS, CORRELATION_PAIRS, CORRELATION_STRENGTH, DEFAULT_CONFIDENCE, FOLDS,
                                  PRODUCTION_CONFIDENCE, TARGETS)
from basketcast.operators import bayes
from basketcast.operators.overlap import union_all
from basketcast.operators.stats import conditional_purchase
from basketcast.plans.bayes_score import blended_scores, production_scores
from basketcast.session import materialise

BLEND_SQL = "blended AS (SELECT *, " + ", ".join(
    " + ".join(f"COALESCE({'p' if part == 'sequence' else part}_{t}, 0) * CAST({w!r} AS DOUBLE)" for part, w in BLEND_WEIGHTS[t].items())
    + f" AS raw_{t}" for t in TARGETS) + f""" FROM scored {MARGINAL_JOINS} LEFT JOIN latest USING (customer_id) LEFT JOIN patterns USING (c1, c2))"""
COND_SQL = "cond AS (SELECT " + ", ".join(
    f"avg(CASE WHEN {a} > 0 THEN {b} END) AS {a}_to_{b}" for a in TARGETS for b in TARGETS if a != b) + " FROM hist)"


def correction_sql(source: str, prefix: str, out: str) -> str:
    """Chained CTEs: each target reads the targets corrected before it."""
    ctes, previous = [], source
    for t in TARGETS:
        done = TARGETS[:TARGETS.index(t)]
        pull = "CAST(0.0 AS DOUBLE)"
        for o in TARGETS:
            if o != t:
                weight = CORRELATION_PAIRS.get((o, t), CORRELATION_STRENGTH[t])
                value = f"{out}_{o}" if o in done else f"{prefix}{o}"
                pull = f"({pull} + {value} * COALESCE({o}_to_{t}, 0) * CAST({weight!r} AS DOUBLE))"
        cte = f"{out}_step_{t}"
        cross = " CROSS JOIN cond" if not ctes else ""
        ctes.append(f"{cte} AS (SELECT *, greatest(least({prefix}{t} + {pull}, 1.0::DOUBLE), 0.0::DOUBLE) AS {out}_{t} FROM {previous}{cross})")
        previous = cte
    return ",\n".join(ctes)


LAST = f"step_{TARGETS[-1]}"
PRODUCTION = (HISTORY_SQL, VALID_SQL, SEGMENT_SQL, CUSTOMER_SQL, OVERALL_SQL, posterior_sql(PRODUCTION_CONFIDENCE),
              *MARGINAL_SQL, BASKET_SQL, PATTERN_SQL, LATEST_SQL, BLEND_SQL, COND_SQL, correction_sql("blended", "raw_", "final"))


@query("bayes_posterior", twin("fact", f"SELECT session_id, {each('bayes_{t}')} FROM scored", *SCORED))
def bayes_posterior(retail):
    return scored(retail).select("session_id", *[f"bayes_{t}" for t in TARGETS])


@query("bayes_score", twin("fact", f"SELECT session_id, {each('round(final_{t}, 12) AS blend_{t}')} FROM final_{LAST}", *PRODUCTION))
def bayes_score(retail):
    retail.keep()
    out = blended_scores(retail.history, retail.validation)
    return out.select("session_id", *[F.round(f"blend_{t}", 12).alias(f"blend_{t}") for t in TARGETS])


@query("weighted_blend", twin("fact", f"SELECT session_id, {each('round(raw_{t}, 12) AS blend_{t}')} FROM blended",
                              HISTORY_SQL, VALID_SQL, SEGMENT_SQL, CUSTOMER_SQL, OVERALL_SQL, posterior_sql(DEFAULT_C),
                              *MARGINAL_SQL, BLEND_SQL.replace(" LEFT JOIN latest USING (customer_id) LEFT JOIN patterns USING (c1, c2)", "").replace("COALESCE(p_", "COALESCE(0 * bayes_")))
def weighted_blend(retail):
    return marginal_blend(retail).select("session_id", *[F.round(f"blend_{t}", 12).alias(f"blend_{t}") for t in TARGETS])


def marginal_blend(retail):
    rows = bayes.lookup_marginals(scored(retail), bayes.marginal_table(retail.history, TARGETS), TARGETS)
    rows = rows.withColumns({f"sequence_{t}": F.lit(None).cast("double") for t in TARGETS})
    return bayes.weighted_blend(rows, TARGETS)


@query("correlation_correction", twin("fact", f"SELECT session_id, {each('round(fixed_{t}, 12) AS bayes_{t}')} FROM fixed_{LAST}",
                                      *SCORED, COND_SQL, correction_sql("scored", "bayes_", "fixed")))
def correlation_correction(retail):
    out = bayes.correlation_correction(scored(retail), conditional_purchase(retail.history, TARGETS), TARGETS, prefix="bayes_")
    return out.select("session_id", *[F.round(f"bayes_{t}", 12).alias(f"bayes_{t}") for t in TARGETS])


ERROR_SQL = "errors AS (SELECT target, dimension, value, avg(error) AS e FROM (" + " UNION ALL ".join(
    f"SELECT target, '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, y - score AS error FROM binned WHERE {d} IS NOT NULL"
    for d in ("age_band", "store", "weekday", "time_band", "bin")) + ") GROUP BY ALL)"
FIXED_SQL = "corrected AS (SELECT b.*, greatest(least(score + (" + " + ".join(
    f"COALESCE(e_{d}.e, 0)" for d in ("age_band", "store", "weekday", "time_band", "bin")) + ") / 5 * 0.5::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) AS better FROM binned b " + " ".join(
    f"LEFT JOIN errors e_{d} ON e_{d}.target = b.target AND e_{d}.dimension = '{d}' AND e_{d}.value = CAST(b.{d} AS VARCHAR)"
    for d in ("age_band", "store", "weekday", "time_band", "bin")) + ")"
CORRECTED = (*SCORED, long_sql(), EDGE_SQL, BIN_SQL, ERROR_SQL, FIXED_SQL)


def corrected(retail):
    rows = materialise(scored(retail))
    model, edges = bayes.error_model(rows, TARGETS, "bayes_")
    return bayes.error_correction(rows, model, edges, TARGETS, "bayes_", 0.5)


@query("error_correction", twin("fact", "SELECT session_id, target, round(better, 9) AS score FROM corrected", *CORRECTED))
def error_correction(retail):
    long = bayes.long_scores(corrected(retail), TARGETS, "corrected_", ["session_id"], with_truth=False)
    return long.withColumn("score", F.round("score", 9))


MARGINAL_BLEND = (HISTORY_SQL, VALID_SQL, SEGMENT_SQL, CUSTOMER_SQL, OVERALL_SQL, posterior_sql(DEFAULT_C), *MARGINAL_SQL,
                  BLEND_SQL.replace(" LEFT JOIN latest USING (customer_id) LEFT JOIN patterns USING (c1, c2)", "").replace("COALESCE(p_", "COALESCE(0 * bayes_"))


@query("model_blend", twin("fact", f"""
SELECT session_id, {each('round(0.6::DOUBLE * bayes_{t} + 0.4::DOUBLE * raw_{t}, 11) AS {t}')} FROM blended""", *MARGINAL_BLEND))
def model_blend(retail):
    """Two models of the same sessions: the posterior, and its blend with the marginal rates."""
    retail.keep()
    first = scored(retail).select("session_id", *[F.col(f"bayes_{t}").alias(t) for t in TARGETS])
    second = marginal_blend(retail).select("session_id", *[F.col(f"blend_{t}").alias(t) for t in TARGETS])
    out = bayes.model_blend(first, second, TARGETS)
    return out.select("session_id", *[F.round(t, 11).alias(t) for t in TARGETS])


def without_fold(sql: str, k: int) -> str:
    """A CTE of the history, spelled for the history outside one fold."""
    for name in ("seg", "cust", "overall", "hist", "scored"):
        sql = re.sub(rf"\b{name}\b", f"{name}_{k}", sql)
    return sql


FOLD_MODELS_SQL = tuple(sql for k in range(FOLDS) for sql in (
    f"hist_{k} AS (SELECT * FROM fact WHERE split = 'train' AND session_id % {FOLDS} <> {k})",
    *[without_fold(part, k) for part in (SEGMENT_SQL, CUSTOMER_SQL, OVERALL_SQL, posterior_sql(DEFAULT_C))]))


@query("fold_average", twin("fact", f"SELECT session_id, {each('round(avg(bayes_{t}), 12) AS {t}')} FROM (" + " UNION ALL ".join(
    f"SELECT session_id, {each('bayes_{t}')} FROM scored_{k}" for k in range(FOLDS)) + ") GROUP BY session_id", VALID_SQL, *FOLD_MODELS_SQL))
def fold_average(retail):
    """Validation sessions by four models, each of which has not seen a quarter of the history."""
    retail.keep()
    fold = F.col("session_id") % FOLDS
    parts = [bayes.bayes_posterior(retail.history.filter(fold != k), retail.validation, TARGETS, DEFAULT_CONFIDENCE)
             .select("session_id", *[F.col(f"bayes_{t}").alias(t) for t in TARGETS]) for k in range(FOLDS)]
    out = bayes.fold_average(union_all(*parts), TARGETS)
    return out.select("session_id", *[F.round(t, 12).alias(t) for t in TARGETS])


@query("production_scores")
def production(retail):
    test = retail.keep().facts.filter("split = 'test'")
    out = production_scores(retail.history, retail.validation, test)
    return out.select("session_id", *[F.round(f"corrected_{t}", 9).alias(t) for t in TARGETS])
