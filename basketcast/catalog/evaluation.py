"""Metrics and tuning."""

import re

from pyspark.sql import functions as F

from basketcast.catalog.encoders import scored
from basketcast.catalog.registry import (CUSTOMER_SQL, DEFAULT_C, HISTORY_SQL, OVERALL_SQL, SCORED, SEGMENT_SQL, VALID_SQL, auc_sql,
                                         long_sql, posterior_sql, query, twin)
from basketcast.catalog.scores import CORRECTED, corrected
from basketcast.constants import TARGETS
from basketcast.operators import evaluate
from basketcast.operators.bayes import long_scores
from basketcast.operators.stats import class_weights
from basketcast.plans import bayes_score


def long(retail):
    return long_scores(scored(retail), TARGETS, "bayes_", ["session_id"])


@query("roc_auc", twin("fact", "SELECT target, auc FROM aucs", *SCORED, long_sql(), auc_sql()))
def roc_auc(retail):
    return evaluate.roc_auc(long(retail), ["target"])


@query("macro_auc", twin("fact", "SELECT round(avg(auc), 12) AS macro_auc FROM aucs", *SCORED, long_sql(), auc_sql()))
def macro_auc(retail):
    return evaluate.macro_auc(long(retail)).select(F.round("macro_auc", 12).alias("macro_auc"))


@query("relative_improvement", twin("fact", """
SELECT round((b.m - a.m) / a.m * 100, 6) AS percent FROM (SELECT avg(auc) AS m FROM aucs) a CROSS JOIN (SELECT avg(auc) AS m FROM after) b""",
    *CORRECTED, auc_sql(), "better AS (SELECT target, better AS score, y FROM corrected)", auc_sql("better", "target", "after")))
def relative_improvement(retail):
    rows = corrected(retail)
    both = long_scores(rows, TARGETS, "bayes_", []).withColumn("stage", F.lit("before")).unionByName(
        long_scores(rows, TARGETS, "corrected_", []).withColumn("stage", F.lit("after")))
    aucs = evaluate.roc_auc(both, ["stage", "target"])
    wide = aucs.agg(*[F.avg(F.when(F.col("stage") == s, F.col("auc"))).alias(s) for s in ("before", "after")])
    return wide.select(F.round(evaluate.relative_improvement("before", "after"), 6).alias("percent"))


@query("weighted_logloss", twin("fact", """
SELECT round(avg(loss), 9) AS logloss FROM (
  SELECT target, avg(CASE WHEN y > 0 THEN -w * CASE WHEN score > 0 THEN greatest(ln(CASE WHEN score > 0 THEN score END), -100) ELSE -100 END
                          ELSE -CASE WHEN score < 1 THEN greatest(ln(CASE WHEN score < 1 THEN 1 - score END), -100) ELSE -100 END END) AS loss
  FROM long JOIN weights USING (target) GROUP BY target)""", *SCORED, long_sql(),
    "weights AS (" + " UNION ALL ".join(f"SELECT '{t}' AS target, least(sum(1 - {t}) / CAST(sum({t}) AS DOUBLE), 15.0::DOUBLE) AS w FROM hist" for t in TARGETS) + ")"))
def weighted_logloss(retail):
    out = evaluate.weighted_logloss(long(retail), class_weights(retail.history, TARGETS))
    return out.select(F.round("logloss", 9).alias("logloss"))


GRID_SQL = ("grid AS (SELECT unnest([" + ", ".join(f"CAST({c!r} AS DOUBLE)" for c in evaluate.log_grid()) + "]) AS c)",
            "tried AS (" + " UNION ALL ".join(f"""
  SELECT '{t}' AS target, c, {t} AS y, CASE WHEN COALESCE(cn_{t}, 0) = 0 AND COALESCE(n_{t}, 0) = 0 THEN o_{t}
    WHEN COALESCE(cn_{t}, 0) = 0 THEN COALESCE(s_{t}, 0) / greatest(1, COALESCE(n_{t}, 0))
    ELSE (cs_{t} + c * (COALESCE(s_{t}, 0) / greatest(1, COALESCE(n_{t}, 0)))) / (cn_{t} + c) END AS score
  FROM pred LEFT JOIN seg USING (age_band, gender, store) LEFT JOIN cust USING (customer_id) CROSS JOIN overall CROSS JOIN grid""" for t in TARGETS) + ")")
GRID = (HISTORY_SQL, VALID_SQL, SEGMENT_SQL, CUSTOMER_SQL, OVERALL_SQL, *GRID_SQL, auc_sql("tried", "target, c"))


@query("confidence_scores", twin("fact", "SELECT target, c AS confidence, auc FROM aucs", *GRID))
def confidence_scores(retail):
    retail.keep()
    return evaluate.confidence_scores(retail.history, retail.validation, TARGETS, evaluate.log_grid())


@query("confidence_grid", twin("fact", """
SELECT target, c AS confidence, auc FROM aucs QUALIFY ROW_NUMBER() OVER (PARTITION BY target ORDER BY auc DESC, c) = 1""", *GRID))
def confidence_grid(retail):
    retail.keep()
    return evaluate.confidence_grid(retail.history, retail.validation, TARGETS)


SWEEP_SQL = ("steps AS (SELECT unnest([" + ", ".join(f"CAST({c!r} AS DOUBLE)" for c in evaluate.thresholds()) + "]) AS threshold)",
             """rated AS (SELECT target, threshold, (count_if(y > 0 AND score >= threshold) / CAST(count_if(y > 0) AS DOUBLE)
             + 1 - count_if(y <= 0 AND score >= threshold) / CAST(count_if(y <= 0) AS DOUBLE)) / 2 AS balanced
             FROM long CROSS JOIN steps GROUP BY target, threshold)""")


@query("threshold_sweep", twin("fact", """
SELECT target, threshold, balanced FROM rated QUALIFY ROW_NUMBER() OVER (PARTITION BY target ORDER BY balanced DESC, threshold) = 1""",
    *SCORED, long_sql(), *SWEEP_SQL))
def threshold_sweep(retail):
    return evaluate.threshold_sweep(long(retail))


def later(sql: str) -> str:
    """A CTE of the first history, spelled for both periods together."""
    for name in ("seg", "cust", "overall", "hist"):
        sql = re.sub(rf"\b{name}\b", f"{name}2", sql)
    return sql


TUNED_SQL = ("best AS (SELECT target, c FROM aucs QUALIFY ROW_NUMBER() OVER (PARTITION BY target ORDER BY auc DESC, c) = 1)",
             "hist2 AS (SELECT * FROM fact WHERE split IN ('train', 'valid'))", "new2 AS (SELECT * FROM fact WHERE split = 'test')",
             later(SEGMENT_SQL), later(CUSTOMER_SQL), later(OVERALL_SQL),
             re.sub(r"CAST\(10\.0 AS DOUBLE\)", "TUNED", later(posterior_sql(DEFAULT_C, "new2", "scored2"))))


def with_tuned(sql: str) -> str:
    """The tuned value of each target in place of the fixed one."""
    parts = sql.split(" AS bayes_")
    return " AS bayes_".join(part.replace("TUNED", f"(SELECT c FROM best WHERE target = '{parts[i + 1].split(',')[0].split()[0]}')")
                             if i + 1 < len(parts) else part for i, part in enumerate(parts))


@query("tuned_scores", twin("fact", "SELECT session_id, " + ", ".join(f"bayes_{t}" for t in TARGETS) + " FROM scored2",
                            *GRID, *TUNED_SQL[:-1], with_tuned(TUNED_SQL[-1])))
def tuned_scores(retail):
    retail.keep()
    out = bayes_score.tuned_scores(retail.history, retail.validation, retail.facts.filter("split = 'test'"))
    return out.select("session_id", *[f"bayes_{t}" for t in TARGETS])
