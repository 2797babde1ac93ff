"""Posterior, blend, corrections and metrics on hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketcast.constants import BLEND_WEIGHTS, DEFAULT_CONFIDENCE, PRODUCTION_CONFIDENCE, TARGETS
from basketcast.functions.calendar import calendar_features
from basketcast.operators import bayes, evaluate, stats
from basketcast.operators.skew import heavy_keys
from basketcast.plans.bayes_score import blended_scores, production_scores, tuned_confidence
from basketcast.sources.surrogate import Retail

SESSION = "session_id long, customer_id long, age_band string, gender string, store string, choc int, beer int, hair int, rice int"


def sessions(spark, rows):
    return spark.createDataFrame([(*r, *([0] * (9 - len(r)))) for r in rows], SESSION)


def brute_auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_posterior_fallbacks(spark):
    past = sessions(spark, [(1, 0, "20s", "f", "A", 1), (2, 0, "20s", "f", "A", 0), (3, 5, "20s", "f", "A", 0), (4, 6, "30s", "m", "B", 1)])
    new = sessions(spark, [(10, 0, "20s", "f", "A"), (11, 99, "20s", "f", "A"), (12, 98, "90s", "f", "A"), (13, 0, None, "f", "A")])
    out = {r["session_id"]: r["bayes_choc"] for r in bayes.bayes_posterior(past, new, TARGETS, DEFAULT_CONFIDENCE).collect()}
    assert out[10] == pytest.approx((1 + 10 * (1 / 3)) / (2 + 10))  # customer 0 is a customer like any other
    assert out[11] == pytest.approx(1 / 3)
    assert out[12] == pytest.approx(0.5)
    assert out[13] == pytest.approx(1 / 12)  # unknown segment: prior 0, own history stays


def test_hot_customers_do_not_change_scores(spark):
    retail = Retail(spark, "/root/testdata/sf0.001").keep()
    heavy = heavy_keys(retail.validation, "customer_id", 1)
    assert heavy.table is not None
    names = [f"bayes_{t}" for t in TARGETS]
    plain = bayes.bayes_posterior(retail.history, retail.validation, TARGETS, PRODUCTION_CONFIDENCE).select("session_id", *names)
    salted = bayes.bayes_posterior(retail.history, retail.validation, TARGETS, PRODUCTION_CONFIDENCE, heavy=heavy).select("session_id", *names)
    assert plain.exceptAll(salted).count() == 0 and salted.count() == plain.count()


def test_marginals_match_separate_groupings(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(9)), rng.choice(["20s", None]), rng.choice(["f", "m"]), rng.choice(["A", "B"]),
             *[int(v) for v in rng.random(4) < 0.4]) for i in range(300)]
    df = spark.createDataFrame([(r[0], r[1], str(r[2]) if r[2] else None, str(r[3]), str(r[4]), *r[5:]) for r in rows], SESSION)
    df = calendar_features(df.withColumns({"sale_date": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("session_id") % 60).cast("int")),
                                           "hour": (F.col("session_id") % 24).cast("int")}))
    table = bayes.marginal_table(df, TARGETS)
    out = bayes.lookup_marginals(df, table, TARGETS)
    for name, keys in bayes.MARGINALS.items():
        means = stats.group_mean(df, keys, TARGETS).withColumnsRenamed({t: f"w_{t}" for t in TARGETS})
        both = out.join(means, list(keys), "left")
        for t in TARGETS:
            assert both.filter(~F.col(f"{name}_{t}").eqNullSafe(F.col(f"w_{t}"))).count() == 0
    overall = bayes.marginal_overall(table, TARGETS).first()
    assert overall["choc"] == pytest.approx(sum(r[5] for r in rows) / 300)


def test_blend_weights_sum_to_one_and_nulls_count_zero(spark):
    for weights in BLEND_WEIGHTS.values():
        assert sum(weights.values()) == pytest.approx(1.0)
    parts = list(BLEND_WEIGHTS["choc"])
    df = spark.range(1).select(*[(F.lit(1.0) if p != "store" else F.lit(None).cast("double")).alias(f"{p}_{t}") for p in parts for t in TARGETS])
    row = bayes.weighted_blend(df, TARGETS).first()
    assert row["blend_choc"] == pytest.approx(1 - BLEND_WEIGHTS["choc"]["store"])


def test_correlation_is_sequential(spark):
    scores = spark.createDataFrame([(0.2, 0.4, 0.1, 0.3)], "choc double, beer double, hair double, rice double")
    shares = {f"{a}_to_{b}": 0.1 * (i + 1) for i, (a, b) in enumerate((a, b) for a in TARGETS for b in TARGETS if a != b)}
    conditionals = spark.createDataFrame([tuple(shares.values())], ", ".join(f"{k} double" for k in shares))
    row = bayes.correlation_correction(scores, conditionals, TARGETS).first()
    p = dict(zip(TARGETS, (0.2, 0.4, 0.1, 0.3)))
    for t in TARGETS:
        add = sum(p[o] * shares[f"{o}_to_{t}"] * bayes.CORRELATION_PAIRS.get((o, t), bayes.CORRELATION_STRENGTH[t])
                  for o in TARGETS if o != t)
        p[t] = min(1.0, max(0.0, p[t] + add))
    assert [row[t] for t in TARGETS] == pytest.approx([p[t] for t in TARGETS])
    other = bayes.correlation_correction(scores, conditionals, TARGETS[::-1]).first()
    assert other["choc"] != row["choc"]


def test_error_correction_moves_scores_by_group_errors(spark):
    rows = [("20s", "A", 0, "朝", 0.1 * (i % 5), int(i % 3 == 0)) for i in range(30)] + [("30s", "B", 1, None, 0.6, 1)] * 10
    df = spark.createDataFrame(rows, "age_band string, store string, weekday int, time_band string, p_choc double, choc int")
    model, edges = bayes.error_model(df, ["choc"], "p_")
    out = bayes.error_correction(df, model, edges, ["choc"], "p_", 0.5).collect()
    err = lambda rs: sum(r["choc"] - r["p_choc"] for r in rs) / len(rs)
    cuts = edges.first()["edges"]
    number = lambda v: next((i - 1 for i in range(1, len(cuts)) if v <= cuts[i]), 0)
    for r in out[:3] + out[-1:]:
        shift = sum(err([q for q in out if q[d] == r[d]]) for d in ("age_band", "store", "weekday"))
        shift += err([q for q in out if q["time_band"] == r["time_band"]]) if r["time_band"] else 0.0
        shift += err([q for q in out if number(q["p_choc"]) == number(r["p_choc"])])
        assert r["corrected_choc"] == pytest.approx(min(1, max(0, r["p_choc"] + shift / 5 * 0.5)))


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_auc_matches_pair_counting(spark, partitions):
    rng = np.random.default_rng(partitions)
    y, s = rng.random(400) < 0.3, np.round(rng.random(400), 2)
    df = spark.createDataFrame([("a", float(v), int(t)) for v, t in zip(s, y)] + [("flat", 0.5, i % 2) for i in range(10)]
                               + [("one", 0.1 * i, 1) for i in range(5)], "target string, score double, y int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["target"]: r["auc"] for r in evaluate.roc_auc(df, ["target"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got["a"] == pytest.approx(brute_auc(y, s), abs=1e-12)
    assert got["flat"] == 0.5 and got["one"] is None


def test_auc_never_sorts_a_group_in_one_task(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("target"), F.rand(1).alias("score"), (F.col("id") % 2).alias("y"))
    plan = evaluate.roc_auc(df, ["target"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(target" in plan.lower() and "SinglePartition" not in plan


def test_threshold_sweep_matches_plain_search(spark):
    rng = np.random.default_rng(4)
    y, s = rng.random(200) < 0.4, rng.random(200)
    df = spark.createDataFrame([("a", float(v), int(t)) for v, t in zip(s, y)] + [("one", 0.3, 1)], "target string, score double, y int")
    got = {r["target"]: r for r in evaluate.threshold_sweep(df).collect()}
    best, at = 0.0, 0.5
    for t in evaluate.thresholds():
        value = brute_auc(y, (s >= t).astype(float))
        if value > best + 1e-12:
            best, at = value, t
    assert (got["a"]["threshold"], got["a"]["balanced"]) == (pytest.approx(at), pytest.approx(best))
    assert got["one"]["threshold"] == 0.5


def test_logloss_and_class_weights(spark):
    df = spark.createDataFrame([("a", 0.8, 1), ("a", 0.4, 0), ("b", 0.0, 1), ("b", 1.0, 1)], "target string, score double, y int")
    got = evaluate.weighted_logloss(df, {"a": 2.0, "b": 3.0}).first()["logloss"]
    a = (-2 * math.log(0.8) - math.log(0.6)) / 2
    assert got == pytest.approx((a + (3 * 100 + 0) / 2) / 2)
    flags = spark.createDataFrame([(1, 0, 0), (0, 0, 0), (0, 0, 1)] + [(0, 0, 1)] * 40, "a int, b int, c int")
    row = stats.class_weights(flags, ["a", "b", "c"]).first()
    assert (row["a"], row["b"], row["c"]) == (15.0, 1.0, pytest.approx(2 / 41))


def test_relative_improvement_of_zero_is_null(spark):
    df = spark.createDataFrame([(0.5, 0.6), (0.0, 0.1)], "a double, b double").coalesce(1)
    assert [r[0] for r in df.select(evaluate.relative_improvement("a", "b")).collect()] == [pytest.approx(20.0), None]


def test_confidence_scores_equal_direct_evaluation(spark):
    retail = Retail(spark, "/root/testdata/sf0.001").keep()
    grid = [0.1, 3.0, 100.0]
    got = {(r["target"], r["confidence"]): r["auc"] for r in
           evaluate.confidence_scores(retail.history, retail.validation, TARGETS, grid).collect()}
    for c in grid:
        scored = bayes.bayes_posterior(retail.history, retail.validation, TARGETS, dict.fromkeys(TARGETS, c))
        for r in evaluate.roc_auc(bayes.long_scores(scored, TARGETS, "bayes_", []), ["target"]).collect():
            assert got[r["target"], c] == pytest.approx(r["auc"], abs=1e-12)
    best = tuned_confidence(retail.history, retail.validation).first().asDict()
    assert set(best) == set(TARGETS) and all(0.1 <= v <= 100.0 + 1e-9 for v in best.values())


def test_scores_do_not_see_later_sessions(spark):
    retail = Retail(spark, "/root/testdata/sf0.001").keep()
    valid = retail.validation
    names = [f"blend_{t}" for t in TARGETS]
    flipped = valid.withColumns({t: 1 - F.col(t) for t in TARGETS})
    a = blended_scores(retail.history, valid, confidence=PRODUCTION_CONFIDENCE).select("session_id", *names)
    b = blended_scores(retail.history, flipped, confidence=PRODUCTION_CONFIDENCE).select("session_id", *names)
    assert a.exceptAll(b).count() == 0 and a.count() == valid.count()


def test_production_scores_cover_every_session_once(spark):
    retail = Retail(spark, "/root/testdata/sf0.001").keep()
    test = retail.facts.filter("split = 'test'")
    out = production_scores(retail.history, retail.validation, test)
    assert out.count() == test.count() == out.select("session_id").distinct().count()
    bad = out.filter(" or ".join(f"corrected_{t} is null or corrected_{t} < 0 or corrected_{t} > 1" for t in TARGETS))
    assert bad.count() == 0
