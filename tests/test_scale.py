"""Shapes of plans that must not grow faster than the tables."""

import re
import threading
import time

import numpy as np
from pyspark.sql import functions as F

from basketcast.catalog.sequences import retail_calendar
from basketcast.operators import boosting, sequences, stats
from basketcast.plans.session_tensors import encoded_sessions, session_vectors
from basketcast.session import store
from basketcast.sources.surrogate import MONEY, Retail


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pivot_moves_narrow_rows_only(spark):
    names = ["a", "b.c", "B.c", "d"]
    rows = spark.createDataFrame(
        [(1, "a", 2.0), (1, "a", 3.0), (1, "b.c", 1.0), (2, "B.c", -1.0), (2, "x", 9.0), (3, None, 4.0), (None, "a", 5.0), (4, "d", None)],
        "session_id long, category string, quantity double")
    want = {1: (5.0, 1.0, 0.0, 0.0), 2: (0.0, 0.0, -1.0, 0.0), 3: (0.0,) * 4, None: (5.0, 0.0, 0.0, 0.0), 4: (0.0,) * 4}
    for hot in (False, True):
        wide, _ = stats.coded_matrix(rows, "session_id", names, "quantity", hot)
        assert {r[0]: tuple(r)[1:] for r in wide.collect()} == want
        plan = plan_of(wide)
        assert "pivotfirst" not in plan.lower()
        # Wide sums are made behind the last exchange, once per key and not once per line.
        top = [line for line in plan.split("\n") if "Exchange" in line or "Aggregate" in line]
        assert re.search("Aggregate.*c3", plan.split("Exchange")[0].replace("\n", " ")) and len(top) >= 2


def test_mean_embedding_needs_no_sort_of_all_rows(spark):
    sessions = spark.range(40).select(F.col("id").alias("session_id"), (F.col("id") % 7).alias("customer_id"),
                                      F.when(F.col("id") % 3 < 2, (F.col("id") % 3).cast("string")).alias("store"))
    vectors = spark.range(0, 40, 2).select(F.col("id").alias("session_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    out = stats.attribute_mean_embedding(sessions, vectors, 2, ["customer_id", "store"])
    assert "ObjectHashAggregate" not in plan_of(out) and "SortAggregate" not in plan_of(out)
    got = {(r["dimension"], r["value"]): r["embedding"] for r in out.collect()}
    for c in range(7):
        mine = [i for i in range(0, 40, 2) if i % 7 == c]
        assert np.allclose(got["customer_id", str(c)], [np.mean(mine), 1.0])
    assert set(got) == {("customer_id", str(c)) for c in range(7)} | {("store", s) for s in ("0", "1", None)}
    lone = stats.attribute_mean_embedding(sessions.filter("session_id = 1"), vectors, 2, ["customer_id"]).first()
    assert lone["embedding"] == [None, None]


def test_runs_are_slices_of_their_block(spark):
    """The same steps as windows that carry the vectors, whatever the blocks; each vector is moved once."""
    rows = spark.range(60).select((F.col("id") % 3).alias("customer_id"), F.col("id").alias("session_id"), (F.col("id") / 3).cast("int").cast("long").alias("pos"),
                                  F.when(F.col("id") % 5 > 0, F.array(F.col("id").cast("double"))).alias("features"))
    want = sequences.sliding_windows(rows, 4, step="features")
    runs = sequences.sliding_windows(rows, 4)
    for block_rows in (4, 7, 1000):
        got = sequences.run_steps(runs.unionByName(runs.filter("start = 3")), rows, "features", 4, block_rows=block_rows)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.unionByName(want.filter("start = 3")).collect()), key=str)


def test_step_features_read_stored_statistics(spark):
    """Customer money is made once and stored; the vectors' own plan only takes maxima and looks for hot customers' rows."""
    retail = Retail(spark, "/root/testdata/sf0.001")
    sessions = store(encoded_sessions(retail_calendar(retail)))
    vectors, _ = session_vectors(sessions, retail.log, retail.products, MONEY, ["category"])
    plan = vectors._jdf.queryExecution().optimizedPlan().toString()
    assert "customer_id" not in "".join(re.findall(r"Aggregate \[.*", plan)) and "map_from_arrays" not in plan


def test_folds_of_few_rows_are_fitted_side_by_side(spark, monkeypatch):
    df = spark.range(40).select(F.col("id").alias("session_id"), (F.col("id") % 4).cast("int").alias("fold"))
    for few, most in ((40, 4), (39, 1)):
        lock, now, seen = threading.Lock(), [0], []

        def fit(train, held, *_):
            with lock:
                now[0] += 1
                seen.append(now[0])
            time.sleep(1)
            with lock:
                now[0] -= 1
            return {"fold": held.first()["fold"]}

        monkeypatch.setattr(boosting, "FEW_ROWS", few)
        monkeypatch.setattr(boosting, "fit_targets", fit)
        monkeypatch.setattr(boosting, "score_own_fold", lambda *_: None)
        _, models = boosting.cross_validate(df, [], [], 4)
        assert [m["fold"] for m in models] == [0, 1, 2, 3] and max(seen) <= most and (most == 1 or max(seen) > 1)
