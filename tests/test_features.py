"""Calendar, scalar, cleaning and encoding rules on hand-made rows."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketcast.constants import HOLIDAYS_2024, HOLIDAYS_ALL, TARGETS
from basketcast.functions import calendar, scalars
from basketcast.operators import clean, coordinates, encode, skew, stats
from basketcast.operators.folds import attach_fold, stratified_group_folds


def column(df, name):
    return [r[name] for r in df.collect()]


def test_hours_and_bands(spark):
    texts = ["00:10:00", "5", "6", "07:00:00", "11", "12", "14", "15", "17", "18", "19", "21", "22", "23:59:59", None, "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    rows = df.withColumn("h", calendar.parse_hour("t")).select(
        "h", calendar.time_band("h").alias("band"), calendar.time_period("h").alias("period")).collect()
    assert [r["h"] for r in rows] == [0, 5, 6, 7, 11, 12, 14, 15, 17, 18, 19, 21, 22, 23, None, None]
    assert [r["band"] for r in rows] == [None, "深夜", "深夜", "午前", "午前", "昼", "昼", "午後", "午後", "夕方", "夕方", "夕方",
                                         "夜", "夜", None, None]
    assert [r["period"] for r in rows] == [3, 0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 3, 3, 3]


def test_dates(spark):
    days = [date(2024, 1, 1), date(2024, 1, 6), date(2024, 3, 5), date(2024, 3, 24), date(2024, 3, 25), date(2024, 3, 8),
            date(2024, 3, 22), date(2024, 12, 23), date(2023, 12, 23)]
    df = spark.createDataFrame([(d, 1) for d in days], "sale_date date, hour int").coalesce(1)
    rows = calendar.calendar_features(df).collect()
    assert [r["weekday"] for r in rows] == [d.weekday() for d in days]
    assert [r["weekend"] for r in rows] == [0, 1, 0, 1, 0, 0, 0, 0, 1]
    assert [r["holiday"] for r in rows] == [1, 0, 0, 0, 0, 0, 0, 1, 1]
    assert [r["holiday_or_weekend"] for r in rows] == [1, 1, 0, 1, 0, 0, 0, 0, 1]
    assert [(r["month_start"], r["month_end"], r["month_middle"]) for r in rows][2:5] == [(1, 0, 0), (0, 0, 1), (0, 1, 0)]
    assert [r["second_friday"] for r in rows] == [0, 0, 0, 0, 0, 1, 0, 0, 0]
    assert [r["fourth_friday"] for r in rows] == [0, 0, 0, 0, 0, 0, 1, 0, 0]
    assert len(HOLIDAYS_ALL) == 40 and len(HOLIDAYS_2024) == 21


def test_clip_binarise_and_missing(spark):
    df = spark.createDataFrame([(1.5, 3), (-0.2, 0), (float("nan"), None), (None, -1)], "p double, n int").coalesce(1)
    assert column(df.select(scalars.clip01("p").alias("p")), "p")[:2] == [1.0, 0.0]
    assert column(scalars.binarise(df, ["n"]), "n") == [1, 0, 0, 0]
    assert scalars.nan_report(df, ["p"]).first()["missing"] == 2
    assert column(scalars.nan_guard(df, ["p"]), "p") == [1.5, -0.2, 0.0, 0.0]


def test_max_normalise_fits_on_part_and_guards_zero(spark):
    df = spark.createDataFrame([(10.0, 0.0, 3, "a"), (20.0, 0.0, 1, "b")], "v double, z double, c int, s string").coalesce(1)
    out = scalars.max_normalise(df, ["v", "z"], ["c"], F.col("s") == "a").collect()
    assert [r["v_scaled"] for r in out] == [1.0, 2.0]
    assert [r["z_scaled"] for r in out] == [0.0, 0.0]
    assert [r["c_scaled"] for r in out] == [0.75, 0.25]


def test_cycle_proximity(spark):
    df = spark.createDataFrame([(30.0, 0), (30.0, 60), (30.0, -5), (999.0, 999)], "gap double, days int").coalesce(1)
    assert column(df.select(scalars.cycle_proximity("gap", "days").alias("p")), "p") == [1.0, 0.5, 1.0, 0.0]


def test_returned_targets_exclude_a_session(spark):
    sessions = spark.createDataFrame([(0,), (1,), (2,)], "session_id long")
    log = spark.createDataFrame([(0, 1, -1.0), (1, 2, -1.0), (1, 1, 2.0), (2, 1, 1.0)], "session_id long, jan long, quantity double")
    products = spark.createDataFrame([(1, "beer"), (2, "soap")], "jan long, category string")
    kept = clean.exclude_return_sessions(sessions, log, products, ["beer"])
    assert sorted(column(kept, "session_id")) == [1, 2]


def test_map_category_falls_back_and_drops_unknown(spark):
    log = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 9)], "session_id long, jan long")
    products = spark.createDataFrame([(1, "tea", "food"), (2, "", "food"), (3, None, "")], "jan long, category string, division string")
    out = clean.map_category(log, products, scalars.coalesce_category(["category", "division"]))
    assert {r["session_id"]: r["category"] for r in out.collect()} == {1: "tea", 2: "food", 3: "3"}


def test_debug_sample_is_repeatable(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("customer_id"), "id")
    first = clean.debug_sample(df, 7, seed=1)
    again = clean.debug_sample(df.repartition(5), 7, seed=1)
    assert first.select("customer_id").distinct().count() == 7 and first.count() == 70
    assert sorted(column(first, "id")) == sorted(column(again, "id"))


def test_feature_columns_rejects_unknown_names(spark):
    with pytest.raises(ValueError):
        clean.feature_columns(spark.range(1), ["nope"])


def test_label_codes_and_unknown(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "c string")
    codes = encode.label_encode(train, "c")
    assert {r["c"]: r["code"] for r in codes.collect()} == {"a": 0, "b": 1}
    out = encode.label_transform(spark.createDataFrame([("a",), ("z",), (None,)], "c string"), codes, "c")
    assert sorted((r["c"] or "", r["code"]) for r in out.collect()) == [("", -1), ("a", 0), ("z", -1)]


def test_out_of_fold_encoding_ignores_its_own_fold(spark):
    rows = [("x", 0, 1), ("x", 0, 1), ("x", 1, 0), ("x", 2, 0), ("y", 0, 1), ("z", 1, 1), ("z", 3, 0)]
    frame = spark.createDataFrame(rows, "store string, fold int, choc int")
    got = {(r["store"], r["fold"]): r["store_te_choc"] for r in encode.target_encode_oof(frame, "store", ["choc"]).collect()}
    want = {}
    for s in "xyz":
        for k in range(4):
            other = [t for a, f, t in rows if a == s and f != k]
            if other:
                want[s, k] = sum(other) / len(other)
    assert got == want  # ("y", 0) is missing: no other fold has y
    changed = spark.createDataFrame([(s, f, 1 - t if f == 0 else t) for s, f, t in rows], "store string, fold int, choc int")
    again = {(r["store"], r["fold"]): r["store_te_choc"] for r in encode.target_encode_oof(changed, "store", ["choc"]).collect()}
    assert all(again[k] == v for k, v in got.items() if k[1] == 0)


@pytest.mark.parametrize("values", [list(range(10)), [0.5] * 12, [0.1, 0.2, 0.3] * 4])
def test_decile_edges_match_numpy(spark, values):
    df = spark.createDataFrame([("t", float(v)) for v in values], "target string, score double")
    edges = encode.decile_edges(df, ["target"], "score").first()["edges"]
    want = np.unique(np.quantile(values, np.arange(11) / 10))
    assert np.allclose(edges, want)


def test_exact_quantiles_beyond_the_sketch(spark):
    """Small accuracy and a low row limit force the bracketed path."""
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.random(6000) ** 4, np.full(3000, 0.125)])
    df = spark.createDataFrame([(float(v),) for v in values], "score double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["prob"]: r["quantile"] for r in encode.exact_quantiles(df, [], "score", probs, accuracy=500).collect()}
    assert np.allclose([got[p] for p in probs], np.quantile(values, probs), atol=1e-12)


def test_bin_lookup_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.2, 0.25, 0.3, 9.0)], "v double").coalesce(1)
    edges = F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3))
    assert column(df.select(encode.bin_lookup("v", edges).alias("b")), "b") == [0, 0, 0, 1, 1, 0]


def test_one_hot_null_has_no_level(spark):
    out = encode.one_hot(spark.createDataFrame([("a",), ("b",), (None,)], "c string").coalesce(1), ["c"])
    assert [(r["c_a"], r["c_b"]) for r in out.collect()] == [(1, 0), (0, 1), (0, 0)]


def test_folds_keep_customers_whole_and_balanced(spark):
    rng = np.random.default_rng(0)
    rows = [(int(c), *[int(v) for v in rng.random(4) < 0.2]) for c in rng.integers(0, 300, 4000)]
    df = spark.createDataFrame(rows, "customer_id long, choc int, beer int, hair int, rice int")
    dealt = attach_fold(df, stratified_group_folds(df, TARGETS))
    per_customer = dealt.groupBy("customer_id").agg(F.countDistinct("fold").alias("n"))
    assert per_customer.filter("n <> 1").count() == 0
    sizes = column(dealt.groupBy("fold").count(), "count")
    assert len(sizes) == 4 and max(sizes) < 1.3 * min(sizes)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 11, 100, 997])
def test_exact_quantiles_of_any_size(spark, n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, max(2, n // 2), n) / 7 if n % 2 else rng.random(n)
    probs = [0.0, 0.05, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]
    df = spark.createDataFrame([("t", float(v)) for v in values], "target string, score double")
    got = {r["prob"]: r["quantile"] for r in encode.exact_quantiles(df, ["target"], "score", probs, accuracy=200).collect()}
    assert [got[p] for p in probs] == pytest.approx(np.quantile(values, probs).tolist())


@pytest.mark.parametrize("finish_rows", [1, 40, 100_000])
def test_exact_quantiles_narrow_until_few_rows_are_left(spark, finish_rows):
    """Several groups at once, with ties, a constant and a single row; bounds are refined where intervals stay large."""
    rng = np.random.default_rng(4)
    values = {"a": rng.random(4000) ** 6, "b": np.r_[rng.random(1500), np.full(1500, 0.5)], "c": np.full(300, 2.5), "d": np.array([1.0])}
    rows = [(g, float(v)) for g, held in values.items() for v in held] + [("a", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "target string, score double").repartition(5)
    probs = [0.0, 0.123, 0.5, 0.51, 0.999, 1.0]
    got = {(r["target"], r["prob"]): r["quantile"] for r in
           encode.exact_quantiles(df, ["target"], "score", probs, accuracy=60, finish_rows=finish_rows).collect()}
    assert len(got) == len(values) * len(probs)
    for g, held in values.items():
        assert [got[g, p] for p in probs] == pytest.approx(np.quantile(held, probs).tolist(), abs=1e-12)
    assert encode.exact_quantiles(df.limit(0), ["target"], "score", probs).count() == 0


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_join_small_keeps_every_row(spark, max_bytes):
    rows = spark.range(500).select(F.col("id").alias("session_id"), F.when(F.col("id") % 5 > 0, F.lit("hot")).when(F.col("id") % 2 == 0, "cold").alias("store"))
    table = spark.createDataFrame([("hot", 1.0), ("cold", 2.0), ("none", 3.0)], "store string, mean double")
    got = skew.join_small(rows, table, ["store"], max_bytes=max_bytes)
    assert got.groupBy("store", "mean").count().orderBy("store").collect() == rows.withColumn(
        "mean", F.when(F.col("store") == "hot", 1.0).when(F.col("store") == "cold", 2.0)).groupBy("store", "mean").count().orderBy("store").collect()
    assert ("BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()) == (max_bytes > 0)


def test_categories_with_any_name(spark):
    """Dots, names that differ only in case, and parts of a unit."""
    names = ["Dr. Tea", "Tea", "tea", "a`b"]
    rows = spark.createDataFrame([(1, "Dr. Tea", 0.5), (1, "tea", 2.0), (2, "Tea", -1.0), (2, "a`b", 0.25), (2, "a`b", 0.25)],
                                 "session_id long, category string, quantity double")
    wide = [tuple(r) for r in stats.category_matrix(rows, "session_id", names, "quantity").orderBy("session_id").collect()]
    assert wide == [(1, 0.5, 0.0, 2.0, 0.0), (2, 0.0, -1.0, 0.0, 0.5)]
    held = stats.purchase_indicators(rows, names)
    assert held.columns == ["session_id", *names]
    assert [tuple(r) for r in held.orderBy("session_id").collect()] == [(1, 0.5, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 0.0, 0.5)]
    people = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "session_id long, store string")
    ratio = {r[1]: tuple(r)[2:] for r in stats.purchase_ratio(people, held, names, ["store"]).collect()}
    assert ratio == {"x": (0.25, 0.0, 0.5, 0.25), "y": (None,) * 4}
    codes = coordinates.rank_codes(rows, "category")
    assert [r["category"] for r in codes.orderBy("code").collect()] == sorted(names)
    vectors = coordinates.sparse_rows(coordinates.coordinate_matrix(rows, "session_id", codes, "quantity"), "session_id").orderBy("session_id").collect()
    assert [(r["codes"], r["values"]) for r in vectors] == [([0, 3], [0.5, 2.0]), ([1, 2], [-1.0, 0.5])]
    levels = encode.one_hot(spark.createDataFrame([("A",), ("a",), (None,)], "c string"), ["c"])
    assert levels.columns == ["c", "c_A", "c_a"] and [tuple(r)[1:] for r in levels.collect()] == [(1, 0), (0, 1), (0, 0)]


def test_sparse_one_hot_of_many_levels(spark):
    df = spark.range(12_000).selectExpr("concat('v', id) AS a", "IF(id % 3 = 0, NULL, concat('w', id % 5)) AS b")
    hot = encode.sparse_one_hot(df, ["a", "b"])
    rows = {r["a"]: r["hot"] for r in hot.collect()}
    order = sorted(f"v{i}" for i in range(12_000))
    assert len(rows) == 12_000 and all(rows[v][0] == i for i, v in enumerate(order))
    assert rows["v0"] == [order.index("v0")] and rows["v1"] == [order.index("v1"), 12_000 + 1]
