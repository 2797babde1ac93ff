"""Properties of the factorisations, the boosted trees and the tensors."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketcast.catalog.encoders import LEVELS
from basketcast.constants import TARGETS
from basketcast.functions.calendar import calendar_features
from basketcast.operators import boosting, coordinates, factorise, stats, strips
from basketcast.operators.evaluate import macro_auc
from basketcast.operators.bayes import long_scores
from basketcast.plans import boosted
from basketcast.plans.session_tensors import session_tensors
from basketcast.sources.surrogate import BRANDS, MONEY, Retail

SMALL = "/root/testdata/sf0.001"


def sparse(x):
    """Rows of (id, codes, values) without the zeros."""
    return [(i, [int(c) for c in np.flatnonzero(r)], [float(v) for v in r[np.flatnonzero(r)]]) for i, r in enumerate(x)]


SPARSE = "session_id long, codes array<int>, values array<double>"


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(7)
    x = np.maximum(0, rng.normal(size=(200, 3)) ** 2 @ rng.random((3, 12)) + 0.05 * rng.random((200, 12)))
    x[5] = 0
    return x, spark.createDataFrame(sparse(x), SPARSE).repartition(5)


def test_svd_matches_numpy(matrix):
    x, rows = matrix
    basis, values = factorise.svd_fit(rows, 12, 4)
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:4], rtol=1e-9)
    got = np.array([r["embedding"] for r in factorise.project(rows, basis, "session_id").orderBy("session_id").collect()])
    assert np.allclose(got, x @ basis)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(got @ basis.T, (u[:, :4] * s[:4]) @ vt[:4])


def subspace_angle(a, b):
    """Sine of the largest angle between the spans of orthonormal columns."""
    return np.linalg.norm(a - b @ (b.T @ a), 2)


@pytest.mark.parametrize("blocks", [2, factorise.BLOCKS])
def test_range_finder_reaches_the_leading_directions(spark, monkeypatch, blocks):
    """More columns than directions are drawn, a slowly falling spectrum, zeros and a compressed subspace."""
    monkeypatch.setattr(factorise, "BLOCKS", blocks)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 90)) * 0.97 ** np.arange(90) * (rng.random((300, 90)) < 0.4)
    rows = spark.createDataFrame(sparse(x), SPARSE).repartition(4)
    basis, values = factorise.svd_fit(rows, 90, 6, tolerance=1e-11)
    _, s, vt = np.linalg.svd(x)
    assert np.allclose(values, s[:6], rtol=1e-9)
    assert subspace_angle(basis, vt[:6].T) < 1e-6
    assert np.allclose(basis.T @ basis, np.eye(6), atol=1e-9)


@pytest.mark.parametrize("tolerance", [1e-9, 1e-3])
def test_wide_blocks_stay_on_the_executors(spark, monkeypatch, tolerance):
    """No block reaches the driver, and the directions are those of the matrix; rows that are empty or share a key stay."""
    width = 2 * strips.STRIP + 100
    monkeypatch.setattr(factorise, "DRIVER_CELLS", 0)
    monkeypatch.setattr(factorise, "BLOCKS", 3)
    monkeypatch.setattr(factorise, "block_sum", None)
    monkeypatch.setattr(strips, "SLOT", 2)
    rng = np.random.default_rng(3)
    x, places = np.zeros((120, width)), np.sort(rng.permutation(np.r_[:strips.STRIP, 2 * strips.STRIP:width])[:40])
    x[:, places] = rng.normal(size=(120, 40)) * 0.97 ** np.arange(40) * (rng.random((120, 40)) < 0.4)
    x[7] = 0
    rows = spark.createDataFrame([(5 if i == 6 else i, c, v) for i, c, v in sparse(x)], SPARSE).repartition(4)
    basis, values = factorise.svd_fit(rows, width, 6, tolerance=tolerance)
    assert not isinstance(basis, np.ndarray) and basis.shape == (width, 6)
    vectors = np.vstack([np.frombuffer(r["cells"]).reshape(-1, 6) for r in basis.table.orderBy("strip").collect()])
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s[:6], rtol=max(tolerance, 1e-8))
    assert np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-9)
    assert tolerance > 1e-6 or subspace_angle(vectors, vt[:6].T) < 1e-6
    got = sorted((r["session_id"], *r["embedding"]) for r in factorise.project(rows, basis, "session_id").collect())
    assert np.allclose(got, sorted((5 if i == 6 else i, *(line @ vectors)) for i, line in enumerate(x)), atol=1e-8)


@pytest.mark.parametrize("limit", [1, 20, 10_000])
def test_parts_hold_all_rows(monkeypatch, limit):
    monkeypatch.setattr(strips, "PART", limit)
    monkeypatch.setattr(strips.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 2})())
    x = np.random.default_rng(1).integers(0, 3, (40, 9)).astype(float)
    x[3] = 0
    ids, codes, values = zip(*sparse(x))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(codes, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["key", "codes", "values"])
    parts = [p.to_pylist()[0] for p in strips.dealt(iter([batch.slice(0, 15), batch.slice(15)]))]
    assert len({p["part"] for p in parts}) == len(parts) and len(parts) == (40 if limit == 1 else len(parts))
    out = {k: np.zeros(9) for k in range(40)}
    for p in parts:
        code = np.frombuffer(p["codes"], np.int32)[np.frombuffer(p["place"], np.int32)]
        for r, c, v in zip(np.frombuffer(p["row"], np.int32), code, np.frombuffer(p["cells"])):
            out[p["keys"][r]][c] += v
    assert sorted(k for p in parts for k in p["keys"]) == list(range(40)) and np.array_equal(np.array(list(out.values())), x)


@pytest.mark.parametrize("width", [5, 30])
def test_wide_blocks_of_few_and_empty_rows(spark, monkeypatch, width):
    monkeypatch.setattr(factorise, "DRIVER_CELLS", 0)
    x = np.zeros((4, width))
    x[1, [2, 4]], x[2, 2] = (3.0, 4.0), 1.0
    rows = spark.createDataFrame(sparse(x), SPARSE)
    _, values = factorise.svd_fit(rows, width, 5)
    assert np.allclose(values, np.r_[np.linalg.svd(x, compute_uv=False)[:2], 0, 0, 0], atol=1e-6)
    assert not factorise.svd_fit(rows.limit(0), width, 5)[1].any()


def test_svd_of_few_and_empty_rows(spark):
    x = np.zeros((4, 30))
    x[1, [2, 7]], x[2, 2] = (3.0, 4.0), 1.0
    rows = spark.createDataFrame(sparse(x), SPARSE)
    basis, values = factorise.svd_fit(rows, 30, 5)
    assert np.allclose(values, np.r_[np.linalg.svd(x, compute_uv=False)[:2], 0, 0, 0], atol=1e-6)
    assert np.allclose(np.linalg.norm(x @ basis, axis=1), np.linalg.norm(x, axis=1))
    assert not factorise.svd_fit(rows.limit(0), 30, 5)[1].any()


def test_twenty_thousand_categories(spark):
    """Sparse rows, directions and factors of a wide list, without a pivot anywhere."""
    width, n = 20_000, 600
    lines = spark.range(n * 12).select(
        (F.col("id") % n).alias("session_id"), F.concat(F.lit("category."), F.pmod(F.xxhash64("id"), F.lit(width))).alias("category"),
        (1 + F.col("id") % 7).cast("double").alias("quantity"))
    codes = coordinates.rank_codes(spark.range(width).select(F.concat(F.lit("category."), "id").alias("category")), "category").persist()
    assert codes.count() == width and codes.agg(F.max("code"), F.countDistinct("code")).first()[:] == (width - 1, width)
    rows = coordinates.sparse_rows(coordinates.coordinate_matrix(lines, "session_id", codes, "quantity"), "session_id")
    assert "pivot" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()
    basis, values = factorise.svd_fit(rows, width, 8, tolerance=1e-3)
    assert basis.shape == (width, 8) and (np.diff(values) <= 1e-9).all()
    x = np.zeros((n, width))
    for r in rows.collect():
        x[r["session_id"], r["codes"]] = r["values"]
    assert np.allclose(np.sort(np.linalg.eigvalsh(x @ x.T))[::-1][:8] ** 0.5, values, rtol=2e-2)
    factor, errors = factorise.nmf_fit(rows, width, rank=3, rounds=3, sweeps=5)
    assert factor.shape == (3, width) and errors[0] > errors[1] > errors[2]


def test_coordinates_match_the_wide_view(spark):
    lines = spark.createDataFrame([(1, "b.c", 2.0), (1, "a", 1.0), (1, "b.c", 3.0), (2, "B.c", 5.0), (3, None, 9.0), (3, "new", 1.0)],
                                  "session_id long, category string, quantity double")
    codes = coordinates.rank_codes(lines.filter("category <> 'new'"), "category")
    names = [r["category"] for r in codes.orderBy("code").collect()]
    assert names == ["B.c", "a", "b.c"]
    matrix = coordinates.coordinate_matrix(lines, "session_id", codes, "quantity")
    rows = {r["session_id"]: (r["codes"], r["values"]) for r in coordinates.sparse_rows(matrix, "session_id", lines).collect()}
    assert rows == {1: ([1, 2], [1.0, 5.0]), 2: ([0], [5.0]), 3: ([], [])}
    assert sorted(map(tuple, coordinates.wide(matrix, "session_id", names).collect())) == [(1, 0.0, 1.0, 5.0), (2, 5.0, 0.0, 0.0)]
    assert coordinates.rank_codes(lines.limit(0), "category").count() == 0


def test_narrow_matrix_is_kept(matrix):
    x, rows = matrix
    out = factorise.truncated_svd(rows, rows, 12, dim=32, keep_if_narrow=True).orderBy("session_id")
    assert np.allclose([r["embedding"] for r in out.collect()], x)


def test_mean_embedding_commutes_with_projection(spark, matrix):
    x, rows = matrix
    basis, _ = factorise.svd_fit(rows, 12, 4)
    people = spark.range(203).select(F.col("id").alias("session_id"), F.when(F.col("id") < 200, (F.col("id") % 3).cast("string")).otherwise("none").alias("store"))
    out = stats.attribute_mean_embedding(people, factorise.project(rows, basis, "session_id"), 4, ["store"])
    for r in out.collect():
        if r["value"] == "none":
            assert r["embedding"] == [None] * 4
        else:
            assert np.allclose(r["embedding"], x[int(r["value"])::3].mean(axis=0) @ basis)


def test_nmf_properties(matrix):
    x, rows = matrix
    factor, errors = factorise.nmf_fit(rows, 12, rank=3, rounds=12)
    assert (factor >= 0).all()
    assert all(b <= a * (1 + 1e-6) for a, b in zip(errors, errors[1:]))
    w = np.array([r["nmf"] for r in factorise.nmf_transform(rows, factor, "session_id").orderBy("session_id").collect()])
    assert (w >= 0).all()
    u, s, vt = np.linalg.svd(x)
    rank_one = ((x - s[0] * np.outer(u[:, 0], vt[0])) ** 2).sum()
    assert ((x - w @ factor) ** 2).sum() < rank_one
    again, _ = factorise.nmf_fit(rows, 12, rank=3, rounds=12)
    assert np.allclose(factor, again)


def planted(spark, n=600):
    rng = np.random.default_rng(2)
    a, b = rng.random(n), rng.random(n)
    rows = [(i, i % 4, float(u), float(v), *[int(rng.random() < (0.85 if (u if k % 2 else v) > 0.5 else 0.1)) for k in range(4)])
            for i, (u, v) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "session_id long, fold int, a double, b double, choc int, beer int, hair int, rice int")


def test_boosting_learns_reloads_and_isolates_folds(spark, tmp_path):
    df = planted(spark)
    params = {"maxIter": 4, "maxDepth": 3, "featureSubsetStrategy": "all"}
    oof, models = boosting.cross_validate(
        df.withColumn("fold", F.col("fold") % 2), ["a", "b"], TARGETS, 2, params)
    assert oof.count() == 600 and oof.select("session_id").distinct().count() == 600
    assert boosting.oof_macro_auc(oof, TARGETS).first()["macro_auc"] > 0.7
    boosting.save_models(models, str(tmp_path / "m"))
    loaded = boosting.load_models(str(tmp_path / "m"), 2, TARGETS)
    names = [f"score_{t}" for t in TARGETS]
    before = boosting.average_folds(df, models, ["a", "b"], TARGETS).orderBy("session_id").collect()
    after = boosting.average_folds(df, loaded, ["a", "b"], TARGETS).orderBy("session_id").collect()
    assert np.allclose([[r[n] for n in names] for r in before], [[r[n] for n in names] for r in after])
    assert macro_auc(long_scores(df.join(boosting.score_targets(df, models[0], ["a", "b"]), "session_id"), TARGETS, "score_", [])
                     ).first()["macro_auc"] > 0.7


def test_best_round():
    falling = [1 / (i + 1) for i in range(60)]
    assert boosting.best_round(falling + [0.5] * 50, 50) == (60, True)
    assert boosting.best_round(falling + [0.5] * 49, 50) == (60, False)
    assert boosting.best_round(falling + [0.5] * 49 + [0.001] + [0.5] * 50, 50) == (110, True)
    assert boosting.best_round([1.0] * 51, 50) == (1, True) and boosting.best_round([], 50) == (1, False)


def test_patience_cuts_at_the_best_round(spark, monkeypatch):
    """Fits of 60 and then 120 rounds; the 60th of the first 110 is the best."""
    df = planted(spark, 200)
    rows = boosting.vectorise(df, ["a", "b"]).select("features", F.col("choc").cast("double"))
    losses = lambda self, _: [1.0 / min(i + 1, 60) + 0.001 * max(0, i - 59) for i in range(self.getNumTrees)]
    monkeypatch.setattr(boosting.GBTClassificationModel, "evaluateEachIteration", losses)
    settings = {**boosting.PARAMS, "maxDepth": 1, "maxIter": 500}
    model = boosting.fit_patiently(rows, rows, "choc", settings, 50)
    assert model.getNumTrees == 60 and len(model.treeWeights) == 60
    whole = boosting.GBTClassifier(labelCol="choc", **{**settings, "maxIter": 60}).fit(rows)
    shown = lambda m: [r["probability"] for r in m.transform(rows).collect()]
    assert shown(model) == shown(whole)


def test_held_rows_stop_the_boosting(spark, tmp_path):
    df = planted(spark, 400)
    train, held = df.filter("fold > 0"), df.filter("fold = 0")
    params = {"maxIter": 40, "maxDepth": 4, "stepSize": 0.5, "featureSubsetStrategy": "all"}
    models = boosting.fit_targets(train, held, ["a", "b"], ["choc"], params, patience=5)
    assert 1 <= models["choc"].getNumTrees < 40
    boosting.save_models([models], str(tmp_path / "m"))
    loaded = boosting.load_models(str(tmp_path / "m"), 1, ["choc"])[0]
    before, after = (boosting.score_targets(held, m, ["a", "b"]).orderBy("session_id").collect() for m in (models, loaded))
    assert before == after and loaded["choc"].getNumTrees == models["choc"].getNumTrees


def test_gamma_is_a_total_gain(spark):
    """Noise is not split when the least gain is high; a planted signal is, however many rows there are."""
    df = planted(spark, 400).filter("fold > 0")
    params = {"maxIter": 2, "maxDepth": 3, "featureSubsetStrategy": "all"}
    trees = [boosting.fit_targets(df, None, ["a", "b"], ["choc"], params, gamma=g)["choc"].totalNumNodes for g in (0.0, boosting.GAMMA, 1e4)]
    assert trees[0] >= trees[1] > trees[2] == 2


def test_scores_of_the_own_fold_take_one_scan(spark):
    df = planted(spark, 300).withColumn("fold", F.col("fold") % 2)
    oof, models = boosting.cross_validate(df, ["a", "b"], TARGETS, 2, {"maxIter": 3, "maxDepth": 2}, patience=2)
    assert oof._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    for k, fitted in enumerate(models):
        alone = boosting.score_targets(df.filter(F.col("fold") == k), fitted, ["a", "b"]).orderBy("session_id").collect()
        own = oof.filter(F.col("fold") == k).select("session_id", *[f"score_{t}" for t in TARGETS]).orderBy("session_id").collect()
        assert alone == own


def test_feature_frames_and_fold_average(spark):
    retail = Retail(spark, SMALL).keep()
    factors = boosted.fit_factors(retail.log, retail.products, retail.history, dim=3, rounds=2)
    tables = boosted.keyed_features(retail.log, retail.products, retail.history, factors, list(BRANDS.values()))
    per_session = boosted.session_features(retail.sessions, LEVELS)
    frame = boosted.training_frame(retail.validation, tables, per_session, folds=2)
    assert frame.count() == retail.validation.count()
    test = retail.facts.filter("split = 'test'")
    scoring = boosted.scoring_frame(test, retail.validation, tables, per_session)
    features = boosted.feature_names(frame)
    assert set(features) == set(boosted.feature_names(scoring)) and "choc" not in features and "fold" not in features
    _, averaged, _ = boosted.boosted_scores(frame, scoring, folds=2, params={"maxIter": 2, "maxDepth": 2})
    assert averaged.count() == test.count()


def test_tensor_shapes_padding_and_masking(spark):
    retail = Retail(spark, SMALL).keep()
    sessions = calendar_features(retail.sessions).drop("holiday_or_weekend")
    out = session_tensors(sessions, retail.targets, retail.log, retail.products, MONEY, ["category"], dim=4)
    money = stats.money_columns(MONEY)
    assert out.width == 9 + 4 + 2 * len(money) + 2
    for df in (out.train, out.valid, out.test):
        bad = df.filter((F.size("steps") != 5) | F.exists("steps", lambda s: F.size(s) != out.width))
        assert df.count() > 0 and bad.count() == 0
    assert out.valid.count() == retail.validation.count()
    hidden = range(9, 9 + 4 + len(money))
    for r in out.valid.limit(50).collect():
        steps = np.array(r["steps"])
        assert (steps[-1][list(hidden)] == 0).all() and steps[-1][-2] == 0
        filled = [i for i in range(5) if steps[i].any()]
        assert filled == list(range(5 - len(filled), 5))  # padding only in front
    shown = session_tensors(sessions, retail.targets, retail.log, retail.products, MONEY, ["category"], dim=4, mask_target_step=False)
    assert any(np.array(r["steps"])[-1][list(hidden)].any() for r in shown.valid.limit(50).collect())
