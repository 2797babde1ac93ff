import numpy as np
import pytest
from pyspark.sql import functions as F

from basketcast.catalog import models as catalog
from basketcast.constants import TARGETS
from basketcast.operators import boosting, trees
from basketcast.plans import boosted


def rows_of(spark, n=500, seed=3):
    rng = np.random.default_rng(seed)
    a, b = rng.random(n).round(2), rng.integers(0, 4, n).astype(float)
    rows = [(i, i % 4, float(u), float(v), float(-v), *[int(rng.random() < (0.85 if (u > 0.5) != (v == k) else 0.1)) for k in range(4)])
            for i, (u, v) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "session_id long, fold int, a double, b double, c double, choc int, beer int, hair int, rice int")


@pytest.mark.parametrize("name", ["boosted_multi_target", "oof_cv_loop", "ensemble_scores"])
def test_queries_boost_until_fifty_rounds_gain_nothing(spark, monkeypatch, name):
    """The plan's own patience, for each of the queries."""
    class Seen(Exception):
        pass

    def fits(frame, features, targets, folds, params=None, fold="fold", patience=None):
        raise Seen(patience, params)

    monkeypatch.setattr(boosted, "cross_validate", fits)
    monkeypatch.setattr(catalog, "learning_parts", lambda *_: (rows_of(spark, 20), {}, None))
    with pytest.raises(Seen) as seen:
        getattr(catalog, name)(catalog_retail(spark))
    assert seen.value.args == (50, None) and boosting.PATIENCE == 50 and boosting.PARAMS["maxIter"] == 1000


def catalog_retail(spark):
    from basketcast.sources.surrogate import Retail
    return Retail(spark, "/root/testdata/sf0.001")


def naive(codes, chosen, rows, values):
    count, total = np.zeros((len(chosen), trees.BINS), int), np.zeros((len(chosen), trees.BINS))
    for i, f in enumerate(chosen):
        for r, v in zip(rows, values):
            count[i, codes[f, r]] += 1
            total[i, codes[f, r]] += v
    return count, total


def test_histograms_and_splits(monkeypatch):
    """By line and by row, with features that share a line, against plain sums and all splits tried."""
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 5, (6, 90)).astype(np.uint8)
    codes[4], codes[5] = 9 - codes[0], 31 - codes[1]
    table = trees.Table(codes)
    assert len(table.lines) == 4
    rows, chosen = np.sort(rng.choice(90, 60, replace=False)), np.array([5, 0, 4, 2])
    values = rng.standard_normal(60)
    count, total = naive(codes, chosen, rows, values)
    for few in (1000, 10):
        monkeypatch.setattr(trees, "FEW", few)
        got = table.histograms(chosen, rows, values)
        assert (got[0] == count).all() and np.allclose(got[1], total)
    gain, at, last = trees.best_split(count, total, 3)
    tried = {}
    for i, f in enumerate(chosen):
        for b in range(trees.BINS - 1):
            here = codes[f, rows] <= b
            if min(here.sum(), (~here).sum()) >= 3:
                tried[i, b] = values.var() - here.mean() * values[here].var() - (~here).mean() * values[~here].var()
            assert (table.left(f, b)(rows) == here).all()
    assert np.isclose(gain, max(tried.values())) and np.isclose(tried[at, last], gain)


def test_cuts_lie_between_all_few_values_and_share_many_evenly():
    assert trees.cuts(np.array([1.0, 2.0, 4.0]), np.array([1, 100, 1])).tolist() == [1.5, 3.0]
    assert trees.cuts(np.array([7.0]), np.array([5])).tolist() == []
    values = np.arange(5000.0)
    found = trees.cuts(values, np.ones(5000, int))
    assert len(found) == 31 and np.abs(found - np.arange(1, 32) * 5000 / 32).max() <= 1
    thin = trees.cuts(*trees.thinned(values, np.ones(5000, int)))
    assert len(thin) == 31 and np.abs(thin - found).max() <= 5000 / trees.POINTS
    heavy = trees.cuts(values, np.where(values == 100, 10 ** 6, 1))
    assert heavy.tolist() == [99.5, 100.5] or {99.5, 100.5} & set(heavy.tolist())


def test_models_of_tasks_score_as_they_were_boosted(spark):
    """Model files against margins put together from the nodes; blocks keep the order of rows of one partition."""
    df = rows_of(spark).coalesce(1)
    features, params = ["a", "b", "c"], {"maxIter": 7, "maxDepth": 4, "featureSubsetStrategy": "0.5", "stepSize": 0.3}
    train, held = df.filter("fold > 0"), df.filter("fold = 0")
    model = boosting.fit_targets(train, held, features, ["beer"], params, patience=50)["beer"]
    rows = [*train.collect(), *held.collect()]
    x, y = np.array([[r[f] for f in features] for r in rows]).T, np.array([r["beer"] for r in rows])
    out = np.array([r["fold"] == 0 for r in rows])
    edges = [trees.cuts(*np.unique(line[~out], return_counts=True)) for line in x]
    codes = np.stack([np.searchsorted(e, line) for e, line in zip(edges, x)]).astype(np.uint8)
    rules = trees.rules_of({"minInfoGain": boosting.GAMMA / (~out).sum(), **boosting.PARAMS, **params}, 3)
    losses = []
    found = trees.boost(trees.Table(codes), y, out, rules, lambda seen: (losses.clear(), losses.extend(seen), (7, False))[-1])
    margin = np.zeros(len(y))
    for turn, nodes in enumerate(found):
        for i in range(len(y)):
            at = 0
            while nodes[at][7] >= 0:
                at = nodes[at][7] if codes[nodes[at][9], i] <= nodes[at][10] else nodes[at][8]
            margin[i] += nodes[at][1] * (0.3 if turn else 1.0)
    best = int(np.argmin(losses)) + 1
    assert model.getNumTrees == best and len(losses) == 7 and model.treeWeights == [1.0] + [0.3] * (best - 1)
    assert np.isclose(losses[-1], 2 * np.logaddexp(0, -2 * np.where(y > 0, 1, -1) * margin)[out].mean())
    vectors = boosting.vectorise(held, features).select("features", F.col("beer").cast("double"))
    assert np.allclose(model.evaluateEachIteration(vectors), losses[:best])
    assert min(losses) < 2 * np.log(2)


def test_a_fit_is_one_row_of_jobs_however_many_rounds(spark):
    df, context = rows_of(spark, 200), spark.sparkContext
    jobs = []
    for rounds in (2, 30):
        group = f"rounds-{rounds}"
        context.setJobGroup(group, group)
        made = boosting.fit_targets(df.filter("fold > 0"), df.filter("fold = 0"), ["a", "b"], ["choc", "rice"], {"maxIter": rounds, "stepSize": 0.01})
        assert set(made) == {"choc", "rice"} and max(m.getNumTrees for m in made.values()) <= rounds
        jobs.append(len(context.statusTracker().getJobIdsForGroup(group)))
    context.setJobGroup(None, None)
    assert jobs[1] <= jobs[0] + 4


def test_both_learners_find_the_signal(spark, monkeypatch):
    """Fits beyond the room of a task go to MLlib's learner; both fit the same rows with the same settings."""
    df = rows_of(spark, 400)
    train, held, losses = df.filter("fold > 0"), df.filter("fold = 0"), []
    rows = boosting.vectorise(held, ["a", "b"]).select("features", F.col("choc").cast("double"))
    for cells in (trees.CELLS, 10):
        monkeypatch.setattr(trees, "CELLS", cells)
        model = boosting.fit_targets(train, held, ["a", "b"], ["choc"], {"maxIter": 8, "maxDepth": 3, "stepSize": 0.3, "featureSubsetStrategy": "all"}, patience=5)["choc"]
        losses.append(min(model.evaluateEachIteration(rows)))
    assert max(losses) < 1.2 and abs(losses[0] - losses[1]) < 0.1


def test_labels_other_than_flags_are_refused(spark):
    df = rows_of(spark, 40).withColumn("choc", F.when(F.col("session_id") > 5, F.col("choc")))
    with pytest.raises(Exception, match="null"):
        boosting.fit_targets(df, None, ["a", "b"], ["choc"], {"maxIter": 1})
