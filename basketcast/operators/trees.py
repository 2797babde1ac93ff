"""Boosted trees of one target grown inside one task, on features cut into bins of one byte.

The learner of MLlib is a job for every level of every tree, and begins anew for more rounds. Here the
rows of a fit are numbers of bins that fit into the memory of a task (``CELLS``, a byte each), and every fit
is one task: it boosts round by round until the held rows gain no more. All rows, features and rounds count,
as there: trees on the labels -1 and 1, then on the gradient of the log loss; a share of the rows for each
tree and of the features for each node; splits by variance between at most ``BINS`` bins. Bins hold about
equally many of all training rows, each distinct value one of its own where there are few. Fits end as MLlib
models, through MLlib's own files.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketcast.session import run_folder

# Bins of a row that one task holds, over all rows.
CELLS = 250_000_000
BINS = 32
# Points that stand for the values of a feature in one batch; fewer distinct values are all kept.
POINTS = 512
# Rows of a node up to which all of its features are counted in one step, row by row.
FEW = 2_500
PURE = 1e-16
KNOWN = {"maxIter", "maxDepth", "stepSize", "subsamplingRate", "featureSubsetStrategy", "minInstancesPerNode", "minInfoGain", "seed"}
NODE = np.dtype([("tree", "<i4"), ("id", "<i4"), ("prediction", "<f8"), ("impurity", "<f8"), ("n", "<i8"), ("sum", "<f8"), ("squares", "<f8"),
                 ("gain", "<f8"), ("left", "<i4"), ("right", "<i4"), ("feature", "<i4"), ("threshold", "<f8")])


def subset_size(strategy: str, features: int) -> int | None:
    """Features that a node looks at; None for a rule that is left to MLlib."""
    if strategy in ("all", "auto"):
        return features
    try:
        return min(features, int(strategy)) if strategy.isdigit() else max(1, math.ceil(float(strategy) * features))
    except ValueError:
        return None


def fits_a_task(rows: int, features: int, settings: Mapping[str, object]) -> bool:
    """Whether ``fit_in_tasks`` can take a fit of so many rows, those held included."""
    return 0 < rows * features <= CELLS and set(settings) <= KNOWN and subset_size(str(settings["featureSubsetStrategy"]), features) is not None


# --- Bins ------------------------------------------------------------------------------

def cells_of(batch: pa.RecordBatch) -> np.ndarray:
    """Rows by features."""
    return batch.column("cells").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def thinned(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most ``POINTS`` of the sorted values, evenly by rank, with the counts of all up to them; the ends stay."""
    if len(values) <= POINTS:
        return values, counts
    total = np.cumsum(counts)
    at = np.unique(np.append(np.searchsorted(total, np.linspace(1, total[-1], POINTS - 1)), 0))
    return values[at], np.diff(total[at], prepend=0)


def cuts(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds between sorted distinct values: all where there are few, else those nearest to equal shares."""
    between = (values[1:] + values[:-1]) / 2
    if len(values) <= bins:
        return between
    total = np.cumsum(counts)
    wanted = total[-1] / bins * np.arange(1, bins)
    at = np.clip(np.searchsorted(total, wanted), 1, len(total) - 1)
    at -= wanted - total[at - 1] < total[at] - wanted
    return between[np.unique(np.minimum(at, len(between) - 1))]


def thresholds_of(rows: DataFrame, features: int) -> list[np.ndarray]:
    """Thresholds of every feature over all training rows."""
    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = [thinned(*np.unique(column, return_counts=True)) for column in cells_of(batch).T]
                yield pa.RecordBatch.from_arrays([pa.array(range(features), pa.int32()), *[pa.array([f[i].astype(kind).tobytes() for f in found], pa.binary())
                                                 for i, kind in enumerate((np.float64, np.int64))]], names=["feature", "points", "counts"])

    def merged(group: pa.Table) -> pa.Table:
        points_, counts = (np.frombuffer(b"".join(group.column(c).to_pylist()), kind) for c, kind in (("points", np.float64), ("counts", np.int64)))
        values, at = np.unique(points_, return_inverse=True)
        return pa.table([group.column("feature")[:1], pa.array([cuts(values, np.bincount(at, counts)).tolist()], pa.list_(pa.float64()))], names=["feature", "cuts"])

    found = rows.filter("NOT held").select("cells").mapInArrow(points, "feature int, points binary, counts binary")
    found = found.groupBy("feature").applyInArrow(merged, "feature int, cuts array<double>").collect()
    return [np.array(r["cuts"]) for r in sorted(found)]


def binned(rows: DataFrame, thresholds: Sequence[np.ndarray], targets: int) -> DataFrame:
    """``target, block, held, labels, codes``: blocks of rows, a line of bins for each feature, once for each target."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not len(batch):
                continue
            codes = np.stack([np.searchsorted(t, column) for t, column in zip(thresholds, cells_of(batch).T)]).astype(np.uint8).tobytes()
            held = batch.column("held").to_numpy(zero_copy_only=False).tobytes()
            labels = batch.column("labels").flatten()
            if labels.null_count:
                raise ValueError("labels must not be null")
            labels = labels.to_numpy(zero_copy_only=False).reshape(len(batch), targets)
            if not np.isin(labels, (0.0, 1.0)).all():
                raise ValueError("labels must be 0 or 1")
            for t in range(targets):
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([number]), pa.array([held], pa.binary()),
                                                  pa.array([labels[:, t].astype(np.int8).tobytes()], pa.binary()), pa.array([codes], pa.binary())],
                                                 names=["target", "block", "held", "labels", "codes"])
            number += 1

    return rows.mapInArrow(run, "target int, block long, held binary, labels binary, codes binary")


# --- Trees -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Rules:
    """Settings of a fit."""

    rounds: int
    depth: int
    step: float
    share: float      # of the rows, for each tree
    subset: int       # features of each node
    least_rows: int
    least_gain: float
    seed: int


def rules_of(settings: Mapping[str, object], features: int) -> Rules:
    return Rules(int(settings["maxIter"]), int(settings["maxDepth"]), float(settings["stepSize"]), float(settings["subsamplingRate"]),
                 subset_size(str(settings["featureSubsetStrategy"]), features), int(settings["minInstancesPerNode"]),
                 float(settings["minInfoGain"]), int(settings["seed"]))


class Table:
    """Bins of all rows. Features that part the rows alike, whatever the order of their bins, share one line and its counts."""

    def __init__(self, codes: np.ndarray):
        features, rows = codes.shape
        self.line_of, self.label = np.empty(features, np.int64), np.empty((features, BINS), np.int64)
        seen: dict[bytes, int] = {}
        lines = []
        for i, line in enumerate(codes):
            # Labels in order of first row; bins without rows come last.
            first = np.full(BINS, rows)
            first[line[::-1]] = np.arange(rows - 1, -1, -1)
            self.label[i, np.argsort(first, kind="stable")] = np.arange(BINS)
            named = self.label[i].astype(np.uint8)[line]
            key = hashlib.blake2b(named, digest_size=16).digest()
            if key not in seen:
                seen[key] = len(lines)
                lines.append(named)
            self.line_of[i] = seen[key]
        self.lines = np.stack(lines)
        self.by_row = np.ascontiguousarray(self.lines.T)
        self.features, self.rows = features, rows

    def histograms(self, chosen: np.ndarray, rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and sums of ``values`` (one for each of the rows) in each bin of the chosen features."""
        lines, place = np.unique(self.line_of[chosen], return_inverse=True)
        size = len(lines) * BINS
        if len(rows) <= FEW:
            at = (self.by_row.take(rows, axis=0).take(lines, axis=1) + np.arange(0, size, BINS)).ravel()
            count, total = np.bincount(at, minlength=size), np.bincount(at, np.repeat(values, len(lines)), size)
        else:
            count, total = np.empty((len(lines), BINS), np.int64), np.empty((len(lines), BINS))
            for i, line in enumerate(lines):
                at = self.lines[line].take(rows).astype(np.intp)
                count[i], total[i] = np.bincount(at, minlength=BINS), np.bincount(at, values, BINS)
        at = place[:, None] * BINS + self.label[chosen]
        return count.ravel()[at], total.ravel()[at]

    def left(self, feature: int, last: int) -> Callable[[np.ndarray], np.ndarray]:
        """Which of some rows are in bins up to ``last``."""
        inside, line = np.zeros(BINS, bool), self.lines[self.line_of[feature]]
        inside[self.label[feature, :last + 1]] = True
        return lambda rows: inside[line[rows]]


def best_split(count: np.ndarray, total: np.ndarray, least_rows: int) -> tuple[float, int, int]:
    """(gain in variance, place among the features, last bin on the left); a gain of minus infinity where no split is."""
    n, s = count[0].sum(), total[0].sum()
    left_n, left_s = np.cumsum(count, axis=1)[:, :-1], np.cumsum(total, axis=1)[:, :-1]
    right_n = n - left_n
    allowed = (left_n >= max(least_rows, 1)) & (right_n >= max(least_rows, 1))
    gain = np.where(allowed, (left_s ** 2 / np.maximum(left_n, 1) + (s - left_s) ** 2 / np.maximum(right_n, 1) - s ** 2 / n) / n, -np.inf)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def grown(table: Table, goal: np.ndarray, inside: np.ndarray, outside: np.ndarray, rules: Rules, rng: np.random.Generator) -> tuple[list[tuple], np.ndarray]:
    """Nodes of a tree that learns ``goal`` from the rows ``inside``, in order of descent, and its prediction for all rows."""
    nodes: list[tuple] = []
    predicted = np.zeros(table.rows)

    def descend(inside: np.ndarray, outside: np.ndarray, depth: int) -> int:
        values = goal[inside]
        n, total, squares = len(inside), float(values.sum()), float((values ** 2).sum())
        mean = total / n
        impurity, place = squares / n - mean ** 2, len(nodes)
        nodes.append(())
        gain = -np.inf
        if depth < rules.depth and impurity >= PURE:
            chosen = rng.choice(table.features, rules.subset, replace=False)
            gain, at, last = best_split(*table.histograms(chosen, inside, values), rules.least_rows)
        if gain > 0 and gain >= rules.least_gain:
            is_left = table.left(chosen[at], last)
            here, there = is_left(inside), is_left(outside)
            left = descend(inside[here], outside[there], depth + 1)
            right = descend(inside[~here], outside[~there], depth + 1)
            nodes[place] = (place, mean, impurity, n, total, squares, gain, left, right, int(chosen[at]), last)
        else:
            nodes[place] = (place, mean, impurity, n, total, squares, -1.0, -1, -1, -1, -1)
            predicted[inside] = predicted[outside] = mean
        return place

    descend(inside, outside, 0)
    return nodes, predicted


def boost(table: Table, labels: np.ndarray, held: np.ndarray, rules: Rules, best_of: Callable[[list], tuple[int, bool]] | None) -> list[list[tuple]]:
    """Trees up to the best round. ``best_of``: from the losses of the held rows, the
    rounds up to the best and whether to end; None boosts all rounds."""
    sign = np.where(labels > 0, 1.0, -1.0)
    train, valid = np.flatnonzero(~held), np.flatnonzero(held)
    margin, trees, losses, best = np.zeros(len(sign)), [], [], rules.rounds
    for turn in range(rules.rounds):
        rng = np.random.default_rng([rules.seed & 0xFFFFFFFF, turn])
        goal = 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin)) if turn else sign
        drawn = rng.random(len(train)) < rules.share
        if not drawn.any():
            drawn[:] = True
        nodes, predicted = grown(table, goal, train[drawn], np.concatenate((train[~drawn], valid)), rules, rng)
        margin += predicted * (rules.step if turn else 1.0)
        trees.append(nodes)
        if best_of is not None:
            losses.append(float(np.logaddexp(0.0, -2.0 * sign[valid] * margin[valid]).mean() * 2.0) if len(valid) else math.nan)
            best, ended = best_of(losses)
            if ended:
                break
    return trees[:best]


# --- Fits ------------------------------------------------------------------------------

def fit_in_tasks(train: DataFrame, valid: DataFrame | None, features: int, targets: Sequence[str], rows: int, settings: Mapping[str, object],
                 best_of: Callable[[list], tuple[int, bool]] | None) -> dict[str, GBTClassificationModel]:
    """One model for each target, each fitted by one task. ``train`` and ``valid`` have ``features`` (a vector) and the targets."""
    def shown(df: DataFrame, held: bool) -> DataFrame:
        return df.select(vector_to_array("features").alias("cells"), F.array(*targets).alias("labels"), F.lit(held).alias("held"))

    both = shown(train, False) if valid is None else shown(train, False).unionByName(shown(valid, True))
    thresholds, rules = thresholds_of(both, features), rules_of(settings, features)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks come target by target; each goes to its place as it comes.
        target = None
        for batch in batches:
            for number, held_, labels_, lines in zip(*(batch.column(c) for c in ("target", "held", "labels", "codes"))):
                if number.as_py() != target:
                    if target is not None:
                        yield fitted(target, codes, labels, held, size)
                    target, size = number.as_py(), 0
                    codes, labels, held = np.empty((features, rows), np.uint8), np.empty(rows, np.int8), np.empty(rows, bool)
                line = np.frombuffer(lines.as_buffer(), np.uint8).reshape(features, -1)
                end = size + line.shape[1]
                codes[:, size:end], labels[size:end] = line, np.frombuffer(labels_.as_buffer(), np.int8)
                held[size:end], size = np.frombuffer(held_.as_buffer(), bool), end
        if target is not None:
            yield fitted(target, codes, labels, held, size)

    def fitted(target: int, codes: np.ndarray, labels: np.ndarray, held: np.ndarray, size: int) -> pa.RecordBatch:
        if size != rows:
            raise ValueError(f"{size} of {rows} rows")
        trees = boost(Table(codes), labels, held, rules, best_of)
        found = np.array([(t, *node) for t, nodes in enumerate(trees) for node in nodes], NODE)
        inner = np.flatnonzero(found["left"] >= 0)
        found["threshold"][inner] = [thresholds[f][int(b)] for f, b in zip(found["feature"][inner], found["threshold"][inner])]
        return pa.RecordBatch.from_arrays([pa.array([target], pa.int32()), pa.array([found.tobytes()], pa.binary())], names=["target", "nodes"])

    blocks = binned(both, thresholds, len(targets)).repartitionById(len(targets), F.col("target")).sortWithinPartitions("target", "block")
    found = {r["target"]: np.frombuffer(r["nodes"], NODE) for r in blocks.mapInArrow(fit, "target int, nodes binary").collect()}

    def model(number: int) -> GBTClassificationModel:
        return model_of(train, found[number], targets[number], features, settings)

    with ThreadPool(len(targets)) as pool:
        return dict(zip(targets, pool.map(inheritable_thread_target(model), range(len(targets)))))


def model_of(df: DataFrame, nodes: np.ndarray, target: str, features: int, settings: Mapping[str, object]) -> GBTClassificationModel:
    """MLlib's model of the trees, read from files as it writes them."""
    spark, learner = df.sparkSession, GBTClassifier(labelCol=target, featuresCol="features", **settings)
    trees = int(nodes["tree"].max()) + 1
    folder = f"{run_folder(spark, 'trees')}/model"

    def described(kind: str, uid: str, names: set[str] | None, **more) -> str:
        chosen = [p for p in learner.params if names is None or p.name in names]
        return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
                           "paramMap": {p.name: learner.getOrDefault(p) for p in chosen if learner.isSet(p)},
                           "defaultParamMap": {p.name: learner.getOrDefault(learner.getParam(p.name)) for p in chosen if learner.hasDefault(p) and not learner.isSet(p)}, **more})

    of_tree = {"maxDepth", "minInfoGain", "minInstancesPerNode", "maxBins", "labelCol", "featuresCol"}
    whole = described("classification.GBTClassificationModel", learner.uid, None, numFeatures=features, numTrees=trees)
    parts = [(t, described("regression.DecisionTreeRegressionModel", f"{learner.uid}_{t}", of_tree), float(settings["stepSize"]) if t else 1.0) for t in range(trees)]
    split = pa.StructArray.from_arrays(
        [pa.array(nodes["feature"]), pa.array([[x] if left >= 0 else [] for x, left in zip(nodes["threshold"].tolist(), nodes["left"])], pa.list_(pa.float64())),
         pa.array(np.full(len(nodes), -1, np.int32))], names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    stats = np.stack([nodes["n"].astype(float), nodes["sum"], nodes["squares"]], axis=1)
    data = pa.StructArray.from_arrays(
        [*[pa.array(nodes[c]) for c in ("id", "prediction", "impurity")], pa.array(stats.tolist(), pa.list_(pa.float64())),
         *[pa.array(nodes[c]) for c in ("n", "gain", "left", "right")], split],
        names=["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write
    frame([(whole,)], "value string").text(f"{folder}/metadata")
    frame(parts, "_1 int, _2 string, _3 double").parquet(f"{folder}/treesMetadata")
    spark.createDataFrame(pa.table([pa.array(nodes["tree"]), data], names=["treeID", "nodeData"])).coalesce(1).write.parquet(f"{folder}/data")
    return GBTClassificationModel.load(folder)
