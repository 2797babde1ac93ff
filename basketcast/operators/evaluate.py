"""Exact ranking metrics, tuning grids and prediction reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketcast.operators.bayes import (attach_group_stats, bayes_counts, error_by_dimension, long_scores,
                                        posterior, segment_stats)
from basketcast.operators.encode import exact_quantiles
from basketcast.operators.stats import overall_mean
from basketcast.session import one_row


def roc_auc(scores: DataFrame, groups: Sequence[str], score: str = "score", y: str = "y",
            rows: str | None = None) -> DataFrame:
    """Exact area under the ROC curve per group; ties count half.

    Equal scores are counted together first; with ``rows`` each input row stands
    for that many equal ones. The distinct scores are then range partitioned, so
    no task ever sorts a whole group: every slice ranks its own part, and a
    slice-level running total (one row per slice) supplies the negatives below
    it. A group with a single class gets null.
    """
    positive = F.col(y) > 0
    n = F.lit(1.0) if rows is None else F.col(rows).cast("double")
    tallies = (scores.filter(F.col(score).isNotNull() & F.col(y).isNotNull())
               .groupBy(*groups, score)
               .agg(F.sum(F.when(positive, n).otherwise(0.0)).alias("pos"),
                    F.sum(F.when(positive, 0.0).otherwise(n)).alias("neg")))
    sliced = tallies.repartitionByRange(*groups, score).withColumn("slice", F.spark_partition_id())
    below = (Window.partitionBy(*groups, "slice").orderBy(score)
             .rowsBetween(Window.unboundedPreceding, -1))
    parts = (sliced.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
             .groupBy(*groups, "slice")
             .agg(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)).alias("won"),
                  F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min(score).alias("low")))
    before = Window.partitionBy(*groups).orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    stacked = parts.withColumn("under", F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    return stacked.groupBy(*groups).agg(
        F.try_divide(F.sum(F.col("won") + F.col("pos") * F.col("under")), F.sum("pos") * F.sum("neg")).alias("auc"))


def macro_auc(scores: DataFrame, target: str = "target") -> DataFrame:
    """One row: mean of the targets' AUCs."""
    return roc_auc(scores, [target]).agg(F.avg("auc").alias("macro_auc"))


def relative_improvement(before: Column | str, after: Column | str) -> Column:
    """Change in percent of the old value; null for a zero base."""
    before = F.col(before) if isinstance(before, str) else before
    after = F.col(after) if isinstance(after, str) else after
    return F.try_divide(after - before, before) * 100


def weighted_logloss(scores: DataFrame, weights: Mapping[str, float] | DataFrame) -> DataFrame:
    """Log loss with positives weighted, averaged per target, then over targets.

    The logarithms are floored at -100, so a certain miss stays finite.
    """
    if isinstance(weights, DataFrame):
        pairs = weights.unpivot([], list(weights.columns), "target", "weight").agg(
            F.map_from_entries(F.collect_list(F.struct("target", "weight"))).alias("m"))
        scores = scores.withColumn("_weights", pairs.scalar())
        weight = F.try_element_at("_weights", F.col("target"))
    else:
        weight = F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("target"))

    def safe_log(p: Column) -> Column:
        return F.when(p > 0, F.greatest(F.ln(F.when(p > 0, p)), F.lit(-100.0))).otherwise(-100.0)

    hit = F.col("y") > 0
    loss = F.when(hit, -safe_log(F.col("score")) * weight).otherwise(-safe_log(1 - F.col("score")))
    per_target = scores.groupBy("target").agg(F.avg(loss).alias("loss"))
    return per_target.agg(F.avg("loss").alias("logloss"))


def log_grid(low: float = 0.1, high: float = 100.0, steps: int = 30) -> list[float]:
    """Confidence values spaced evenly on a log scale."""
    return [low * (high / low) ** (i / (steps - 1)) for i in range(steps)]


def confidence_scores(history: DataFrame, validation: DataFrame, targets: Sequence[str],
                      grid: Sequence[float]) -> DataFrame:
    """AUC of the posterior per target and confidence value.

    Counts do not depend on the confidence, so they are joined once. Sessions
    with equal counts share every posterior; they are merged before the grid
    multiplies the rows.
    """
    segments = segment_stats(history, targets)
    customers = bayes_counts(history, ("customer_id",), targets)
    joined = attach_group_stats(validation, segments, customers, targets)
    names = ("count", "sum", "count_customer", "sum_customer")
    cells = F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y"), *[
        F.col(f"{t}_{n}").alias(f"x_{n}") for n in names]) for t in targets]))
    shapes = (joined.select(cells).groupBy("target", "y", *[f"x_{n}" for n in names])
              .agg(F.count("*").alias("rows")))
    means = F.col("_overall")
    overall = F.coalesce(*[F.when(F.col("target") == t, means[t]) for t in targets])
    shapes = shapes.withColumn("_overall", one_row(overall_mean(history, targets)))
    tried = shapes.withColumn("confidence", F.explode(F.array(*[F.lit(float(c)) for c in grid])))
    scored = tried.withColumn("score", posterior("x", F.col("confidence"), overall))
    return roc_auc(scored, ["target", "confidence"], rows="rows")


def confidence_grid(history: DataFrame, validation: DataFrame, targets: Sequence[str],
                    grid: Sequence[float] | None = None) -> DataFrame:
    """Best confidence per target; equal AUCs go to the smaller value."""
    tried = confidence_scores(history, validation, targets, grid or log_grid())
    best = F.max_by(F.struct("confidence", "auc"), F.struct(F.col("auc"), -F.col("confidence")))
    return tried.groupBy("target").agg(best.alias("b")).select("target", "b.confidence", "b.auc")


def thresholds(low: float = 0.01, high: float = 0.99, steps: int = 50) -> list[float]:
    return [low + (high - low) * i / (steps - 1) for i in range(steps)]


def threshold_sweep(scores: DataFrame, grid: Sequence[float] | None = None, default: float = 0.5) -> DataFrame:
    """Threshold with the best balanced accuracy per target.

    A score is first mapped to the number of thresholds it reaches: one small
    histogram per target holds everything the sweep needs. The first strict
    maximum above zero wins; otherwise the default stays.
    """
    grid = list(grid or thresholds())
    reached = sum((F.when(F.col("score") >= t, 1).otherwise(0) for t in grid[1:]),
                  F.when(F.col("score") >= grid[0], 1).otherwise(0))
    histogram = scores.withColumn("_k", reached).groupBy("target", "_k").agg(
        F.count_if(F.col("y") > 0).alias("pos"), F.count_if(F.col("y") <= 0).alias("neg"))
    steps = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    swept = histogram.select("*", F.inline(steps)).groupBy("target", "i", "threshold").agg(
        F.sum(F.when(F.col("_k") >= F.col("i"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("_k") >= F.col("i"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # AUC of a yes/no score: mean of hit rate and correct-rejection rate.
    rated = swept.withColumn("balanced", (F.try_divide("tp", "pos") + 1 - F.try_divide("fp", "neg")) / 2)
    usable = F.when(F.col("balanced") > 0, F.struct(F.col("balanced"), -F.col("i")))
    best = rated.groupBy("target").agg(F.max_by(F.struct("threshold", "balanced"), usable).alias("b"))
    return best.select("target", F.coalesce("b.threshold", F.lit(default)).alias("threshold"),
                       F.coalesce("b.balanced", F.lit(0.0)).alias("balanced"))


# --- reports --------------------------------------------------------------

def error_totals(df: DataFrame, targets: Sequence[str], prefix: str) -> DataFrame:
    """Mean, mean absolute, smallest and largest error per target."""
    error = F.col("y") - F.col("score")
    return long_scores(df, targets, prefix, []).groupBy("target").agg(
        F.avg(error).alias("mean_error"), F.avg(F.abs(error)).alias("mae"),
        F.min(error).alias("min_error"), F.max(error).alias("max_error"))


def abs_error_report(df: DataFrame, targets: Sequence[str], prefix: str, edges: DataFrame,
                     dimensions: Sequence[str] = ("age_band", "store", "weekday", "time_band")) -> DataFrame:
    """Mean absolute error per target and segment."""
    report = error_by_dimension(df, targets, prefix, edges, dimensions, absolute=True)
    return report.filter(F.col("dimension") != "bin").withColumnRenamed("mean_error", "mae")


def worst_segments(report: DataFrame, dimension: str = "store", n: int | None = 5) -> DataFrame:
    """Segments by falling error per target, the first ``n`` or all of them."""
    rank = Window.partitionBy("target").orderBy(F.desc("mae"), "value")
    ranked = report.filter(F.col("dimension") == dimension).withColumn("rank", F.row_number().over(rank))
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def prediction_summary(scores: DataFrame) -> DataFrame:
    """Distribution of each target's scores, exact quartiles included."""
    s = F.col("score")
    stats = scores.groupBy("target").agg(
        F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"),
        F.min(s).alias("min"), F.max(s).alias("max"),
        F.avg((s > 0.9).cast("int")).alias("share_above_09"),
        F.avg((s < 0.1).cast("int")).alias("share_below_01"),
        F.avg(((s > 0.99) | (s < 0.01)).cast("int")).alias("share_extreme"))
    points = exact_quantiles(scores, ["target"], "score", [0.25, 0.5, 0.75])
    wide = points.groupBy("target").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
          for p, name in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))])
    return stats.join(F.broadcast(wide), "target")
