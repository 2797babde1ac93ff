"""Empirical-Bayes scores, blending and corrections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketcast.constants import (ATTRIBUTES, BLEND_WEIGHTS, CORRELATION_PAIRS, CORRELATION_STRENGTH,
                                  MODEL_BLEND)
from basketcast.functions.scalars import clip01
from basketcast.operators.encode import bin_lookup, decile_edges
from basketcast.operators.skew import BROADCAST_BYTES, HeavyKeys, byte_sizes, join_small, join_statistics
from basketcast.operators.stats import overall_mean
from basketcast.session import materialise, one_row

# Key columns of the marginal means the blend reads.
MARGINALS = {
    "segment": ATTRIBUTES,
    "weekday": ("weekday",),
    "band": ("time_band",),
    "phase": ("month_start", "month_end"),
    "store": ("store",),
}


def bayes_counts(history: DataFrame, keys: Sequence[str], targets: Sequence[str],
                 weights: Mapping[str, str] | None = None) -> DataFrame:
    """Known flags and purchases per key: ``{t}_count`` and ``{t}_sum``.

    ``weights`` may name a weight column per target, such as a time decay.
    """
    def count(t: str) -> Column:
        return F.count(t) if not weights else F.sum(F.when(F.col(t).isNotNull(), F.col(weights[t])))

    def total(t: str) -> Column:
        return F.sum(t) if not weights else F.sum(F.col(t) * F.col(weights[t]))

    return history.dropna(subset=list(keys)).groupBy(*keys).agg(
        *[f for t in targets for f in (count(t).alias(f"{t}_count"), total(t).alias(f"{t}_sum"))])


def segment_stats(history: DataFrame, targets: Sequence[str], attributes: Sequence[str] = ATTRIBUTES,
                  weights: Mapping[str, str] | None = None) -> DataFrame:
    """Stored counts per segment."""
    return materialise(bayes_counts(history, attributes, targets, weights))


def attach_group_stats(sessions: DataFrame, segment_counts: DataFrame, customer_counts: DataFrame,
                       targets: Sequence[str], attributes: Sequence[str] = ATTRIBUTES,
                       customer: str = "customer_id", heavy: HeavyKeys | None = None,
                       segment_size: int | None = None, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Segment and customer counts next to each session, 0 where unknown.

    A shuffle by segment would send all its sessions to one task, see ``join_small``.
    """
    names = [f"{t}_{s}" for t in targets for s in ("count", "sum")]
    theirs = customer_counts.withColumnsRenamed({n: f"{n}_customer" for n in names})
    joined = join_small(join_statistics(sessions, theirs, customer, heavy), segment_counts, attributes, size=segment_size, max_bytes=max_bytes)
    return joined.fillna(0, subset=[*names, *[f"{n}_customer" for n in names]])


def posterior(target: str, confidence: Column | float, overall: Column) -> Column:
    """Purchase probability from the customer's own counts and the segment's.

    The segment acts as ``confidence`` extra sessions. Unknown customers get
    the segment mean, and unknown segments on top of that the overall mean.
    """
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    n, bought = F.col(f"{target}_count_customer"), F.col(f"{target}_sum_customer")
    prior = F.col(f"{target}_sum") / F.greatest(F.lit(1), F.col(f"{target}_count"))
    return (F.when((n == 0) & (F.col(f"{target}_count") == 0), overall)
            .when(n == 0, prior)
            .otherwise((bought + c * prior) / (n + c)))


def bayes_posterior(history: DataFrame, sessions: DataFrame, targets: Sequence[str],
                    confidence: Mapping[str, float] | DataFrame, attributes: Sequence[str] = ATTRIBUTES,
                    customer: str = "customer_id", segment_counts: DataFrame | None = None,
                    overall: DataFrame | None = None, weights: Mapping[str, str] | None = None,
                    heavy: HeavyKeys | None = None, segment_size: int | None = None) -> DataFrame:
    """Sessions with one posterior ``bayes_{t}`` per target.

    Segment counts and the overall mean may be passed in when already known.
    ``confidence`` may be a frame with one row and a column per target, such as
    a tuned one; it then stays inside the plan as a scalar subquery.
    """
    segments = segment_counts if segment_counts is not None else segment_stats(
        history, targets, attributes, weights)
    customers = bayes_counts(history, [customer], targets, weights)
    means = one_row(overall if overall is not None else overall_mean(history, targets))
    joined = attach_group_stats(sessions, segments, customers, targets, attributes, customer, heavy, segment_size)
    joined = joined.withColumn("_overall", means)
    if isinstance(confidence, DataFrame):
        joined = joined.withColumn("_confidence", one_row(confidence))
        confidence = {t: F.col("_confidence")[t] for t in targets}
    return joined.select(*sessions.columns, *[
        posterior(t, confidence[t], F.col("_overall")[t]).alias(f"bayes_{t}") for t in targets])


def marginal_table(history: DataFrame, targets: Sequence[str],
                   marginals: Mapping[str, Sequence[str]] = MARGINALS) -> DataFrame:
    """Counts and sums for every marginal, and overall, in one pass.

    The grouping sets share one scan and combine on the map side. The stored
    result is small: one row per observed value of each marginal.
    """
    keys = list(dict.fromkeys(k for columns in marginals.values() for k in columns))
    grouped = history.groupingSets([*[list(c) for c in marginals.values()], []], *keys).agg(
        F.grouping_id().alias("_gid"),
        *[f for t in targets for f in (F.count(t).alias(f"{t}_count"), F.sum(t).alias(f"{t}_sum"))])
    # In a grouping id the bits of the grouped keys are 0.
    bit = {k: 1 << (len(keys) - 1 - i) for i, k in enumerate(keys)}
    everything = sum(bit.values())
    name = F.when(F.col("_gid") == everything, "overall")
    for label, columns in marginals.items():
        hit = F.col("_gid") == everything - sum(bit[k] for k in columns)
        name = name.when(hit, label)
    return materialise(grouped.select(name.alias("marginal"), *keys, *[
        f"{t}_{s}" for t in targets for s in ("count", "sum")]))


def marginal_counts(table: DataFrame, label: str, targets: Sequence[str],
                    marginals: Mapping[str, Sequence[str]] = MARGINALS) -> DataFrame:
    """Counts and sums of one marginal."""
    keys = list(marginals[label])
    part = table.filter(F.col("marginal") == label).dropna(subset=keys)
    return part.select(*keys, *[f"{t}_{s}" for t in targets for s in ("count", "sum")])


def marginal_overall(table: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Overall target means, as one row."""
    return table.filter(F.col("marginal") == "overall").agg(*[
        F.try_divide(F.first(f"{t}_sum"), F.first(f"{t}_count")).alias(t) for t in targets])


def lookup_marginals(sessions: DataFrame, table: DataFrame, targets: Sequence[str],
                     marginals: Mapping[str, Sequence[str]] = MARGINALS,
                     sizes: Mapping[str, int] | None = None, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Marginal means ``{marginal}_{t}`` next to each session, null if unseen."""
    out = sessions
    sizes = sizes if sizes is not None else byte_sizes(table, "marginal")
    for label, keys in marginals.items():
        means = {f"{label}_{t}": F.try_divide(F.col(f"{t}_sum"), F.col(f"{t}_count")) for t in targets}
        part = marginal_counts(table, label, targets, marginals)
        out = join_small(out, part, keys, size=sizes.get(label, 0), max_bytes=max_bytes).withColumns(means).drop(
            *[f"{t}_{s}" for t in targets for s in ("count", "sum")])
    return out.select(*sessions.columns, *[f"{label}_{t}" for label in marginals for t in targets])


def weighted_blend(df: DataFrame, targets: Sequence[str],
                   weights: Mapping[str, Mapping[str, float]] = BLEND_WEIGHTS) -> DataFrame:
    """Weighted sum of the component scores ``{component}_{t}``; nulls count 0."""
    def blend(t: str) -> Column:
        parts = [F.coalesce(F.col(f"{name}_{t}"), F.lit(0.0)) * F.lit(w) for name, w in weights[t].items()]
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return total
    return df.withColumns({f"blend_{t}": blend(t) for t in targets})


def correlation_correction(df: DataFrame, conditionals: DataFrame, targets: Sequence[str], prefix: str = "",
                           strength: Mapping[str, float] = CORRELATION_STRENGTH,
                           pairs: Mapping[tuple[str, str], float] = CORRELATION_PAIRS) -> DataFrame:
    """Add what the scores of the other targets say, one target after the other.

    A later target sees the already corrected values of the earlier ones, so
    the columns are chained on purpose.
    """
    share = F.col("_share")
    out = df.withColumn("_share", one_row(conditionals))
    for t in targets:
        value = F.col(f"{prefix}{t}")
        pull = F.lit(0.0)
        for other in targets:
            if other != t:
                weight = pairs.get((other, t), strength[t])
                pull = pull + F.col(f"{prefix}{other}") * F.coalesce(share[f"{other}_to_{t}"], F.lit(0.0)) * F.lit(weight)
        out = out.withColumn(f"{prefix}{t}", clip01(value + pull))
    return out.drop("_share")


# --- error model ----------------------------------------------------------

ERROR_DIMENSIONS = ("age_band", "store", "weekday", "time_band")


def long_scores(df: DataFrame, targets: Sequence[str], prefix: str, keep: Sequence[str],
                with_truth: bool = True) -> DataFrame:
    """One row per session and target: score, and the flag when known."""
    cells = [F.struct(F.lit(t).alias("target"), F.col(f"{prefix}{t}").alias("score"),
                      *([F.col(t).alias("y")] if with_truth else [])) for t in targets]
    return df.select(*keep, F.inline(F.array(*cells)))


def error_by_dimension(df: DataFrame, targets: Sequence[str], prefix: str, edges: DataFrame,
                       dimensions: Sequence[str] = ERROR_DIMENSIONS, absolute: bool = False) -> DataFrame:
    """Mean error per target by each dimension and by score bin, in long form.

    ``absolute`` gives mean absolute errors. One grouped pass over the scores.
    """
    scored = long_scores(df, targets, prefix, list(dimensions)).join(F.broadcast(edges), "target")
    error = F.col("y") - F.col("score")
    cells = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]
    cells.append(F.struct(F.lit("bin").alias("dimension"),
                          bin_lookup("score", "edges").cast("string").alias("value")))
    return (scored.withColumn("error", F.abs(error) if absolute else error)
            .select("target", "error", F.inline(F.array(*cells)))
            .filter(F.col("value").isNotNull())
            .groupBy("target", "dimension", "value").agg(F.avg("error").alias("mean_error")))


def error_model(df: DataFrame, targets: Sequence[str], prefix: str,
                dimensions: Sequence[str] = ERROR_DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """(mean errors, bin edges), both stored: the fitted correction."""
    scores = long_scores(df, targets, prefix, [])
    edges = materialise(decile_edges(scores, ["target"], "score"))
    return materialise(error_by_dimension(df, targets, prefix, edges, dimensions)), edges


def error_correction(df: DataFrame, model: DataFrame, edges: DataFrame, targets: Sequence[str], prefix: str,
                     strength: float, dimensions: Sequence[str] = ERROR_DIMENSIONS,
                     out_prefix: str = "corrected_", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Move each score by the mean error of its groups, clipped to [0, 1].

    A group the model has not seen adds 0; the divisor is the number of
    dimensions. Model rows of all targets are pivoted to one row per value, so
    sessions stay one row each and meet each dimension in one join.
    """
    out = df
    sizes = byte_sizes(model, "dimension")
    shifts = {t: F.lit(0.0) for t in targets}
    for d in dimensions:
        wide = (model.filter(F.col("dimension") == d).groupBy("value").agg(
            *[F.max(F.when(F.col("target") == t, F.col("mean_error"))).alias(f"_{d}_{t}") for t in targets])
            .withColumnRenamed("value", f"_{d}"))
        out = join_small(out.withColumn(f"_{d}", F.col(d).cast("string")), wide, [f"_{d}"], size=sizes.get(d, 0), max_bytes=max_bytes).drop(f"_{d}")
        for t in targets:
            shifts[t] = shifts[t] + F.coalesce(F.col(f"_{d}_{t}"), F.lit(0.0))
    bins = F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws("|", "target", "value"), F.col("mean_error"))))
    # Fixed size: at most ten bins and eleven edges per target.
    by_bin = model.filter(F.col("dimension") == "bin").agg(bins.alias("m")).scalar()
    cuts = edges.agg(F.map_from_entries(F.collect_list(F.struct("target", "edges"))).alias("m")).scalar()
    out = out.withColumns({"_bins": by_bin, "_cuts": cuts})
    for t in targets:
        number = bin_lookup(F.col(f"{prefix}{t}"), F.try_element_at("_cuts", F.lit(t)))
        hit = F.try_element_at("_bins", F.concat_ws("|", F.lit(t), number.cast("string")))
        shifts[t] = shifts[t] + F.coalesce(hit, F.lit(0.0))
    parts = len(dimensions) + 1
    out = out.withColumns({f"{out_prefix}{t}": clip01(F.col(f"{prefix}{t}") + shifts[t] / F.lit(parts) * F.lit(strength))
                           for t in targets})
    return out.select(*df.columns, *[f"{out_prefix}{t}" for t in targets])


# --- combining models -----------------------------------------------------

def model_blend(first: DataFrame, second: DataFrame, targets: Sequence[str],
                weights: tuple[float, float] = MODEL_BLEND, key: str = "session_id") -> DataFrame:
    """Weighted mean of two models' scores, matched by key."""
    a = first.select(key, *[F.col(t).alias(f"_a_{t}") for t in targets])
    b = second.select(key, *[F.col(t).alias(f"_b_{t}") for t in targets])
    return a.join(b, key).select(key, *[
        (F.lit(weights[0]) * F.col(f"_a_{t}") + F.lit(weights[1]) * F.col(f"_b_{t}")).alias(t) for t in targets])


def fold_average(scores: DataFrame, targets: Sequence[str], key: str = "session_id") -> DataFrame:
    """Mean over the fold models' scores of each key."""
    return scores.groupBy(key).agg(*[F.avg(t).alias(t) for t in targets])
