"""Encoders for categories and continuous scores."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketcast.operators.coordinates import rank_codes
from basketcast.operators.stats import category_levels
from basketcast.operators.skew import join_small
from basketcast.session import store

# Rows of an interval that one task may sort, and the shares at which a larger one is cut.
FINISH_ROWS = 100_000
GRID = [i / 64 for i in range(65)]


def one_hot(df: DataFrame, columns: Sequence[str], levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Indicator column ``{column}_{level}`` for each level; null has no level."""
    levels = levels or category_levels(df, columns)
    flags = [F.coalesce((F.col(c) == level).cast("int"), F.lit(0)) for c in columns for level in levels[c]]
    # Named by place: levels may differ only in case, which column lookups do not tell apart.
    return df.select("*", *flags).toDF(*df.columns, *[f"{c}_{level}" for c in columns for level in levels[c]])


def sparse_one_hot(df: DataFrame, columns: Sequence[str], tables: Mapping[str, DataFrame] | None = None,
                   name: str = "hot") -> DataFrame:
    """Indices of the set indicators of each row, for any number of levels.

    ``tables`` are fitted code tables (``label_encode``), by column; the levels of each column follow
    those of the column before. A null or unknown value sets no indicator.
    """
    tables = tables or {c: label_encode(df, c) for c in columns}
    out, offset, parts = df, 0, []
    for i, c in enumerate(columns):
        out = label_transform(out, tables[c].select(c, F.col("code").alias(f"code{i}__")), c, f"code{i}__")
        parts.append(F.when(F.col(f"code{i}__") >= 0, F.col(f"code{i}__") + offset))
        offset += tables[c].count()
    return out.withColumn(name, F.array_compact(F.array(*parts))).select(*df.columns, name)


def label_encode(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Fitted code table of the sorted distinct values: 0 .. n-1, numbered range by range.

    The table is stored, as a fitted encoder is used on several frames.
    """
    return rank_codes(df, column, name)


def label_transform(df: DataFrame, codes: DataFrame, column: str, name: str = "code",
                    unknown: int = -1) -> DataFrame:
    """Look codes up; values not seen while fitting get ``unknown``."""
    return join_small(df, codes, [column]).withColumn(name, F.coalesce(name, F.lit(unknown)))


def target_encode_oof(df: DataFrame, category: str, targets: Sequence[str], fold: str = "fold",
                      folds: int = 4) -> DataFrame:
    """Target means by category over the rows outside each fold.

    One aggregation by category and fold; the other folds' mean is the
    category total minus the fold's own part. A fold in which a category does
    not occur still gets its row, as long as other folds have the category.
    """
    sums = {t: F.sum(t) for t in targets} | {f"{t}__n": F.count(t) for t in targets}
    by_fold = (df.groupBy(category, fold).agg(F.count("*").alias("_rows"),
                                              *[v.alias(k) for k, v in sums.items()]))
    # At most ``folds`` rows per category: totals per category are a tiny window.
    parts = F.map_from_entries(F.collect_list(F.struct(F.col(fold).cast("int"), F.struct("_rows", *sums))))
    grouped = by_fold.groupBy(category).agg(
        parts.alias("_own"), F.sum("_rows").alias("_all_rows"),
        *[F.sum(k).alias(f"_all_{k}") for k in sums])
    per_fold = grouped.withColumn(fold, F.explode(F.array(*[F.lit(k) for k in range(folds)])))

    def other(name: str) -> Column:
        own = F.try_element_at("_own", F.col(fold))[name]
        return F.col(f"_all_{name}") - F.coalesce(own, F.lit(0))

    rows_left = F.col("_all_rows") - F.coalesce(F.try_element_at("_own", F.col(fold))["_rows"], F.lit(0))
    return per_fold.filter(rows_left > 0).select(
        category, fold, *[F.try_divide(other(t).cast("double"), other(f"{t}__n")).alias(f"{category}_te_{t}")
                          for t in targets])


def target_encode_full(df: DataFrame, category: str, targets: Sequence[str]) -> DataFrame:
    return df.groupBy(category).agg(*[F.avg(t).alias(f"{category}_te_{t}") for t in targets])


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float],
                    accuracy: int = 10_000, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per group and probability.

    A distributed selection of the wanted ranks, all groups and probabilities at once. A mergeable sketch
    proposes bounds on both sides of each rank; one pass counts the rows of every interval between bounds,
    with its least and greatest value. A rank that is a bound or an end of its interval is found; any other
    is looked for in its interval alone, by further bounds while that holds more than ``finish_rows`` rows,
    and else by sorting it. No task sees more rows of a group than that, and no row is multiplied. Groups
    must be few (such as the targets): a few dozen bounds of each pass through the driver.
    """
    if not groups:
        single = exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, accuracy, finish_rows)
        return single.drop("_all")
    spark = df.sparkSession
    names = [f"_g{i}" for i in range(len(groups))]
    keys = [F.col(g).alias(n) for g, n in zip(groups, names)]
    rows = store(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).dropna(subset=names))
    margin = 4.0 / accuracy
    near = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-margin, margin)})
    sketch = {tuple(r[:len(names)]): r for r in rows.groupBy(*names).agg(
        F.percentile_approx("_v", near, accuracy).alias("bounds"), F.count("*").alias("n")).collect()}
    ranks = {g: {int(f((r["n"] - 1) * p)) for p in probs for f in (math.floor, math.ceil)} for g, r in sketch.items()}
    bounds = {g: sorted(set(r["bounds"])) for g, r in sketch.items()}
    found: dict[tuple, float] = {}
    spans: dict[tuple, dict[int, Span]] = {}
    while bounds:
        spans |= open_spans(rows, names, bounds, ranks, found)
        wide = {g: {s for s in spans[g].values() if s.rows > finish_rows} for g in bounds}
        wide = {g: held for g, held in wide.items() if held}
        more = inside(rows, names, wide).groupBy(*names, "_span").agg(F.percentile_approx("_v", GRID, accuracy).alias("cuts")).collect() if wide else []
        bounds = {g: sorted({*bounds[g], *[x for r in more if tuple(r[:len(names)]) == g for x in r["cuts"]]}) for g in wide}
    # What is left are intervals of at most finish_rows rows.
    left = {g: {s for s in held.values()} for g, held in spans.items() if held}
    if left:
        for r in inside(rows, names, left).groupBy(*names, "_span").agg(F.array_sort(F.collect_list("_v")).alias("sorted")).collect():
            g = tuple(r[:len(names)])
            for rank, span in spans[g].items():
                if (span.low, span.high) == (r["_span"]["low"], r["_span"]["high"]):
                    found[g, rank] = r["sorted"][rank - span.before]
    out = []
    for g, r in sketch.items():
        for p in probs:
            place = (r["n"] - 1) * p
            a, b = found[g, math.floor(place)], found[g, math.ceil(place)]
            out.append((*g, float(p), a + (b - a) * (place - math.floor(place))))
    result = spark.createDataFrame(out, group_schema(rows, names, "prob double, quantile double"))
    return result.toDF(*groups, "prob", "quantile")


@dataclass(frozen=True)
class Span:
    """An open interval between bounds that holds a wanted rank."""

    before: int   # rows of the group below it
    rows: int
    low: float    # its least and greatest value
    high: float


def group_schema(rows: DataFrame, names: Sequence[str], more: str) -> str:
    return ", ".join([*[f"{n} {rows.schema[n].dataType.simpleString()}" for n in names], more])


def open_spans(rows: DataFrame, names: Sequence[str], bounds: Mapping[tuple, Sequence[float]], ranks: Mapping[tuple, set[int]],
               found: dict[tuple, float]) -> dict[tuple, dict[int, Span]]:
    """Count the rows between bounds; ranks at a bound or an end of an interval go to ``found``, the others stay with their interval."""
    table = rows.sparkSession.createDataFrame([(*g, list(b)) for g, b in bounds.items()], group_schema(rows, names, "_bounds array<double>"))
    # A cell is the number of bounds below a value, and whether the value is itself a bound.
    below = F.size(F.filter("_bounds", lambda b: b < F.col("_v"))).alias("k")
    cells = rows.join(F.broadcast(table), list(names)).groupBy(*names, below, F.array_contains("_bounds", F.col("_v")).alias("on")).agg(
        F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).collect()
    spans: dict[tuple, dict[int, Span]] = {g: {} for g in bounds}
    for g in bounds:
        before = 0
        # An interval comes in front of the bound that ends it: both have the same number of bounds below.
        for cell in sorted((c for c in cells if tuple(c[:len(names)]) == g), key=lambda c: (c["k"], c["on"])):
            last = before + cell["n"] - 1
            for rank in [r for r in ranks[g] if before <= r <= last]:
                if rank in (before, last) or cell["low"] == cell["high"]:
                    found[g, rank] = cell["high"] if rank == last else cell["low"]
                else:
                    spans[g][rank] = Span(before, cell["n"], cell["low"], cell["high"])
            before = last + 1
    return spans


def inside(rows: DataFrame, names: Sequence[str], spans: Mapping[tuple, set[Span]]) -> DataFrame:
    """Rows of the given intervals, each with its ``_span``; a group's intervals do not overlap."""
    table = rows.sparkSession.createDataFrame([(*g, [(s.low, s.high) for s in held]) for g, held in spans.items()],
                                              group_schema(rows, names, "_spans array<struct<low:double,high:double>>"))
    span = F.get(F.filter("_spans", lambda s: F.col("_v").between(s["low"], s["high"])), F.lit(0))
    return rows.join(F.broadcast(table), list(names)).withColumn("_span", span).filter(F.col("_span").isNotNull())


def decile_edges(df: DataFrame, groups: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """Distinct bin edges per group, ascending, as one array."""
    probs = [i / bins for i in range(bins + 1)]
    points = exact_quantiles(df, groups, value, probs)
    return points.groupBy(*groups).agg(F.array_sort(F.collect_set("quantile")).alias("edges"))


def bin_lookup(value: Column | str, edges: Column | str, bins: int = 10) -> Column:
    """Index of the first upper edge that reaches the value; above all edges 0."""
    value = F.col(value) if isinstance(value, str) else value
    edges = F.col(edges) if isinstance(edges, str) else edges
    reached = [F.when(value <= F.get(edges, F.lit(i)), F.lit(i - 1)) for i in range(1, bins + 1)]
    return F.coalesce(*reached, F.lit(0))
