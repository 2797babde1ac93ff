"""Scalar rules: clipping, null handling, normalising and fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketcast.session import one_row


def clip01(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.greatest(F.least(column, F.lit(1.0)), F.lit(0.0))


def binarise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1 where the value is positive, else 0."""
    return df.withColumns({c: F.coalesce((F.col(c) > 0).cast("int"), F.lit(0)) for c in columns})


def fill_null(df: DataFrame, columns: Sequence[str], value: float = 0) -> DataFrame:
    return df.fillna(value, subset=list(columns))


def missing(value: Column | str) -> Column:
    """Null or NaN."""
    column = F.col(value) if isinstance(value, str) else value
    return column.isNull() | F.isnan(column)


def nan_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: missing values over all score columns."""
    return df.agg(*[F.count_if(missing(c)).alias(c) for c in columns]).select(
        sum((F.col(c) for c in columns), F.lit(0)).cast("long").alias("missing"))


def nan_guard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing scores become 0."""
    return df.withColumns({c: F.when(missing(c), 0.0).otherwise(F.col(c)) for c in columns})


def cycle_proximity(gap: Column | str, days: Column | str, never: int = 999) -> Column:
    """How far a customer is through the usual gap, within [0, 1]."""
    gap = F.col(gap) if isinstance(gap, str) else gap
    days = F.col(days) if isinstance(days, str) else days
    return F.when(gap < never, clip01(gap / F.greatest(days, F.lit(1)))).otherwise(F.lit(0.0))


# Divisor of each calendar number.
CYCLE_DIVISORS = {"hour": 24.0, "weekday": 6.0, "day": 31.0, "month": 12.0, "time_period": 3.0}


def cyclic_scaling(df: DataFrame, divisors: dict[str, float] = CYCLE_DIVISORS) -> DataFrame:
    return df.withColumns({f"{c}_scaled": F.col(c) / F.lit(d) for c, d in divisors.items()})


def max_normalise(df: DataFrame, values: Sequence[str] = (), codes: Sequence[str] = (),
                  fit_on: Column | None = None) -> DataFrame:
    """Divide values by their maximum (0 counts as 1) and codes by maximum + 1.

    The maxima come from the rows that ``fit_on`` selects, in one aggregate
    that reaches the rows as a scalar subquery.
    """
    fitted = df if fit_on is None else df.filter(fit_on)
    maxima = F.col("_maxima")
    scaled = {}
    for c in values:
        top = F.coalesce(maxima[c].cast("double"), F.lit(0.0))
        scaled[f"{c}_scaled"] = F.col(c).cast("double") / F.when(top == 0, 1.0).otherwise(top)
    for c in codes:
        scaled[f"{c}_scaled"] = F.col(c) / (maxima[c] + F.lit(1))
    limits = one_row(fitted.agg(*[F.max(c).alias(c) for c in (*values, *codes)]))
    return df.withColumn("_maxima", limits).withColumns(scaled).drop("_maxima")


def coalesce_category(columns: Sequence[str], item: str = "jan") -> Column:
    """First non-empty category column, else the product code itself."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.col(item).cast("string"))


def bitmask_stratum(targets: Sequence[str]) -> Column:
    """Each target set adds its power of two."""
    return sum((F.col(t) * F.lit(1 << i) for i, t in enumerate(targets)), F.lit(0)).cast("int")


def prefix_columns(df: DataFrame, prefix: str, columns: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in columns})
