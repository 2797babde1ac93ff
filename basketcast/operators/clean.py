"""Filters, splits and key-based restrictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_returns(log: DataFrame, quantity: str = "quantity") -> DataFrame:
    """Purchases only."""
    return log.filter(F.col(quantity) > 0)


def return_rows(log: DataFrame, quantity: str = "quantity") -> DataFrame:
    return log.filter(F.col(quantity) <= 0)


def target_category(products: DataFrame, categories: Sequence[str], column: str = "category") -> DataFrame:
    return products.filter(F.col(column).isin(*categories))


def date_range(df: DataFrame, start: str, end: str, date: str = "sale_date") -> DataFrame:
    """Rows dated within the closed interval."""
    return df.filter(F.col(date).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def temporal_split(train_end: str, valid_end: str, date: str = "sale_date") -> Column:
    """``train`` up to the first date, ``valid`` up to the second, then ``test``."""
    column = F.col(date)
    return (F.when(column <= F.to_date(F.lit(train_end)), "train")
            .when(column <= F.to_date(F.lit(valid_end)), "valid")
            .when(column.isNotNull(), "test"))


def month_split(train: Sequence[int] = (7, 8, 9), valid: Sequence[int] = (10,),
                date: str = "sale_date") -> Column:
    month = F.month(date)
    return F.when(month.isin(*train), "train").when(month.isin(*valid), "valid")


def fold_split(df: DataFrame, fold: int, column: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(rows of the other folds, rows of this fold)."""
    return df.filter(F.col(column) != fold), df.filter(F.col(column) == fold)


def returns_with_product(log: DataFrame, products: DataFrame, item: str = "jan") -> DataFrame:
    return return_rows(log).join(products, item)


def log_with_product(log: DataFrame, products: DataFrame, item: str = "jan") -> DataFrame:
    """Lines with their product; unknown products keep null attributes.

    Catalyst broadcasts the product master while its size stays below the
    session's threshold, and otherwise shuffles with skewed items split.
    """
    return log.join(products, item, "left")


def exclude_return_sessions(sessions: DataFrame, log: DataFrame, products: DataFrame,
                            categories: Sequence[str]) -> DataFrame:
    """Sessions without a returned item of the given categories."""
    returned = (return_rows(log).join(target_category(products, categories).select("jan"), "jan", "left_semi")
                .select("session_id").distinct())
    return sessions.join(returned, "session_id", "left_anti")


def restrict_to_sessions(df: DataFrame, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    return df.join(sessions.select(key), key, "left_semi")


def purchase_history(targets: DataFrame, sessions: DataFrame, columns: Sequence[str],
                     key: str = "session_id") -> DataFrame:
    """Target flags with the date and customer of their session."""
    return targets.join(sessions.select(key, *columns), key, "left")


def map_category(log: DataFrame, products: DataFrame, category: Column, item: str = "jan") -> DataFrame:
    """Lines with a mapped category; lines of unknown products are dropped."""
    mapped = products.select(item, category.alias("category"))
    return (log.join(mapped, item, "left")
            .withColumn("category", F.coalesce("category", F.lit("unknown")))
            .filter(F.col("category") != "unknown"))


def debug_sample(df: DataFrame, n: int, seed: int = 42, key: str = "customer_id") -> DataFrame:
    """All rows of ``n`` keys picked by a seeded hash."""
    draw = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    picked = df.select(key).distinct().orderBy(draw, key).limit(n)
    return df.join(picked, key, "left_semi")


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> DataFrame:
    """Drop targets, keys and raw categories before fitting."""
    unknown = set(exclude) - set(df.columns)
    if unknown:
        raise ValueError(f"columns to drop are missing: {sorted(unknown)}")
    return df.drop(*exclude)
