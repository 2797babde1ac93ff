"""Input tables: explicit schemas, file readers and key checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketcast.constants import TARGET_CATEGORIES
from basketcast.functions.calendar import parse_hour

# File column -> (column here, type). Times stay text because a
# file may hold either HH:mm:ss or a bare hour.
SESSION_COLUMNS = {
    "session_id": ("session_id", T.LongType()),
    "顧客CD": ("customer_id", T.StringType()),
    "売上日": ("sale_date", T.DateType()),
    "時刻": ("sale_time", T.StringType()),
    "店舗名": ("store", T.StringType()),
    "年代": ("age_band", T.StringType()),
    "性別": ("gender", T.StringType()),
}
LOG_COLUMNS = {
    "session_id": ("session_id", T.LongType()),
    "JAN": ("jan", T.StringType()),
    "売上数量": ("quantity", T.DoubleType()),
    "売上金額": ("amount", T.DecimalType(18, 2)),
}
PRODUCT_COLUMNS = {
    "JAN": ("jan", T.StringType()),
    "カテゴリ名": ("category", T.StringType()),
}
TARGET_COLUMNS = {
    "session_id": ("session_id", T.LongType()),
    **{label: (name, T.IntegerType()) for name, label in TARGET_CATEGORIES.items()},
}
TABLES = {
    "train_session": SESSION_COLUMNS,
    "test_session": SESSION_COLUMNS,
    "train_target": TARGET_COLUMNS,
    "train_log": LOG_COLUMNS,
    "jan": PRODUCT_COLUMNS,
}


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "csv",
               date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Read one table with its declared schema and neutral column names.

    CSV columns are matched to the schema by the header, so their order does not
    matter; dates are parsed while reading. Columns that are not declared are
    kept under their own names (from CSV as text), because money and category
    columns are found among all columns of a file; a declared column goes before
    another one that already has its neutral name.
    """
    columns = TABLES[name]
    path = f"{folder}/{name}.{fmt}"
    if fmt == "csv":
        # The header alone is read here (one line), to line the schema up with it.
        header = spark.read.option("header", True).csv(path).columns
        types = {source: kind for source, (_, kind) in columns.items()}
        schema = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
        raw = (spark.read.option("header", True).option("dateFormat", date_format)
               .option("mode", "FAILFAST").schema(schema).csv(path))
    else:
        raw = spark.read.format(fmt).load(path)
    present = [c for c in columns if c in raw.columns]
    taken = {columns[c][0] for c in present}
    others = [c for c in raw.columns if c not in columns and c not in taken]
    out = raw.select(*[F.col(quoted(c)).cast(columns[c][1]).alias(columns[c][0]) for c in present],
                     *[F.col(quoted(c)) for c in others])
    return out.withColumn("hour", parse_hour("sale_time")) if "sale_time" in out.columns else out


def load_tables(spark: SparkSession, folder: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """Read the five tables of a data folder."""
    return {name: read_table(spark, folder, name, fmt) for name in TABLES}


def attach_targets(sessions: DataFrame, targets: DataFrame, columns: Sequence[str],
                   key: str = "session_id") -> DataFrame:
    """Left-join the target flags to their sessions by key."""
    return sessions.join(targets.select(key, *columns), key, "left")


def alignment_report(sessions: DataFrame, targets: DataFrame, key: str = "session_id") -> DataFrame:
    """One row: rows on both sides, and keys that only one side has."""
    left = sessions.groupBy(key).agg(F.count("*").alias("_l"))
    right = targets.groupBy(key).agg(F.count("*").alias("_r"))
    return left.join(right, key, "full").agg(
        F.coalesce(F.sum("_l"), F.lit(0)).alias("session_rows"),
        F.coalesce(F.sum("_r"), F.lit(0)).alias("target_rows"),
        F.count(F.when(F.col("_r").isNull(), 1)).alias("sessions_without_target"),
        F.count(F.when(F.col("_l").isNull(), 1)).alias("targets_without_session"),
        F.count(F.when((F.col("_l") > 1) | (F.col("_r") > 1), 1)).alias("repeated_keys"),
    )


def check_alignment(sessions: DataFrame, targets: DataFrame, key: str = "session_id") -> None:
    """Raise unless sessions and targets match one to one."""
    row = alignment_report(sessions, targets, key).first().asDict()
    bad = ("sessions_without_target", "targets_without_session", "repeated_keys")
    if any(row[name] for name in bad):
        raise ValueError(f"sessions and targets do not line up: {row}")


# Substrings that mark a money column.
MONEY_KEYWORDS = ("金額", "値引", "値割", "割引", "売上金額", "売価", "支払い", "支払額",
                  "price", "discount", "payment", "amount")
# Category and quantity columns by preference.
CATEGORY_COLUMNS = ("ディビジョン", "部門", "カテゴリ", "カテゴリ名", "サブカテゴリ", "ブランド")
CATEGORY_PREFERENCE = ("カテゴリ", "カテゴリ名", "category", "部門", "department", "division", "ディビジョン")
QUANTITY_COLUMNS = ("売上数量", "数量", "点数", "個数", "quantity")


def detect_columns(log: DataFrame, products: DataFrame, key: str = "session_id",
                   item: str = "jan") -> dict[str, object]:
    """Pick money, category and quantity columns from the column names alone."""
    keys = {key, item, item.upper(), "mapped_category"}
    money = [c for c in log.columns if any(word in c.lower() for word in MONEY_KEYWORDS)]
    money = money or [c for c in log.columns if c not in keys][:3]
    known = {*CATEGORY_COLUMNS, *CATEGORY_PREFERENCE}
    category = [c for c in products.columns if c in known]
    category = category or [c for c in products.columns if c not in keys][:5]
    by_name = {c.lower(): c for c in category}
    chosen = next((by_name[c.lower()] for c in CATEGORY_PREFERENCE if c.lower() in by_name),
                  category[0] if category else None)
    quantity = next((c for c in QUANTITY_COLUMNS if c in log.columns), None)
    return {"money": money, "category": category, "chosen_category": chosen, "quantity": quantity}


def with_quantity(log: DataFrame, quantity: str | None) -> DataFrame:
    """Name the quantity column ``quantity``; without one every line counts 1."""
    return log.withColumn("quantity", F.lit(1.0) if quantity is None else F.col(f"`{quantity}`"))
