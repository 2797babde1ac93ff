"""Writers for scores and helpers that put scores into submission shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_predictions(scores: DataFrame, path: str, targets: Sequence[str], key: str | None = "session_id",
                      fmt: str = "csv", labels: dict[str, str] | None = None) -> None:
    """Write one column per target, with or without the session key; an earlier file of that path is replaced."""
    labels = labels or {}
    columns = [F.col(key)] if key else []
    columns += [F.col(t).alias(labels.get(t, t)) for t in targets]
    scores.select(*columns).write.mode("overwrite").option("header", True).format(fmt).save(path)


def write_oof(scores: DataFrame, path: str, fold: str = "fold", fmt: str = "parquet", key: str = "session_id") -> None:
    """Write out-of-fold scores, one folder per fold, and a manifest next to each.

    Only the folds that ``scores`` has are replaced, so that a fold may be
    written again after a failure without touching the others. The manifest
    (rows and sum of keys of each fold) is taken from the scores, not from the
    files, and tells whether they were written whole.
    """
    def replace(rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(fold).format(fmt).save(f"{path}/{folder}")

    replace(scores, "scores")
    replace(manifest(scores, fold, key), "manifest")


def manifest(scores: DataFrame, fold: str = "fold", key: str = "session_id") -> DataFrame:
    """Rows and sum of keys of each fold."""
    return scores.groupBy(fold).agg(F.count("*").alias("rows"), F.sum(F.col(key).cast("decimal(38,0)")).alias("key_sum"))


def read_oof(spark: SparkSession, path: str, schema: StructType, fold: str = "fold", fmt: str = "parquet", key: str = "session_id") -> DataFrame:
    """Scores written by ``write_oof``; an error names the folds whose files are not what the manifest says."""
    scores = spark.read.schema(schema).format(fmt).load(f"{path}/scores")
    stated = spark.read.format(fmt).load(f"{path}/manifest")
    found = manifest(scores, fold, key).select(fold, F.col("rows").alias("_rows"), F.col("key_sum").alias("_sum"))
    wrong = stated.join(found, fold, "full").filter(~(F.col("rows").eqNullSafe(F.col("_rows")) & F.col("key_sum").eqNullSafe(F.col("_sum"))))
    folds = sorted(str(r[0]) for r in wrong.select(fold).collect())  # one row per fold
    if folds:
        raise ValueError(f"folds that differ from their manifest: {', '.join(folds)}")
    return scores


def restore_order(scores: DataFrame, order: DataFrame, key: str = "session_id",
                  position: str = "ord") -> DataFrame:
    """Scores in the order of ``order``; a key without a score gets nulls."""
    return order.select(position, key).join(scores, key, "left").orderBy(position)


def dedupe_keep_last(rows: DataFrame, key: str = "session_id", position: str = "ord") -> DataFrame:
    """One row per key: the one with the highest position."""
    payload = [c for c in rows.columns if c not in (key, position)]
    # max_by combines on the map side, so a much repeated key stays cheap.
    latest = rows.groupBy(key).agg(
        F.max(position).alias(position),
        F.max_by(F.struct(*payload), F.col(position)).alias("_row"),
    )
    return latest.select(key, position, "_row.*").select(*rows.columns)


def preview_head(rows: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First rows in a stated order."""
    return rows.orderBy(*order).limit(n)
