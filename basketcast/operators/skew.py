"""Joins of session rows with one-row-per-key statistics, safe for hot keys.

AQE splits skewed partitions only where both join inputs come straight from a
shuffle. Statistics that were just aggregated by the same key reuse their
partitioning and get no such help, so hot keys are found and salted here.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that one task may join.
HOT_ROWS = 2_000_000
# Bytes (as text) up to which a small table is broadcast, and copies of a larger one.
BROADCAST_BYTES = 32 << 20
COPIES = 16


@dataclass
class HeavyKeys:
    """Keys with too many rows and their number of slices; None if there are none.

    The table has at most (rows / hot_rows) entries and may be broadcast.
    """

    key: str
    table: DataFrame | None


def heavy_keys(rows: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> HeavyKeys:
    """Find the hot keys: one counting pass over the key column."""
    slices = F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int")
    counted = (rows.dropna(subset=[key]).groupBy(key).agg(F.count("*").alias("_n"))
               .filter(F.col("_n") > hot_rows).select(key, slices.alias("_slices")))
    # At most rows / hot_rows entries, so they may pass through the driver; as
    # fixed rows, both sides of a join are sure to see the same slices.
    found = counted.collect()
    return HeavyKeys(key, rows.sparkSession.createDataFrame(found, counted.schema) if found else None)


def join_statistics(rows: DataFrame, stats: DataFrame, key: str, heavy: HeavyKeys | None = None,
                    also_on: Sequence[str] = (), how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``stats`` to ``rows`` by ``key`` with hot keys cut into slices.

    Rows of a hot key are spread by a hash of the row, and its statistics are
    copied to every slice. ``heavy`` saves the counting pass when several joins
    share their keys.
    """
    on = [key, *also_on]
    heavy = heavy or heavy_keys(rows, key, hot_rows)
    if heavy.table is None:
        return rows.join(stats, on, how)
    marks = F.broadcast(heavy.table)
    spread_by = ["session_id"] if "session_id" in rows.columns else list(rows.columns)
    salt = F.pmod(F.xxhash64(*spread_by), F.coalesce("_slices", F.lit(1))).cast("int")
    salted = rows.join(marks, key, "left").withColumn("_salt", salt).drop("_slices")
    copies = (stats.join(marks, key, "left")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)))
              .drop("_slices"))
    columns = [*rows.columns, *[c for c in stats.columns if c not in on]]
    return salted.join(copies, [*on, "_salt"], how).select(*columns)


def byte_sizes(df: DataFrame, label: str) -> dict[str, int]:
    """Bytes per label of a materialised table with a handful of labels."""
    return {r[0]: r[1] or 0 for r in df.groupBy(label).agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).collect()}


def join_small(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", size: int | None = None,
               max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join a table that should be small and has few keys, so that a shuffle by key would pile up rows.

    A table of at most ``max_bytes`` (measured where ``size`` does not say) is broadcast. A larger one is
    copied ``COPIES`` times and the rows of every key are spread over the copies.
    """
    if size is None:
        size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size <= max_bytes:
        return rows.join(F.broadcast(table), list(on), how)
    spread_by = ["session_id"] if "session_id" in rows.columns else list(rows.columns)
    salted = rows.withColumn("_copy", F.pmod(F.xxhash64(*spread_by), F.lit(COPIES)).cast("int"))
    copies = table.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return salted.join(copies, [*on, "_copy"], how).drop("_copy").select(*rows.columns, *[c for c in table.columns if c not in on])
