"""Set operations between splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "valid", "test")


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, matched by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def distinct_map(sessions: DataFrame, key: str = "session_id", value: str = "customer_id") -> DataFrame:
    return sessions.select(key, value).dropDuplicates()


def membership(df: DataFrame, key: str, split: str = "split", splits: Sequence[str] = SPLITS) -> DataFrame:
    """One row per key: in which splits it occurs."""
    return df.dropna(subset=[key]).groupBy(key).agg(
        *[F.bool_or(F.col(split) == s).alias(f"in_{s}") for s in splits])


def split_overlap(df: DataFrame, key: str = "session_id", split: str = "split",
                  splits: Sequence[str] = SPLITS) -> DataFrame:
    """Keys that two splits share, one row per pair of splits."""
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1:]]
    one = membership(df, key, split, splits).agg(
        *[F.count_if(F.col(f"in_{a}") & F.col(f"in_{b}")).alias(f"{a}_{b}") for a, b in pairs])
    return one.unpivot([], [f"{a}_{b}" for a, b in pairs], "pair", "shared")


def customer_overlap(df: DataFrame, key: str = "customer_id", split: str = "split",
                     splits: Sequence[str] = SPLITS) -> DataFrame:
    """Common customers of each pair of splits and customers of one split only."""
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1:]]
    seen = {s: F.coalesce(F.col(f"in_{s}"), F.lit(False)) for s in splits}

    def only(s: str):
        alone = seen[s]
        for other in splits:
            if other != s:
                alone = alone & ~seen[other]
        return alone

    return membership(df, key, split, splits).agg(
        *[F.count_if(seen[a] & seen[b]).alias(f"{a}_{b}") for a, b in pairs],
        *[F.count_if(only(s)).alias(f"{s}_only") for s in splits])


def multi_key_sort(df: DataFrame, keys: Sequence[str] = ("customer_id", "sale_date", "hour", "session_id")) -> DataFrame:
    """Global order by customer, date and time."""
    return df.orderBy(*keys)
