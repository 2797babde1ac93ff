"""Wide feature tables from many keyed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketcast.operators.skew import heavy_keys, join_statistics
from basketcast.session import broadcast_if_small, materialise


def merge_by_key(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Tables of one key side by side; a key may be missing from some."""
    return reduce(lambda a, b: a.join(b, key, "full"), tables)


def split_long(long: DataFrame, names: Sequence[str], key: str, prefix: str, kind: str) -> DataFrame:
    """Rows of one dimension of a long means table, as a table of that key."""
    return long.filter(F.col("dimension") == key).dropna(subset=["value"]).select(
        F.col("value").cast(kind).alias(key), *[F.col(f"`{n}`").alias(f"{key}_{prefix}{n}") for n in names])


def assemble_features(sessions: DataFrame, by_key: Mapping[str, Sequence[DataFrame]],
                      by_session: Sequence[DataFrame] = (),
                      encodings: Mapping[str, DataFrame] | None = None, fold: str | None = "fold",
                      small_keys: Sequence[str] = ("gender", "age_band", "store")) -> DataFrame:
    """Left-join every feature table to its sessions.

    Tables that share a key are merged first, so each key is joined once. The
    tables of ``small_keys`` and the encodings are stored and broadcast when
    their row count proves small; customers are joined by shuffle with hot
    ones salted, sessions by shuffle.
    """
    out = sessions
    for key, tables in by_key.items():
        merged = merge_by_key(tables, key)
        if key in small_keys:
            out = out.join(broadcast_if_small(materialise(merged)), key, "left")
        else:
            out = join_statistics(out, merged, key, heavy_keys(sessions, key))
    for table in by_session:
        out = out.join(table, "session_id", "left")
    for key, table in (encodings or {}).items():
        on = [key, fold] if fold else [key]
        out = out.join(broadcast_if_small(materialise(table)), on, "left")
    return out
