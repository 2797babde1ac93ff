"""Cross-validation folds that keep customers whole and targets balanced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketcast.constants import FOLDS
from basketcast.functions.scalars import bitmask_stratum
from basketcast.operators.ordering import with_position
from basketcast.operators.skew import join_statistics


def stratified_group_folds(sessions: DataFrame, targets: Sequence[str], folds: int = FOLDS,
                           customer: str = "customer_id") -> DataFrame:
    """One fold per customer.

    A customer's signature says which target combinations occur in the
    sessions. Customers of one signature are dealt out in turn, larger ones
    first, which spreads every combination over all folds; each signature
    starts at a fold of its own, so that rare ones do not pile up in the first.
    Signatures with many customers are numbered in hashed slices, not in one
    sorted task.
    """
    seen = F.bit_or(F.call_function("shiftleft", F.lit(1), bitmask_stratum(targets)))
    profile = sessions.groupBy(customer).agg(F.count("*").alias("size"), seen.alias("signature"))
    keyed = profile.withColumn("slice", F.substring(F.md5(F.col(customer).cast("string").cast("binary")), 1, 3))
    dealt = with_position(keyed, ["signature"], ["size", "slice"], [customer], descending=["size"])
    start = F.conv(F.substring(F.md5(F.col("signature").cast("string").cast("binary")), 1, 4), 16, 10).cast("long")
    return dealt.select(customer, "size", "signature", F.pmod(F.col("pos") + start, F.lit(folds)).cast("int").alias("fold"))


def attach_fold(sessions: DataFrame, folds: DataFrame, customer: str = "customer_id") -> DataFrame:
    return join_statistics(sessions, folds.select(customer, "fold"), customer)
