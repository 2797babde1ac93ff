"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketcast.llm.common import fold

# Largest text of a sample row, so that rows times this bounds the sample.
SAMPLE_CHARS = 200_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int, balance: bool = False) -> DataFrame:
    """``text`` and ``y`` of at most ``rows`` labelled documents outside the held-out fold, in seeded order.

    With ``balance`` each class gives at most half. Distinct texts only: copies teach nothing new. Ids are
    chosen from the labels alone (a bounded set, hence the broadcast), then their texts are fetched.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y")).filter(fold("id", modulus) != held_out)
    draw = known.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id")
    if balance:
        parts = [draw.filter(F.col("y") == y).limit(rows // 2) for y in (0, 1)]
        chosen = parts[0].unionAll(parts[1])
    else:
        chosen = draw.limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= SAMPLE_CHARS)
    found = found.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("text", "y")
    return found.groupBy("text").agg(F.max("y").alias("y"))
