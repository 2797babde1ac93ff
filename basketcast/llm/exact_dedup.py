"""Exact duplicates by composable polynomial fingerprints.

A text is cut into chunks from its end. Each chunk is hashed on its own as a polynomial modulo two
primes; chunk hashes combine by shifting the earlier part by the length of the later one, so chunks
of a huge document can be hashed in any order and on any machine (``combine``). Texts with equal
fingerprints are then compared piece by piece with the text that stays; rows that differ after all
(a collision) are told apart by their SHA-256.

Only thin facts are grouped. Texts move once, in the join that fetches those of repeated
fingerprints, and a hot group meets its keeper in a plain join that Spark splits.

Defined cases: null text counts as empty, and all empty texts are equal; a null id counts as the
largest; of rows with the same id and text exactly one stays; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketcast.llm.common import blocks, small_batches, stored, strings

PRIMES = np.array([2147483647, 2147483629], np.uint64)
BASES = np.array([1_000_003, 69_069_071], np.uint64)
CHUNK = 256          # bytes of one hashed chunk; sums of 256 products stay exact in a double
PIECE = 1 << 16      # bytes of one compared piece
PRINT = ["f1", "f2", "length"]


def powers(n: int, step: int = 1) -> np.ndarray:
    """``base ** (step * i)`` modulo each prime, for i below n."""
    table = np.ones((1, 2), np.uint64)
    factor = np.array([pow(int(b), step, int(p)) for b, p in zip(BASES, PRIMES)], np.uint64)
    while len(table) < n:
        table = np.concatenate((table, table * factor % PRIMES))
        factor = factor * factor % PRIMES
    return table[:n]


IN_CHUNK = powers(CHUNK)[::-1].astype(np.float64)


def combine(left: np.ndarray, right: np.ndarray, right_length: int) -> np.ndarray:
    """Fingerprint of two texts in a row, from theirs and the length of the second."""
    shift = np.array([pow(int(b), right_length, int(p)) for b, p in zip(BASES, PRIMES)], np.uint64)
    return (left * shift + right) % PRIMES


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """One row of two hashes per text; the chunks of all texts are hashed together."""
    count = np.array([max(1, -(-len(t) // CHUNK)) for t in texts])
    ends = np.cumsum(count)
    # Zeros in front of a text change neither its polynomial nor its stated length.
    padded = np.zeros(int(ends[-1]) * CHUNK, np.uint8)
    for text, end in zip(texts, ends):
        padded[end * CHUNK - len(text):end * CHUNK] = np.frombuffer(text, np.uint8)
    chunks = (padded.reshape(-1, CHUNK).astype(np.float64) @ IN_CHUNK).astype(np.uint64) % PRIMES
    behind = np.repeat(ends, count) - 1 - np.arange(ends[-1])
    shifted = chunks * powers(int(count.max()), CHUNK)[behind] % PRIMES
    return np.add.reduceat(shifted, ends - count, axis=0) % PRIMES


def normalise(text: str) -> bytes:
    """UTF-8 with every run of ``[\\x20\\x09-\\x0D]`` as one space."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return b" " if raw else b""
    return (b" " if raw[:1].isspace() else b"") + b" ".join(words) + (b" " if raw[-1:].isspace() else b"")


def facts(docs: DataFrame) -> DataFrame:
    """``doc_id``, fingerprint, length and SHA-256 of each row's normalised text."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = [normalise(t) for t in strings(block.column("text")).to_pylist()]
            prints = fingerprints(texts).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts])], names=["doc_id", *PRINT, "text_sha256"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        each, "doc_id long, f1 long, f2 long, length long, text_sha256 string")


def pieces(docs: DataFrame) -> DataFrame:
    """Fingerprint and normalised text of each row, one row per piece."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = [normalise(t) for t in strings(block.column("text")).to_pylist()]
            prints = fingerprints(texts).astype(np.int64)
            cuts = [range(0, max(1, len(t)), PIECE) for t in texts]
            row = np.repeat(np.arange(len(texts)), [len(c) for c in cuts])
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").take(pa.array(row)), pa.array(prints[row, 0]), pa.array(prints[row, 1]),
                 pa.array([len(texts[r]) for r in row], pa.int64()), pa.array([start for c in cuts for start in c], pa.int64()),
                 pa.array([t[start:start + PIECE] for t, c in zip(texts, cuts) for start in c], pa.binary())],
                names=["doc_id", *PRINT, "start", "piece"])

    return docs.mapInArrow(each, "doc_id long, f1 long, f2 long, length long, start long, piece binary")


def different_rows(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``doc_id`` and fingerprint of rows whose text differs from that of their group's keeper.

    ``repeated`` has the rows of repeated fingerprints: ``doc_id``, fingerprint and ``keep_id``.
    """
    ids = repeated.select("doc_id").distinct().withColumnRenamed("doc_id", "wanted")
    wanted = docs.select(F.col("doc_id").cast("long"), "text").join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    texts = stored(pieces(wanted))
    keepers = repeated.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", *PRINT).distinct()
    same_row = [texts[c].eqNullSafe(keepers[c]) for c in ("doc_id", *PRINT)]
    kept = texts.join(keepers, same_row[0] & same_row[1] & same_row[2] & same_row[3], "left_semi")
    kept = stored(kept.dropDuplicates([*PRINT, "start"]).withColumnRenamed("piece", "kept_piece").drop("doc_id"))
    return (texts.join(kept, [*PRINT, "start"]).filter(F.col("piece") != F.col("kept_piece"))
            .select("doc_id", *PRINT).distinct())


def exact_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``."""
    rows = stored(facts(docs).withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = rows.groupBy(*PRINT).agg(first, F.count("*").alias("n")).filter("n > 1")
    groups = stored(groups.select(*PRINT, F.col("first.doc_id").alias("keep_id")))
    repeated = stored(rows.select("doc_id", *PRINT).join(groups, PRINT))
    # Empty unless two texts share a fingerprint.
    odd = stored(different_rows(docs, repeated).withColumn("odd", F.lit(True)))
    match = [rows["doc_id"].eqNullSafe(odd["doc_id"]), *[rows[c] == odd[c] for c in PRINT]]
    told = rows.join(odd, match[0] & match[1] & match[2] & match[3], "left").select(
        *[rows[c] for c in rows.columns], F.when(F.col("odd"), F.col("text_sha256")).otherwise("").alias("apart"))
    key = [*PRINT, "apart"]
    final = stored(told.groupBy(*key).agg(first, F.count("*").alias("group_size")).filter("group_size > 1"))
    return told.join(final, key, "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("kept"), "text_sha256")
