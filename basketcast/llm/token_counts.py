"""Token counts from a digest cache: only texts that were never counted are encoded.

The cache is a Parquet table ``(content, n_tokens, tokenizer)``, partitioned by the digest of the
tokenizer (its file, library and version), so that a new version never meets the counts of an old
one and a run reads only the counts of its own. ``content`` is the SHA-256 of the text as the
tokenizer gets it: nulls are empty, anything else stays as it is, because these vocabularies tell
apart all white space and letter cases; ``normalise`` is an argument for those that do not.

A run joins the distinct digests of the documents to the cache, takes one text for each digest that
is missing (copies are merged inside the map tasks before the shuffle, so a group of copies that
holds a third of all rows crosses it once per task), encodes these, appends their counts and answers
every document from the cache. Texts cross the shuffle only where they may be missing: few misses
are broadcast, after counting them, and sift the texts in front of it. The last join carries
digests alone, and both its sides come straight from a shuffle, so that Spark splits the copies.

Defined cases: null texts are empty and count 0; rows with equal or null ids stay rows of their own;
an empty table gives an empty result and leaves the cache as it is; other columns are ignored; very
long texts are counted by pieces. Two runs that append the same digest at once leave it twice with
the same count, and readers take one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketcast.llm.common import blocks, small_batches, stored
from basketcast.llm.vocabularies import version_digest, vocabulary
from basketcast.session import broadcast_if_small

LIMIT = 1024
# Missing digests (32 bytes each) up to which they are broadcast to sift the texts.
FEW_MISSES = 20_000
CACHE_SCHEMA = "content binary, n_tokens long, tokenizer string"


def as_given(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def open_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The stored counts; a folder that does not exist becomes an empty cache."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([], CACHE_SCHEMA).write.partitionBy("tokenizer").mode("append").parquet(folder)
    return spark.read.schema(CACHE_SCHEMA).parquet(folder)


def encode_missing(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """``content, n_tokens`` of distinct texts."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary(tokenizer_path)
        for block in blocks(batches):
            counts = encoder.counts(block.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([block.column("content").cast(pa.binary()), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(count, "content binary, n_tokens long")


def count_tokens(docs: DataFrame, cache: str, tokenizer_path: str, limit: int = LIMIT,
                 normalise: Callable[[Column], Column] = as_given) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document; the cache in folder ``cache`` gains what it lacked."""
    spark = docs.sparkSession
    version = version_digest(tokenizer_path)
    text = as_given(F.col("text"))
    keyed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
                        F.unhex(F.sha2(normalise(text), 256)).alias("content"), normalise(text).alias("text"))
    digests = stored(keyed.select("content").distinct())
    held = open_cache(spark, cache).where(F.col("tokenizer") == version).select("content")
    missing = stored(digests.join(held, "content", "left_anti"))
    one_each = keyed.groupBy("content").agg(F.max("text").alias("text"))
    misses = one_each.join(broadcast_if_small(missing, max_rows=FEW_MISSES), "content", "left_semi")
    (encode_missing(misses, tokenizer_path).withColumn("tokenizer", F.lit(version))
     .write.partitionBy("tokenizer").mode("append").option("compression", "zstd").parquet(cache))
    counts = open_cache(spark, cache).where(F.col("tokenizer") == version).select("content", "n_tokens")
    counts = stored(digests.join(counts, "content").groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))
    return keyed.select("doc_id", "n_bytes", "content").join(counts, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
