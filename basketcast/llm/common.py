"""Table access and Arrow helpers shared by the text operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketcast.session import delete_at_end, shared_folder

# Rows of one Arrow batch: with texts of 100,000 characters still about 50 MB.
BATCH_ROWS = 512
# Text bytes that one step inside a task works on.
BLOCK_BYTES = 4_000_000
# Stored frames by folder, until they are dropped.
_kept: dict[str, DataFrame] = {}
# Those of them that a stage of the pipeline has made, with a hash of the files that it has read.
_of_stages: dict[str, int] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows that Spark puts into one Arrow batch, because texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that this run made and no longer reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, "llm")
    df.write.option("compression", "zstd").parquet(path)
    delete_at_end(df.sparkSession, path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    _kept[path] = held
    return held


def dropped(*frames: DataFrame) -> None:
    """Delete frames that ``stored`` has made and nothing reads any more."""
    for path in [p for p, held in _kept.items() if any(held is f for f in frames)]:
        delete_folder(_kept.pop(path).sparkSession, path)


def stage(build: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A pipeline stage that first deletes what earlier stages have stored on their way.

    An earlier stage is one that has read other files: ``docs`` are then its written result, or come after
    it. Frames that ``docs`` itself still reads stay.
    """
    @wraps(build)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles()
        folders, read = {os.path.dirname(f).split("/llm-")[-1] for f in files}, hash(frozenset(files))
        for path in [p for p, other in _of_stages.items() if files and other != read and p.split("/llm-")[-1] not in folders]:
            del _of_stages[path]
            if path in _kept:
                dropped(_kept[path])
        before = set(_kept)
        out = build(spark, docs, sf_dir)
        _of_stages.update(dict.fromkeys(set(_kept) - before, read))
        return out

    return run


def fold(doc_id: str | Column, modulus: int) -> Column:
    """``crc32`` of the id as text, modulo: decides which rows a model may learn from."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def strings(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One string array without nulls (null texts are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each holds about ``limit`` bytes, or is a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(sizes)]):
            yield batch.slice(start, end - start)


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """``blocks`` after joining small neighbours, for steps that gain from repeated words."""
    held, size = [], 0
    for block in blocks(batches, column, limit):
        held.append(block)
        size += pc.sum(pc.binary_length(block.column(column))).as_py() or 0
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case: code of each token, the words by code, row of each token."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, rows = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py():
        flat, rows = flat.filter(full), rows.filter(full)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, rows.to_numpy()
