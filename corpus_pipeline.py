"""From raw documents to token files: five stages, each written as Parquet and reread by the next.

1. ``toxicity`` (operator 3): documents that the grammar rejects go.
2. ``near_dedup`` (operator 4): one document of each near-duplicate class stays, the one with the smallest id.
3. ``decontaminate`` (operator 10): documents that cover a benchmark item by half or more go.
4. ``mix`` (operator 5): sources by weight; a document is taken up to three times and then stands in as many rows.
5. ``tokens`` (operator 8): token files in order of id; the result is read back from them.

What a stage has stored on its way is deleted when the next one starts, whose documents are then written.
A stage works on all that the one before it kept, and all but the last return the columns of
``documents``. Nulls, empty tables and repeated rows are handled as the operators state. SQL cannot
express the fitted grammar, so there is no SQL for the whole; the tests compare a run with a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketcast.llm import mixing, near_dedup, tiling, token_files, toxicity
from basketcast.llm.common import new_folder, stage, stored, table
from basketcast.llm.queries import tokenizer_path


@stage
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; the grammar is fitted to the labelled documents of ``sf_dir``."""
    grammar = toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, grammar)


@stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


@stage
def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


@stage
def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    target = new_folder(spark, "corpus-tokens")
    token_files.write_tokens(docs, target, tokenizer_path())
    return token_files.digests(token_files.read_tokens(spark, target))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, build in STAGES:
        docs = stored(build(spark, docs, sf_dir))
    return docs
