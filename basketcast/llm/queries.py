"""One query per operator over its whole table, and the SQL twins that exist."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketcast.llm import (
    alignment, byte_cnn, chat, exact_dedup, mixing, near_dedup, pitman_yor, secrets, tiling, token_counts, token_files, toxicity, turn_repair,
)
from basketcast.llm.common import new_folder, table
from basketcast.session import delete_at_end

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_token_files")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    target = new_folder(spark, "tokens")
    token_files.write_tokens(table(spark, folder, "documents"), target, tokenizer_path())
    return token_files.digests(token_files.read_tokens(spark, target))


@query("op9_exact_dedup", sql=r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@query("op10_tiling")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: the benchmark items it covers by half or more, and the largest coverage of any item."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return tiling.tile(docs, table(spark, folder, "benchmark")).select(
        "doc_id", (F.size("leak_items") > 0).alias("contaminated"), F.array_sort("leak_items").alias("item_ids"), "leak_coverage")


@query("op1_secrets")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, folder, "documents")))


def escaped_sql(column: str) -> str:
    text = f"replace({column}, '\\', '\\\\')"
    for control in chat.CONTROL:
        text = f"replace({text}, '{control}', '{control[0]}\\{control[1:]}')"
    return text


MARKS = len(chat.TURN) + len(chat.TEXT) + len(chat.END)


@query("op2_chat_examples", sql=f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS trained,
             CAST(sum({MARKS} + length({escaped_sql('role')}) + length({escaped_sql('text')})) AS BIGINT) AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(trained) AS loss_chars, sha256(trained) AS loss_sha256, formatted_chars FROM s""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    own = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', :said), (-1L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)", args={"said": said})
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.segments(rows.unionByName(own)))


@query("op5_mixing", sql=r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
s AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place
      FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
w AS (SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER e, 0) AS DOUBLE)
                / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER e, 0) AS DOUBLE) AS level
      FROM w WINDOW e AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, CAST(most AS DOUBLE) <= weight * level AS held FROM l),
t AS (SELECT source, place, source_size,
             CASE WHEN held THEN CAST(most AS DOUBLE)
                  ELSE weight * (SELECT arg_min(level, (most / weight, place)) FROM h WHERE NOT held) END AS target FROM h),
q AS (SELECT doc_id, size, place, source_size, target,
             CAST(sum(size) OVER (PARTITION BY place ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT doc_id, place, size, pass, CAST(pass * source_size + upto AS DOUBLE) / target AS finish
      FROM q, (VALUES (0), (1), (2)) p(pass) WHERE size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, place, doc_id, size, pass ROWS UNBOUNDED PRECEDING) AS running FROM i),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM r WHERE running <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0) AS taken FROM q LEFT JOIN k USING (doc_id)""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan_mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes_taken")).alias("taken"))


@query("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    grammar = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, grammar).select(
        "doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "matched_clauses")


@query("op6_byte_cnn")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    network = byte_cnn.fit(docs, table(spark, folder, "labels"))
    return byte_cnn.score(docs, network).select(
        "doc_id", byte_cnn.held_out().alias("held_out"), F.col("quality").alias("score"),
        (F.col("quality") >= byte_cnn.THRESHOLD).cast("int").alias("predicted"))


@query("op4_prob_minhash")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate class of every document: the smallest id of its class."""
    return near_dedup.near_classes(table(spark, folder, "documents"))


@query("op7_pitman_yor")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, folder, "documents"))


@query("op11_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.link_counts(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query("op12_token_counts")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Counts answered from a cache that this run starts empty."""
    cache = new_folder(spark, "token-counts")
    delete_at_end(spark, cache)
    return token_counts.count_tokens(table(spark, folder, "documents"), cache, tokenizer_path("byte_bpe_50k.json"))


@query("op13_turn_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(table(spark, folder, "conversations")))
