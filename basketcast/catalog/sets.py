"""Sorts, top lists, unions and overlaps."""

from pyspark.sql import functions as F

from basketcast.catalog.aggregates import DIMENSION_SQL, scored_edges
from basketcast.catalog.encoders import BIN_SQL, EDGE_SQL
from basketcast.catalog.registry import SCORED, long_sql, query, text_date, twin
from basketcast.constants import TARGETS
from basketcast.functions.scalars import coalesce_category
from basketcast.operators import evaluate, overlap
from basketcast.operators.clean import map_category
from basketcast.operators.stats import top_categories as top


@query("multi_key_sort", twin("session", "SELECT customer_id, CAST(sale_date AS VARCHAR) AS sale_date, hour, session_id FROM session"))
def multi_key_sort(retail):
    return text_date(overlap.multi_key_sort(retail.visits.select("customer_id", "sale_date", "hour", "session_id")), "sale_date")


@query("top_categories", twin("log", """
SELECT COALESCE(nullif(category_raw, ''), nullif(division, ''), CAST(jan AS VARCHAR)) AS category, CAST(count(*) AS BIGINT) AS n
FROM log JOIN jan USING (jan) GROUP BY 1 ORDER BY n DESC, category LIMIT 10"""))
def top_categories(retail):
    return top(map_category(retail.log, retail.products, coalesce_category(["category_raw", "division"])), 10)


@query("worst_segments", twin("fact", f"""
SELECT target, value, round(mae, 9) AS mae FROM (
  SELECT target, dimension, value, avg(abs(error)) AS mae FROM ({DIMENSION_SQL}) GROUP BY ALL)
WHERE dimension = 'store' QUALIFY ROW_NUMBER() OVER (PARTITION BY target ORDER BY mae DESC, value) <= 3""",
    *SCORED, long_sql(), EDGE_SQL, BIN_SQL))
def worst_segments(retail):
    rows, edges = scored_edges(retail)
    out = evaluate.worst_segments(evaluate.abs_error_report(rows, TARGETS, "bayes_", edges), "store", 3)
    return out.select("target", "value", F.round("mae", 9).alias("mae"))


@query("union_all", twin("session", "SELECT session_id, customer_id, store FROM session"))
def union_all(retail):
    base = retail.visits.select("session_id", "customer_id", "store", "split")
    parts = [base.filter(F.col("split") == s).drop("split") for s in overlap.SPLITS]
    return overlap.union_all(*parts)


@query("split_overlap", twin("session log", """
SELECT a || '_' || b AS pair, CAST(count(DISTINCT session_id) AS BIGINT) AS shared FROM (VALUES ('train', 'valid'), ('train', 'test'), ('valid', 'test')) v(a, b)
LEFT JOIN (SELECT x.session_id, x.split AS s1, y.split AS s2 FROM session x JOIN session y ON x.session_id = y.session_id) ON s1 = a AND s2 = b GROUP BY a, b"""))
def split_overlap(retail):
    return overlap.split_overlap(retail.visits)


@query("customer_overlap", twin("session", """
SELECT CAST(count_if(t AND v) AS BIGINT) AS train_valid, CAST(count_if(t AND x) AS BIGINT) AS train_test, CAST(count_if(v AND x) AS BIGINT) AS valid_test,
       CAST(count_if(t AND NOT v AND NOT x) AS BIGINT) AS train_only, CAST(count_if(v AND NOT t AND NOT x) AS BIGINT) AS valid_only,
       CAST(count_if(x AND NOT t AND NOT v) AS BIGINT) AS test_only
FROM (SELECT customer_id, bool_or(split = 'train') AS t, bool_or(split = 'valid') AS v, bool_or(split = 'test') AS x FROM session GROUP BY customer_id)"""))
def customer_overlap(retail):
    return overlap.customer_overlap(retail.visits)


@query("distinct_map", twin("session", "SELECT DISTINCT session_id, customer_id FROM session"))
def distinct_map(retail):
    return overlap.distinct_map(retail.visits)
