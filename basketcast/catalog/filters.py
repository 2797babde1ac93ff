"""Filters and splits."""

from pyspark.sql import functions as F

from basketcast.catalog.registry import SCORED, each, query, text_date, twin
from basketcast.constants import DEFAULT_CONFIDENCE, TARGETS
from basketcast.functions import scalars
from basketcast.operators import clean
from basketcast.operators.bayes import bayes_posterior
from basketcast.operators.folds import attach_fold, stratified_group_folds
from basketcast.catalog.encoders import FOLD_SQL
from basketcast.session import materialise
from basketcast.sources.surrogate import BRANDS

BRAND_LIST = ", ".join(f"'{b}'" for b in BRANDS.values())


@query("filter_returns", twin("log", "SELECT session_id, jan, quantity FROM log WHERE quantity > 0"))
def filter_returns(retail):
    return clean.filter_returns(retail.purchases.select("session_id", "jan", "quantity"))


@query("return_rows", twin("log", "SELECT session_id, jan, quantity FROM log WHERE quantity <= 0"))
def return_rows(retail):
    return clean.return_rows(retail.returns.select("session_id", "jan", "quantity"))


@query("target_category_filter", twin("log", f"SELECT jan, category FROM jan WHERE category IN ({BRAND_LIST})"))
def target_category_filter(retail):
    return clean.target_category(retail.products.select("jan", "category"), list(BRANDS.values()))


@query("date_range", twin("session", """
SELECT session_id, 'input' AS period FROM session WHERE sale_date BETWEEN DATE '1999-07-01' AND DATE '1999-09-30'
UNION ALL SELECT session_id, 'shifted' FROM session WHERE sale_date BETWEEN DATE '1999-08-01' AND DATE '1999-10-31'
UNION ALL SELECT session_id, 'target' FROM session WHERE sale_date BETWEEN DATE '1999-10-01' AND DATE '1999-10-30'"""))
def date_range(retail):
    periods = {"input": ("1999-07-01", "1999-09-30"), "shifted": ("1999-08-01", "1999-10-31"),
               "target": ("1999-10-01", "1999-10-30")}
    parts = [clean.date_range(retail.visits, *bounds).select("session_id", F.lit(name).alias("period"))
             for name, bounds in periods.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("temporal_split", twin("session", "SELECT session_id, split FROM session"))
def temporal_split(retail):
    return retail.visits.select("session_id", "split")


@query("month_split", twin("session", """
SELECT session_id, CASE WHEN month(sale_date) IN (7, 8, 9) THEN 'train' ELSE 'valid' END AS part
FROM session WHERE month(sale_date) IN (7, 8, 9, 10)"""))
def month_split(retail):
    return (retail.visits.select("session_id", clean.month_split().alias("part"))
            .filter(F.col("part").isNotNull()))


@query("fold_split", twin("fact", """
SELECT fold AS held_fold, CAST((SELECT count(*) FROM fact) - count(*) AS BIGINT) AS train_rows,
       CAST(count(*) AS BIGINT) AS held_rows
FROM fact JOIN folds USING (customer_id) GROUP BY fold""", FOLD_SQL))
def fold_split(retail):
    dealt = materialise(attach_fold(retail.visits.select("session_id", "customer_id"),
                                    stratified_group_folds(retail.outcomes, TARGETS)))
    parts = []
    for k in range(4):
        train, held = clean.fold_split(dealt, k)
        sized = train.withColumn("_t", F.lit(1)).unionByName(held.withColumn("_t", F.lit(0)))
        parts.append(sized.agg(F.sum("_t").alias("train_rows"), F.sum(1 - F.col("_t")).alias("held_rows"))
                     .select(F.lit(k).alias("held_fold"), "train_rows", "held_rows"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("binarise", twin("log", """
SELECT session_id, jan, CASE WHEN quantity > 0 THEN 1 ELSE 0 END AS quantity FROM log"""))
def binarise(retail):
    return scalars.binarise(retail.log.select("session_id", "jan", "quantity"), ["quantity"])


@query("clip01", twin("log", """
SELECT session_id, jan, greatest(least(quantity / 20, 1.0::DOUBLE), 0.0::DOUBLE) AS clipped FROM log"""))
def clip01(retail):
    return retail.log.select("session_id", "jan", scalars.clip01(F.col("quantity") / 20).alias("clipped"))


@query("fill_null", twin("log", """
SELECT session_id, COALESCE(CAST(sum(quantity) AS DOUBLE), 0) AS quantity
FROM (SELECT o_orderkey AS session_id FROM orders) LEFT JOIN log USING (session_id) GROUP BY session_id"""))
def fill_null(retail):
    keys = retail.visits.select("session_id")
    sums = retail.log.groupBy("session_id").agg(F.sum("quantity").alias("quantity"))
    return scalars.fill_null(keys.join(sums, "session_id", "left"), ["quantity"], 0.0)


@query("nan_guard", twin("log", """
SELECT CAST(count(*) - count(q) AS BIGINT) AS missing, CAST(count(*) AS BIGINT) AS n, CAST(sum(COALESCE(q, 0)) AS DOUBLE) AS total
FROM (SELECT o_orderkey AS session_id FROM orders) LEFT JOIN (
  SELECT session_id, sum(quantity) AS q FROM log GROUP BY session_id) USING (session_id)"""))
def nan_guard(retail):
    keys = retail.visits.select("session_id")
    sums = keys.join(retail.log.groupBy("session_id").agg(F.sum("quantity").alias("q")), "session_id", "left")
    guarded = scalars.nan_guard(sums, ["q"]).agg(F.count("*").alias("n"), F.sum("q").alias("total"))
    return guarded.withColumn("missing", scalars.nan_report(sums, ["q"]).scalar())


@query("debug_sample", twin("session", """
SELECT session_id, customer_id, CAST(sale_date AS VARCHAR) AS sale_date, hour, store, split FROM session WHERE customer_id IN (
  SELECT customer_id FROM (SELECT DISTINCT customer_id FROM session) ORDER BY md5(customer_id || '|42'), customer_id LIMIT 100)"""))
def debug_sample(retail):
    return text_date(clean.debug_sample(retail.visits, 100), "sale_date")


@query("exclude_return_sessions", twin("session log", f"""
SELECT session_id, customer_id, store FROM session WHERE session_id NOT IN (
  SELECT session_id FROM log JOIN jan USING (jan) WHERE quantity <= 0 AND category IN ({BRAND_LIST}))"""))
def exclude_return_sessions(retail):
    return clean.exclude_return_sessions(retail.visits.select("session_id", "customer_id", "store"),
                                         retail.log, retail.products, list(BRANDS.values()))


@query("posterior_nan_count", twin("fact", f"SELECT CAST({each('(count(*) - count(bayes_{t}))', ' + ')} AS BIGINT) AS missing FROM scored", *SCORED))
def posterior_nan_count(retail):
    scored = bayes_posterior(retail.history, retail.validation, TARGETS, DEFAULT_CONFIDENCE)
    return scalars.nan_report(scored, [f"bayes_{t}" for t in TARGETS])
