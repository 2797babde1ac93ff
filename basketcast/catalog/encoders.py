"""Categorical encoders, bins and folds."""

from pyspark.sql import functions as F

from basketcast.catalog.registry import SCORED, each, long_sql, query, twin
from basketcast.constants import DEFAULT_CONFIDENCE, TARGETS
from basketcast.functions.scalars import coalesce_category
from basketcast.operators import encode
from basketcast.operators.bayes import bayes_posterior, long_scores
from basketcast.operators.clean import map_category
from basketcast.operators.folds import attach_fold, stratified_group_folds

LEVELS = {
    "store": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "age_band": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "gender": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
}
FOLD_SQL = """
prof AS (SELECT customer_id, count(*) AS size, bit_or(1 << (choc + 2 * beer + 4 * hair + 8 * rice)) AS signature FROM fact GROUP BY customer_id),
folds AS (SELECT customer_id, size, signature, CAST((ROW_NUMBER() OVER (PARTITION BY signature
            ORDER BY size DESC, substr(md5(CAST(customer_id AS VARCHAR)), 1, 3), customer_id) - 1
            + CAST('0x' || substr(md5(CAST(signature AS VARCHAR)), 1, 4) AS BIGINT)) % 4 AS INTEGER) AS fold FROM prof)"""
EDGE_SQL = """
edges AS (SELECT target, list_sort(list_distinct(quantile_cont(score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e
          FROM long GROUP BY target)"""
# First upper edge that reaches the score, counted from 0; none gives 0.
BIN_SQL = """
binned AS (SELECT long.*, CAST(COALESCE((SELECT min(i) - 2 FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS i)
             WHERE i >= 2 AND score <= x), 0) AS INTEGER) AS bin FROM long JOIN edges USING (target))"""


def scored(retail):
    """Validation sessions with the posterior for the default confidence."""
    retail.keep()
    return bayes_posterior(retail.history, retail.validation, TARGETS, DEFAULT_CONFIDENCE)


@query("one_hot", twin("session", "SELECT session_id, " + ", ".join(
    f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS {c}_is_{i}" for c, vs in LEVELS.items() for i, v in enumerate(vs)) + " FROM session"))
def one_hot(retail):
    base = retail.sessions.select("session_id", *LEVELS)
    levels = encode.category_levels(base, list(LEVELS))
    wide = encode.one_hot(base, list(LEVELS), levels)
    return wide.select("session_id", *[F.col(f"`{c}_{v}`").alias(f"{c}_is_{i}") for c in LEVELS for i, v in enumerate(levels[c])])


@query("sparse_one_hot", twin("session", "SELECT session_id, " + "concat_ws(',', " + ", ".join(
    f"CAST({c}_code + {' + '.join(['0', *[f'(SELECT count(*) FROM of_{o})' for o in list(LEVELS)[:i]]])} AS VARCHAR)" for i, c in enumerate(LEVELS)) + ") AS hot FROM session "
    + " ".join(f"LEFT JOIN of_{c} USING ({c})" for c in LEVELS), *[
    f"of_{c} AS (SELECT {c}, ROW_NUMBER() OVER (ORDER BY {c}) - 1 AS {c}_code FROM (SELECT DISTINCT {c} FROM session WHERE {c} IS NOT NULL))" for c in LEVELS]))
def sparse_one_hot(retail):
    """Places of the set indicators of each session, whatever the number of levels."""
    hot = encode.sparse_one_hot(retail.sessions.select("session_id", *LEVELS), list(LEVELS))
    return hot.select("session_id", F.concat_ws(",", F.transform("hot", lambda i: i.cast("string"))).alias("hot"))


@query("label_encode", twin("session", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS label, CAST(ROW_NUMBER() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code FROM "
    f"(SELECT DISTINCT {c} FROM session WHERE split = 'train')" for c in LEVELS)))
def label_encode(retail):
    train = retail.with_attributes(retail.visits_of("train"))
    parts = [encode.label_encode(train, c).select(F.lit(c).alias("column_name"), F.col(c).alias("label"), "code") for c in LEVELS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("label_transform_unknown", twin("session", """
SELECT session_id, CASE store WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE -1 END AS code FROM session"""))
def label_transform_unknown(retail):
    codes = encode.label_encode(retail.visits.filter("store <> '5-LOW'"), "store")
    return encode.label_transform(retail.visits.select("session_id", "store"), codes, "store").select("session_id", "code")


@query("stratified_group_folds", twin("fact", "SELECT customer_id, CAST(size AS BIGINT) AS size, CAST(signature AS INTEGER) AS signature, fold FROM folds", FOLD_SQL))
def folds(retail):
    return stratified_group_folds(retail.outcomes, TARGETS)


def dealt(retail):
    retail.keep()
    return attach_fold(retail.facts.select("session_id", "customer_id", *LEVELS, *TARGETS),
                       stratified_group_folds(retail.facts, TARGETS))


@query("target_encode_oof", twin("fact", f"""
SELECT store, k AS fold, {each('avg({t}) AS store_te_{t}')} FROM dealt JOIN (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS k) ON dealt.fold <> k
GROUP BY store, k""", FOLD_SQL, "dealt AS (SELECT * FROM fact JOIN folds USING (customer_id))"))
def target_encode_oof(retail):
    return encode.target_encode_oof(dealt(retail), "store", TARGETS)


@query("target_encode_full", twin("fact", f"SELECT age_band, {each('avg({t}) AS age_band_te_{t}')} FROM fact GROUP BY age_band"))
def target_encode_full(retail):
    return encode.target_encode_full(retail.facts, "age_band", TARGETS)


@query("map_category", twin("log", """
SELECT session_id, jan, COALESCE(nullif(category_raw, ''), nullif(division, ''), CAST(jan AS VARCHAR)) AS category
FROM log JOIN jan USING (jan)"""))
def mapped(retail):
    out = map_category(retail.log.select("session_id", "jan"), retail.products, coalesce_category(["category_raw", "division"]))
    return out.select("session_id", "jan", "category")


@query("quantile_bin10", twin("fact", """
SELECT target, round(unnest(e), 6) AS edge, CAST(generate_subscripts(e, 1) - 1 AS INTEGER) AS position FROM edges""",
    *SCORED, long_sql(), EDGE_SQL))
def quantile_bin10(retail):
    edges = encode.decile_edges(long_scores(scored(retail), TARGETS, "bayes_", []), ["target"], "score")
    return edges.select("target", F.posexplode("edges").alias("position", "edge")).withColumn("edge", F.round("edge", 6))


@query("bin_lookup", twin("fact", "SELECT session_id, target, bin FROM binned", *SCORED, long_sql(), EDGE_SQL, BIN_SQL))
def bin_lookup(retail):
    long = long_scores(scored(retail), TARGETS, "bayes_", ["session_id"])
    edges = encode.decile_edges(long, ["target"], "score")
    return long.join(F.broadcast(edges), "target").select("session_id", "target", encode.bin_lookup("score", "edges").alias("bin"))
