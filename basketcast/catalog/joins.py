"""Joins between sessions, lines, products and statistics."""

from pyspark.sql import functions as F

from basketcast.catalog.encoders import FOLD_SQL, LEVELS, dealt
from basketcast.catalog.registry import (CUSTOMER_SQL, HISTORY_SQL, SEGMENT_SQL, VALID_SQL, each, query, text_date,
                                         twin)
from basketcast.constants import TARGETS
from basketcast.functions.calendar import weekday1_dom
from basketcast.operators import bayes, clean
from basketcast.operators.assemble import assemble_features, split_long
from basketcast.operators.encode import target_encode_oof
from basketcast.operators.skew import join_statistics
from basketcast.operators.sequences import basket_triples, purchase_sequence
from basketcast.operators.stats import customer_money, purchase_indicators, purchase_ratio, session_category_sum, session_money
from basketcast.session import materialise, store
from basketcast.sources.surrogate import BRANDS

MARGINAL_SQL = tuple(
    f"m_{name} AS (SELECT {keys}, {each('avg({t}) AS ' + name + '_{t}')} FROM hist WHERE {cond} GROUP BY {keys})"
    for name, keys, cond in (
        ("segment", "age_band, gender, store", "true"), ("weekday", "weekday", "true"),
        ("band", "time_band", "time_band IS NOT NULL"), ("phase", "month_start, month_end", "true"),
        ("store", "store", "true")))
MARGINAL_JOINS = """LEFT JOIN m_segment USING (age_band, gender, store) LEFT JOIN m_weekday USING (weekday)
LEFT JOIN m_band USING (time_band) LEFT JOIN m_phase USING (month_start, month_end) LEFT JOIN m_store USING (store)"""


@query("log_with_product", twin("log", "SELECT session_id, jan, quantity, category, division FROM log LEFT JOIN jan USING (jan)"))
def log_with_product(retail):
    return clean.log_with_product(retail.log, retail.products).select("session_id", "jan", "quantity", "category", "division")


@query("returns_with_product", twin("log", "SELECT session_id, jan, quantity, category FROM log JOIN jan USING (jan) WHERE quantity <= 0"))
def returns_with_product(retail):
    return clean.returns_with_product(retail.log, retail.products).select("session_id", "jan", "quantity", "category")


@query("restrict_to_sessions", twin("session log", """
SELECT session_id, jan, quantity FROM log WHERE session_id IN (SELECT session_id FROM session WHERE split = 'train')"""))
def restrict_to_sessions(retail):
    return clean.restrict_to_sessions(retail.log.select("session_id", "jan", "quantity"), retail.visits_of("train"))


@query("purchase_history", twin("fact", f"""
SELECT session_id, {each('{t}')}, customer_id, CAST(sale_date AS VARCHAR) AS sale_date FROM target LEFT JOIN session USING (session_id)"""))
def purchase_history(retail):
    return text_date(clean.purchase_history(retail.targets, retail.visits, ["customer_id", "sale_date"]), "sale_date")


@query("attach_group_stats", twin("fact", f"""
SELECT session_id, {each('CAST(COALESCE(n_{t}, 0) AS BIGINT) AS {t}_count, CAST(COALESCE(s_{t}, 0) AS BIGINT) AS {t}_sum, CAST(COALESCE(cn_{t}, 0) AS BIGINT) AS {t}_count_customer, CAST(COALESCE(cs_{t}, 0) AS BIGINT) AS {t}_sum_customer')}
FROM pred LEFT JOIN seg USING (age_band, gender, store) LEFT JOIN cust USING (customer_id)""", HISTORY_SQL, VALID_SQL, SEGMENT_SQL, CUSTOMER_SQL))
def attach_group_stats(retail):
    retail.keep()
    segments = bayes.segment_stats(retail.history, TARGETS)
    people = bayes.bayes_counts(retail.history, ["customer_id"], TARGETS)
    out = bayes.attach_group_stats(retail.validation, segments, people, TARGETS)
    return out.select("session_id", *[f"{t}_{s}" for t in TARGETS for s in ("count", "sum", "count_customer", "sum_customer")])


@query("lookup_marginals", twin("fact", "SELECT session_id, " + ", ".join(
    each(f"COALESCE({m}_{{t}}, -1) AS {m}_{{t}}") for m in ("segment", "weekday", "band", "phase", "store")) + f" FROM pred {MARGINAL_JOINS}",
    HISTORY_SQL, VALID_SQL, *MARGINAL_SQL))
def lookup_marginals(retail):
    table = bayes.marginal_table(retail.keep().history, TARGETS)
    out = bayes.lookup_marginals(retail.validation, table, TARGETS)
    return out.select("session_id", *[F.coalesce(f"{m}_{t}", F.lit(-1.0)).alias(f"{m}_{t}") for m in bayes.MARGINALS for t in TARGETS])


@query("replicated_marginals", twin("fact", "SELECT session_id, " + ", ".join(
    each(f"COALESCE({m}_{{t}}, -1) AS {m}_{{t}}") for m in ("segment", "weekday", "band", "phase", "store")) + f" FROM pred {MARGINAL_JOINS}",
    HISTORY_SQL, VALID_SQL, *MARGINAL_SQL))
def replicated_marginals(retail):
    """The same look-ups with tables that count as too large to broadcast: copied, and sessions spread over the copies."""
    table = bayes.marginal_table(retail.keep().history, TARGETS)
    out = bayes.lookup_marginals(retail.validation, table, TARGETS, max_bytes=0)
    return out.select("session_id", *[F.coalesce(f"{m}_{t}", F.lit(-1.0)).alias(f"{m}_{t}") for m in bayes.MARGINALS for t in TARGETS])


RATIO_SQL = f"""
ind AS (SELECT session_id, {', '.join(f"greatest(least(CAST(sum(CASE WHEN category = '{b}' THEN quantity ELSE 0 END) AS DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE) AS i_{t}" for t, b in BRANDS.items())}
        FROM log JOIN jan USING (jan) WHERE quantity > 0 GROUP BY session_id)"""
ASSEMBLE_CTES = tuple(
    f"r_{k} AS (SELECT {k}, {each(f'avg(i_{{t}}) AS {k}_ratio_{{t}}')} FROM fact LEFT JOIN ind USING (session_id) WHERE split = 'train' GROUP BY {k})"
    for k in ("customer_id", *LEVELS)) + tuple(
    f"te_{k} AS (SELECT {k}, k AS fold, {each(f'avg({{t}}) AS {k}_te_{{t}}')} FROM dealt JOIN (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS k) ON dealt.fold <> k GROUP BY {k}, k)"
    for k in LEVELS)


@query("assemble_features", twin("fact", "SELECT session_id, fold, weekday + 1 AS weekday1, day AS day_of_month, hour, " + ", ".join(
    [each(f"COALESCE({k}_ratio_{{t}}, -1) AS {k}_ratio_{{t}}") for k in ("customer_id", *LEVELS)] +
    [each(f"{k}_te_{{t}}") for k in LEVELS]) + " FROM dealt " + " ".join(
    [f"LEFT JOIN r_{k} USING ({k})" for k in ("customer_id", *LEVELS)] + [f"LEFT JOIN te_{k} USING ({k}, fold)" for k in LEVELS]),
    FOLD_SQL, "dealt AS (SELECT fact.*, fold FROM fact JOIN folds USING (customer_id))", RATIO_SQL, *ASSEMBLE_CTES))
def assembled(retail):
    keys = ("customer_id", *LEVELS)
    base = materialise(dealt(retail))
    quantity = session_category_sum(clean.filter_returns(retail.purchases), retail.products, "quantity")
    indicators = purchase_indicators(quantity, list(BRANDS.values())).withColumnsRenamed({b: t for t, b in BRANDS.items()})
    ratios = store(purchase_ratio(retail.history, indicators, TARGETS, keys), ["dimension"])
    kinds = {"customer_id": "bigint"}
    tables = {k: [split_long(ratios, TARGETS, k, "ratio_", kinds.get(k, "string"))] for k in keys}
    calendar = weekday1_dom(retail.visits.select("session_id", "sale_date", "hour")).drop("sale_date")
    out = assemble_features(base, tables, [calendar], {k: target_encode_oof(base, k, TARGETS) for k in LEVELS})
    names = [f"{k}_ratio_{t}" for k in keys for t in TARGETS]
    return out.select("session_id", "fold", "weekday1", "day_of_month", "hour",
                      *[F.coalesce(n, F.lit(-1.0)).alias(n) for n in names],
                      *[f"{k}_te_{t}" for k in LEVELS for t in TARGETS])


@query("basket_triples", twin("fact", f"""
SELECT a.customer_id, CAST(a.pos AS BIGINT) AS pos, a.item AS c1, b.item AS c2, array_to_string(c.items, ',') AS following
FROM items a JOIN items b ON a.customer_id = b.customer_id AND b.pos = a.pos + 1
JOIN baskets c ON c.customer_id = a.customer_id AND c.pos = a.pos + 2""",
    f"""baskets AS (SELECT customer_id, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY sale_date, session_id) - 1 AS pos,
      string_split(concat_ws(',', {each("CASE WHEN {t} > 0 THEN '{t}' END")}), ',') AS items
      FROM fact WHERE split = 'train' AND {each('{t}', ' + ')} > 0)""",
    "items AS (SELECT customer_id, pos, unnest(items) AS item FROM baskets)"))
def triples(retail):
    out = basket_triples(purchase_sequence(retail.outcomes.filter("split = 'train'"), TARGETS))
    return out.select("customer_id", "pos", "c1", "c2", F.concat_ws(",", "third").alias("following"))


@query("dict_lookups", twin("session log", """
SELECT session_id, customer_id, COALESCE(CAST(s AS DOUBLE), -1) AS session_amount, COALESCE(c, -1) AS customer_amount
FROM session LEFT JOIN m USING (session_id) LEFT JOIN p USING (customer_id)""",
    "m AS (SELECT session_id, sum(amount) AS s FROM log GROUP BY session_id)",
    "p AS (SELECT customer_id, CAST(sum(s) AS DOUBLE) / count(*) AS c FROM session JOIN m USING (session_id) WHERE split = 'train' GROUP BY customer_id)"))
def dict_lookups(retail):
    stats = session_money(retail.log, ["amount"])
    people = customer_money(stats, retail.visits_of("train"), ["amount"])
    own = stats.select("session_id", F.col("amount_sum").cast("double").alias("session_amount"))
    theirs = people.select("customer_id", F.col("amount_sum").alias("customer_amount"))
    return (join_statistics(retail.visits.select("session_id", "customer_id"), theirs, "customer_id").join(own, "session_id", "left")
            .fillna(-1.0, subset=["session_amount", "customer_amount"]))
