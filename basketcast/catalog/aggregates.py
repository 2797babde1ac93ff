"""Group statistics."""

from pyspark.sql import functions as F

from basketcast.catalog.encoders import BIN_SQL, EDGE_SQL, scored
from basketcast.catalog.joins import RATIO_SQL
from basketcast.catalog.registry import SCORED, each, long_sql, query, text_date, twin
from basketcast.constants import EMBED_DIM, TARGETS
from basketcast.operators import bayes, evaluate, stats
from basketcast.operators.clean import filter_returns, map_category
from basketcast.operators.encode import decile_edges
from basketcast.operators.coordinates import coordinate_matrix, rank_codes, sparse_rows
from basketcast.operators.factorise import project, svd_fit
from basketcast.operators.overlap import union_all
from basketcast.functions.scalars import coalesce_category, cycle_proximity as rule
from basketcast.session import materialise, store
from basketcast.sources.surrogate import BRANDS, MONEY

ALL_BRANDS = [f"Brand#{i}" for i in range(1, 26)]
SORTED_BRANDS = sorted(ALL_BRANDS)


def category_sums(retail, value, purchases_only=True):
    log = filter_returns(retail.purchases) if purchases_only else retail.log
    return stats.session_category_sum(log, retail.products, value)


@query("session_category_amount", twin("log", """
SELECT session_id, category, CAST(sum(amount) AS DOUBLE) AS amount FROM log LEFT JOIN jan USING (jan) WHERE quantity > 0 GROUP BY session_id, category"""))
def session_category_amount(retail):
    return category_sums(retail, "amount").withColumn("amount", F.col("amount").cast("double"))


@query("session_category_quantity", twin("log", """
SELECT session_id, category, sum(quantity) AS quantity FROM log LEFT JOIN jan USING (jan) WHERE quantity > 0 GROUP BY session_id, category"""))
def session_category_quantity(retail):
    return category_sums(retail, "quantity")


def pivot_sql(value: str) -> str:
    return ", ".join(f"COALESCE(sum(CASE WHEN category = '{b}' THEN {value} END), 0) AS c{i}" for i, b in enumerate(SORTED_BRANDS))


def ascii_names(df, names, key):
    return df.select(key, *[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])


@query("customer_category_matrix", twin("session log", f"""
SELECT customer_id, {pivot_sql('quantity')} FROM session LEFT JOIN (SELECT * FROM log JOIN jan USING (jan) WHERE quantity > 0) USING (session_id)
WHERE split = 'train' GROUP BY customer_id"""))
def customer_category_matrix(retail):
    names = stats.category_names(retail.products)
    wide = stats.customer_category_matrix(retail.visits_of("train"), category_sums(retail, "quantity"), names, "quantity")
    return ascii_names(wide, names, "customer_id")


@query("session_category_pivot", twin("log", f"""
SELECT session_id, {pivot_sql('quantity')} FROM log JOIN jan USING (jan) GROUP BY session_id"""))
def session_category_pivot(retail):
    mapped = map_category(retail.log, retail.products, F.col("category"))
    names = sorted(r[0] for r in stats.top_categories(mapped, 100).select("category").collect())
    return ascii_names(stats.category_matrix(mapped, "session_id", names, "quantity"), names, "session_id")


@query("purchase_indicator_matrix", twin("log", f"SELECT session_id, {each('i_{t}')} FROM ind", RATIO_SQL))
def purchase_indicator_matrix(retail):
    out = stats.purchase_indicators(category_sums(retail, "quantity"), list(BRANDS.values()))
    return out.select("session_id", *[F.col(f"`{b}`").alias(f"i_{t}") for t, b in BRANDS.items()])


@query("purchase_ratio", twin("session log", " UNION ALL ".join(
    f"SELECT '{k}' AS dimension, CAST({k} AS VARCHAR) AS value, {each('COALESCE(avg(i_{t}), -1) AS {t}')} "
    f"FROM session LEFT JOIN ind USING (session_id) WHERE split = 'train' GROUP BY {k}" for k in ("customer_id", "gender", "age_band", "store")), RATIO_SQL))
def purchase_ratio(retail):
    ind = stats.purchase_indicators(category_sums(retail, "quantity"), list(BRANDS.values())).withColumnsRenamed(
        {b: t for t, b in BRANDS.items()})
    out = stats.purchase_ratio(retail.with_attributes(retail.visits_of("train")), ind, TARGETS, ("customer_id", "gender", "age_band", "store"))
    return out.fillna(-1.0, subset=list(TARGETS))


def session_rows(retail):
    """Sparse rows of kept quantities by session, the code table, and the number of categories."""
    codes = store(rank_codes(retail.products, "category"))
    matrix = stats.session_categories(filter_returns(retail.purchases), retail.products, codes, ["quantity"])
    # The fit and the projection read the same rows.
    rows = store(sparse_rows(matrix.withColumnRenamed("quantity", "value"), "session_id"))
    return rows, codes, codes.count()


def embeddings(retail, dim=EMBED_DIM):
    """(rows, embedding of each, basis) with the basis fitted on training sessions."""
    rows, _, width = session_rows(retail)
    fit = rows.join(retail.visits_of("train").select("session_id"), "session_id", "left_semi")
    basis, _ = svd_fit(fit, width, dim)
    return rows, project(rows, basis, "session_id"), basis


# Added before rounding, so that sums of either engine that should end on half a digit round alike.
NUDGE = 3e-8


def reconstructed(vector, basis):
    """Columns ``c0 ..`` of a row or mean row, from its coordinates: what does not depend on the rotation of the basis."""
    columns = []
    for i, line in enumerate(basis):
        weights = F.array(*[F.lit(float(x)) for x in line])
        value = F.aggregate(F.zip_with(vector, weights, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        columns.append(F.round(value + NUDGE, 6).alias(f"c{i}"))
    return columns


ROW_SQL = f"""
kept_rows AS (SELECT session_id, {pivot_sql('quantity')} FROM log JOIN jan USING (jan) WHERE quantity > 0 GROUP BY session_id)"""
CELLS = range(len(SORTED_BRANDS))


@query("truncated_svd", twin("log", f"SELECT session_id, {', '.join(f'round(c{i} + {NUDGE}::DOUBLE, 6) AS c{i}' for i in CELLS)} FROM kept_rows", ROW_SQL))
def truncated_svd(retail):
    """Every session's embedding, led back to categories: with as many dimensions as categories nothing may be lost."""
    _, embedded, basis = embeddings(retail)
    return embedded.select("session_id", *reconstructed(F.col("embedding"), basis))


@query("attribute_mean_embedding", twin("session log", " UNION ALL ".join(
    f"SELECT '{k}' AS dimension, CAST({k} AS VARCHAR) AS value, {', '.join(f'round(avg(c{i}) + {NUDGE}::DOUBLE, 6) AS c{i}' for i in CELLS)} "
    f"FROM session LEFT JOIN kept_rows USING (session_id) WHERE split = 'train' GROUP BY {k}" for k in ("customer_id", "gender", "age_band", "store")), ROW_SQL))
def attribute_mean_embedding(retail):
    _, embedded, basis = embeddings(retail)
    out = stats.attribute_mean_embedding(retail.with_attributes(retail.visits_of("train")), embedded, basis.shape[1], ("customer_id", "gender", "age_band", "store"))
    return out.select("dimension", "value", *reconstructed(F.col("embedding"), basis))


@query("wide_svd", twin("log", """
SELECT session_id, count(*) AS products, CAST(sum(q * q) AS DOUBLE) AS squares, TRUE AS held
FROM (SELECT session_id, jan, sum(quantity) AS q FROM log WHERE quantity > 0 GROUP BY session_id, jan) GROUP BY session_id"""))
def wide_svd(retail):
    """Sessions by single products, as wide as the product master: sparse rows and their 32 leading directions.

    The squared length of an embedding is at most that of its row.
    """
    codes = store(rank_codes(retail.products, "jan"))
    lines = filter_returns(retail.purchases)
    rows = store(sparse_rows(coordinate_matrix(lines, "session_id", codes, "quantity", "jan"), "session_id"))
    fit = rows.join(retail.visits_of("train").select("session_id"), "session_id", "left_semi")
    basis, _ = svd_fit(fit, codes.count(), tolerance=1e-2)
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    embedded = project(rows, basis, "session_id").withColumn("inside", square("embedding"))
    return rows.select("session_id", F.size("codes").cast("long").alias("products"), square("values").alias("squares")).join(embedded, "session_id").select(
        "session_id", "products", "squares", (F.col("inside") <= F.col("squares") * (1 + 1e-9)).alias("held"))


@query("category_coordinates", twin("session log", f"""
SELECT 'session' AS kind, session_id AS key, code, CAST(sum(quantity) AS DOUBLE) AS value FROM log JOIN jan USING (jan) JOIN coded USING (category)
WHERE quantity > 0 GROUP BY session_id, code
UNION ALL SELECT 'customer', customer_id, code, CAST(sum(quantity) AS DOUBLE) FROM session JOIN log USING (session_id) JOIN jan USING (jan) JOIN coded USING (category)
WHERE quantity > 0 AND split = 'train' GROUP BY customer_id, code""", """
coded AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT category FROM jan))"""))
def category_coordinates(retail):
    """The session and the customer matrix in the format that the factorisations read."""
    codes = store(rank_codes(retail.products, "category"))
    matrix = store(stats.session_categories(filter_returns(retail.purchases), retail.products, codes, ["quantity"]))
    people = stats.customer_categories(retail.visits_of("train"), matrix, "quantity")
    parts = [matrix.select(F.lit("session").alias("kind"), F.col("session_id").alias("key"), "code", F.col("quantity").alias("value")),
             people.select(F.lit("customer").alias("kind"), F.col("customer_id").alias("key"), "code", "value")]
    return parts[0].unionByName(parts[1]).withColumn("value", F.col("value").cast("double"))


# --- recency ---------------------------------------------------------------

def recency_select(prefix: str = "") -> str:
    def one(t):
        days = f"COALESCE(date_diff('day', {t}_last, sale_date), 999)"
        gap = (f"CASE WHEN {t}_n > 1 THEN date_diff('day', {t}_first, {t}_last) / CAST({t}_n - 1 AS DOUBLE) "
               f"WHEN {t}_n = 1 THEN 30.0::DOUBLE ELSE 999.0::DOUBLE END")
        near = f"CASE WHEN {gap} < 999 THEN greatest(least({gap} / greatest({days}, 1), 1.0::DOUBLE), 0.0::DOUBLE) ELSE 0.0::DOUBLE END"
        return (f"CAST({days} AS INTEGER) AS {t}_days, CAST(COALESCE({t}_n, 0) AS BIGINT) AS {t}_count, "
                f"{gap} AS {t}_gap, {near} AS {t}_proximity")
    return ", ".join(one(t) for t in TARGETS)


RECENCY = [f"{t}_{s}" for t in TARGETS for s in ("days", "count", "gap", "proximity")]


@query("recency_global", twin("fact", f"SELECT session_id, {recency_select()} FROM fact LEFT JOIN r USING (customer_id)", f"""
r AS (SELECT customer_id, {each('min(CASE WHEN {t} > 0 THEN sale_date END) AS {t}_first, max(CASE WHEN {t} > 0 THEN sale_date END) AS {t}_last, sum({t}) AS {t}_n')}
      FROM fact GROUP BY customer_id)"""))
def recency_global(retail):
    return stats.recency_global(retail.outcomes, retail.outcomes, TARGETS).select("session_id", *RECENCY)


@query("recency_asof", twin("fact", f"SELECT session_id, {recency_select()} FROM r", f"""
r AS (SELECT session_id, any_value(f.sale_date) AS sale_date, {each('min(CASE WHEN h_{t} > 0 THEN h_date END) AS {t}_first, max(CASE WHEN h_{t} > 0 THEN h_date END) AS {t}_last, sum(h_{t}) AS {t}_n')}
      FROM fact f LEFT JOIN (SELECT customer_id, sale_date AS h_date, {each('{t} AS h_{t}')} FROM fact) h
      ON h.customer_id = f.customer_id AND h_date < f.sale_date GROUP BY session_id)"""))
def recency_asof(retail):
    return stats.recency_asof(retail.outcomes, retail.outcomes, TARGETS).select("session_id", *RECENCY)


GAP_SQL = "b AS (SELECT customer_id, target, sale_date, count(*) - 1 AS same_day FROM (" + " UNION ALL ".join(
    f"SELECT customer_id, sale_date, '{t}' AS target FROM fact WHERE {t} > 0" for t in TARGETS) + ") GROUP BY ALL)"


@query("cycle_proximity", twin("fact", """
SELECT customer_id, target, CAST(sale_date AS VARCHAR) AS sale_date,
       CASE WHEN gap < 999 THEN greatest(least(gap / greatest(date_diff('day', sale_date, DATE '2001-08-01'), 1), 1.0::DOUBLE), 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS proximity
FROM (SELECT *, COALESCE(CAST(date_diff('day', lag(sale_date) OVER (PARTITION BY customer_id, target ORDER BY sale_date), sale_date) AS DOUBLE), 999.0::DOUBLE) AS gap FROM b)""", GAP_SQL))
def cycle_proximity(retail):
    """How near a purchase is again, from the gap before each purchase day and the days since."""
    gaps = text_date(stats.purchase_gaps(retail.outcomes, TARGETS).withColumn(
        "proximity", rule(F.coalesce(F.col("gap").cast("double"), F.lit(999.0)), F.datediff(F.to_date(F.lit("2001-08-01")), "sale_date"))), "sale_date")
    return gaps.select("customer_id", "target", "sale_date", "proximity")


@query("purchase_gaps", twin("fact", """
SELECT customer_id, target, CAST(sale_date AS VARCHAR) AS sale_date, CAST(same_day AS BIGINT) AS same_day,
       COALESCE(CAST(date_diff('day', lag(sale_date) OVER (PARTITION BY customer_id, target ORDER BY sale_date), sale_date) AS INTEGER), -1) AS gap
FROM b""", "b AS (SELECT customer_id, target, sale_date, count(*) - 1 AS same_day FROM (" + " UNION ALL ".join(
    f"SELECT customer_id, sale_date, '{t}' AS target FROM fact WHERE {t} > 0" for t in TARGETS) + ") GROUP BY ALL)"))
def purchase_gaps(retail):
    return text_date(stats.purchase_gaps(retail.outcomes, TARGETS), "sale_date").fillna(-1, subset=["gap"])


# --- target means ----------------------------------------------------------

GROUPS = {"weekday": "weekday", "band": "time_band", "phase": "month_start, month_end", "store": "store", "segment": "age_band, gender, store"}


@query("group_mean", twin("fact", " UNION ALL ".join(
    f"SELECT '{n}' AS grouping_name, concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys.split(', '))}) AS key, {each('avg({t}) AS {t}')} "
    f"FROM fact WHERE split = 'train' AND {keys.split(', ')[0]} IS NOT NULL GROUP BY {keys}" for n, keys in GROUPS.items())))
def group_mean(retail):
    """One grouped mean for each marginal."""
    history = retail.keep().history
    return union_all(*[stats.group_mean(history, keys, TARGETS).select(
        F.lit(name).alias("grouping_name"), F.concat_ws("|", *[F.col(c).cast("string") for c in keys]).alias("key"), *TARGETS)
        for name, keys in bayes.MARGINALS.items()])


@query("bayes_counts", twin("fact", f"""
SELECT concat_ws('|', age_band, gender, store) AS key, {each('CAST(count({t}) AS BIGINT) AS {t}_count, CAST(sum({t}) AS BIGINT) AS {t}_sum')} FROM fact WHERE split = 'train' GROUP BY age_band, gender, store
UNION ALL SELECT CAST(customer_id AS VARCHAR), {each('CAST(count({t}) AS BIGINT), CAST(sum({t}) AS BIGINT)')} FROM fact WHERE split = 'train' GROUP BY customer_id"""))
def bayes_counts(retail):
    names = [f"{t}_{s}" for t in TARGETS for s in ("count", "sum")]
    segments = bayes.bayes_counts(retail.history, ("age_band", "gender", "store"), TARGETS)
    people = bayes.bayes_counts(retail.history, ["customer_id"], TARGETS)
    return segments.select(F.concat_ws("|", "age_band", "gender", "store").alias("key"), *names).unionByName(
        people.select(F.col("customer_id").cast("string").alias("key"), *names))


@query("weighted_bayes_counts", twin("fact", f"""
SELECT gender, {each('round(sum(w_{t}), 6) AS {t}_count, round(sum({t} * w_{t}), 6) AS {t}_sum')}
FROM (SELECT *, {', '.join(f"exp(-{r}::DOUBLE * date_diff('day', sale_date, (SELECT max(sale_date) FROM fact WHERE split = 'train'))) AS w_{t}" for t, r in stats.DECAY_RATES.items())}
      FROM fact WHERE split = 'train') GROUP BY gender"""))
def weighted_bayes_counts(retail):
    aged = stats.time_decay_weight(retail.history)
    out = bayes.bayes_counts(aged, ["gender"], TARGETS, {t: f"weight_{t}" for t in TARGETS})
    return out.select("gender", *[F.round(f"{t}_{s}", 6).alias(f"{t}_{s}") for t in TARGETS for s in ("count", "sum")])


@query("conditional_purchase", twin("fact", "SELECT " + ", ".join(
    f"avg(CASE WHEN {a} > 0 THEN {b} END) AS {a}_to_{b}" for a in TARGETS for b in TARGETS if a != b) + " FROM fact WHERE split = 'train'"))
def conditional_purchase(retail):
    return stats.conditional_purchase(retail.outcomes.filter("split = 'train'"), TARGETS)


@query("overall_mean", twin("fact", f"SELECT {each('avg({t}) AS {t}')} FROM fact WHERE split = 'train'"))
def overall_mean(retail):
    return stats.overall_mean(retail.outcomes.filter("split = 'train'"), TARGETS)


@query("class_weights", twin("fact", f"SELECT {each('least(sum(1 - {t}) / CAST(nullif(sum({t}), 0) AS DOUBLE), 15.0::DOUBLE) AS {t}')} FROM fact WHERE split = 'train'"))
def class_weights(retail):
    return stats.class_weights(retail.outcomes.filter("split = 'train'"), TARGETS)


@query("date_extent", twin("session", """
SELECT split, CAST(min(sale_date) AS VARCHAR) AS first_date, CAST(max(sale_date) AS VARCHAR) AS last_date, CAST(count(*) AS BIGINT) AS n FROM session GROUP BY split"""))
def date_extent(retail):
    return text_date(stats.date_extent(retail.visits), "first_date", "last_date")


# --- money -----------------------------------------------------------------

SESSION_MONEY_SQL = "sm AS (SELECT session_id, " + ", ".join(
    f"sum({m}) AS {m}_sum, CAST(round(CAST(sum({m}) AS DOUBLE) / count({m}), 6) AS DECIMAL(18,6)) AS {m}_mean, count({m}) AS {m}_count" for m in MONEY) + " FROM log GROUP BY session_id)"


def customer_money_sql(name: str, where: str) -> str:
    return f"{name} AS (SELECT customer_id, " + ", ".join(
        f"CAST(sum({m}_{s}) AS DOUBLE) / count(*) AS {m}_{s}" for m in MONEY for s in ("sum", "mean", "count")) + \
        f" FROM sm JOIN session USING (session_id) WHERE {where} GROUP BY customer_id)"


CUSTOMER_MONEY_SQL = customer_money_sql("cm", "split = 'train'")
MONEY_NAMES = stats.money_columns(MONEY)


@query("session_money", twin("log", "SELECT session_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MONEY_NAMES) + " FROM sm", SESSION_MONEY_SQL))
def session_money(retail):
    return stats.session_money(retail.log, MONEY).select("session_id", *[F.col(c).cast("double").alias(c) for c in MONEY_NAMES])


@query("customer_money", twin("session log", f"""
SELECT 'train' AS known, customer_id, {', '.join(MONEY_NAMES)} FROM cm
UNION ALL SELECT 'train+valid', customer_id, {', '.join(MONEY_NAMES)} FROM cv""",
    SESSION_MONEY_SQL, CUSTOMER_MONEY_SQL, customer_money_sql("cv", "split IN ('train', 'valid')")))
def customer_money(retail):
    per_session = store(stats.session_money(retail.log, MONEY))
    train = stats.customer_money(per_session, retail.visits_of("train"), MONEY)
    both = stats.customer_money(per_session, retail.visits.filter("split in ('train', 'valid')"), MONEY)
    return train.select(F.lit("train").alias("known"), "*").unionByName(both.select(F.lit("train+valid").alias("known"), "*"))


@query("default_money", twin("session log", "SELECT " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in MONEY_NAMES) + " FROM cm",
                             SESSION_MONEY_SQL, CUSTOMER_MONEY_SQL))
def default_money(retail):
    people = stats.customer_money(stats.session_money(retail.log, MONEY), retail.visits_of("train"), MONEY)
    return stats.default_money(people, MONEY).select(*[F.round(c, 4).alias(c) for c in MONEY_NAMES])


@query("presence_flags", twin("session log", """
SELECT session_id, CASE WHEN sm.session_id IS NOT NULL THEN 1 ELSE 0 END AS has_session_money,
       CASE WHEN cm.customer_id IS NOT NULL THEN 1 ELSE 0 END AS has_customer_money
FROM session s LEFT JOIN sm USING (session_id) LEFT JOIN cm USING (customer_id)""".replace("SELECT session_id", "SELECT s.session_id"),
    SESSION_MONEY_SQL, CUSTOMER_MONEY_SQL))
def presence_flags(retail):
    per_session = stats.session_money(retail.log, MONEY)
    people = stats.customer_money(per_session, retail.visits_of("train"), MONEY)
    return stats.presence_flags(retail.visits.select("session_id", "customer_id"), per_session, people).drop("customer_id")


@query("category_frequency", twin("log", """
SELECT COALESCE(nullif(category_raw, ''), nullif(division, ''), CAST(jan AS VARCHAR)) AS category, CAST(count(*) AS BIGINT) AS n
FROM log JOIN jan USING (jan) GROUP BY 1"""))
def category_frequency(retail):
    mapped = map_category(retail.log, retail.products, coalesce_category(["category_raw", "division"]))
    return stats.category_frequency(mapped)


# --- errors and distributions ----------------------------------------------

DIMENSION_SQL = " UNION ALL ".join(
    f"SELECT target, '{d}' AS dimension, CAST({c} AS VARCHAR) AS value, y - score AS error FROM binned WHERE {c} IS NOT NULL"
    for d, c in (("age_band", "age_band"), ("store", "store"), ("weekday", "weekday"), ("time_band", "time_band"), ("bin", "bin")))


def scored_edges(retail):
    rows = materialise(scored(retail))
    return rows, decile_edges(bayes.long_scores(rows, TARGETS, "bayes_", []), ["target"], "score")


@query("error_by_dimension", twin("fact", f"SELECT target, dimension, value, round(avg(error), 9) AS mean_error FROM ({DIMENSION_SQL}) GROUP BY ALL",
                                  *SCORED, long_sql(), EDGE_SQL, BIN_SQL))
def error_by_dimension(retail):
    rows, edges = scored_edges(retail)
    return bayes.error_by_dimension(rows, TARGETS, "bayes_", edges).withColumn("mean_error", F.round("mean_error", 9))


@query("abs_error_report", twin("fact", f"SELECT target, dimension, value, round(avg(abs(error)), 9) AS mae FROM ({DIMENSION_SQL}) WHERE dimension <> 'bin' GROUP BY ALL",
                                *SCORED, long_sql(), EDGE_SQL, BIN_SQL))
def abs_error_report(retail):
    rows, edges = scored_edges(retail)
    return evaluate.abs_error_report(rows, TARGETS, "bayes_", edges).withColumn("mae", F.round("mae", 9))


@query("error_totals", twin("fact", """
SELECT target, round(avg(y - score), 9) AS mean_error, round(avg(abs(y - score)), 9) AS mae, round(min(y - score), 9) AS min_error,
       round(max(y - score), 9) AS max_error FROM long GROUP BY target""", *SCORED, long_sql()))
def error_totals(retail):
    out = evaluate.error_totals(scored(retail), TARGETS, "bayes_")
    return out.select("target", *[F.round(c, 9).alias(c) for c in out.columns if c != "target"])


@query("prediction_summary", twin("fact", """
SELECT target, CAST(count(score) AS BIGINT) AS n, round(avg(score), 9) AS mean, round(stddev_samp(score), 9) AS std, round(min(score), 9) AS min,
       round(max(score), 9) AS max, round(avg(CASE WHEN score > 0.9 THEN 1 ELSE 0 END), 9) AS share_above_09,
       round(avg(CASE WHEN score < 0.1 THEN 1 ELSE 0 END), 9) AS share_below_01,
       round(avg(CASE WHEN score > 0.99 OR score < 0.01 THEN 1 ELSE 0 END), 9) AS share_extreme,
       round(quantile_cont(score, 0.25), 9) AS q25, round(quantile_cont(score, 0.5), 9) AS median, round(quantile_cont(score, 0.75), 9) AS q75
FROM long GROUP BY target""", *SCORED, long_sql()))
def prediction_summary(retail):
    out = evaluate.prediction_summary(bayes.long_scores(scored(retail), TARGETS, "bayes_", []))
    return out.select("target", "n", *[F.round(c, 9).alias(c) for c in out.columns if c not in ("target", "n")])
