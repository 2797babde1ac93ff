"""Purchase sequences and session windows."""

from pyspark.sql import functions as F

from basketcast.functions.calendar import calendar_features
from basketcast.catalog.registry import each, query, text_date, twin
from basketcast.constants import HOLIDAYS_2024, RANDOM_CUT, TARGETS
from basketcast.functions.scalars import CYCLE_DIVISORS
from basketcast.operators import sequences
from basketcast.operators.stats import money_columns
from basketcast.plans.session_tensors import encoded_sessions, session_vectors
from basketcast.session import store
from basketcast.sources.surrogate import MONEY

BASKET_SQL = f"""
baskets AS (SELECT customer_id, sale_date, session_id, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY sale_date, session_id) - 1 AS pos,
      string_split(concat_ws(',', {each("CASE WHEN {t} > 0 THEN '{t}' END")}), ',') AS items
      FROM fact WHERE split = 'train' AND {each('{t}', ' + ')} > 0)"""
PATTERN_SQL = f"""
items AS (SELECT customer_id, pos, unnest(items) AS item FROM baskets),
patterns AS (SELECT a.item AS c1, b.item AS c2, count(*) AS total,
               {each("CAST(sum(CASE WHEN list_contains(c.items, '{t}') THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS p_{t}")}
             FROM items a JOIN items b ON a.customer_id = b.customer_id AND b.pos = a.pos + 1
             JOIN baskets c ON c.customer_id = a.customer_id AND c.pos = a.pos + 2
             GROUP BY a.item, b.item HAVING count(*) >= 5)"""
LATEST_SQL = """
latest AS (SELECT customer_id, max(CASE WHEN back = 2 THEN items[1] END) AS c1, max(CASE WHEN back = 1 THEN items[1] END) AS c2
           FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY sale_date DESC, session_id DESC) AS back FROM baskets)
           WHERE back <= 2 GROUP BY customer_id HAVING count(*) = 2)"""
ORDERED_SQL = """
ordered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id, split ORDER BY sale_date, hour, session_id) - 1 AS pos FROM session)"""


def train_outcomes(retail):
    return retail.outcomes.filter("split = 'train'")


@query("purchase_sequence", twin("fact", """
SELECT customer_id, session_id, CAST(pos AS BIGINT) AS pos, array_to_string(items, ',') AS basket FROM baskets""", BASKET_SQL))
def purchase_sequence(retail):
    out = sequences.purchase_sequence(train_outcomes(retail), TARGETS)
    return out.select("customer_id", "session_id", "pos", F.concat_ws(",", "basket").alias("basket"))


@query("sequence_patterns", twin("fact", f"SELECT c1, c2, CAST(total AS BIGINT) AS total, {each('p_{t}')} FROM patterns", BASKET_SQL, PATTERN_SQL))
def sequence_patterns(retail):
    return sequences.sequence_patterns(sequences.purchase_sequence(train_outcomes(retail), TARGETS), TARGETS)


@query("latest_sequence", twin("fact", "SELECT customer_id, c1, c2 FROM latest", BASKET_SQL, LATEST_SQL))
def latest_sequence(retail):
    return sequences.latest_sequence(train_outcomes(retail), TARGETS)


@query("sequence_score", twin("fact", f"""
SELECT session_id, {each('COALESCE(p_{t}, 0) AS p_{t}')} FROM fact LEFT JOIN latest USING (customer_id) LEFT JOIN patterns USING (c1, c2)
WHERE split = 'valid'""", BASKET_SQL, PATTERN_SQL, LATEST_SQL))
def sequence_score(retail):
    patterns = sequences.sequence_patterns(sequences.purchase_sequence(train_outcomes(retail), TARGETS), TARGETS)
    out = sequences.sequence_score(retail.visits_of("valid").select("session_id", "customer_id"),
                                   sequences.latest_sequence(train_outcomes(retail), TARGETS), patterns, TARGETS)
    return out.drop("customer_id")


@query("customer_sessions", twin("session", "SELECT customer_id, split, session_id, CAST(pos AS BIGINT) AS pos FROM ordered", ORDERED_SQL))
def customer_sessions(retail):
    return sequences.customer_sessions(retail.visits).select("customer_id", "split", "session_id", "pos")


WINDOW_SQL = """
windows AS (SELECT a.customer_id, a.pos AS start, string_agg(CAST(b.session_id AS VARCHAR), ',' ORDER BY b.pos) AS steps, max_by(b.session_id, b.pos) AS session_id
            FROM ordered a JOIN ordered b ON a.customer_id = b.customer_id AND b.pos BETWEEN a.pos AND a.pos + 4
            WHERE a.split = 'train' AND b.split = 'train' GROUP BY a.customer_id, a.pos HAVING count(*) = 5)"""


def train_windows(retail):
    return sequences.sliding_windows(sequences.customer_sessions(retail.visits_of("train")))


@query("sliding_windows", twin("session", "SELECT customer_id, CAST(start AS BIGINT) AS start, session_id, steps FROM windows", ORDERED_SQL, WINDOW_SQL))
def sliding_windows(retail):
    return train_windows(retail).withColumn("steps", F.concat_ws(",", F.transform("steps", lambda s: s.cast("string"))))


def draw_sql(salt: int) -> str:
    return f"CAST(CAST('0x' || substr(md5(customer_id || '|' || start || '|42|{salt}'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296"


@query("random_cut", twin("session", f"""
SELECT p.customer_id, CAST(p.start AS BIGINT) AS start, CAST(p.origin AS BIGINT) AS origin, w.session_id, w.steps
FROM (SELECT customer_id, start AS origin,
             CASE WHEN {draw_sql(1)} < {RANDOM_CUT}::DOUBLE AND start > 0 THEN start + CAST(floor({draw_sql(2)} * (last - start + 1)) AS BIGINT) ELSE start END AS start
      FROM (SELECT *, max(start) OVER (PARTITION BY customer_id) AS last FROM windows)) p
JOIN windows w ON w.customer_id = p.customer_id AND w.start = p.start""", ORDERED_SQL, WINDOW_SQL))
def random_cut(retail):
    return sequences.random_cut(train_windows(retail)).withColumn(
        "steps", F.concat_ws(",", F.transform("steps", lambda s: s.cast("string"))))


def history_sql(split: str, known: str) -> str:
    return f"""
SELECT c.session_id, concat_ws(',', COALESCE(CAST(max(CASE WHEN back = 4 THEN h.session_id END) AS VARCHAR), '-'),
       COALESCE(CAST(max(CASE WHEN back = 3 THEN h.session_id END) AS VARCHAR), '-'), COALESCE(CAST(max(CASE WHEN back = 2 THEN h.session_id END) AS VARCHAR), '-'),
       COALESCE(CAST(max(CASE WHEN back = 1 THEN h.session_id END) AS VARCHAR), '-'), CAST(c.session_id AS VARCHAR)) AS steps
FROM session c LEFT JOIN (SELECT customer_id, session_id, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY sale_date DESC, hour DESC, session_id DESC) AS back
  FROM session WHERE split IN ({known})) h ON h.customer_id = c.customer_id AND back <= 4
WHERE c.split = '{split}' GROUP BY c.session_id"""


def padded(windows):
    steps = F.transform("steps", lambda s: F.coalesce(s.cast("string"), F.lit("-")))
    return windows.select("session_id", F.concat_ws(",", steps).alias("steps"))


@query("valid_history", twin("session", history_sql("valid", "'train'")))
def valid_history(retail):
    return padded(sequences.recent_history(retail.visits_of("valid"), retail.visits_of("train")))


@query("test_history", twin("session", history_sql("test", "'train', 'valid'")))
def test_history(retail):
    return padded(sequences.recent_history(retail.visits_of("test"), retail.visits.filter("split in ('train', 'valid')")))


# --- the parts of a step vector -----------------------------------------------

STEP_MONEY = money_columns(MONEY)
CODE_SQL = ",\n".join(f"""
code_{c} AS (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS {c}_code FROM (SELECT DISTINCT {c} FROM session WHERE split = 'train' AND {c} IS NOT NULL))"""
                      for c in ("store", "age_band", "gender"))
EMBED_SQL = f"""
ranked AS (SELECT category, row_number() OVER (ORDER BY count(*) DESC, category) - 1 AS code
           FROM log JOIN jan USING (jan) JOIN session USING (session_id) WHERE split = 'train' GROUP BY category),
bought AS (SELECT session_id, {', '.join(f"COALESCE(sum(quantity) FILTER (code = {i}), 0) AS e{i}" for i in range(25))}
           FROM log JOIN jan USING (jan) JOIN ranked USING (category) GROUP BY session_id)"""
STEP_SQL = (CODE_SQL, EMBED_SQL, "sm AS (SELECT session_id, " + ", ".join(
    f"sum({m}) AS {m}_sum, round(CAST(sum({m}) AS DOUBLE) / count({m}), 6) AS {m}_mean, count({m}) AS {m}_count" for m in MONEY) + " FROM log GROUP BY session_id)",
    *[f"{name} AS (SELECT '{known}' AS money_from, customer_id, " + ", ".join(f"CAST(sum(CAST({c} AS DECIMAL(38,6))) AS DOUBLE) / count(*) AS c_{c}" for c in STEP_MONEY)
      + f" FROM sm JOIN session USING (session_id) WHERE split IN ({splits}) GROUP BY customer_id)"
      for name, known, splits in (("of_train", "train", "'train'"), ("of_both", "both", "'train', 'valid'"))],
    "people AS (SELECT * FROM of_train UNION ALL SELECT * FROM of_both)",
    "fallback AS (SELECT money_from, " + ", ".join(f"avg(c_{c}) AS d_{c}" for c in STEP_MONEY) + " FROM people GROUP BY money_from)",
    f"""
joined AS (SELECT s.session_id, s.split, s.hour, f.weekday, f.day, f.month, f.time_period,
             CASE WHEN s.sale_date IN ({', '.join(f"DATE '{d}'" for d in HOLIDAYS_2024)}) OR isodow(s.sale_date) >= 6 THEN 1.0 ELSE 0.0 END AS holiday,
             COALESCE(store_code, -1) AS store_code, COALESCE(age_band_code, -1) AS age_code, COALESCE(gender_code, -1) AS gender_code,
             {', '.join(f'COALESCE(e{i}, 0) AS e{i}' for i in range(25))},
             {', '.join(f'COALESCE(CAST(sm.{c} AS DOUBLE), 0) AS s_{c}' for c in STEP_MONEY)},
             {', '.join(f'COALESCE(c_{c}, d_{c}, 0) AS c_{c}' for c in STEP_MONEY)},
             CASE WHEN sm.session_id IS NULL THEN 0.0 ELSE 1.0 END AS has_session,
             CASE WHEN COALESCE(c_{STEP_MONEY[0]}, d_{STEP_MONEY[0]}) IS NULL THEN 0.0 ELSE 1.0 END AS has_customer
           FROM (SELECT *, CASE WHEN split = 'test' THEN 'both' ELSE 'train' END AS money_from FROM session) s JOIN fact f ON f.session_id = s.session_id
           LEFT JOIN code_store ON code_store.store = s.store LEFT JOIN code_age_band ON code_age_band.age_band = s.age_band
           LEFT JOIN code_gender ON code_gender.gender = s.gender LEFT JOIN bought b ON b.session_id = s.session_id
           LEFT JOIN sm ON sm.session_id = s.session_id LEFT JOIN people p ON p.customer_id = s.customer_id AND p.money_from = s.money_from
           LEFT JOIN fallback d ON d.money_from = s.money_from)""",
    "top AS (SELECT " + ", ".join(f"COALESCE(max({c}), 0) AS m_{c}" for c in (
        "store_code", "age_code", "gender_code", *[f"{side}_{c}" for side in "sc" for c in STEP_MONEY])) + " FROM joined WHERE split = 'train')")
STEP_PARTS = ([f"{c} / {d}::DOUBLE" for c, d in CYCLE_DIVISORS.items()] + ["holiday"] + [f"{c} / (m_{c} + 1.0::DOUBLE)" for c in ("store_code", "age_code", "gender_code")]
              + [f"e{i}" for i in range(25)] + [f"{side}_{c} / CASE WHEN m_{side}_{c} = 0 THEN 1 ELSE m_{side}_{c} END" for side in "sc" for c in STEP_MONEY]
              + ["has_session", "has_customer"])


@query("step_features", twin("fact", "SELECT session_id, " + ", ".join(
    f"round(CAST({part} AS DOUBLE) + 3e-8::DOUBLE, 6) AS v{i}" for i, part in enumerate(STEP_PARTS)) + " FROM joined CROSS JOIN top", *STEP_SQL))
def step_features(retail):
    """Whole step vectors; 25 categories are fewer than the 32 dimensions, so they stand in it as they are."""
    vectors, size = session_vectors(store(encoded_sessions(retail_calendar(retail))), retail.log, retail.products, MONEY, ["category"])
    width = sequences.step_width(STEP_MONEY, size)
    parts = vectors.select("session_id", *[F.get("features", F.lit(i)).alias(f"v{i}") for i in range(width)])
    # Rounding goes through decimals, and whole numbers, most of a vector, would come out as they are.
    whole = lambda c: F.when(F.rint(c) == F.col(c), F.col(c) + 0.0).otherwise(F.round(F.col(c) + 3e-8, 6)).alias(c)
    return parts.select("session_id", *[whole(f"v{i}") for i in range(width)])


def retail_calendar(retail):
    return calendar_features(retail.sessions).drop("holiday_or_weekend")


@query("sequence_labels", twin("fact", f"SELECT session_id, start, {each('{t}')} FROM (SELECT session_id, CAST(start AS BIGINT) AS start FROM windows) LEFT JOIN target USING (session_id)", ORDERED_SQL, WINDOW_SQL))
def sequence_labels(retail):
    out = sequences.sequence_labels(train_windows(retail), retail.targets, TARGETS)
    return out.select("session_id", "start", *TARGETS)
