"""Registration of queries, and the pieces their SQL twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketcast.constants import TARGETS
from basketcast.sources.surrogate import FACT_SQL, LOG_SQL, SESSION_SQL, TARGET_SQL, Retail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_NEEDS = {"session": (SESSION_SQL,), "log": (LOG_SQL,), "target": (SESSION_SQL, LOG_SQL, TARGET_SQL),
          "fact": (SESSION_SQL, LOG_SQL, TARGET_SQL, FACT_SQL)}


def twin(views: str, select: str, *ctes: str) -> str:
    """SQL text: the named base views, further CTEs, then the final select."""
    base = dict.fromkeys(part for view in views.split() for part in _NEEDS[view])
    order = [part for part in (SESSION_SQL, LOG_SQL, TARGET_SQL, FACT_SQL) if part in base]
    return "WITH " + ",".join([*order, *ctes]) + "\n" + select


def query(name: str, sql: str | None = None):
    """Register a function of the retail views under a name."""
    def register(build: Callable[[Retail], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Retail(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def each(template: str, separator: str = ", ") -> str:
    """The template once per target, with ``{t}`` filled in."""
    return separator.join(template.format(t=t) for t in TARGETS)


def text_date(df: DataFrame, *columns: str) -> DataFrame:
    """Dates as text, so that both engines print the same value."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


# --- SQL of the empirical-Bayes chain --------------------------------------

SEGMENT_SQL = f"""
seg AS (SELECT age_band, gender, store,
               {each('count({t}) AS n_{t}, CAST(sum({t}) AS DOUBLE) AS s_{t}')}
        FROM hist GROUP BY age_band, gender, store)"""
CUSTOMER_SQL = f"""
cust AS (SELECT customer_id, {each('count({t}) AS cn_{t}, CAST(sum({t}) AS DOUBLE) AS cs_{t}')}
         FROM hist GROUP BY customer_id)"""
OVERALL_SQL = f"""
overall AS (SELECT {each('avg({t}) AS o_{t}')} FROM hist)"""


def posterior_sql(confidence: dict[str, float], source: str = "pred", name: str = "scored") -> str:
    """CTE with ``bayes_{t}`` for the rows of ``source``, learned from ``hist``."""
    def one(t: str) -> str:
        prior = f"(COALESCE(s_{t}, 0) / greatest(1, COALESCE(n_{t}, 0)))"
        c = f"CAST({confidence[t]!r} AS DOUBLE)"
        return (f"CASE WHEN COALESCE(cn_{t}, 0) = 0 AND COALESCE(n_{t}, 0) = 0 THEN o_{t} "
                f"WHEN COALESCE(cn_{t}, 0) = 0 THEN {prior} "
                f"ELSE (cs_{t} + {c} * {prior}) / (cn_{t} + {c}) END AS bayes_{t}")
    return f"""
{name} AS (SELECT p.*, {', '.join(one(t) for t in TARGETS)}
           FROM {source} p LEFT JOIN seg USING (age_band, gender, store)
           LEFT JOIN cust USING (customer_id) CROSS JOIN overall)"""


HISTORY_SQL = "hist AS (SELECT * FROM fact WHERE split = 'train')"
VALID_SQL = "pred AS (SELECT * FROM fact WHERE split = 'valid')"
DEFAULT_C = dict.fromkeys(TARGETS, 10.0)
# Validation sessions scored with the default confidence.
SCORED = (HISTORY_SQL, VALID_SQL, SEGMENT_SQL, CUSTOMER_SQL, OVERALL_SQL, posterior_sql(DEFAULT_C))


def long_sql(prefix: str = "bayes_", source: str = "scored", name: str = "long") -> str:
    """CTE with one row per session and target."""
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT session_id, age_band, store, weekday, time_band, '{t}' AS target, {prefix}{t} AS score, {t} AS y FROM {source}"
        for t in TARGETS) + ")"


def auc_sql(source: str = "long", groups: str = "target", name: str = "aucs") -> str:
    """CTE with the exact AUC per group, by counting pairs through ranks."""
    return f"""
{name}_t AS (SELECT {groups}, score, CAST(sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS pos,
                    CAST(sum(CASE WHEN y > 0 THEN 0 ELSE 1 END) AS DOUBLE) AS neg
             FROM {source} GROUP BY {groups}, score),
{name}_r AS (SELECT *, COALESCE(sum(neg) OVER (PARTITION BY {groups} ORDER BY score
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM {name}_t),
{name} AS (SELECT {groups}, sum(pos * (under + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc
           FROM {name}_r GROUP BY {groups})"""
