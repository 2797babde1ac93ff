"""Group statistics of sessions, lines, money and targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketcast.constants import CLASS_WEIGHT_CAP, DECAY_RATES, NEVER, SINGLE_PURCHASE_GAP
from basketcast.functions.calendar import days_from_max
from basketcast.functions.scalars import cycle_proximity
from basketcast.operators.skew import join_statistics
from basketcast.session import broadcast_if_small


# --- lines and categories -------------------------------------------------

def session_category_sum(log: DataFrame, products: DataFrame, value: str) -> DataFrame:
    """Sum of a line value by session and category."""
    return (log.join(products.select("jan", "category"), "jan", "left")
            .groupBy("session_id", "category").agg(F.sum(value).alias(value)))


def session_categories(log: DataFrame, products: DataFrame, codes: DataFrame, values: Sequence[str]) -> DataFrame:
    """Sessions by category in coordinate format: ``session_id, category, code`` and one sum per line value.

    One pass over the lines for all values; sums are made before the codes are joined.
    """
    sums = (log.join(products.select("jan", "category"), "jan", "left")
            .groupBy("session_id", "category").agg(*[F.sum(v).alias(v) for v in values]))
    return sums.join(broadcast_if_small(codes.select("category", "code")), "category").select("session_id", "category", "code", *values)


def customer_categories(sessions: DataFrame, matrix: DataFrame, value: str, key: str = "customer_id") -> DataFrame:
    """Customers by category in coordinate format: ``key, code, value``."""
    return (sessions.select("session_id", key).join(matrix.select("session_id", "code", value), "session_id")
            .groupBy(key, "code").agg(F.sum(value).alias("value")))


def category_names(products: DataFrame, column: str = "category") -> list[str]:
    """Sorted category names, the columns of a wide matrix: a list of the size of its header."""
    rows = products.select(column).dropna().distinct().orderBy(column).collect()
    return [r[0] for r in rows]


def category_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted values of several columns, found in one pass; ``encode.sparse_one_hot`` needs no such list."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = df.select(F.inline(cells)).filter(F.col("value").isNotNull()).distinct().collect()
    return {c: sorted(r["value"] for r in rows if r["column"] == c) for c in columns}


def coded_matrix(rows: DataFrame, key: str, names: Sequence[str], value: str, hot: bool = False) -> tuple[DataFrame, list[str]]:
    """One row per key and one column per category, named by its place in ``names``; also the column names.

    Category names may hold dots or differ only in case, which column names may not. Narrow rows are dealt out
    by key and become wide only there: a wide sum before that would be one row per line. ``hot``: keys may have
    many rows, which are added up by category first.
    """
    code = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("category")) - 1
    narrow = rows.select(key, code.cast("int").alias("code__"), F.col(value).alias("value__"))
    combine = F.sum
    if hot:
        # Behind this there is one number per cell.
        narrow, combine = narrow.groupBy(key, "code__").agg(F.sum("value__").alias("value__")), F.max
    columns = [f"c{i}" for i in range(len(names))]
    cells = [combine(F.when(F.col("code__") == i, F.col("value__"))).alias(c) for i, c in enumerate(columns)]
    return narrow.repartition(key).groupBy(key).agg(*cells).fillna(0, subset=columns), columns


def category_matrix(rows: DataFrame, key: str, names: Sequence[str], value: str, hot: bool = False) -> DataFrame:
    """One row per key and one column per category, 0 where nothing was bought."""
    return coded_matrix(rows, key, names, value, hot)[0].toDF(key, *names)


def customer_category_matrix(sessions: DataFrame, category_sums: DataFrame, names: Sequence[str],
                             value: str, key: str = "customer_id") -> DataFrame:
    """Customers by category; customers without a line keep a row of zeros."""
    joined = sessions.select("session_id", key).join(category_sums, "session_id", "left")
    return category_matrix(joined, key, names, value, hot=True)


def purchase_indicators(category_sums: DataFrame, names: Sequence[str], value: str = "quantity",
                        key: str = "session_id") -> DataFrame:
    """Sessions by category: the net quantity held to [0, 1], so part of a unit counts as that part."""
    wide, columns = coded_matrix(category_sums, key, names, value)
    held = [F.greatest(F.least(F.col(c).cast("double"), F.lit(1.0)), F.lit(0.0)) for c in columns]
    return wide.select(key, *held).toDF(key, *names)


def category_frequency(mapped_log: DataFrame) -> DataFrame:
    return mapped_log.groupBy("category").agg(F.count("*").alias("n"))


def top_categories(mapped_log: DataFrame, n: int = 100) -> DataFrame:
    """Most frequent categories; equal counts go by name."""
    return category_frequency(mapped_log).orderBy(F.desc("n"), "category").limit(n)


def purchase_ratio(sessions: DataFrame, indicators: DataFrame, names: Sequence[str],
                   keys: Sequence[str]) -> DataFrame:
    """Mean purchase indicator by each key, all keys in one aggregation.

    Sessions without a line have no indicator and leave the means alone. The
    result is long: which key, its value, one ratio per name.
    """
    # Indicators go by place while they are joined: names may differ only in case.
    place = {n: f"i{i}__" for i, n in enumerate(names)}
    coded = indicators.toDF(*[place.get(c, c) for c in indicators.columns]).select("session_id", *place.values())
    joined = sessions.select("session_id", *keys).join(coded, "session_id", "left")
    means = long_means(joined, keys, {c: F.col(c) for c in place.values()})
    return means.toDF("dimension", "value", *names)


def long_means(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Means by each key separately: columns dimension, value, then the means."""
    return long_groups(df, keys, {n: F.avg(v) for n, v in values.items()})


def long_groups(df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates by each key separately: columns dimension, value, then the aggregates."""
    grouped = df.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id().alias("_gid"), *[a.alias(n) for n, a in aggregates.items()])
    # In a grouping id the bit of the key that is grouped by is 0.
    all_bits = (1 << len(keys)) - 1
    gid = {k: all_bits ^ (1 << (len(keys) - 1 - i)) for i, k in enumerate(keys)}
    dimension, value = None, None
    for k in keys:
        hit = F.col("_gid") == gid[k]
        text = F.col(k).cast("string")
        dimension = F.when(hit, k) if dimension is None else dimension.when(hit, k)
        value = F.when(hit, text) if value is None else value.when(hit, text)
    return grouped.select(dimension.alias("dimension"), value.alias("value"), *aggregates)


def attribute_mean_embedding(sessions: DataFrame, embeddings: DataFrame, dim: int, keys: Sequence[str],
                             column: str = "embedding") -> DataFrame:
    """Mean embedding by each key: one sum per direction, and one count.

    Sessions without an embedding do not count; a group of such sessions has a vector of nulls. Sums of plain
    numbers stay in one hash table; an aggregate of vectors would sort all rows, once per key, from a hundred
    groups on.
    """
    joined = sessions.select("session_id", *keys).join(
        embeddings.select("session_id", column), "session_id", "left")
    # Taken apart below the copies that the groupings make of each row.
    apart = joined.select(*keys, F.col(column).isNotNull().alias("_full"), *[F.get(column, F.lit(i)).alias(f"_e{i}") for i in range(dim)])
    sums = long_groups(apart, keys, {"_n": F.count(F.when(F.col("_full"), 1)), **{f"_s{i}": F.sum(f"_e{i}") for i in range(dim)}})
    mean = F.array(*[F.try_divide(F.coalesce(f"_s{i}", F.lit(0.0)), F.col("_n")) for i in range(dim)])
    return sums.select("dimension", "value", mean.alias(column))


# --- recency --------------------------------------------------------------

def mean_gap(first: Column, last: Column, n: Column) -> Column:
    """Mean days between purchases: the gaps add up to last minus first."""
    return (F.when(n > 1, F.datediff(last, first) / (n - 1))
            .when(n == 1, F.lit(float(SINGLE_PURCHASE_GAP))))


def _recency_columns(targets: Sequence[str], date: str) -> dict[str, Column]:
    """Days, count, gap and proximity from ``{t}_first/_last/_n`` columns."""
    out = {}
    for t in targets:
        n = F.coalesce(F.col(f"{t}_n"), F.lit(0))
        days = F.coalesce(F.datediff(F.col(date), F.col(f"{t}_last")), F.lit(NEVER))
        gap = F.coalesce(mean_gap(F.col(f"{t}_first"), F.col(f"{t}_last"), n), F.lit(float(NEVER)))
        out |= {f"{t}_days": days, f"{t}_count": n.cast("long"), f"{t}_gap": gap,
                f"{t}_proximity": cycle_proximity(gap, days, NEVER)}
    return out


def recency_global(sessions: DataFrame, history: DataFrame, targets: Sequence[str],
                   customer: str = "customer_id", date: str = "sale_date") -> DataFrame:
    """Recency features from each customer's whole history in ``history``."""
    bought = {t: F.when(F.col(t) > 0, F.col(date)) for t in targets}
    stats = history.groupBy(customer).agg(
        *[f for t in targets for f in (F.min(bought[t]).alias(f"{t}_first"),
                                       F.max(bought[t]).alias(f"{t}_last"),
                                       F.count(bought[t]).alias(f"{t}_n"))])
    joined = join_statistics(sessions, stats, customer)
    features = _recency_columns(targets, date)
    return joined.select(*sessions.columns, *[c.alias(n) for n, c in features.items()])


def recency_asof(sessions: DataFrame, history: DataFrame, targets: Sequence[str],
                 customer: str = "customer_id", date: str = "sale_date") -> DataFrame:
    """Recency features from sessions dated strictly before each session.

    History is reduced to one row per customer and day first, so the running
    window is bounded by the calendar, whatever the size of a customer.
    """
    # Dates that only occur in ``sessions`` need a row as well: they count 0.
    asked = sessions.select(customer, date, *[F.lit(0).alias(t) for t in targets])
    known = history.select(customer, date, *[(F.col(t) > 0).cast("int").alias(t) for t in targets])
    cells = asked.unionByName(known).groupBy(customer, date).agg(*[F.sum(t).alias(t) for t in targets])
    before = (Window.partitionBy(customer).orderBy(date)
              .rowsBetween(Window.unboundedPreceding, -1))
    past = cells.select(customer, date, *[f for t in targets for f in (
        F.min(F.when(F.col(t) > 0, F.col(date))).over(before).alias(f"{t}_first"),
        F.max(F.when(F.col(t) > 0, F.col(date))).over(before).alias(f"{t}_last"),
        F.sum(t).over(before).alias(f"{t}_n"))])
    joined = sessions.join(past, [customer, date], "left")
    features = _recency_columns(targets, date)
    return joined.select(*sessions.columns, *[c.alias(n) for n, c in features.items()])


def purchase_gaps(history: DataFrame, targets: Sequence[str], customer: str = "customer_id",
                  date: str = "sale_date") -> DataFrame:
    """Days since the previous purchase of the same target, by customer.

    One row per customer, target and purchase day, with the gap to the previous
    purchase day; ``same_day`` more purchases that day follow with gap 0.
    """
    bought = (history.unpivot([customer, date], list(targets), "target", "flag")
              .filter(F.col("flag") > 0)
              .groupBy(customer, "target", date).agg((F.count("*") - 1).alias("same_day")))
    order = Window.partitionBy(customer, "target").orderBy(date)
    return bought.withColumn("gap", F.datediff(date, F.lag(date).over(order)))


def time_decay_weight(df: DataFrame, rates: dict[str, float] = DECAY_RATES,
                      date: str = "sale_date") -> DataFrame:
    """Weight per target that fades exponentially with the age of a session."""
    aged = days_from_max(df, date)
    return aged.withColumns({f"weight_{t}": F.exp(F.lit(-rate) * F.col("days_from_max"))
                             for t, rate in rates.items()})


# --- target means ---------------------------------------------------------

def group_mean(df: DataFrame, keys: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Mean of each target by the key columns; rows with a null key drop out."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*[F.avg(t).alias(t) for t in targets])


def conditional_purchase(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """One row: share of buyers of ``a`` who also bought ``b``, as ``a_to_b``."""
    return df.agg(*[F.avg(F.when(F.col(a) > 0, F.col(b))).alias(f"{a}_to_{b}")
                    for a in targets for b in targets if a != b])


def overall_mean(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(t).alias(t) for t in targets])


def class_weights(df: DataFrame, targets: Sequence[str], cap: float = CLASS_WEIGHT_CAP) -> DataFrame:
    """Negatives per positive, at most ``cap``; 1 without positives."""
    def weight(t: str) -> Column:
        positive, negative = F.count_if(F.col(t) == 1), F.count_if(F.col(t) == 0)
        ratio = F.when(positive > 0, F.try_divide(negative, positive)).otherwise(F.lit(1.0))
        return F.least(ratio, F.lit(cap)).alias(t)
    return df.agg(*[weight(t) for t in targets])


def date_extent(df: DataFrame, split: str = "split", date: str = "sale_date") -> DataFrame:
    return df.groupBy(split).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"),
                                 F.count("*").alias("n"))


# --- money ----------------------------------------------------------------

def session_money(log: DataFrame, money: Sequence[str], key: str = "session_id") -> DataFrame:
    """Sum, mean and count of each money column by session.

    Sums stay decimal and means are rounded to six places, so later totals do
    not depend on the order in which tasks add them up.
    """
    base = log.groupBy(key).agg(*[f for m in money for f in (F.sum(m).alias(f"{m}_sum"),
                                                            F.count(m).alias(f"{m}_count"))])
    means = {f"{m}_mean": F.round(F.try_divide(F.col(f"{m}_sum").cast("double"), F.col(f"{m}_count")), 6)
             .cast("decimal(18,6)") for m in money}
    return base.withColumns(means).select(key, *[f"{m}_{s}" for m in money for s in ("sum", "mean", "count")])


def money_columns(money: Sequence[str]) -> list[str]:
    return [f"{m}_{s}" for m in money for s in ("sum", "mean", "count")]


def customer_money(session_stats: DataFrame, sessions: DataFrame, money: Sequence[str],
                   customer: str = "customer_id") -> DataFrame:
    """Mean over a customer's sessions of the session money statistics."""
    joined = session_stats.join(sessions.select("session_id", customer), "session_id")
    return joined.dropna(subset=[customer]).groupBy(customer).agg(
        *[(F.sum(c).cast("double") / F.count("*")).alias(c) for c in money_columns(money)])


def default_money(customer_stats: DataFrame, money: Sequence[str]) -> DataFrame:
    """One row for customers without history: the mean over customers."""
    return customer_stats.agg(*[F.avg(c).alias(c) for c in money_columns(money)])


def presence_flags(sessions: DataFrame, session_stats: DataFrame, customer_stats: DataFrame,
                   customer: str = "customer_id") -> DataFrame:
    """1 where a session, or its customer, has money statistics."""
    has_session = session_stats.select("session_id", F.lit(1).alias("has_session_money"))
    has_customer = customer_stats.select(customer, F.lit(1).alias("has_customer_money"))
    return (join_statistics(sessions, has_customer, customer).join(has_session, "session_id", "left")
            .fillna(0, subset=["has_session_money", "has_customer_money"]))
