"""Purchase sequences: baskets, patterns, session windows and step vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketcast.constants import RANDOM_CUT, SEQUENCE_LENGTH, SEQUENCE_SUPPORT
from basketcast.functions.scalars import CYCLE_DIVISORS
from basketcast.operators.ordering import BLOCK_ROWS, halo_blocks, last_rows, with_position
from basketcast.operators.skew import HeavyKeys, heavy_keys, join_statistics
from basketcast.session import one_row, store

# Sessions of one customer whose steps are gathered into one list.
LIST_ROWS = 1_000
# Calendar cells of a customer's history, in time order.
DAY = ("sale_date",)
DAY_HOUR = ("sale_date", "hour")


def basket(targets: Sequence[str]) -> Column:
    """Targets bought in a session, in target order."""
    return F.filter(F.array(*[F.when(F.col(t) > 0, t) for t in targets]), lambda t: t.isNotNull())


def purchase_sequence(history: DataFrame, targets: Sequence[str], customer: str = "customer_id",
                      date: str = "sale_date") -> DataFrame:
    """Non-empty baskets of each customer, numbered from 0 in date order.

    Sessions of one day are ordered by their id.
    """
    baskets = (history.select(customer, date, "session_id", basket(targets).alias("basket"))
               .filter(F.size("basket") > 0))
    return with_position(baskets, [customer], [date], ["session_id"])


def basket_steps(sequence: DataFrame, customer: str = "customer_id",
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each basket with the next one and the one after, where both exist."""
    blocks = halo_blocks(sequence, reach_ahead=2, block_rows=block_rows)
    order = Window.partitionBy(customer, "block").orderBy("pos")
    return (blocks.withColumns({"second": F.lead("basket", 1).over(order),
                                "third": F.lead("basket", 2).over(order)})
            .filter("owned and third is not null")
            .select(customer, "pos", F.col("basket").alias("first"), "second", "third"))


def basket_triples(sequence: DataFrame, customer: str = "customer_id") -> DataFrame:
    """Every (category, next category) of consecutive baskets with what followed."""
    return (basket_steps(sequence, customer)
            .select(customer, "pos", F.explode("first").alias("c1"), "second", "third")
            .select(customer, "pos", "c1", F.explode("second").alias("c2"), "third"))


def sequence_patterns(sequence: DataFrame, targets: Sequence[str], support: int = SEQUENCE_SUPPORT,
                      customer: str = "customer_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of consecutive categories and the share of each target next.

    Equal basket triples are counted before they are expanded into pairs, so
    the expansion works on distinct baskets instead of on sessions.
    """
    shapes = (basket_steps(sequence, customer, block_rows)
              .groupBy("first", "second", "third").agg(F.count("*").alias("n")))
    pairs = (shapes.select(F.explode("first").alias("c1"), "second", "third", "n")
             .select("c1", F.explode("second").alias("c2"), "third", "n"))
    counted = pairs.groupBy("c1", "c2").agg(
        F.sum("n").alias("total"),
        *[F.sum(F.when(F.array_contains("third", t), F.col("n")).otherwise(0)).alias(f"n_{t}") for t in targets])
    return counted.filter(F.col("total") >= support).select(
        "c1", "c2", "total", *[(F.col(f"n_{t}") / F.col("total")).alias(f"p_{t}") for t in targets])


def latest_sequence(history: DataFrame, targets: Sequence[str], customer: str = "customer_id",
                    date: str = "sale_date") -> DataFrame:
    """First target of the last two non-empty baskets, older one first."""
    baskets = (history.select(customer, date, "session_id", basket(targets).alias("basket"))
               .filter(F.size("basket") > 0)
               .select(customer, date, "session_id", F.get("basket", F.lit(0)).alias("lead_target")))
    newest = last_rows(baskets, [customer], [date, "session_id"], 2)
    return newest.groupBy(customer).agg(
        F.max(F.when(F.col("back") == 2, F.col("lead_target"))).alias("c1"),
        F.max(F.when(F.col("back") == 1, F.col("lead_target"))).alias("c2"),
    ).filter(F.col("c1").isNotNull())


def sequence_score(sessions: DataFrame, latest: DataFrame, patterns: DataFrame, targets: Sequence[str],
                   customer: str = "customer_id", heavy: HeavyKeys | None = None) -> DataFrame:
    """Pattern share of a customer's latest pair; 0 without a pair or pattern.

    Patterns have one row per ordered pair of targets, so they are broadcast.
    """
    scored = latest.join(F.broadcast(patterns.select("c1", "c2", *[f"p_{t}" for t in targets])),
                         ["c1", "c2"]).drop("c1", "c2")
    return join_statistics(sessions, scored, customer, heavy).fillna(0.0, subset=[f"p_{t}" for t in targets])


# --- session windows ------------------------------------------------------

def customer_sessions(sessions: DataFrame, customer: str = "customer_id",
                      cell: Sequence[str] = DAY_HOUR) -> DataFrame:
    """Sessions numbered from 0 per customer and split, by date and hour."""
    return with_position(sessions, [customer, "split"], cell, ["session_id"])


def sliding_windows(numbered: DataFrame, length: int = SEQUENCE_LENGTH, customer: str = "customer_id",
                    step: str = "session_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every run of ``length`` consecutive sessions, oldest first.

    ``start`` is the position of the first one. Shorter histories give none.
    ``step`` names what a step holds: the session id, or its feature vector.
    """
    blocks = halo_blocks(numbered, reach_back=length - 1, block_rows=block_rows)
    run = (Window.partitionBy(customer, "block").orderBy("pos").rowsBetween(-(length - 1), 0))
    # Wrapped in a struct, because collecting drops nulls.
    steps = F.transform(F.collect_list(F.struct(step)).over(run), lambda s: s[step])
    return (blocks.withColumn("steps", steps)
            .filter((F.size("steps") == length) & F.col("owned"))
            .select(customer, (F.col("pos") - (length - 1)).alias("start"), "session_id", "steps"))


def random_cut(windows: DataFrame, probability: float = RANDOM_CUT, seed: int = 42,
               customer: str = "customer_id") -> DataFrame:
    """Training windows after the random cut.

    With the given probability, a window that is not a customer's first is
    replaced by one that starts anywhere from there to the customer's last
    start. The draw is a seeded hash, so reruns and retries agree. The windows
    are stored once: three reads of a few columns follow.
    """
    windows = store(windows)
    last = windows.groupBy(customer).agg(F.max("start").alias("_last"))

    def draw(salt: int) -> Column:
        text = F.concat_ws("|", F.col(customer).cast("string"), F.col("start").cast("string"), F.lit(str(seed)), F.lit(str(salt)))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))

    span = F.col("_last") - F.col("start") + 1
    moved = F.col("start") + F.floor(draw(2) * span).cast("long")
    chosen = F.when((draw(1) < probability) & (F.col("start") > 0), moved).otherwise(F.col("start"))
    picks = join_statistics(windows.select(customer, "start", "session_id"), last, customer).select(
        customer, F.col("start").alias("origin"), chosen.alias("start"))
    return picks.join(windows, [customer, "start"])


def run_steps(runs: DataFrame, numbered: DataFrame, step: str, length: int = SEQUENCE_LENGTH,
              customer: str = "customer_id", block_rows: int = LIST_ROWS) -> DataFrame:
    """``runs`` with what ``step`` holds for each of the ``length`` sessions from their ``start`` on.

    Histories are gathered in blocks that overlap by a run, and every run is a slice of its block: a step is
    moved once, however many runs it stands in.
    """
    blocks = halo_blocks(numbered.select(customer, "pos", step), reach_ahead=length - 1, block_rows=block_rows)
    # Dealt out first, as an aggregate would sort whole blocks on both sides of the shuffle.
    lists = (blocks.repartition(customer, "block").groupBy(customer, "block")
             .agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(step).alias("held")))).alias("_list")))
    first = F.col("start") - F.get("_list", F.lit(0))["pos"] + 1
    steps = F.transform(F.slice("_list", first.cast("int"), length), lambda s: s["held"][step])
    return (runs.drop("steps").withColumn("block", F.floor(F.col("start") / F.lit(block_rows)).cast("long"))
            .join(lists, [customer, "block"]).withColumn("steps", steps).drop("block", "_list"))


def recent_history(current: DataFrame, history: DataFrame, length: int = SEQUENCE_LENGTH,
                   customer: str = "customer_id", step: str = "session_id",
                   order: Sequence[str] = ("sale_date", "hour", "session_id")) -> DataFrame:
    """Each session after its customer's last ``length - 1`` history sessions.

    ``steps`` runs from oldest to newest; nulls pad short histories in front.
    """
    columns = list(dict.fromkeys([customer, step, *order]))
    newest = last_rows(history.select(*columns), [customer], list(order), length - 1)
    kept = newest.groupBy(customer).agg(*[
        F.first(F.when(F.col("back") == b, F.struct(step)), ignorenulls=True).alias(f"_h{b}") for b in range(1, length)])
    joined = join_statistics(current.select(customer, "session_id", *([step] if step != "session_id" else [])), kept, customer)
    past = [F.col(f"_h{b}")[step] for b in range(length - 1, 0, -1)]
    return joined.select(customer, "session_id", F.array(*past, F.col(step)).alias("steps"))


def sequence_labels(windows: DataFrame, targets_of: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Target flags of each window's last session; 0 where unknown."""
    flags = targets_of.select("session_id", *targets)
    return windows.join(flags, "session_id", "left").fillna(0, subset=list(targets))


# --- step vectors ---------------------------------------------------------

BASE_FEATURES = (*CYCLE_DIVISORS, "holiday_or_weekend", "store_code", "age_code", "gender_code")


def step_features(sessions: DataFrame, embeddings: DataFrame, session_stats: DataFrame,
                  customer_stats: DataFrame, fallback: DataFrame, money: Sequence[str], dim: int,
                  fit_on: Column, customer: str = "customer_id") -> DataFrame:
    """One feature vector per session.

    Nine calendar and code features, the embedding, the session's money, the
    customer's money and two presence flags. Money is scaled by the maximum over
    the rows ``fit_on`` selects. ``customer_stats`` and ``fallback`` have a
    ``known`` column that says for which ``money_from`` of a session they hold.
    """
    s_cols = [f"s_{c}" for c in money]
    c_cols = [f"c_{c}" for c in money]
    codes = ("store_code", "age_code", "gender_code")
    own = session_stats.select("session_id", F.lit(1.0).alias("has_session"),
                               *[F.col(c).cast("double").alias(f"s_{c}") for c in money])
    theirs = customer_stats.select(customer, F.col("known").alias("money_from"),
                                   *[F.col(c).alias(f"c_{c}") for c in money])
    # One row per kind of history.
    defaults = F.broadcast(fallback.select(F.col("known").alias("money_from"),
                                           *[F.col(c).alias(f"d_{c}") for c in money]))
    heavy = heavy_keys(sessions, customer)
    joined = (join_statistics(sessions, theirs, customer, heavy, ["money_from"])
              .join(embeddings.select("session_id", "embedding"), "session_id", "left")
              .join(own, "session_id", "left").join(defaults, "money_from", "left"))
    # A default counts as money of the customer, as long as there is one.
    known = F.coalesce(f"c_{money[0]}", f"d_{money[0]}").isNotNull()
    filled = joined.withColumns(
        {f"s_{c}": F.coalesce(f"s_{c}", F.lit(0.0)) for c in money}
        | {f"c_{c}": F.coalesce(f"c_{c}", f"d_{c}", F.lit(0.0)) for c in money}
        | {"has_session": F.coalesce("has_session", F.lit(0.0)), "has_customer": known.cast("double"),
           "embedding": F.coalesce("embedding", F.array_repeat(F.lit(0.0), dim))})
    # Maxima of the sessions' inputs, without the joins that no maximum needs.
    fitted = sessions.filter(fit_on).select("session_id", customer, "money_from", *codes)
    numbers = (join_statistics(fitted, theirs, customer, heavy, ["money_from"])
               .join(own, "session_id", "left").join(defaults, "money_from", "left"))
    limits = one_row(numbers.agg(
        *[F.max(F.coalesce(c, F.lit(0.0))).alias(c) for c in s_cols],
        *[F.max(F.coalesce(f"c_{c}", f"d_{c}", F.lit(0.0))).alias(f"c_{c}") for c in money],
        *[F.max(c).alias(c) for c in codes]))
    top = F.col("_top")

    def scaled(c: str) -> Column:
        limit = F.coalesce(top[c], F.lit(0.0))
        return F.col(c) / F.when(limit == 0, 1.0).otherwise(limit)

    base = [F.col(c) / F.lit(d) for c, d in CYCLE_DIVISORS.items()]
    base += [F.col("holiday_or_weekend").cast("double")]
    base += [F.col(c) / (top[c] + 1) for c in codes]
    features = F.concat(F.array(*base), F.col("embedding"), F.array(*[scaled(c) for c in (*s_cols, *c_cols)]),
                        F.array("has_session", "has_customer"))
    return filled.withColumn("_top", limits).select("session_id", features.alias("features"))


def step_width(money: Sequence[str], dim: int) -> int:
    return len(BASE_FEATURES) + dim + 2 * len(money) + 2


def without_own_basket(features: Column, money: Sequence[str], dim: int) -> Column:
    """A step vector that hides what its session bought and paid."""
    head, hidden = len(BASE_FEATURES), dim + len(money)
    kept = F.slice(features, head + hidden + 1, len(money))
    customer_flag = F.slice(features, head + hidden + len(money) + 2, 1)
    return F.concat(F.slice(features, 1, head), F.array_repeat(F.lit(0.0), hidden), kept,
                    F.array(F.lit(0.0)), customer_flag)


def window_features(windows: DataFrame, money: Sequence[str], dim: int, mask_last: bool = True) -> DataFrame:
    """Windows of step vectors, with zeros for missing steps.

    ``mask_last`` hides the basket and money of the last step, the session that
    is to be predicted. A projection: nothing is shuffled here.
    """
    zeros = F.array_repeat(F.lit(0.0), step_width(money, dim))
    last = F.size("steps") - 1

    def step(vector: Column, index: Column) -> Column:
        value = F.coalesce(vector, zeros)
        return F.when(index == last, without_own_basket(value, money, dim)).otherwise(value) if mask_last else value

    return windows.withColumn("steps", F.transform("steps", step))
