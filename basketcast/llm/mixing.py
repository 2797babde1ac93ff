"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source is a queue of its documents in a seeded order, repeated up to ``PASSES`` times. A
document leaves its queue at the virtual time (words of the queue up to and including it) / (target
of the source); merging all queues by that time and stopping at the total budget gives each source
its share. Targets are shares of the budget by weight, at most ``PASSES`` times what the source has;
what a short source leaves is shared again by weight.

Queue positions come from slices of the seeded order: one running sum over the slices of a source and
one inside each slice, so a source with a third of all rows is spread over many tasks. The stopping
point is found by counting words per interval of virtual time and looking closer at the one interval
that crosses the budget; ``mixture`` then sorts what is taken by range.

Defined cases: null texts have no words, and documents without words are never taken; a null source
is the last one; repeated rows queue one by one; equal times go by source, id, size and pass; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from basketcast.llm.common import stored
from basketcast.session import broadcast_if_small

WEIGHTS = (1, 2, 3)
PASSES = 3
WORD = r"[^\x20\x09-\x0D]+"
SLICE_ROWS = 20_000      # documents of a source in one slice of its queue
INTERVALS = 1_024        # intervals of virtual time counted at once
LAST_ROWS = 10_000       # queued copies among which the stopping point is looked up
MAX_SOURCES = 20_000     # sources that may be broadcast


def words_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` with the number of words."""
    return docs.select("doc_id", "source", words_of("text").alias("size"))


def targets(thin: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """One row per source: ``source, place, rows, source_size, target``."""
    found = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    found = found.withColumn("place", place).withColumn("weight", weight.cast("long")).withColumn("most", passes * F.col("source_size"))
    # Sources in order of how soon their limit binds: each is held to it if an equal share per
    # weight of what is left would be more.
    soonest = Window.orderBy(F.col("most") / F.col("weight"), "place")
    earlier = soonest.rowsBetween(Window.unboundedPreceding, -1)
    every = soonest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(earlier), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    found = found.withColumn("level", left.cast("double") / open_weight.cast("double"))
    found = found.withColumn("held", F.col("most").cast("double") <= F.col("weight") * F.col("level"))
    # The level of the first source that is not held is everyone's who is not.
    level = F.min(F.when(~F.col("held"), F.struct(F.col("most") / F.col("weight"), "place", "level"))).over(every)["level"]
    return found.select("source", "place", "rows", "source_size",
                        F.when(F.col("held"), F.col("most").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def queue(thin: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents with ``upto``: words of their source's queue up to and including them."""
    plan = stored(plan)
    named = broadcast_if_small(plan.withColumnRenamed("source", "of"), max_rows=MAX_SOURCES)
    draw = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = thin.withColumn("draw", draw).join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    number = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("slice", F.shiftright(number * F.ceil(F.col("rows") / SLICE_ROWS), 32))
    before = Window.partitionBy("place").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy("place", "slice").agg(F.sum("size").alias("total"))
    slices = slices.select("place", "slice", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("place", "slice").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("inside", F.sum("size").over(inside)).join(slices, ["place", "slice"]).select(
        "doc_id", "source", "size", "place", "source_size", "target", (F.col("base") + F.col("inside")).alias("upto"))


def finish(turn: int | Column) -> Column:
    """Virtual time at which the copy of a pass has left its queue."""
    turn = F.lit(turn) if isinstance(turn, int) else turn
    return (turn * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")


def order_of(turn: int | Column) -> Column:
    turn = F.lit(turn) if isinstance(turn, int) else turn
    return F.struct(finish(turn).alias("finish"), F.col("place"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("size"), turn.alias("turn"))


def copies(queued: DataFrame, passes: int = PASSES) -> DataFrame:
    """One row per document with words and pass, with its place in the merged queue."""
    some = queued.filter((F.col("size") > 0) & (F.col("target") > 0))
    return some.withColumn("turn", F.explode(F.array(*[F.lit(p) for p in range(passes)]))).withColumn("key", order_of(F.col("turn")))


def last_taken(queued: DataFrame, budget: int, passes: int = PASSES) -> Row | None:
    """Key of the last copy that fits the budget; None if nothing does."""
    items = copies(queued, passes).select("size", "key", F.col("key.finish").alias("finish"))
    bounds = items.agg(F.min("finish"), F.max("finish"), F.count("*"), F.sum("size")).first()
    low, high, rows, total = bounds
    if rows == 0:
        return None
    if total <= budget:
        return items.agg(F.max("key")).first()[0]
    spent, best = 0, None
    while rows > LAST_ROWS and low < high:
        width = (high - low) / INTERVALS
        interval = F.least(F.floor((F.col("finish") - low) / width), F.lit(INTERVALS - 1))
        counted = (items.filter((F.col("finish") >= low) & (F.col("finish") <= high)).groupBy(interval.alias("i"))
                   .agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.min("finish").alias("low"), F.max("finish").alias("high"),
                        F.max("key").alias("key")).orderBy("i").collect())
        for found in counted:
            if spent + found["words"] > budget:
                break
            spent, best = spent + found["words"], found["key"]
        if (found["low"], found["high"]) == (low, high):
            break
        low, high, rows = found["low"], found["high"], found["rows"]
    near = items.filter((F.col("finish") >= low) & (F.col("finish") <= high))
    running = F.sum("size").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    last = near.withColumn("running", running).filter(F.col("running") + spent <= budget).agg(F.max("key")).first()[0]
    return best if last is None else last


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, budget: int | None = None) -> DataFrame:
    """Every document with ``size, source_size, target`` and ``passes_taken``, how often the mix takes it."""
    thin = stored(sizes(docs))
    queued = stored(queue(thin, targets(thin, weights, passes)))
    if budget is None:
        budget = thin.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    last = last_taken(queued, budget, passes)
    if last is None:
        taken = F.lit(0)
    else:
        end = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["place"]).alias("place"), F.lit(last["id"]).cast("long").alias("id"),
                       F.lit(last["size"]).cast("long").alias("size"), F.lit(last["turn"]).alias("turn"))
        taken = sum((F.when(order_of(p) <= end, 1).otherwise(0) for p in range(passes)), F.lit(0))
    some = (F.col("size") > 0) & (F.col("target") > 0)
    return queued.select("doc_id", "source", "size", "place", "source_size", "target", "upto", F.when(some, taken).otherwise(0).alias("passes_taken"))


def mixture(planned: DataFrame, passes: int = PASSES) -> DataFrame:
    """The mix itself, one row per taken copy in order of virtual time (a global range sort)."""
    return copies(planned, passes).filter(F.col("turn") < F.col("passes_taken")).orderBy("key").select(
        "doc_id", "source", "size", F.col("turn").alias("pass"), F.col("key.finish").alias("finish"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` as the mix takes them: each as often as it is taken, with its own columns."""
    planned = stored(plan_mix(docs))
    ids = stored(planned.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("repeated__")))
    taken = planned.filter("passes_taken > 0").select(F.col("doc_id").alias("taken_id"), "passes_taken")
    once = taken.join(ids, F.col("taken_id").eqNullSafe(F.col("repeated__")), "left_anti")
    rows = docs.join(once, docs["doc_id"].eqNullSafe(once["taken_id"])).select(*[docs[c] for c in docs.columns], once["passes_taken"].alias("passes__"))
    if not ids.isEmpty():
        # Rows that share an id are told apart by source and size, in the same order on both sides.
        def numbered(frame: DataFrame, last: str) -> DataFrame:
            some = frame.join(ids, F.col("doc_id").eqNullSafe(F.col("repeated__")), "left_semi")
            return some.withColumn("number__", F.row_number().over(Window.partitionBy("doc_id").orderBy("source", "size__", last)))

        left = numbered(docs.withColumn("size__", words_of("text")), "text")
        right = numbered(planned.withColumnRenamed("size", "size__"), "upto").select(
            F.col("doc_id").alias("taken_id"), F.col("number__").alias("taken_number"), F.col("passes_taken").alias("passes__"))
        more = left.join(right, F.col("doc_id").eqNullSafe(F.col("taken_id")) & (F.col("number__") == F.col("taken_number")))
        rows = rows.unionByName(more.select(*docs.columns, "passes__"))
    return rows.withColumn("copy__", F.explode(F.array_repeat(F.lit(1), F.col("passes__")))).select(*docs.columns)
