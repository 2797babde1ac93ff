"""Ordered operators: positions, blocks, baskets, windows, histories."""

from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketcast.constants import TARGETS
from basketcast.operators import sequences, stats
from basketcast.operators.skew import heavy_keys, join_statistics
from basketcast.operators.ordering import halo_blocks, last_rows, with_position

DAY0 = date(2024, 1, 1)


def day(n):
    return DAY0 + timedelta(days=n)


def history(spark, rows):
    """rows: (customer, session, day number, hour, bought letters)."""
    data = [(c, s, day(d), h, *[int(t[0] in bought) for t in TARGETS]) for c, s, d, h, bought in rows]
    return spark.createDataFrame(data, "customer_id long, session_id long, sale_date date, hour int, "
                                       "choc int, beer int, hair int, rice int").withColumn("split", F.lit("train"))


@pytest.fixture(scope="module")
def hot(spark):
    """One customer holds most rows."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id") % 50).alias("customer_id"), F.col("id").alias("session_id"),
        F.date_add(F.lit(DAY0), (F.xxhash64("id") % 40).cast("int")).alias("sale_date"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(24)).cast("int").alias("hour"), F.lit("train").alias("split"),
        *[(F.pmod(F.xxhash64("id", F.lit(t)), F.lit(3)) == 0).cast("int").alias(t) for t in TARGETS])


@pytest.mark.parametrize("cell", [["sale_date", "hour"], ["hour"]])
@pytest.mark.parametrize("sub_rows", [1, 7, 10_000])
@pytest.mark.parametrize("falling", [[], ["session_id"]])
def test_position_equals_row_number(spark, hot, cell, sub_rows, falling):
    last = F.desc("session_id") if falling else F.asc("session_id")
    want = hot.withColumn("want", F.row_number().over(Window.partitionBy("customer_id").orderBy(*cell, last)) - 1).select("session_id", "want")
    got = with_position(hot, ["customer_id"], cell, ["session_id"], descending=falling, sub_rows=sub_rows)
    joined = got.join(want, "session_id")
    assert joined.count() == 3000 and joined.filter("pos <> want").count() == 0


def test_position_orders_null_cells_first(spark):
    df = spark.createDataFrame([(1, 5, 3), (1, None, 1), (1, None, 2), (None, 1, 9)], "k int, h int, id int")
    got = {r["id"]: r["pos"] for r in with_position(df, ["k"], ["h"], ["id"]).collect()}
    assert got == {1: 0, 2: 1, 3: 2}


@pytest.mark.parametrize("rows", [2, 3, 7, 1000])
def test_halo_blocks_reproduce_lead_and_lag(spark, hot, rows):
    numbered = with_position(hot, ["customer_id"], ["sale_date", "hour"], ["session_id"])
    whole = Window.partitionBy("customer_id").orderBy("pos")
    want = numbered.select("session_id", F.lag("session_id", 2).over(whole).alias("b"), F.lead("session_id", 2).over(whole).alias("a"))
    part = Window.partitionBy("customer_id", "block").orderBy("pos")
    got = (halo_blocks(numbered, 2, 2, block_rows=rows)
           .withColumns({"b": F.lag("session_id", 2).over(part), "a": F.lead("session_id", 2).over(part)})
           .filter("owned").select("session_id", "b", "a"))
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_block_shorter_than_reach_is_refused(spark, hot):
    with pytest.raises(ValueError):
        halo_blocks(hot.withColumn("pos", F.lit(0)), reach_back=4, block_rows=3)


def test_last_rows_limits_before_the_shuffle(spark, hot):
    out = last_rows(hot, ["customer_id"], ["sale_date", "hour", "session_id"], 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert out.groupBy("customer_id").count().filter("count > 2").count() == 0


def test_sequence_skips_empty_baskets_and_breaks_ties_by_id(spark):
    df = history(spark, [(0, 12, 1, 0, "c"), (0, 11, 1, 0, "b"), (0, 13, 2, 0, ""), (0, 14, 3, 0, "rc")])
    rows = sequences.purchase_sequence(df, TARGETS).orderBy("pos").collect()
    assert [(r["session_id"], r["basket"]) for r in rows] == [(11, ["beer"]), (12, ["choc"]), (14, ["choc", "rice"])]
    latest = sequences.latest_sequence(df, TARGETS).first()
    assert (latest["customer_id"], latest["c1"], latest["c2"]) == (0, "choc", "choc")


def brute_patterns(df, support):
    """The pattern rule as plain loops."""
    people = {}
    for r in sorted(df.collect(), key=lambda r: (r["customer_id"], r["sale_date"], r["session_id"])):
        bought = [t for t in TARGETS if r[t]]
        if bought:
            people.setdefault(r["customer_id"], []).append(bought)
    counts = {}
    for baskets in people.values():
        for a, b, c in zip(baskets, baskets[1:], baskets[2:]):
            for x in a:
                for y in b:
                    entry = counts.setdefault((x, y), dict.fromkeys(("total", *TARGETS), 0))
                    entry["total"] += 1
                    for z in c:
                        entry[z] += 1
    return {k: (v["total"], *[v[t] / v["total"] for t in TARGETS]) for k, v in counts.items() if v["total"] >= support}


@pytest.mark.parametrize("block_rows", [2, 5, 100_000])
def test_patterns_match_loops_for_any_block_size(spark, hot, block_rows):
    out = sequences.sequence_patterns(sequences.purchase_sequence(hot, TARGETS), TARGETS, 5, block_rows=block_rows)
    got = {(r["c1"], r["c2"]): (r["total"], *[r[f"p_{t}"] for t in TARGETS]) for r in out.collect()}
    assert got == brute_patterns(hot, 5)


def test_short_histories_give_no_pattern(spark):
    df = history(spark, [(1, 1, 1, 0, "c"), (1, 2, 2, 0, "b")])
    assert sequences.sequence_patterns(sequences.purchase_sequence(df, TARGETS), TARGETS, 1).count() == 0
    assert sequences.latest_sequence(history(spark, [(1, 1, 1, 0, "c")]), TARGETS).count() == 0


@pytest.mark.parametrize("block_rows", [4, 6, 100_000])
def test_sliding_windows(spark, hot, block_rows):
    numbered = sequences.customer_sessions(hot)
    out = sequences.sliding_windows(numbered, block_rows=block_rows)
    ordered = {}
    for r in sorted(numbered.collect(), key=lambda r: (r["customer_id"], r["pos"])):
        ordered.setdefault(r["customer_id"], []).append(r["session_id"])
    want = {(c, i): ids[i:i + 5] for c, ids in ordered.items() for i in range(len(ids) - 4)}
    assert {(r["customer_id"], r["start"]): r["steps"] for r in out.collect()} == want


def test_random_cut_moves_forward_within_the_history(spark, hot):
    windows = sequences.sliding_windows(sequences.customer_sessions(hot))
    out = sequences.random_cut(windows, 0.3, seed=5)
    again = sequences.random_cut(windows.repartition(3), 0.3, seed=5)
    columns = ["customer_id", "origin", "start"]
    assert out.select(*columns).exceptAll(again.select(*columns)).count() == 0
    assert out.count() == windows.count()
    last = windows.groupBy("customer_id").agg(F.max("start").alias("last"))
    bad = out.join(last, "customer_id").filter("start < origin or start > last or (origin = 0 and start <> 0)")
    assert bad.count() == 0
    moved = out.filter("start <> origin").count() / out.count()
    assert 0.15 < moved < 0.35


def test_recent_history_pads_and_ignores_the_future(spark):
    past = [(0, i, i, 0, "") for i in range(5)] + [(2, 50, 1, 0, "")]
    train = history(spark, past)
    current = history(spark, [(0, 90, 30, 1, ""), (1, 91, 30, 1, ""), (2, 92, 30, 1, "")])
    out = {r["session_id"]: r["steps"] for r in sequences.recent_history(current, train).collect()}
    assert out == {90: [1, 2, 3, 4, 90], 91: [None] * 4 + [91], 92: [None, None, None, 50, 92]}


def test_recency_global_and_asof(spark):
    df = history(spark, [(0, 1, 0, 0, "c"), (0, 2, 10, 0, "c"), (0, 3, 30, 0, "c"), (0, 4, 40, 0, ""), (1, 5, 3, 0, "c"), (2, 6, 4, 0, "")])
    every = {r["session_id"]: r for r in stats.recency_global(df, df, TARGETS).collect()}
    assert (every[4]["choc_days"], every[4]["choc_count"], every[4]["choc_gap"], every[4]["choc_proximity"]) == (10, 3, 15.0, 1.0)
    assert every[1]["choc_days"] == -30  # the whole history looks ahead
    assert (every[5]["choc_gap"], every[6]["choc_days"], every[6]["choc_gap"], every[6]["choc_proximity"]) == (30.0, 999, 999.0, 0.0)
    before = {r["session_id"]: r for r in stats.recency_asof(df, df, TARGETS).collect()}
    assert (before[1]["choc_days"], before[1]["choc_count"]) == (999, 0)
    assert (before[3]["choc_days"], before[3]["choc_count"], before[3]["choc_gap"]) == (20, 2, 10.0)
    later = df.unionByName(history(spark, [(0, 99, 31, 0, "cb")]))
    same = {r["session_id"]: r for r in stats.recency_asof(df, later, TARGETS).collect()}
    assert all(same[s] == before[s] for s in (1, 2, 3))


def test_purchase_gaps(spark):
    df = history(spark, [(0, 1, 0, 0, "c"), (0, 2, 5, 0, "c"), (0, 3, 5, 1, "c")])
    rows = stats.purchase_gaps(df, TARGETS).orderBy("sale_date").collect()
    assert [(r["gap"], r["same_day"]) for r in rows] == [(None, 0), (5, 1)]


@pytest.mark.parametrize("hot_rows", [50, 700, 10_000])
def test_hot_keys_are_salted_without_changing_the_join(spark, hot, hot_rows):
    people = hot.groupBy("customer_id").agg(F.count("*").alias("n"))
    rows = hot.select("customer_id", "session_id").unionByName(
        spark.createDataFrame([(None, 9001), (777, 9002)], "customer_id long, session_id long"))
    heavy = heavy_keys(rows, "customer_id", hot_rows)
    out = join_statistics(rows, people, "customer_id", heavy)
    assert out.exceptAll(rows.join(people, "customer_id", "left")).count() == 0 and out.count() == 3002
    counts = {r["customer_id"]: r["n"] for r in people.collect()}
    want = {c: -(-n // hot_rows) for c, n in counts.items() if n > hot_rows}
    assert {r["customer_id"]: r["_slices"] for r in heavy.table.collect()} == want if want else heavy.table is None
