"""Calendar and scalar features, mostly over the events table."""

from pyspark.sql import functions as F

from basketcast.catalog.registry import each, query, text_date, twin
from basketcast.constants import DECAY_RATES, HOLIDAYS_2024, HOLIDAYS_ALL, TARGETS
from basketcast.functions import calendar, scalars
from basketcast.operators.encode import label_encode, label_transform
from basketcast.operators.stats import session_money, time_decay_weight

EVENT = "FROM (SELECT event_id, CAST(ts AS DATE) AS d, CAST(hour(ts) AS INTEGER) AS h, strftime(ts, '%H:%M:%S') AS clock FROM events)"
LISTED = ", ".join(f"DATE '{d}'" for d in HOLIDAYS_ALL)
LISTED_2024 = ", ".join(f"DATE '{d}'" for d in HOLIDAYS_2024)


@query("calendar_parts", f"""
SELECT event_id, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day,
       CAST(isodow(d) - 1 AS INTEGER) AS weekday {EVENT}""")
def calendar_parts(retail):
    return calendar.calendar_parts(retail.events).select("event_id", "month", "day", "weekday")


@query("weekday1_dom", f"SELECT event_id, CAST(isodow(d) AS INTEGER) AS weekday1, CAST(day(d) AS INTEGER) AS day_of_month {EVENT}")
def weekday1_dom(retail):
    return calendar.weekday1_dom(retail.events).select("event_id", "weekday1", "day_of_month")


@query("parse_hour", f"""
SELECT event_id, h AS from_clock, h AS from_hour, CAST(-1 AS INTEGER) AS from_text {EVENT}""")
def parse_hour(retail):
    bad = F.concat(F.lit("x"), F.col("sale_time"))
    return retail.events.select("event_id", calendar.parse_hour("sale_time").alias("from_clock"),
                                calendar.parse_hour(F.col("hour").cast("string")).alias("from_hour"),
                                F.coalesce(calendar.parse_hour(bad), F.lit(-1)).alias("from_text"))


@query("weekend_flag", f"SELECT event_id, CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS weekend {EVENT}")
def weekend_flag(retail):
    return retail.events.select("event_id", calendar.is_weekend("sale_date").alias("weekend"))


@query("week_of_month", f"SELECT event_id, CAST((day(d) - 1) // 7 + 1 AS INTEGER) AS week_of_month {EVENT}")
def week_of_month(retail):
    return retail.events.select("event_id", calendar.week_of_month("sale_date").alias("week_of_month"))


@query("holiday_flag", f"SELECT event_id, CASE WHEN d IN ({LISTED}) THEN 1 ELSE 0 END AS holiday {EVENT}")
def holiday_flag(retail):
    return retail.events.select("event_id", calendar.is_listed_holiday("sale_date").alias("holiday"))


@query("holiday_or_weekend", f"""
SELECT event_id, CASE WHEN d IN ({LISTED_2024}) OR isodow(d) >= 6 THEN 1 ELSE 0 END AS free_day {EVENT}""")
def holiday_or_weekend(retail):
    return retail.events.select("event_id", calendar.is_holiday_or_weekend("sale_date").alias("free_day"))


@query("time_band6", f"""
SELECT event_id, COALESCE(CASE WHEN h BETWEEN 1 AND 6 THEN '深夜' WHEN h BETWEEN 7 AND 11 THEN '午前'
       WHEN h BETWEEN 12 AND 14 THEN '昼' WHEN h BETWEEN 15 AND 17 THEN '午後'
       WHEN h BETWEEN 18 AND 21 THEN '夕方' WHEN h BETWEEN 22 AND 24 THEN '夜' END, 'none') AS band {EVENT}""")
def time_band6(retail):
    return retail.events.select("event_id", F.coalesce(calendar.time_band("hour"), F.lit("none")).alias("band"))


@query("time_period4", f"""
SELECT event_id, CASE WHEN h BETWEEN 5 AND 10 THEN 0 WHEN h BETWEEN 11 AND 14 THEN 1
       WHEN h BETWEEN 15 AND 18 THEN 2 ELSE 3 END AS period {EVENT}""")
def time_period4(retail):
    return retail.events.select("event_id", calendar.time_period("hour").alias("period"))


@query("month_phase", f"""
SELECT event_id, CASE WHEN day(d) <= 5 THEN 1 ELSE 0 END AS month_start, CASE WHEN day(d) >= 25 THEN 1 ELSE 0 END AS month_end,
       CASE WHEN day(d) > 5 AND day(d) < 25 THEN 1 ELSE 0 END AS month_middle {EVENT}""")
def month_phase(retail):
    return calendar.month_phase(retail.events).select("event_id", "month_start", "month_end", "month_middle")


@query("nth_friday", f"""
SELECT event_id, CASE WHEN isodow(d) = 5 AND day(d) BETWEEN 8 AND 14 THEN 1 ELSE 0 END AS second_friday,
       CASE WHEN isodow(d) = 5 AND day(d) BETWEEN 22 AND 28 THEN 1 ELSE 0 END AS fourth_friday {EVENT}""")
def nth_friday(retail):
    return calendar.nth_friday(retail.events).select("event_id", "second_friday", "fourth_friday")


@query("days_from_max", twin("session", """
SELECT session_id, CAST(date_diff('day', sale_date, (SELECT max(sale_date) FROM session)) AS INTEGER) AS days_from_max FROM session"""))
def days_from_max(retail):
    return calendar.days_from_max(retail.visits).select("session_id", "days_from_max")


@query("time_decay_weight", twin("session", "SELECT session_id, " + ", ".join(
    f"round(exp(-{rate!r}::DOUBLE * date_diff('day', sale_date, (SELECT max(sale_date) FROM session))), 9) AS weight_{t}"
    for t, rate in DECAY_RATES.items()) + " FROM session"))
def decay(retail):
    weighted = time_decay_weight(retail.visits)
    return weighted.select("session_id", *[F.round(f"weight_{t}", 9).alias(f"weight_{t}") for t in DECAY_RATES])


@query("cyclic_scaling", twin("fact", """
SELECT session_id, hour / 24.0::DOUBLE AS hour_scaled, weekday / 6.0::DOUBLE AS weekday_scaled, day / 31.0::DOUBLE AS day_scaled,
       month / 12.0::DOUBLE AS month_scaled, time_period / 3.0::DOUBLE AS time_period_scaled FROM fact"""))
def cyclic_scaling(retail):
    scaled = scalars.cyclic_scaling(calendar.calendar_features(retail.visits))
    return scaled.select("session_id", *[c for c in scaled.columns if c.endswith("_scaled")])


@query("max_normalise", twin("session log", """
SELECT session_id, CAST(a AS DOUBLE) / (SELECT max(CAST(a AS DOUBLE)) FROM j WHERE split = 'train') AS amount_scaled,
       hour / (SELECT CAST(max(hour) + 1 AS DOUBLE) FROM j WHERE split = 'train') AS hour_scaled FROM j""",
    "j AS (SELECT session_id, hour, split, COALESCE(a, 0) AS a FROM session LEFT JOIN (SELECT session_id, sum(amount) AS a FROM log GROUP BY session_id) USING (session_id))"))
def max_normalise(retail):
    sums = session_money(retail.log, ["amount"]).select("session_id", "amount_sum")
    joined = retail.visits.select("session_id", "hour", "split").join(sums, "session_id", "left").fillna(0, subset=["amount_sum"])
    out = scalars.max_normalise(joined, ["amount_sum"], ["hour"], F.col("split") == "train")
    return out.select("session_id", F.col("amount_sum_scaled").alias("amount_scaled"), "hour_scaled")


@query("coalesce_category", twin("log", """
SELECT jan, COALESCE(nullif(category_raw, ''), nullif(division, ''), CAST(jan AS VARCHAR)) AS filled,
       COALESCE(nullif(category_raw, ''), CAST(jan AS VARCHAR)) AS filled_by_code FROM jan"""))
def coalesce_category(retail):
    return retail.products.select("jan", scalars.coalesce_category(["category_raw", "division"]).alias("filled"),
                                  scalars.coalesce_category(["category_raw"]).alias("filled_by_code"))


@query("bitmask_stratum", twin("target", "SELECT session_id, CAST(choc + 2 * beer + 4 * hair + 8 * rice AS INTEGER) AS stratum FROM target"))
def bitmask_stratum(retail):
    return retail.targets.select("session_id", scalars.bitmask_stratum(TARGETS).alias("stratum"))


@query("label_scaling", twin("session", """
SELECT session_id, (dense_rank() OVER (ORDER BY store) - 1) / (SELECT CAST(count(DISTINCT store) AS DOUBLE) FROM session) AS store_scaled
FROM session"""))
def label_scaling(retail):
    coded = label_transform(retail.visits.select("session_id", "store"), label_encode(retail.visits, "store"), "store")
    return scalars.max_normalise(coded, codes=["code"]).select("session_id", F.col("code_scaled").alias("store_scaled"))
