"""The sample star schema read as retail tables.

Orders are sessions, line items are purchase lines, parts are products and four
brands are the targets. Columns nobody asks for are pruned from the scans.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketcast.constants import TARGETS
from basketcast.functions.calendar import calendar_features
from basketcast.operators.clean import temporal_split
from basketcast.session import store, tune

TRAIN_END, VALID_END = "2000-06-30", "2000-12-31"
BRANDS = {t: f"Brand#{i}" for i, t in enumerate(TARGETS, start=1)}
MONEY = ("amount", "discount")


class Retail:
    """Lazy retail views over one folder of the sample tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder
        self._kept = False

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def visits(self) -> DataFrame:
        """Sessions without their customer's attributes: no join at all."""
        return self._visits(self.table("orders"))

    @staticmethod
    def _visits(orders: DataFrame) -> DataFrame:
        return orders.select(
            F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("customer_id"),
            F.to_date("o_orderdate").alias("sale_date"), (F.col("o_orderkey") % 24).cast("int").alias("hour"),
            F.col("o_orderpriority").alias("store")).withColumn("split", temporal_split(TRAIN_END, VALID_END))

    def visits_of(self, split: str) -> DataFrame:
        """Visits of one split, picked on the stored date so that the scan can use it."""
        date = F.col("o_orderdate")
        after = {"train": None, "valid": TRAIN_END, "test": VALID_END}[split]
        upto = {"train": TRAIN_END, "valid": VALID_END, "test": None}[split]
        orders = self.table("orders")
        if after:
            orders = orders.filter(date >= F.date_add(F.lit(after).cast("date"), 1).cast("timestamp"))
        if upto:
            orders = orders.filter(date < F.date_add(F.lit(upto).cast("date"), 1).cast("timestamp"))
        return self._visits(orders)

    def with_attributes(self, visits: DataFrame) -> DataFrame:
        places = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        people = (self.table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
                  .select("c_custkey", F.col("c_mktsegment").alias("age_band"), F.col("r_name").alias("gender")))
        return visits.join(people, F.col("customer_id") == F.col("c_custkey"), "left").drop("c_custkey")

    @cached_property
    def sessions(self) -> DataFrame:
        return self.with_attributes(self.visits)

    @cached_property
    def log(self) -> DataFrame:
        return self._lines(self.table("lineitem"))

    # The sign of a quantity comes from the return flag: filters on the stored columns reach the scan.
    @cached_property
    def purchases(self) -> DataFrame:
        flag, quantity = F.col("l_returnflag"), F.col("l_quantity")
        kept = ((flag.isNull() | (flag != "R")) & (quantity > 0)) | ((flag == "R") & (quantity < 0))
        return self._lines(self.table("lineitem").filter(kept))

    @cached_property
    def returns(self) -> DataFrame:
        flag, quantity = F.col("l_returnflag"), F.col("l_quantity")
        back = ((flag.isNull() | (flag != "R")) & (quantity <= 0)) | ((flag == "R") & (quantity >= 0))
        return self._lines(self.table("lineitem").filter(back))

    @staticmethod
    def _lines(lines: DataFrame) -> DataFrame:
        price = F.col("l_extendedprice").cast("decimal(18,2)")
        return lines.select(
            F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("jan"),
            F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
            price.alias("amount"),
            (price * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(18,2)").alias("discount"))

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("jan"), F.col("p_brand").alias("category"),
            F.when(F.col("p_size") % 10 == 0, "").otherwise(F.col("p_brand")).alias("category_raw"),
            F.col("p_type").alias("division"))

    @cached_property
    def kept_targets(self) -> DataFrame:
        """Target flags of sessions with a kept line of a target's brand.

        The filter is spelled on the stored columns, so that the scan can use it.
        """
        wanted = self.products.filter(F.col("category").isin(*BRANDS.values())).select("jan", "category")
        kept = self.table("lineitem").filter((F.col("l_returnflag") != "R") & (F.col("l_quantity") > 0))
        return (kept.select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("jan")).join(wanted, "jan")
                .groupBy("session_id").agg(*[
                    F.max((F.col("category") == b).cast("int")).alias(t) for t, b in BRANDS.items()]))

    @cached_property
    def outcomes(self) -> DataFrame:
        """Visits with their target flags."""
        return self.visits.join(self.kept_targets, "session_id", "left").fillna(0, subset=list(TARGETS))

    @cached_property
    def targets(self) -> DataFrame:
        """Target flags of every session."""
        return self.outcomes.select("session_id", *TARGETS)

    @cached_property
    def base(self) -> DataFrame:
        return self.with_attributes(self.outcomes)

    def keep(self) -> "Retail":
        """Write the session facts once, for queries that read them repeatedly."""
        if not self._kept:
            self.base = store(self.base, ["split"])
            self.__dict__.pop("facts", None)
            self._kept = True
        return self

    @cached_property
    def facts(self) -> DataFrame:
        """Sessions with calendar features and targets."""
        return calendar_features(self.base)

    @property
    def history(self) -> DataFrame:
        return self.facts.filter(F.col("split") == "train")

    @property
    def validation(self) -> DataFrame:
        return self.facts.filter(F.col("split") == "valid")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(
            "event_id", F.to_date("ts").alias("sale_date"), F.hour("ts").alias("hour"),
            F.date_format("ts", "HH:mm:ss").alias("sale_time"))


# The same views for the SQL twins of the queries.
SESSION_SQL = f"""
session AS (
  SELECT o_orderkey AS session_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS sale_date,
         CAST(o_orderkey % 24 AS INTEGER) AS hour, o_orderpriority AS store,
         c_mktsegment AS age_band, r_name AS gender,
         CASE WHEN CAST(o_orderdate AS DATE) <= DATE '{TRAIN_END}' THEN 'train'
              WHEN CAST(o_orderdate AS DATE) <= DATE '{VALID_END}' THEN 'valid' ELSE 'test' END AS split
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey)"""
LOG_SQL = """
log AS (
  SELECT l_orderkey AS session_id, l_partkey AS jan,
         CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS discount
  FROM lineitem),
jan AS (
  SELECT p_partkey AS jan, p_brand AS category,
         CASE WHEN p_size % 10 = 0 THEN '' ELSE p_brand END AS category_raw, p_type AS division
  FROM part)"""
TARGET_SQL = """
target AS (
  SELECT session_id, """ + ", ".join(
    f"CAST(COALESCE(MAX(CASE WHEN category = '{b}' AND quantity > 0 THEN 1 ELSE 0 END), 0) AS INTEGER) AS {t}"
    for t, b in BRANDS.items()) + """
  FROM session LEFT JOIN log USING (session_id) LEFT JOIN jan USING (jan) GROUP BY session_id)"""
FACT_SQL = """
fact AS (
  SELECT session.*, choc, beer, hair, rice,
         CAST(month(sale_date) AS INTEGER) AS month, CAST(day(sale_date) AS INTEGER) AS day,
         CAST(isodow(sale_date) - 1 AS INTEGER) AS weekday,
         CASE WHEN day(sale_date) <= 5 THEN 1 ELSE 0 END AS month_start,
         CASE WHEN day(sale_date) >= 25 THEN 1 ELSE 0 END AS month_end,
         CASE WHEN hour > 0 AND hour <= 6 THEN '深夜' WHEN hour > 6 AND hour <= 11 THEN '午前'
              WHEN hour > 11 AND hour <= 14 THEN '昼' WHEN hour > 14 AND hour <= 17 THEN '午後'
              WHEN hour > 17 AND hour <= 21 THEN '夕方' WHEN hour > 21 AND hour <= 24 THEN '夜' END AS time_band,
         CASE WHEN hour >= 5 AND hour < 11 THEN 0 WHEN hour >= 11 AND hour < 15 THEN 1
              WHEN hour >= 15 AND hour < 19 THEN 2 ELSE 3 END AS time_period
  FROM session JOIN target USING (session_id))"""
VIEWS = {"session": SESSION_SQL, "log": LOG_SQL, "target": TARGET_SQL, "fact": FACT_SQL}
