"""Reading, keying and ordering of tables."""

import uuid

from pyspark.sql import functions as F

from basketcast.catalog.encoders import scored
from basketcast.catalog.registry import SCORED, each, query, text_date, twin
from basketcast.constants import FOLDS, TARGET_CATEGORIES, TARGETS
from basketcast.functions.calendar import days_between
from basketcast.functions.scalars import coalesce_category, prefix_columns
from basketcast.operators.clean import feature_columns
from basketcast.operators.overlap import union_all
from basketcast.session import delete_at_end, run_folder, shared_folder, store
from basketcast.sources import sinks, tables


@query("load_tables", twin("target", """
SELECT 'session' AS name, CAST(count(*) AS BIGINT) AS n, CAST(sum(session_id) AS BIGINT) AS key_sum FROM session
UNION ALL SELECT 'log', CAST(count(*) AS BIGINT), CAST(sum(session_id) AS BIGINT) FROM log
UNION ALL SELECT 'jan', CAST(count(*) AS BIGINT), CAST(sum(jan) AS BIGINT) FROM jan
UNION ALL SELECT 'target', CAST(count(*) AS BIGINT), CAST(sum(session_id) AS BIGINT) FROM target"""))
def load_tables(retail):
    frames = {"session": (retail.sessions, "session_id"), "log": (retail.log, "session_id"),
              "jan": (retail.products, "jan"), "target": (retail.targets, "session_id")}
    return union_all(*[df.agg(F.count("*").alias("n"), F.sum(key).alias("key_sum")).select(F.lit(name).alias("name"), "n", "key_sum")
                       for name, (df, key) in frames.items()])


@query("date_parsing_read", twin("session", """
SELECT session_id, CAST(sale_date AS VARCHAR) AS sale_date, hour, CAST(date_diff('day', DATE '1998-01-01', sale_date) AS INTEGER) AS days FROM session"""))
def date_parsing_read(retail):
    """Sessions written with their dates as text, day first, and read back through the declared schema."""
    folder = run_folder(retail.spark, "csv")
    retail.visits.select("session_id", F.date_format("sale_date", "dd/MM/yyyy").alias("売上日"), F.format_string("%02d:30:00", "hour").alias("時刻")
                         ).write.option("header", True).csv(f"{folder}/train_session.csv")
    read = tables.read_table(retail.spark, folder, "train_session", date_format="dd/MM/yyyy")
    days = days_between(F.col("sale_date"), F.lit("1998-01-01").cast("date"))
    return text_date(read.select("session_id", "sale_date", "hour", days.alias("days")), "sale_date")


@query("attach_targets", twin("target", f"""
SELECT session_id, customer_id, {each('{t}')} FROM session LEFT JOIN target USING (session_id)"""))
def attach_targets(retail):
    return tables.attach_targets(retail.visits.select("session_id", "customer_id"), retail.targets, TARGETS)


@query("restore_order", twin("fact", """
SELECT o.ord, o.session_id, COALESCE(CAST(f.choc + f.beer + f.hair + f.rice AS DOUBLE), -1) AS score
FROM (SELECT session_id, -session_id AS ord FROM session) o
LEFT JOIN (SELECT * FROM fact WHERE split = 'test') f USING (session_id)"""))
def restore_order(retail):
    # Later sessions first: a unique order that needs no window.
    order = retail.visits.select("session_id", (-F.col("session_id")).alias("ord"))
    scores = retail.outcomes.filter("split = 'test'").select(
        "session_id", sum((F.col(t) for t in TARGETS), F.lit(0)).cast("double").alias("score"))
    return sinks.restore_order(scores, order).withColumn("score", F.coalesce("score", F.lit(-1.0)))


@query("dedupe_keep_last", twin("session", """
SELECT customer_id, session_id, store, hour FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY session_id DESC) AS r FROM session) WHERE r = 1"""))
def dedupe_keep_last(retail):
    return sinks.dedupe_keep_last(retail.visits.select("customer_id", "session_id", "store", "hour"),
                                  "customer_id", "session_id")


@query("detect_columns", twin("log", """
SELECT CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(discount) AS DOUBLE) AS discount,
       CAST(sum(quantity) AS DOUBLE) AS quantity FROM log"""))
def detect_columns(retail):
    found = tables.detect_columns(retail.log, retail.products)
    counted = tables.with_quantity(retail.log, found["quantity"])
    return counted.agg(*[F.sum(c).cast("double").alias(c) for c in (*found["money"], "quantity")])


@query("loaded_money", twin("log", """
SELECT COALESCE(nullif(category_raw, ''), division) AS filled, CAST(count(*) AS BIGINT) AS n, CAST(sum(amount) AS DOUBLE) AS amount,
       CAST(sum(discount) AS DOUBLE) AS discount, CAST(sum(quantity) AS DOUBLE) AS quantity
FROM log JOIN jan USING (jan) GROUP BY ALL"""))
def loaded_money(retail):
    """The tables written as CSV files with more columns than the schemas declare, read back and put to use."""
    spark, folder = retail.spark, f"{shared_folder(retail.spark)}/csv-{uuid.uuid4().hex}"
    files = {"train_log": retail.log.select("session_id", F.col("jan").alias("JAN"), F.col("quantity").alias("売上数量"),
                                            F.col("amount").alias("売上金額"), F.col("discount").alias("値引金額")),
             "jan": retail.products.select(F.col("jan").alias("JAN"), F.col("division").alias("部門"), F.col("category_raw").alias("カテゴリ名"))}
    for name, df in files.items():
        df.write.option("header", True).csv(f"{folder}/{name}.csv")
    delete_at_end(spark, folder)
    log, products = (tables.read_table(spark, folder, name) for name in files)
    found = tables.detect_columns(log, products)
    order = sorted(found["category"], key=lambda c: c != found["chosen_category"])
    mapped = products.select("jan", coalesce_category(order).alias("filled"))
    names = {"amount": "amount", "値引金額": "discount"}
    sums = [F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(names[c]) for c in found["money"]]
    lines = tables.with_quantity(log, found["quantity"]).join(mapped, "jan")
    return lines.groupBy("filled").agg(F.count("*").alias("n"), *sums, F.sum("quantity").alias("quantity"))


@query("feature_columns", twin("fact", """
SELECT session_id, hour, month, day, weekday, month_start, month_end, time_period FROM fact"""))
def features_only(retail):
    frame = retail.facts.select("session_id", "hour", "month", "day", "weekday", "month_start", "month_end", "time_period",
                                "store", "age_band", "gender", "customer_id", *TARGETS)
    return feature_columns(frame, [*TARGETS, "store", "age_band", "gender", "customer_id"])


@query("prefix_columns", twin("target", f"SELECT session_id, {each('{t} AS f_{t}')} FROM target"))
def prefixed(retail):
    return prefix_columns(retail.targets, "f_", TARGETS)


@query("preview_head", twin("session", "SELECT session_id, customer_id, store FROM session ORDER BY session_id LIMIT 5"))
def preview_head(retail):
    return sinks.preview_head(retail.visits.select("session_id", "customer_id", "store"), ["session_id"])


@query("row_alignment_check", twin("target", """
SELECT CAST((SELECT count(*) FROM session) AS BIGINT) AS session_rows,
       CAST((SELECT count(*) FROM target) AS BIGINT) AS target_rows,
       CAST((SELECT count(*) FROM session WHERE session_id NOT IN (SELECT session_id FROM target)) AS BIGINT) AS sessions_without_target,
       CAST((SELECT count(*) FROM target WHERE session_id NOT IN (SELECT session_id FROM session)) AS BIGINT) AS targets_without_session,
       CAST((SELECT count(*) FROM (SELECT session_id FROM session GROUP BY session_id HAVING count(*) > 1)) AS BIGINT) AS repeated_keys"""))
def row_alignment_check(retail):
    return tables.alignment_report(retail.visits, retail.targets)


# --- writing a run ----------------------------------------------------------

SCORE_COLUMNS = each("bayes_{t} AS {t}")


def run_scores(retail):
    """Scores of the validation sessions and the quarter each belongs to."""
    return scored(retail).select("session_id", (F.col("session_id") % FOLDS).cast("int").alias("fold"),
                                 *[F.col(f"bayes_{t}").alias(t) for t in TARGETS])


@query("write_predictions", twin("fact", f"SELECT session_id, {SCORE_COLUMNS} FROM scored", *SCORED))
def write_predictions(retail):
    """A submission file with labelled columns, written twice to the same place and read back."""
    folder = run_folder(retail.spark, "submission")
    scores = store(run_scores(retail))
    sinks.write_predictions(scores.limit(0), folder, TARGETS, labels=TARGET_CATEGORIES)
    sinks.write_predictions(scores, folder, TARGETS, labels=TARGET_CATEGORIES)
    columns = ["session_id long", *[f"`{TARGET_CATEGORIES[t]}` double" for t in TARGETS]]
    return retail.spark.read.option("header", True).schema(", ".join(columns)).csv(folder).toDF("session_id", *TARGETS)


def written_oof(retail):
    """Folder and schema of out-of-fold scores, of which one fold was written with errors first and then again."""
    folder, scores = run_folder(retail.spark, "oof"), store(run_scores(retail))
    half = scores.withColumns({t: F.when(F.col("fold") == 1, F.lit(0.5)).otherwise(F.col(t)) for t in TARGETS})
    sinks.write_oof(half.filter("fold <> 1 OR session_id % 8 = 1"), folder)
    sinks.write_oof(scores.filter("fold = 1"), folder)
    return folder, scores.schema


@query("write_oof", twin("fact", f"SELECT session_id, CAST(session_id % {FOLDS} AS INTEGER) AS fold, {SCORE_COLUMNS} FROM scored", *SCORED))
def write_oof(retail):
    folder, schema = written_oof(retail)
    return sinks.read_oof(retail.spark, folder, schema).select("session_id", "fold", *TARGETS)


@query("oof_manifest", twin("fact", f"""
SELECT CAST(session_id % {FOLDS} AS INTEGER) AS fold, CAST(count(*) AS BIGINT) AS rows, CAST(sum(session_id) AS BIGINT) AS key_sum FROM scored GROUP BY 1""", *SCORED))
def oof_manifest(retail):
    folder, _ = written_oof(retail)
    stated = retail.spark.read.parquet(f"{folder}/manifest")
    return stated.select(F.col("fold").cast("int").alias("fold"), "rows", F.col("key_sum").cast("long").alias("key_sum"))
