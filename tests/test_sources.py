"""File readers, writers and checks."""

import pytest
from pyspark.sql import functions as F

from basketcast.constants import TARGET_CATEGORIES, TARGETS
from basketcast.sources import sinks, tables


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "train_session.csv").write_text(
        "売上日,session_id,顧客CD,時刻,店舗名,年代,性別\n2024-07-01,1,c0,08:30:00,A,20代,女\n2024-10-02,2,c1,21:00:00,B,30代,男\n")
    (tmp_path / "test_session.csv").write_text("session_id,顧客CD,売上日,時刻,店舗名,年代,性別\n3,c0,2024-11-01,9,A,20代,女\n")
    (tmp_path / "train_target.csv").write_text("チョコレート,ビール,ヘアケア,米（5㎏以下）,session_id\n1,0,0,1,1\n0,0,1,0,2\n")
    (tmp_path / "train_log.csv").write_text("session_id,JAN,売上数量,売上金額\n1,4900,2,198.50\n2,4901,-1,-100\n")
    (tmp_path / "jan.csv").write_text("JAN,カテゴリ名\n4900,チョコレート\n4901,洗剤\n")
    return str(tmp_path)


def test_load_tables_parses_dates_hours_and_names(spark, folder):
    loaded = tables.load_tables(spark, folder)
    assert set(loaded) == set(tables.TABLES)
    sessions = loaded["train_session"]
    assert dict(sessions.dtypes)["sale_date"] == "date"
    rows = sessions.orderBy("session_id").collect()
    assert [(r["customer_id"], str(r["sale_date"]), r["hour"], r["gender"]) for r in rows] == [
        ("c0", "2024-07-01", 8, "女"), ("c1", "2024-10-02", 21, "男")]
    assert loaded["test_session"].first()["hour"] == 9
    assert dict(loaded["train_log"].dtypes)["amount"] == "decimal(18,2)"
    joined = tables.attach_targets(sessions, loaded["train_target"], TARGETS).orderBy("session_id").collect()
    assert [[r[t] for t in TARGETS] for r in joined] == [[1, 0, 0, 1], [0, 0, 1, 0]]


def test_alignment(spark, folder):
    loaded = tables.load_tables(spark, folder)
    tables.check_alignment(loaded["train_session"], loaded["train_target"])
    with pytest.raises(ValueError):
        tables.check_alignment(loaded["test_session"], loaded["train_target"])


def test_detect_columns(spark):
    log = spark.createDataFrame([(1, 2, 3, 4.0, 5.0)], ["session_id", "JAN", "売上数量", "売上金額", "値引金額"])
    jan = spark.createDataFrame([(1, "a", "b")], ["JAN", "部門", "カテゴリ名"])
    found = tables.detect_columns(log, jan)
    assert found["money"] == ["売上金額", "値引金額"]
    assert (found["chosen_category"], found["quantity"]) == ("カテゴリ名", "売上数量")
    bare = tables.detect_columns(spark.createDataFrame([(1, 2, 3, 4)], "session_id int, JAN int, x int, y int"),
                                 spark.createDataFrame([(1, "q")], "JAN int, kind string"))
    assert bare == {"money": ["x", "y"], "category": ["kind"], "chosen_category": "kind", "quantity": None}
    assert tables.with_quantity(log, None).first()["quantity"] == 1.0


def test_predictions_round_trip(spark, tmp_path):
    scores = spark.createDataFrame([(1, 0.1, 0.2, 0.3, 0.4)], "session_id long, choc double, beer double, hair double, rice double")
    sinks.write_predictions(scores, str(tmp_path / "a"), TARGETS, labels=TARGET_CATEGORIES)
    back = spark.read.option("header", True).csv(str(tmp_path / "a"))
    assert back.columns == ["session_id", *TARGET_CATEGORIES.values()] and back.count() == 1
    sinks.write_predictions(scores, str(tmp_path / "b"), TARGETS, key=None)
    assert spark.read.option("header", True).csv(str(tmp_path / "b")).columns == list(TARGETS)


def test_oof_is_partitioned_by_fold(spark, tmp_path):
    scores = spark.range(8).select(F.col("id").alias("session_id"), (F.col("id") % 4).cast("int").alias("fold"), F.lit(0.5).alias("choc"))
    path = str(tmp_path / "oof")
    sinks.write_oof(scores, path)
    assert sorted(p.name for p in (tmp_path / "oof" / "scores").glob("fold=*")) == [f"fold={k}" for k in range(4)]
    assert sinks.read_oof(spark, path, scores.schema).select(*scores.columns).exceptAll(scores).count() == 0
    # One fold again, with other scores: the others stay.
    sinks.write_oof(scores.filter("fold = 2").withColumn("choc", F.lit(0.75)), path)
    back = {r["session_id"]: r["choc"] for r in sinks.read_oof(spark, path, scores.schema).collect()}
    assert back == {i: 0.75 if i % 4 == 2 else 0.5 for i in range(8)}
    # A fold whose files are gone or were written twice is named.
    scores.filter("fold = 3").write.mode("append").partitionBy("fold").parquet(f"{path}/scores")
    with pytest.raises(ValueError, match="manifest: 3$"):
        sinks.read_oof(spark, path, scores.schema)


def test_restore_order_and_keep_last(spark):
    order = spark.createDataFrame([(0, 5), (1, 3), (2, 9)], "ord int, session_id long")
    scores = spark.createDataFrame([(3, 0.3), (5, 0.5)], "session_id long, choc double")
    assert [(r["session_id"], r["choc"]) for r in sinks.restore_order(scores, order).collect()] == [(5, 0.5), (3, 0.3), (9, None)]
    twice = spark.createDataFrame([(1, 0, 0.1), (1, 2, None), (2, 1, 0.2)], "session_id long, ord int, choc double")
    assert sorted((r["session_id"], r["ord"], r["choc"]) for r in sinks.dedupe_keep_last(twice).collect()) == [(1, 2, None), (2, 1, 0.2)]


def test_undeclared_columns_are_kept(spark, tmp_path):
    (tmp_path / "train_log.csv").write_text("値引金額,session_id,JAN,quantity,売上数量,売上金額,店.名\n1.5,1,4900,9,2,198.50,x\n,2,4901,9,-1,-100,\n")
    (tmp_path / "jan.csv").write_text("JAN,部門,カテゴリ名,ブランド\n4900,菓子,,A\n4901,日用品,洗剤,\n")
    log, jan = tables.read_table(spark, str(tmp_path), "train_log"), tables.read_table(spark, str(tmp_path), "jan")
    assert log.columns == ["session_id", "jan", "quantity", "amount", "値引金額", "店.名"]
    assert [r["quantity"] for r in log.orderBy("session_id").collect()] == [2.0, -1.0]
    found = tables.detect_columns(log, jan)
    assert found["money"] == ["amount", "値引金額"] and found["category"] == ["category", "部門", "ブランド"]
