"""Fixed-length session histories as nested arrays, one row per sample."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketcast.constants import EMBED_DIM, RANDOM_CUT, SEQUENCE_LENGTH, TARGETS, TOP_CATEGORIES
from basketcast.functions.calendar import is_holiday_or_weekend
from basketcast.functions.scalars import coalesce_category
from basketcast.operators.clean import map_category
from basketcast.operators.encode import label_encode, label_transform
from basketcast.operators.coordinates import coordinate_matrix, sparse_rows
from basketcast.operators.factorise import truncated_svd
from basketcast.operators.sequences import (customer_sessions, random_cut, recent_history, run_steps, sequence_labels,
                                            sliding_windows, step_features, step_width, window_features)
from basketcast.operators.overlap import union_all
from basketcast.operators.stats import (customer_money, default_money, money_columns,
                                        session_money, top_categories)
from basketcast.session import materialise, store


@dataclass
class Tensors:
    train: DataFrame
    valid: DataFrame
    test: DataFrame
    width: int


def encoded_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions with label codes fitted on the training split and the holiday flag."""
    out = sessions.withColumn("holiday_or_weekend", is_holiday_or_weekend("sale_date"))
    train = sessions.filter(F.col("split") == "train")
    for column, code in (("store", "store_code"), ("age_band", "age_code"), ("gender", "gender_code")):
        out = label_transform(out, label_encode(train, column, code), column, code)
    return out


def session_vectors(sessions: DataFrame, log: DataFrame, products: DataFrame, money: Sequence[str],
                    category_columns: Sequence[str], dim: int = EMBED_DIM, most: int = TOP_CATEGORIES) -> tuple[DataFrame, int]:
    """(feature vector per session, size of the embedding in it).

    Customer money of training and validation sessions is learned from training
    sessions; test sessions may also look at the validation period.
    """
    train = sessions.filter(F.col("split") == "train")
    both = sessions.filter(F.col("split").isin("train", "valid"))
    mapped = map_category(log, products, coalesce_category(category_columns)).select("session_id", "category", "quantity")
    ranked = top_categories(mapped.join(train.select("session_id"), "session_id", "left_semi"), most)
    # At most ``most`` categories, numbered by how often they are bought.
    codes = materialise(ranked.withColumn("code", F.row_number().over(Window.orderBy(F.desc("n"), "category")) - 1).select("category", "code"))
    width = codes.count()
    rows = store(sparse_rows(coordinate_matrix(mapped, "session_id", codes, "quantity"), "session_id", mapped))
    fit = rows.join(train.select("session_id"), "session_id", "left_semi")
    embeddings = truncated_svd(fit, rows, width, dim=dim, keep_if_narrow=True)
    stats = store(session_money(log, money))
    columns = money_columns(money)
    people = {name: customer_money(stats, frame, money) for name, frame in (("train", train), ("both", both))}
    # Read by four joins below, and made by two.
    known = store(union_all(*[df.withColumn("known", F.lit(name)) for name, df in people.items()]))
    fallback = materialise(union_all(*[default_money(known.filter(F.col("known") == name), money).withColumn("known", F.lit(name)) for name in people]))
    staged = sessions.withColumn("money_from", F.when(F.col("split") == "test", "both").otherwise("train"))
    size = min(dim, width)
    return step_features(staged, embeddings, stats, known, fallback, columns, size, F.col("split") == "train"), size


def session_tensors(sessions: DataFrame, targets_of: DataFrame, log: DataFrame, products: DataFrame,
                    money: Sequence[str], category_columns: Sequence[str],
                    targets: Sequence[str] = TARGETS, length: int = SEQUENCE_LENGTH, dim: int = EMBED_DIM,
                    cut: float = RANDOM_CUT, mask_target_step: bool = True, most: int = TOP_CATEGORIES) -> Tensors:
    """Samples of ``length`` steps for training, validation and test.

    With ``mask_target_step`` the last step never shows the basket and money of
    the session that is to be predicted. Step vectors are written once and read
    by the three sample sets.
    """
    coded = store(encoded_sessions(sessions))
    vectors, size = session_vectors(coded, log, products, money, category_columns, dim, most)
    columns = money_columns(money)
    # A number of its own tells rows apart that share a session id.
    steps = store(coded.select("session_id", "customer_id", "split", "sale_date", "hour").join(vectors, "session_id")
                  .withColumn("row", F.monotonically_increasing_id()), ["split"])
    train, valid, test = [steps.filter(F.col("split") == s) for s in ("train", "valid", "test")]

    def samples(windows: DataFrame) -> DataFrame:
        return window_features(windows, columns, size, mask_target_step)

    # Runs are cut and drawn as session ids; the vectors come to the runs that are left.
    numbered = store(customer_sessions(train.drop("features")))
    runs = random_cut(sliding_windows(numbered, length), cut)
    held = numbered.select("row", "customer_id", "pos").join(train.select("row", "features"), "row")
    x_train = sequence_labels(samples(run_steps(runs, held, "features", length)), targets_of, targets)
    x_valid = sequence_labels(samples(recent_history(valid, train, length, step="features")), targets_of, targets)
    x_test = samples(recent_history(test, train.unionByName(valid), length, step="features"))
    return Tensors(x_train, x_valid, x_test, step_width(columns, size))
