"""Toxicity grammar, byte network and language model: brute force, invariants and held-out accuracy."""

import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest

from basketcast.llm import byte_cnn, pitman_yor, toxicity
from basketcast.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)


def area(score, y):
    rank = pd.Series(score).rank().to_numpy()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def held_out(spark, name, label):
    got = QUERIES[name](spark, LARGER).toPandas()
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    assert sorted(got.doc_id) == sorted(r[0] for r in docs.select("doc_id").collect()) and got.score.between(0, 1).all()
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").toPandas()
    some = got[got.held_out].merge(labels, on="doc_id")
    return got, some, some[label].to_numpy()


# --- Toxicity ------------------------------------------------------------------

def events(*texts):
    import pyarrow as pa

    return [dict(zip(toxicity.EVENTS, row)) for row in toxicity.event_sums(pa.array(texts, pa.string()), toxicity.prior_grammar())]


def test_clauses_and_not_words_are_scored():
    plain, aimed, negated, quoted, threat, idle, far, after, empty = events(
        "what an idiot", "you are an idiot", "you are not an idiot", "they reported that the man was an idiot", "i will kill you", "kill time",
        "not so. then came one idiot", "idiots, you two", "")
    assert plain["plain"] == 1 and aimed["aimed"] == 1 and negated["negated"] == 1 and quoted["reported"] == 1 and threat["threat"] == 1
    assert sum(idle.values()) == 0 and far["negated"] == 0 and sum(far.values()) == 1 and after["aimed"] == 1 and sum(empty.values()) == 0


def test_composition_equals_the_parts():
    rng = np.random.default_rng(0)
    machine = toxicity.Machine()
    for _ in range(50):
        tags = rng.integers(0, 7, 30).tolist()
        state, parts = 0, [0] * len(toxicity.PARTS)
        for tag in tags:
            state, event = machine.move(state, tag)
            assert event == toxicity.Machine.event(tuple(parts), tag)
            parts = [step(s, tag) for step, s in zip(toxicity.PARTS, parts)]
            assert machine.tuples[state] == tuple(parts)
    assert len(machine.tuples) <= 4 * 9 * 5


def test_texts_do_not_reach_into_each_other():
    together = events("you", "idiot", "not", "moron you", "x " * 40_000 + "scum")
    alone = [events(t)[0] for t in ("you", "idiot", "not", "moron you", "x " * 40_000 + "scum")]
    assert together == alone and together[1]["plain"] == 1


def test_toxicity_on_held_out_rows(spark):
    got, some, y = held_out(spark, "op3_toxicity", "toxic")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert area(some.score, y) > 0.95
    assert (some.predicted[y == 1] == 1).mean() > 0.8 and (some.predicted[y == 0] == 1).mean() < 0.01


def test_toxicity_edges(spark):
    docs = documents(spark, [None, "", "you idiot moron scum, you pathetic loser", "fine"]).withColumnRenamed("n_chars", "toxicity")
    labels = spark.createDataFrame([(None, 1, 1), (2, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    grammar = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, grammar).orderBy("doc_id").collect()
    assert [r["toxicity"] >= toxicity.THRESHOLD for r in rows] == [False, False, True, False]
    assert rows[0]["toxicity"] == rows[1]["toxicity"] == rows[3]["toxicity"] and rows[2]["matched_clauses"] == 5
    assert [r["doc_id"] for r in toxicity.clean(docs, grammar).orderBy("doc_id").collect()] == [0, 1, 3]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0


# --- Quality ---------------------------------------------------------------------

def brute_forward(net, text):
    data = np.zeros((len(text) + byte_cnn.WIDTH + byte_cnn.HALF - 1) // byte_cnn.HALF * byte_cnn.HALF + byte_cnn.WIDTH, int)
    data[byte_cnn.WIDTH:byte_cnn.WIDTH + len(text)] = list(text)
    places = (len(data) - byte_cnn.WIDTH) // byte_cnn.STRIDE
    conv = np.array([np.maximum(net.bias + sum(net.tables[k, data[p * byte_cnn.STRIDE + k]] for k in range(byte_cnn.WIDTH)), 0) for p in range(places)])
    half = [conv[i:i + byte_cnn.PLACES].mean(axis=0) for i in range(0, places, byte_cnn.PLACES)]
    seen = [(half[i] + half[min(i + 1, len(half) - 1)]) / 2 for i in range(len(half))]
    best = np.max([np.maximum(s @ net.units + net.unit_bias, 0) for s in seen], axis=0)
    return 1 / (1 + np.exp(-(best @ net.out + net.out_bias)))


def test_network_matches_a_plain_one():
    rng = np.random.default_rng(4)
    net = byte_cnn.new_network(rng)
    texts = [b"", b"a", bytes(range(256)) * 3, rng.bytes(1_000), b"word " * 200, "é😀".encode() * 30]
    want = [brute_forward(net, t) for t in texts]
    assert byte_cnn.forward(net, texts) == pytest.approx(want, abs=1e-5)
    assert [float(byte_cnn.forward(net, [t])[0]) for t in texts] == pytest.approx(want, abs=1e-5)
    # The end of a long text counts as much as its start.
    assert byte_cnn.forward(net, [b"a" * 100_000 + b"&&& ***" * 20])[0] != byte_cnn.forward(net, [b"a" * 100_140])[0]


def test_gradients_match_differences():
    rng = np.random.default_rng(6)
    net = byte_cnn.new_network(rng)
    net = byte_cnn.Network(*[np.asarray(getattr(net, k), np.float64) for k in ("tables", "bias", "units", "unit_bias", "out")], 0.1)
    texts, y = [b"The quick brown fox " * 9, b"AND *** &&& 123 " * 7, b"x"], np.array([1.0, 0.0, 1.0])

    def loss(n):
        p = byte_cnn.forward(n, texts)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    grad = byte_cnn.gradients(net, texts, y)
    for key, at in (("out", 3), ("units", (2, 5)), ("unit_bias", 1), ("bias", 4), ("tables", (2, ord("u"), 7)), ("tables", (0, ord("*"), 1))):
        values = []
        for step in (1e-2, -1e-2):
            moved = getattr(net, key).copy()
            moved[at] += step
            values.append(loss(byte_cnn.Network(**{**net.__dict__, key: moved})))
        assert grad[key][at] == pytest.approx((values[0] - values[1]) / 2e-2, rel=0.1, abs=2e-5)


def test_quality_on_held_out_rows(spark):
    got, some, y = held_out(spark, "op6_byte_cnn", "quality")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert area(some.score, y) > 0.97
    assert (some.predicted[y == 1] == 1).mean() > 0.98 and (some.predicted[y == 0] == 0).mean() > 0.85


def test_quality_edges(spark):
    docs = documents(spark, [None, "", "text"]).withColumnRenamed("n_chars", "quality")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    share = byte_cnn.fit(docs, labels)
    assert share == 1.0 and [r["quality"] for r in byte_cnn.score(docs, share).collect()] == [1.0] * 3
    assert byte_cnn.fit(docs, labels.limit(0)) == 0.5 and byte_cnn.score(docs.limit(0), 0.5).count() == 0
    net = byte_cnn.new_network(np.random.default_rng(0))
    rows = byte_cnn.score(docs, net).orderBy("doc_id").collect()
    assert rows[0]["quality"] == rows[1]["quality"]


# --- Language model -------------------------------------------------------------------

def brute_base(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + ["\n"] for _, t in rows]
    train = Counter()
    for (doc, _), t in zip(rows, tokens):
        if zlib.crc32(str(doc).encode()) % 7 != 2:
            train.update(t)
    n = sum(train.values())
    score = [sum(np.log10((train[w] + 1) / (n + len(train) + 1)) for w in t) for t in tokens]
    return {doc: (len(t), sum(train[w] > 0 for w in t), n, s) for (doc, _), t, s in zip(rows, tokens, score)}


def test_counts_and_base_match_brute_force_and_the_model_is_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    got = QUERIES["op7_pitman_yor"](spark, "/root/testdata/sf0.01").toPandas()
    want = brute_base(list(zip(docs.doc_id, docs.text)))
    assert len(got) == len(docs)
    for r in got.itertuples():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.base_score == pytest.approx(want[r.doc_id][3])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    report = {r["held_out"]: r for r in pitman_yor.perplexity(spark.createDataFrame(got)).collect()}
    assert report[True]["perplexity"] < 0.6 * report[True]["base_perplexity"]
    assert report[False]["perplexity"] < report[True]["perplexity"]


def test_probabilities_of_a_context_sum_to_one(spark, tmp_path):
    rng = np.random.default_rng(8)
    names = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(names, 30, p=np.r_[[0.02] * 30, [0.04] * 10])) for _ in range(60)] + [None, ""]
    docs = documents(spark, texts).selectExpr("doc_id", "coalesce(text, '') AS text", "false AS held_out")
    model = pitman_yor.fit(docs, str(tmp_path / "tokens"))
    rows = pitman_yor.model_words(model.words).toArrow().combine_chunks().to_batches()[0:]
    total, seen = np.zeros(pitman_yor.CONTEXTS + 1), 0
    for batch in rows:
        key, probability, parents, count = pitman_yor.predictive(batch, model.samples)
        value = pitman_yor.mean_back_off(parents, model.samples)
        value[key // 256, key % 256] = probability
        total += value.sum(axis=0)
        seen += len(batch)
    unknown = pitman_yor.mean_back_off(np.array([[t.parent(0.0, 0.0) for t in model.samples]]), model.samples)[0]
    assert seen == 41 and total + unknown == pytest.approx(np.ones(len(total)))


def test_seating_keeps_its_books():
    rng = np.random.default_rng(9)
    contexts, customers, n_pairs = np.array([0, 1, 2, 1, 5], np.uint8), np.array([1, 7, 900, 2, 30], np.int64), np.array([3, 1, 1], np.int16)
    pack = {"names": b"a\nb\nc", "n_pairs": n_pairs.tobytes(), "contexts": contexts.tobytes(), "customers": customers.tobytes(),
            **dict.fromkeys(["sizes", "parent_sizes", "table_sums", "parents"])}
    sizes = np.zeros(pitman_yor.CONTEXTS + 1, np.int64)
    np.add.at(sizes, contexts, customers)
    totals = pitman_yor.Totals(sizes, (sizes > 0).astype(np.int64), 3.0, 0.6, 0.5, 3)
    for turn in range(40):
        pack, sums = pitman_yor.sweep(pack, totals, rng, keep=turn >= 2)
        child, parent = np.frombuffer(pack["sizes"], np.int64), np.frombuffer(pack["parent_sizes"], np.int64)
        assert child.sum() == customers.sum() and (child > 0).all() and parent.sum() == len(child) == sums[:-1].sum() and len(parent) == sums[-1]
        totals = pitman_yor.Totals(sizes, sums[:-1], float(sums[-1]), 0.6, 0.5, 3)
    means = np.frombuffer(pack["table_sums"], np.int32) / 38
    assert means[0] == 1 and (means >= 1).all() and (means <= customers).all()


def exact_tables(customers, fresh, discount):
    """Expected tables of one dish given its customers, by summing over all seatings."""
    weight = {(1, 1): 1.0}
    for n in range(1, customers):
        weight_next: dict = {}
        for (c, t), w in weight.items():
            weight_next[c + 1, t] = weight_next.get((c + 1, t), 0) + w * (c - discount * t)
            weight_next[c + 1, t + 1] = weight_next.get((c + 1, t + 1), 0) + w * fresh
        weight = weight_next
    return sum(t * w for (_, t), w in weight.items()) / sum(weight.values())


def test_gibbs_moves_reach_the_seating_distribution():
    rng, copies, customers, fresh, discount = np.random.default_rng(10), 4_000, 6, 0.8, 0.5
    seats = pitman_yor.Seats(*pitman_yor.even_tables(np.full(copies, customers), np.full(copies, 1)), rng)
    everyone = np.arange(copies)
    for _ in range(60):
        seats.take_out(everyone)
        seats.seat(everyone, np.full(copies, fresh), discount)
    assert seats.counts(copies).mean() == pytest.approx(exact_tables(customers, fresh, discount), rel=0.03)


def test_language_model_edges(spark):
    rows = [None, "", "A a\x0bb", "x" * 50_000, "word " * 50_000, "A a\x0bb"]
    got = pitman_yor.score_documents(documents(spark, rows)).toPandas().set_index("doc_id")
    want = brute_base(list(enumerate(rows)))
    assert {d: (r.n_tokens, r.n_known, r.train_tokens) for d, r in got.iterrows()} == {d: w[:3] for d, w in want.items()}
    assert np.isfinite(got.score).all() and pitman_yor.score_documents(documents(spark, rows).limit(0)).count() == 0
    lone = pitman_yor.score_documents(documents(spark, ["a"] * 30).filter("doc_id % 7 = 0 AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 7 = 2")).toPandas()
    assert (lone.score == 0).all() and (lone.base_score == 0).all()


def table_moments(customers, fresh, discount, most):
    """Mean and deviation of the number of tables, up to ``most``, by a recursion over the customers in logs."""
    weight = np.full(most + 1, -np.inf)
    weight[1], t = 0.0, np.arange(most + 1)
    for n in range(1, customers):
        old = weight + np.log(np.maximum(n - discount * t, 1e-300))
        old[1:] = np.logaddexp(old[1:], weight[:-1] + np.log(fresh))
        weight = old
    share = np.exp(weight - weight.max())
    mean = (t * share).sum() / share.sum()
    return mean, np.sqrt(((t - mean) ** 2 * share).sum() / share.sum())


def test_numbers_of_tables_are_drawn_from_their_distribution():
    for customers, fresh, discount in ((6, 0.8, 0.5), (100, 3.0, 0.75), (300, 0.01, 0.6), (300, 40.0, 0.6), (400, 5.0, 0.9), (400, 300.0, 0.3)):
        copies = 4_000
        got = pitman_yor.draw_tables(np.full(copies, customers), np.full(copies, np.log(fresh)), discount, np.random.default_rng(12))
        mean, sd = table_moments(customers, fresh, discount, customers)
        assert got.mean() == pytest.approx(mean, abs=0.08 * sd) and got.std() == pytest.approx(sd, rel=0.1), (customers, fresh, discount)


def test_weights_of_seatings_match_the_recursion():
    for n in (129, 552, 1500):
        for discount in (0.05, 0.3, 0.6, 0.9, 0.934, 0.95):
            weight, t = np.full(n + 1, -np.inf), np.arange(n + 1)
            weight[1] = 0.0
            for m in range(1, n):
                more = weight + np.log(np.maximum(m - discount * t, 1e-300))
                more[1:] = np.logaddexp(more[1:], weight[:-1])
                weight = more
            got = pitman_yor.log_seatings(np.full(n, n), t[1:], discount)
            assert np.abs(got - weight[1:]).max() < 0.05, (n, discount)


def test_draws_end_for_any_numbers():
    rng, began = np.random.default_rng(14), time.thread_time()
    for discount in [0.05, 0.934, 0.6333, 0.95, *rng.uniform(0.05, 0.95, 6)]:
        n = np.exp(rng.uniform(0, np.log(3e6), 20_000)).astype(np.int64)
        weight = rng.uniform(-30, np.log(n) + 3)
        got = pitman_yor.draw_tables(n, weight, discount, rng, np.ones(len(n), np.int64))
        assert ((got >= 1) & (got <= n)).all()
    for n, weight, discount in ((552, 6.4414, 0.934), (1_100_381, 0.4391, 0.6334)):
        pitman_yor.draw_tables(np.full(500, n), np.full(500, weight), discount, rng)
    assert time.thread_time() - began < 120


def test_large_pairs_are_seated_whole_and_leave_a_bad_start():
    customers, fresh, discount = 100_000, 10.0, 0.6
    mean, sd = table_moments(customers, fresh, discount, 400)
    got = pitman_yor.draw_tables(np.full(2_000, customers), np.full(2_000, np.log(fresh)), discount, np.random.default_rng(13))
    assert mean < 200 and got.mean() == pytest.approx(mean, abs=0.1 * sd) and got.std() == pytest.approx(sd, rel=0.1)
    # The same pair in a sweep, in 200 words, from far too few and far too many tables.
    n = 200
    totals = pitman_yor.Totals(np.r_[customers * n, np.zeros(255, int)], np.r_[500 * n, np.zeros(255, int)], 2.0 * n, discount, 0.5, n)
    ends = []
    for start in (1, 90_000):
        pack = {"names": b"\n".join([b"a"] * n), "n_pairs": np.ones(n, np.int16).tobytes(), "contexts": bytes(n), "customers": np.full(n, customers).tobytes(),
                "table_sums": bytes(4 * n), "parents": b"", "sizes": pitman_yor.even_tables(np.full(n, customers), np.full(n, start))[1].tobytes(),
                "parent_sizes": np.full(n, start).tobytes()}
        seen = []
        for turn in range(30):
            pack, sums = pitman_yor.sweep(pack, totals, np.random.default_rng(turn), keep=False)
            seen.append(sums[0] / n)
        ends.append(np.mean(seen[12:]))
    assert ends[0] == pytest.approx(ends[1], rel=0.15), ends


def test_burn_in_goes_on_while_totals_drift():
    totals = lambda *tables: pitman_yor.Totals(np.array([10 ** 6] * 2), np.array(tables), 10_000.0, 0.6, 0.5, 50)
    assert pitman_yor.drifting(totals(50_000, 40_000), totals(54_000, 43_000))
    assert not pitman_yor.drifting(totals(54_000, 43_000), totals(54_200, 42_900)) and not pitman_yor.drifting(totals(9, 4), totals(7, 5))


def test_frequent_words_count_where_they_are_rare_too(spark):
    texts = ["x " * 50_000 + "seldom", "seldom " * 300 + "y " * 50_000]
    rows = [(0, t, False) for t in texts] + [(0, "seldom " * 9, True)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string, held_out boolean")
    got = {r["word"]: r["c"] for r in pitman_yor.frequent_words(docs).collect()}
    assert got["seldom"] == 301 and got["x"] == got["y"] == 50_000


def test_a_task_puts_the_places_of_a_word_into_one_row(spark, tmp_path):
    """Texts that are cut into words one by one; places, contexts and fold stay with their words."""
    rng = np.random.default_rng(5)
    names = [f"{'w' * 60}{i:06d}" for i in range(25_000)]
    texts = [" ".join(names[i] for i in rng.permutation(np.tile(np.arange(25_000), 6))) + " the lone%d" % k for k in range(3)]
    docs = spark.createDataFrame([(k, k == 1, t) for k, t in enumerate(texts)], "doc_id long, held_out boolean, text string").coalesce(1)
    assert min(map(len, texts)) > pitman_yor.BLOCK
    pitman_yor.encode(docs, ["the", pitman_yor.END], str(tmp_path / "tokens"))
    coded = pitman_yor.coded_tokens(spark, str(tmp_path / "tokens"))
    rows = {r["word"]: r for r in coded.filter("kind = 'word'").collect()}
    assert coded.filter("kind = 'word'").count() == len(rows) == 25_003
    assert np.bincount(np.frombuffer(rows[names[7]]["a"], np.int32) + 2).tolist() == [6, 0, 6, 0, 6]
    assert [(np.frombuffer(rows[f"lone{k}"]["a"], np.int32).tolist(), rows[f"lone{k}"]["b"]) for k in range(3)] == [([0], b"\1"), ([-2], b"\1"), ([2], b"\1")]
    assert sorted(r["place"] for r in coded.filter("kind = 'doc'").collect()) == [0, 1, 2]


def test_packs_hold_whole_words(monkeypatch):
    monkeypatch.setattr(pitman_yor, "WORD_ROWS", 3)
    words = ["a", "a", "b", "c", "c", "c", "d", "e", "f", "f", "g"]
    for cut in range(1, 12):
        batches = [pa.RecordBatch.from_arrays([pa.array(words[i:i + cut])], names=["word"]) for i in range(0, len(words), cut)]
        got = [(rows.column("word").to_pylist(), first.tolist()) for rows, first in pitman_yor.whole_words(iter(batches))]
        assert [w for w, _ in got] == [words[:6], words[6:10], words[10:]]
        assert got[1][1] == [True, True, True, False]


def test_words_behind_rare_words_have_a_context(spark, tmp_path, monkeypatch):
    """Pairs of rare words, far from the commonest ones: what follows a word depends on that word, by counts of all rows."""
    rng = np.random.default_rng(15)
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    pairs = lambda numbers: " ".join(f"a{i} b{i}" for i in numbers)
    texts = [" ".join(f"often{i}" for i in range(260)) * 1] * 60 + [pairs(rng.permutation(300)[:100]) for _ in range(60)]
    at = [i for i in range(len(texts), len(texts) + 60) if fold(i)][:2]
    texts += [""] * 60
    texts[at[0]], texts[at[1]] = pairs(range(40)), " ".join(f"a{i} b{39 - i}" for i in range(40))
    docs = documents(spark, texts)
    got = pitman_yor.score_documents(docs).toPandas().set_index("doc_id")
    assert got.held_out[at].all() and got.base_score[at[0]] == pytest.approx(got.base_score[at[1]])
    assert got.score[at[0]] > got.score[at[1]] + 20
    # Counts of followers next to plain ones, and the same when Spark adds them up.
    coded_docs = docs.selectExpr("doc_id", "text", "pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 7) = 2 AS held_out")
    common = [f"often{i}" for i in range(260)] + [pitman_yor.END]
    pitman_yor.encode(coded_docs, common, str(tmp_path / "tokens"))
    coded = pitman_yor.coded_tokens(spark, str(tmp_path / "tokens"))
    train, every = Counter(), Counter()
    for i, text in enumerate(texts):
        # Without words there is only an end, the first token; often255 and on are no contexts but stand near them.
        both = [(u, v) for u, v in zip(text.split(), text.split()[1:] + [pitman_yor.END]) if text.startswith("a")]
        every.update(both)
        train.update(both if not fold(i) else [])
    n, t = Counter(), Counter()
    for (u, _), c in train.items():
        n[u] += c
        t[u] += 1
    want = Counter()
    for (u, v), c in every.items():
        if n[u]:
            want[v, train[u, v], n[u], t[u]] += c
    twice = [sum(c == k for c in train.values()) for k in (1, 2)]
    for listed in (pitman_yor.LISTED, 0):
        monkeypatch.setattr(pitman_yor, "LISTED", listed)
        rows = pitman_yor.follower_counts(coded).collect()
        found = Counter()
        for r in rows:
            if r["word"] is not None:
                for f in np.frombuffer(r["followers"], pitman_yor.FOLLOWERS):
                    found[r["word"], int(f["c"]), int(f["n"]), int(f["t"])] += 1
        extra = {k: v for k, v in (found - want).items() if not k[0].startswith("often") and k[0] != pitman_yor.END}
        assert not extra and not want - found
        assert np.sum([r["sums"] for r in rows if r["sums"]], axis=0)[1] == twice[1]


def test_a_rare_word_counts_though_a_common_one_stands_near(spark, tmp_path):
    """``the`` is two words back, and the rare word right before decides; the probabilities of what follows it sum to one."""
    rng = np.random.default_rng(17)
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    triples = lambda numbers, shift=0: " ".join(f"the a{i} b{(i + shift) % 30}" for i in numbers)
    texts = ["the " * 3000 + " ".join(f"often{i} " * 200 for i in range(254))] + [triples(rng.permutation(30)) for _ in range(100)]
    # One half of the held-out texts have the pairs of the others, one half have new ones.
    held = [i for i in range(1, len(texts)) if fold(i)]
    for k, i in enumerate(held):
        texts[i] = triples(range(30), k % 2)
    assert not fold(0) and len(held) >= 4
    got = pitman_yor.score_documents(documents(spark, texts)).toPandas().set_index("doc_id")
    assert got.held_out[held].all() and got.base_score[held[0]] == pytest.approx(got.base_score[held[1]])
    assert got.score[held[0]] > got.score[held[1]] + 20
    # Contexts travel with the tokens, of common and of other words.
    docs = documents(spark, ["the u v w", "the u v", "u v"]).selectExpr("doc_id", "text", "false AS held_out")
    pitman_yor.encode(docs, ["the", "v", pitman_yor.END], str(tmp_path / "tokens"))
    found = Counter()
    for r in pitman_yor.follower_counts(pitman_yor.coded_tokens(spark, str(tmp_path / "tokens"))).filter("word IS NOT NULL").collect():
        for f in np.frombuffer(r["followers"], pitman_yor.FOLLOWERS):
            found[r["word"], int(f["c"]), int(f["n"]), int(f["t"]), int(f["context"])] += 1
    assert found == {("v", 3, 3, 1, 1): 2, ("v", 3, 3, 1, 0): 1, (pitman_yor.END, 1, 1, 1, 2): 1}


def test_gains_of_a_context_keep_the_sum_of_one():
    rng = np.random.default_rng(16)
    parent, c = rng.dirichlet(np.ones(30)), rng.integers(0, 4, 30)
    followers = np.zeros(30, pitman_yor.FOLLOWERS)
    followers["c"], followers["n"], followers["t"] = c, c.sum(), (c > 0).sum()
    assert (parent * 10 ** pitman_yor.gains(followers, parent, 0.7)).sum() == pytest.approx(1)


def test_a_pack_does_not_grow_with_its_tables():
    """Stored state is a number for each pair and word, whether few or many customers sit there."""
    sizes = []
    for customers in (1_000, 1_000_000):
        totals = pitman_yor.Totals(np.r_[customers, np.zeros(255, int)], np.r_[customers // 2, np.zeros(255, int)], 2.0, 0.9, 0.5, 1)
        pack = dict.fromkeys(pitman_yor.PACK) | {"names": b"a", "n_pairs": np.ones(1, np.int16).tobytes(), "contexts": bytes(1), "customers": np.array([customers]).tobytes()}
        for turn in range(3):
            pack, sums = pitman_yor.reseated(pack, totals, np.random.default_rng(turn), keep=False)
        assert 1 <= sums[0] <= customers
        sizes.append(sum(len(pack[c] or b"") for c in pitman_yor.PACK))
    assert sizes[0] == sizes[1] < 100


def test_a_word_takes_its_model_along():
    """However rows are cut into batches, every row finds the model of its word, or none."""
    rows = [("a", b"A"), ("a", None), ("a", None), ("b", None), ("c", b"C"), ("d", b"D"), ("d", None), ("d", None), ("e", None), ("e", None)]
    for cut in range(1, 11):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows[i:i + cut]), (pa.string(), pa.binary()))], names=["word", "d"])
                   for i in range(0, len(rows), cut)]
        got = [(word, model if at < 0 else batch.column("d")[at].as_py()) for batch, of in pitman_yor.with_models(iter(batches))
               for word, model, at in zip(batch.column("word").to_pylist(), batch.column("d").to_pylist(), of)]
        want = [("a", b"A")] * 3 + [("b", None), ("c", b"C")] + [("d", b"D")] * 3 + [("e", None)] * 2
        # A model that goes into the next batch comes again there.
        assert sorted(set(got), key=str) == sorted(set(want), key=str) and len(want) <= len(got) <= len(want) + 4


def test_batches_and_packs_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """Packs are large: a task must not get all of its packs in one batch."""
    docs = documents(spark, ["a b c"] * 30).selectExpr("doc_id", "text", "doc_id % 5 = 0 AS held_out")
    with pitman_yor.setting(spark, "spark.sql.maxConcurrentOutputFileWriters", "0"):
        pitman_yor.fit(docs, str(tmp_path / "tokens"))
        assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    large = spark.range(0, 40, 1, 1).selectExpr("CAST(repeat('x', 1000000) AS binary) AS pack").mapInArrow(sizes, "n long").toPandas().n
    assert large.sum() >= 40_000_000 and large.max() < 2 * pitman_yor.BATCH_BYTES
    monkeypatch.setattr(pitman_yor, "PACK_BYTES", 100)
    batches = [pa.RecordBatch.from_arrays([pa.array([w] * 2), pa.array(["x" * 40] * 2)], names=["word", "x"]) for w in "aabcc"]
    got = [rows.column("word").to_pylist() for rows, _ in pitman_yor.whole_words(iter(batches))]
    assert got == [["a"] * 4, ["b", "b", "c", "c", "c", "c"]] or got == [["a"] * 4, ["b"] * 2, ["c"] * 4]


def test_codes_are_renumbered_as_by_sorting():
    codes = np.random.default_rng(3).integers(0, 500, 300)
    used, at = pitman_yor.renumbered(codes, 500)
    want, place = np.unique(codes, return_inverse=True)
    assert used.tolist() == want.tolist() and at.tolist() == place.tolist()
