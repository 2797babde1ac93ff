"""Exact and near duplicates, mixing, token files and the pipeline against plain versions."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from basketcast.llm import exact_dedup, mixing, near_dedup, token_files, toxicity
from basketcast.llm.queries import ORACLES, QUERIES, tokenizer_path
from check import connect, normal

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)


def brute_words(text):
    return [w for w in (re.sub(r"[\W_]+", "", x) for x in (text or "").lower().split()) if w]


def brute_classes(rows, similarity=near_dedup.SIMILARITY):
    """Smallest id of each connected set, by comparing all texts that share a shingle."""
    grams, parent, inverted = [], list(range(len(rows))), defaultdict(list)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, text) in enumerate(rows):
        w = brute_words(text)
        grams.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))})
        for j in set().union(*[inverted[g] for g in grams[i]]):
            both = len(grams[i] & grams[j])
            if both / (len(grams[i]) + len(grams[j]) - both) >= similarity:
                parent[root(i)] = root(j)
        for g in grams[i]:
            inverted[g].append(i)
    low = defaultdict(lambda: 1 << 60)
    for i, (doc, _) in enumerate(rows):
        low[root(i)] = min(low[root(i)], doc)
    return {doc: low[root(i)] for i, (doc, _) in enumerate(rows)}


# --- Exact ----------------------------------------------------------------------

def test_fingerprints_combine_and_differ():
    rng = np.random.default_rng(1)
    for size in (0, 1, 255, 256, 257, 5_000, 70_000):
        text = rng.bytes(size)
        whole = exact_dedup.fingerprints([text])[0]
        want = [0, 0]
        for byte in text:
            want = [(v * int(b) + byte) % int(p) for v, b, p in zip(want, exact_dedup.BASES, exact_dedup.PRIMES)]
        assert whole.tolist() == want
        for cut in {0, size // 3, size}:
            left, right = exact_dedup.fingerprints([text[:cut], text[cut:]])
            assert exact_dedup.combine(left, right, size - cut).tolist() == whole.tolist()
    assert exact_dedup.fingerprints([b"ab", b"ba", b"\0ab"])[:, 0].tolist()[0] != exact_dedup.fingerprints([b"ba"])[0, 0]


def test_exact_query_matches_sql(spark):
    got = QUERIES["op9_exact_dedup"](spark, FOLDER).toPandas()
    assert normal(got) == normal(connect(FOLDER).execute(ORACLES["op9_exact_dedup"]).df())


def test_exact_edge_cases(spark):
    long = "word " * 60_000
    rows = [(5, "a  b", "s"), (3, "a\t\nb", "s"), (4, " a b", None), (9, None, "s"), (8, "", "s"), (7, "a b", "s"), (20, long + "x", "s"), (21, long + "x", "s"),
            (22, long + "y", "s"), (3, "a b", "s"), (None, "a b", "s"), (30, "  ", "s"), (31, "\n", "s"), (None, "only", "s"), (40, "\0a b", "s")]
    docs = documents(spark, rows).withColumn("row", F.lit(1)).withColumn("f1", F.lit("x"))
    got = exact_dedup.exact_groups(docs).toPandas()
    assert len(got) == len(rows) and sorted(got.columns) == ["doc_id", "group_size", "keep_id", "kept", "text_sha256"]
    by = got.groupby("text_sha256")
    assert (by.kept.sum() == 1).all()
    ids = got.set_index("doc_id")
    assert (ids.loc[5].keep_id, ids.loc[5].group_size, ids.loc[5].kept) == (3, 4, False)
    assert sorted(ids.loc[3].kept) == [False, True]  # of two rows with the same id and text one stays
    assert (ids.loc[9].keep_id, ids.loc[8].keep_id, ids.loc[30].keep_id, ids.loc[31].keep_id) == (8, 8, 30, 30)
    assert (ids.loc[20].group_size, ids.loc[22].group_size, ids.loc[7].group_size, ids.loc[40].group_size) == (2, 1, 1, 1)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


# --- Near -------------------------------------------------------------------------

def brute_probability_jaccard(x, y):
    union = set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in union) for i in x if i in y)


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(1, 2**63, 300).astype(np.uint64))
    b = np.unique(np.concatenate((a[:240], rng.integers(1, 2**63, 50).astype(np.uint64))))
    x, y = 1 + np.log(rng.integers(1, 6, len(a))), 1 + np.log(rng.integers(1, 6, len(b)))
    want = brute_probability_jaccard(dict(zip(a.tolist(), x)), dict(zip(b.tolist(), y)))
    plain, probability = near_dedup.similarity(a, x, b, y)
    assert probability == pytest.approx(want) and plain == pytest.approx(len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist())))
    of = np.repeat([0, 1], [len(a), len(b)])
    signature = near_dedup.prob_minhash(of, np.concatenate((a, b)), np.concatenate((x, y)), 2, 20_000)
    assert (signature[0] == signature[1]).mean() == pytest.approx(want, abs=0.015)
    # A text signs alike whatever stands beside it, and one shingle fills all registers.
    alone = near_dedup.prob_minhash(np.zeros(len(a), int), a, x, 1)
    assert (near_dedup.prob_minhash(of, np.concatenate((a, b)), np.concatenate((x, y)), 2)[0] == alone[0]).all()
    assert (near_dedup.prob_minhash(np.zeros(1, int), a[:1], np.ones(1), 1) == a[0]).all()


def test_near_query_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    got = QUERIES["op4_prob_minhash"](spark, "/root/testdata/sf0.01").toPandas()
    assert dict(zip(got.doc_id, got.class_id)) == brute_classes(list(zip(docs.doc_id, docs.text)))


def edited(rng, words, edits):
    words = list(words)
    for at in rng.choice(len(words), edits, replace=False):
        words[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def test_large_groups_chains_and_edges(spark):
    rng = np.random.default_rng(5)
    base, other, passage = ([f"{p}{i}" for i in range(300)] for p in "bop")
    rows = [(100 + i, edited(rng, base, 4)) for i in range(60)]                              # one large near group
    rows += [(300 + i, edited(rng, base, 4)) for i in range(3)] + [(400 + i, " ".join(other)) for i in range(25)]
    chain = other
    for i in range(12):                                                                      # a chain whose ends differ
        chain = edited(rng, chain, 3).split()
        rows.append((500 + i, " ".join(chain)))
    rows += [(600 + i, " ".join(passage[:150] + [f"u{i}x{k}" for k in range(150)])) for i in range(40)]  # a shared passage
    rows += [(1, None), (2, ""), (3, "!!! ..."), (4, "one two"), (5, "One, two!"), (6, "one three"), (7, "a b c d e"), (8, "a b c d e"), (7, "a b c d e"),
             (9, "same same same same same same same"), (10, "same same same same same same")]
    frame = documents(spark, [(i, t, None) for i, t in rows]).withColumn("bands", F.lit(0)).withColumn("label", F.lit("x"))
    got = near_dedup.near_classes(frame).collect()
    want = brute_classes([(i, t) for i, t in rows])
    assert len(got) == len(rows) and {r["doc_id"]: r["class_id"] for r in got} == want
    kept = near_dedup.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert near_dedup.near_classes(frame.limit(0)).count() == 0 and near_dedup.keep_one(frame.limit(0)).count() == 0


# --- Mixing -------------------------------------------------------------------------

def test_mixing_query_matches_sql(spark):
    got = QUERIES["op5_mixing"](spark, FOLDER).toPandas()
    assert normal(got) == normal(connect(FOLDER).execute(ORACLES["op5_mixing"]).df())


def mixing_rows():
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 60)), "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    return rows + [(1000, None, "null text"), (1001, "x y", None), (1001, "x y", None), (1002, "", "hot"), (None, "a b c", "s1"), (1003, "big " * 5_000, "s2")]


def test_targets_are_shared_again_up_to_the_limit(spark):
    thin = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 5), ("d", 0)], "source string, size long").withColumn("doc_id", F.lit(1))
    got = {r["source"]: r["target"] for r in mixing.targets(thin).collect()}
    have, weight, left = {"a": 10, "b": 1000, "c": 1, "d": 0, None: 5}, {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, 1016.0
    want, open_ = {}, set(have)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 3 * have[s]]
        if not over:
            break
        for s in over:
            want[s], left = 3.0 * have[s], left - 3 * have[s]
            open_.remove(s)
    want |= {s: weight[s] * level for s in open_}
    assert got == pytest.approx(want)


def test_slices_and_intervals_do_not_change_the_mix(spark, monkeypatch):
    docs = documents(spark, mixing_rows()).withColumn("place", F.lit("clash")).withColumn("size", F.lit(1)).cache()
    whole = sorted((tuple(r) for r in mixing.plan_mix(docs).select("doc_id", "size", "target", "upto", "passes_taken").collect()), key=repr)
    monkeypatch.setattr(mixing, "SLICE_ROWS", 11)
    monkeypatch.setattr(mixing, "LAST_ROWS", 3)
    monkeypatch.setattr(mixing, "INTERVALS", 5)
    planned = mixing.plan_mix(docs).cache()
    assert sorted((tuple(r) for r in planned.select("doc_id", "size", "target", "upto", "passes_taken").collect()), key=repr) == whole
    frame = planned.toPandas()
    frame["taken"] = frame["size"] * frame.passes_taken
    budget = frame["size"].sum()
    assert frame.taken.sum() <= budget and (frame.passes_taken <= 3).all() and len(frame) == len(mixing_rows())
    for _, group in frame.groupby("source", dropna=False):
        assert abs(group.taken.sum() - group.target.iloc[0]) <= max(0.1 * group.target.iloc[0], group["size"].max())
    taken = mixing.mixture(planned).toPandas()
    assert taken["size"].sum() == frame.taken.sum() and taken.finish.is_monotonic_increasing
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    assert sorted(map(repr, rows.toPandas().doc_id)) == sorted(map(repr, frame.loc[frame.index.repeat(frame.passes_taken)].doc_id))
    assert mixing.plan_mix(docs.limit(0)).count() == 0 and mixing.mixed_rows(docs.limit(0)).count() == 0


def test_mixing_stays_in_the_engine(spark):
    plans = [mixing.plan_mix(documents(spark, mixing_rows())), QUERIES["op2_chat_examples"](spark, FOLDER)]
    for df in plans:
        assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", df._jdf.queryExecution().executedPlan().toString())


# --- Tokens ---------------------------------------------------------------------------

def brute_tokens(rows):
    """``doc_id, start, n_tokens, ids_crc32`` in order of id, straight from the tokenizer."""
    tokenizer, start, out = Tokenizer.from_file(tokenizer_path()), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_query_matches_the_tokenizer(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()
    got = QUERIES["op8_token_files"](spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_tokens(list(zip(docs.doc_id, docs.text)))


def test_token_files_of_awkward_texts(spark, tmp_path):
    texts = [None, "", "  ", "It's <|endoftext|> here", "<|ENDOFTEXT|> <|startoftext|>x", "café café İstanbul İx ẞ", "a b　c\u0085d", "don't. we'll!! o'clock's",
             "abc...def... x…. …..", "\U0001F600\U0001F600 1234 5٣", "ΣΣ Σ", "word " * 200_000, "a̸ ≠ ≮", "x-y_z.w,", "한국어 中文", "́start", "a'b 'tis 's't"]
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)] + [(3, "repeated id"), (3, "repeated id"), (-5, "first")]
    docs = documents(spark, [(i, t, None) for i, t in rows]).withColumn("part", F.lit("clash"))
    folder = str(tmp_path / "tokens")
    token_files.write_tokens(docs, folder, tokenizer_path())
    tokens = token_files.read_tokens(spark, folder)
    got = token_files.digests(tokens).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    want = brute_tokens(rows)
    assert sorted(r[0::2] for r in map(tuple, got)) == sorted(r[0::2] for r in want)
    assert sorted(tuple(r) for r in got if r["doc_id"] != 3) == sorted(r for r in want if r[0] != 3)
    counts = token_files.read_counts(spark, folder)
    assert sorted(tuple(r) for r in counts.collect() if r["doc_id"] != 3) == sorted(r[:3] for r in want if r[0] != 3)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in re.search(r"ReadSchema: (.*)", plan)[1]  # the lists are not read for the counters
    assert token_files.digests(token_files.read_tokens(spark, written_empty(spark, docs, tmp_path))).count() == 0


def written_empty(spark, docs, tmp_path):
    token_files.write_tokens(docs.limit(0), str(tmp_path / "none"), tokenizer_path())
    return str(tmp_path / "none")


def test_file_layout(spark, tmp_path):
    import pyarrow.parquet as pq

    folder = tmp_path / "layout"
    token_files.write_tokens(spark.read.parquet(f"{FOLDER}/documents.parquet"), str(folder), tokenizer_path())
    file = pq.ParquetFile(next(f for f in sorted(folder.glob("*.parquet")) if pq.ParquetFile(f).metadata.num_rows))
    columns = {file.metadata.row_group(0).column(i).path_in_schema: file.metadata.row_group(0).column(i) for i in range(file.metadata.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    assert any("DICTIONARY" in e for e in next(c for n, c in columns.items() if n.startswith("ids")).encodings)


# --- Pipeline ------------------------------------------------------------------------------

def test_pipeline_matches_a_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scores = QUERIES["op3_toxicity"](spark, FOLDER).filter(F.col("score") < toxicity.THRESHOLD).select("doc_id").toPandas()
    rows = docs.toPandas().set_index("doc_id").loc[sorted(scores.doc_id)]
    classes = brute_classes(list(zip(rows.index, rows.text)))
    rows = rows.loc[sorted(set(classes.values()))]
    bench = [brute_words(t) for t in spark.read.parquet(f"{FOLDER}/benchmark.parquet").toPandas().text]
    # The planted passages are whole or share a phrase; whole ones are told by their words in a row.
    leaks = [doc for doc, text in zip(rows.index, rows.text) if any(" ".join(b) in " ".join(brute_words(text)) for b in bench)]
    rows = rows.drop(leaks)
    mixed = plain_mix(rows.reset_index())
    want = brute_tokens([(doc, text) for doc, text, n in mixed for _ in range(n)])
    got = corpus_pipeline.run(spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert leaks and [tuple(r) for r in got] == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix", "tokens"]


def plain_mix(rows):
    """Weighted fair queueing with one sorted list."""
    import hashlib

    rows = rows.assign(size=[len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in rows.text])
    sources = sorted(rows.source.unique())
    have = rows.groupby("source")["size"].sum().to_dict()
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    left, open_, target = float(rows["size"].sum()), set(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 3 * have[s]]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s], left = 3.0 * have[s], left - 3 * have[s]
            open_.remove(s)
    items = []
    for place, s in enumerate(sources):
        upto = 0
        own = rows[rows.source == s]
        for doc, size in sorted(zip(own.doc_id, own["size"]), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            upto += size
            items += [((p * have[s] + upto) / target[s], place, doc, size) for p in range(3)] if size else []
    taken, total = defaultdict(int), 0
    for _, _, doc, size in sorted(items):
        total += size
        if total > rows["size"].sum():
            break
        taken[doc] += 1
    return [(doc, text, taken[doc]) for doc, text in zip(rows.doc_id, rows.text)]


def test_stages_keep_columns_and_bear_nulls(spark, tmp_path):
    rows = [(1, None, "en", None, None, 1), (None, "you are an idiot and a moron", None, "s", 3, 2), (2, "plain words here for you all", "en", "s", None, 3),
            (2, "plain words here for you all", "en", "s", None, 3), (3, "", None, "t", 0, 4)]
    docs = spark.createDataFrame(rows, DOCS + ", kept_id long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        empty = stage(spark, docs.limit(0), FOLDER)
        assert empty.count() == 0
        if name != "tokens":
            assert out.columns == docs.columns and 0 < out.count() <= 3 * len(rows)
    toxic = corpus_pipeline.toxicity_stage(spark, docs, FOLDER).toPandas()
    assert not toxic.text.fillna("").str.contains("idiot").any() and len(toxic) == 4
    assert len(corpus_pipeline.near_dedup_stage(spark, docs, FOLDER).toPandas()) == 3


def test_blocks_find_every_link_between_classes(spark, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(12)
    base = [f"b{i}" for i in range(200)]
    texts = [edited(rng, base, int(rng.integers(2, 14))) for _ in range(60)] + [edited(rng, [f"c{i}" for i in range(80)], 2) for _ in range(5)]
    values, rows = near_dedup.word_numbers(pa.array(texts))
    of, value, count = near_dedup.shingles(values, rows, len(texts))
    sets = [set(value[of == i].tolist()) for i in range(len(texts))]
    keys = [b"%03d" % i for i in range(len(texts))]
    table = spark.createDataFrame([(bytearray(k), bytearray(value[of == i].tobytes())) for i, k in enumerate(keys)], "text_key binary, hashes binary")
    members = spark.createDataFrame([(bytearray(k), bytearray(b"base" if i < 60 else b"other"), bytearray(k if i % 3 else b"class")) for i, k in enumerate(keys)],
                                    "text_key binary, family binary, label binary")
    want = {(keys[i], keys[j]) for i in range(len(texts)) for j in range(i + 1, len(texts))
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= near_dedup.SIMILARITY and (i % 3 or j % 3) and (i < 60) == (j < 60)}
    for block in (64, 7):
        monkeypatch.setattr(near_dedup, "FAMILY_BLOCK", block)
        assert {(bytes(r["a"]), bytes(r["b"])) for r in near_dedup.linked_blocks(members, table).collect()} == want
    assert want


def test_copies_that_repeat_a_passage_are_found(spark):
    rng = np.random.default_rng(17)
    rows = []
    for i in range(60):
        base = [f"p{i}w{k}" for k in range(204)]
        other = base + [f"n{rng.integers(1 << 40)}" for _ in range(45)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:104] * 50 + other[104:]))]
    want = brute_classes(rows)
    assert sum(want[2 * i + 1] == 2 * i for i in range(60)) == 60
    got = near_dedup.near_classes(documents(spark, [(i, t, None) for i, t in rows])).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_links_travel_without_occurrences(spark):
    """Similarity goes by distinct shingles: a table of texts and the compared pairs hold nothing else, and repeats change no link."""
    base = " ".join(f"w{i}" for i in range(60))
    texts = [base + " " + " ".join(["again and again we go"] * 4), base + " again and again we go again and again we", " ".join(f"v{i}" for i in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = near_dedup.signatures(docs).select("doc_id", "text_key")
    table = near_dedup.shingle_table(docs, keys)
    assert table.columns == ["text_key", "hashes"]
    key = {r["doc_id"]: bytes(r["text_key"]) for r in keys.collect()}
    pairs = spark.createDataFrame([(key[0], key[1]), (key[0], key[2])], "a binary, b binary")
    assert [(bytes(r["a"]), bytes(r["b"])) for r in near_dedup.verified(pairs, table).collect()] == [(key[0], key[1])]


def test_texts_that_stay_are_not_moved(spark):
    """Rows go by a list of ids without a shuffle of all texts, and exactly: null ids, negative ones, repeated rows."""
    ids = [None, -5, *range(3_000), 7, 2**62]
    docs = spark.createDataFrame([(i, f"text {n} " + "x" * 50) for n, i in enumerate(ids)], "doc_id long, text string").repartition(4)
    for out in ([], [None], [-5, 7, 2**62, 99_999], list(range(0, 3_000, 3)) + [None]):
        listed = spark.createDataFrame([(i,) for i in out], "kept_id long")
        got = near_dedup.without(docs, listed)
        assert sorted(r["text"] for r in got.collect()) == sorted(f"text {n} " + "x" * 50 for n, i in enumerate(ids) if i not in out)
    listed = spark.createDataFrame([(i,) for i in range(10)], "kept_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = near_dedup.without(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), listed)
        plan = got._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The first branch of the union are the texts that stay: their only join is a broadcast one.
    stays, others = plan.split("Union")[1].split("SortMergeJoin")
    assert "BroadcastHashJoin" in stays and "BroadcastHashJoin" in others
