"""Token counts, alignment of tokenisations and conversation repair against plain versions."""

import bisect
import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketcast.llm import alignment, token_counts, turn_repair
from basketcast.llm.common import new_folder
from basketcast.llm.queries import QUERIES, tokenizer_path
from basketcast.llm.vocabularies import vocabulary

FOLDER = "/root/testdata/sf0.001"
BYTES, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
HOSTILE = [
    "", " ", "  a", "\n x\n\n y  ", "a  b", "<|endoftext|> x<|endoftext|>", "x ▁ y", "▁", "don't 've\t\tx  ", "日本 語\n",
    "😀 😀x", "\x00 a\x1c b", "a\r\n b", "};\r\n\r\n  }", "<s> x </s>", "<0x41>", "a  ", "\n\n", "\ta\tb", "é é", "a  b ", "ab " * 5000,
    "x" * 3000, " " * 500, "a\v\fb", "᠎ a", "1 234,5 %", "ﬁ ﬂ Å", "İ ı",
]


def texts_of(folder):
    return pd.read_parquet(f"{folder}/documents.parquet")


# --- Token counts -----------------------------------------------------------------

@pytest.mark.parametrize("special_as_text", [False, True])
def test_pieces_give_the_library_ids(special_as_text):
    texts = HOSTILE + texts_of(FOLDER).text.fillna("").tolist()
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = special_as_text
    held = vocabulary(BYTES, special_as_text)
    assert held.apart
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in held.ids(texts)] == want
    assert held.counts(texts) == list(map(len, want))
    pieces = vocabulary(PIECES)
    assert pieces.apart
    assert [i.tolist() for i in pieces.ids(texts)] == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(texts)


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr("basketcast.llm.vocabularies.REMEMBERED", 10)
    held = vocabulary(BYTES, True)
    held.memory.forget()
    want = Tokenizer.from_file(BYTES).encode_batch(["a b c d"] * 3, add_special_tokens=False)
    for words in ("a b c d", "e f g h i j k l m n o p", "a b c d"):
        assert len(held.ids([words])[0]) == len(words.split())
    assert held.ids(["a b c d"])[0].tolist() == want[0].ids


def test_counts_match_the_library(spark):
    docs = texts_of(FOLDER)
    got = QUERIES["op12_token_counts"](spark, FOLDER).toPandas().set_index("doc_id").sort_index()
    library = Tokenizer.from_file(BYTES)
    docs["text"] = docs.text.fillna("")
    docs = docs.set_index("doc_id").sort_index()
    n = [len(e.ids) for e in library.encode_batch(docs.text.tolist(), add_special_tokens=False)]
    assert got.n_tokens.tolist() == n
    assert got.n_bytes.tolist() == [len(t.encode()) for t in docs.text]
    assert got.over_limit.tolist() == [x > 1024 for x in n]


def rows_of(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def cached(spark, folder):
    return token_counts.open_cache(spark, folder)


def test_cache_encodes_only_what_is_new(spark):
    folder = new_folder(spark, "counts")
    first = rows_of(spark, [(1, "a b"), (2, "a b"), (None, None), (1, "c d e"), (3, "")])
    got = token_counts.count_tokens(first, folder, BYTES, limit=2).collect()
    assert Counter(tuple(r) for r in got) == Counter([(1, 3, 2, False), (2, 3, 2, False), (None, 0, 0, False), (1, 5, 3, True), (3, 0, 0, False)])
    assert cached(spark, folder).count() == 3
    # A planted count shows that known texts are read from the cache and not encoded again.
    version = token_counts.version_digest(BYTES)
    planted = [(hashlib.sha256(b"known").digest(), 77, version), (hashlib.sha256(b"other").digest(), 5, "another version")]
    rows_of(spark, planted, token_counts.CACHE_SCHEMA).write.partitionBy("tokenizer").mode("append").parquet(folder)
    second = rows_of(spark, [(1, "a b"), (4, "known"), (5, "other"), (6, "new words here")])
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(second, folder, BYTES).collect()}
    assert got == {1: 2, 4: 77, 5: 1, 6: 3}
    assert cached(spark, folder).count() == 3 + 2 + 2
    # The same with misses that are not broadcast, another tokenizer, and nothing at all.
    assert token_counts.count_tokens(second.limit(0), folder, BYTES).count() == 0
    pieces = token_counts.count_tokens(second, folder, PIECES).orderBy("doc_id").collect()
    assert [r.n_tokens for r in pieces] == list(map(len, sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(["a b", "known", "other", "new words here"])))


def test_many_misses_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "FEW_MISSES", 0)
    texts = HOSTILE * 3
    docs = rows_of(spark, list(enumerate(texts))).selectExpr("doc_id", "text", "'x' AS content", "1 AS n_tokens", "2 AS tokenizer")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, new_folder(spark, "counts"), BYTES).collect()}
    want = Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)
    assert got == {i: len(e.ids) for i, e in enumerate(want)}


# --- Alignment --------------------------------------------------------------------

def brute_alignment(rows):
    """All columns by plain comparison of byte ranges."""
    a_lib, b_lib = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_lib.encode_special_tokens = True
    a_bytes, b_bytes = vocabulary(BYTES, True).token_bytes(), vocabulary(PIECES).token_bytes()
    found, held, out = [], Counter(), []
    for doc, text in rows:
        text = text or ""
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        whole = (" " + text).encode()
        if b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            a, b = [], []
        a_ends = list(itertools.accumulate(len(a_bytes[i]) for i in a))
        b_ends = list(itertools.accumulate(len(b_bytes[i]) for i in b))
        common, links = sorted(set(a_ends) & set(b_ends)), []
        parts = [([], []) for _ in common]
        for side, (ids, ends) in enumerate(((a, a_ends), (b, b_ends))):
            for i, e in zip(ids, ends):
                parts[bisect.bisect_left(common, e)][side].append(str(i))
        groups = [",".join(left) + "|" + ",".join(right) for left, right in parts]
        j = 0
        for i, (x, e) in enumerate(zip(a, a_ends)):
            start = e - len(a_bytes[x])
            while j < len(b) and b_ends[j] <= start:
                j += 1
            k = j
            while k < len(b) and b_ends[k] - len(b_bytes[b[k]]) < e:
                links.append((x, b[k]))
                k += 1
        found.append((doc, len(a), len(b), groups, links))
        held.update(set(links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    for doc, n_a, n_b, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        out.append((doc, n_a, n_b, len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), digest))
    return out


@pytest.mark.parametrize("common", [alignment.COMMON_PAIRS, 300, 0])
def test_alignment_matches_byte_ranges(spark, common):
    docs = texts_of(FOLDER)
    rows = list(zip(docs.doc_id.tolist(), docs.text.where(docs.text.notna(), None).tolist())) + [(-1, t) for t in HOSTILE] + [(None, None), (-1, "a b")]
    frame = rows_of(spark, rows).repartition(4).selectExpr("doc_id", "text", "1 AS row", "2 AS pairs", "'x' AS n_a")
    got = [tuple(r) for r in alignment.link_counts(frame, BYTES, PIECES, common).collect()]
    assert Counter(got) == Counter(brute_alignment(rows))


def test_query_of_alignment(spark):
    docs = texts_of(FOLDER)
    got = [tuple(r) for r in QUERIES["op11_alignment"](spark, FOLDER).collect()]
    assert Counter(got) == Counter(brute_alignment(list(zip(docs.doc_id.tolist(), docs.text.tolist()))))


def test_alignment_of_an_empty_table(spark):
    assert alignment.link_counts(rows_of(spark, []), BYTES, PIECES).count() == 0


def test_stretches_cover_both_lists():
    rng = random.Random(5)
    for _ in range(3000):
        size = rng.randint(1, 60)
        every = rng.choice([0.3, 0.8, 0.98])
        a, b = ([e for e in range(1, size) if rng.random() < every] + [size] for _ in range(2))
        i = j = 0
        seen = []
        for i1, j1, single in zip(*alignment.stretches(a, b)):
            assert a[i1 - 1] == b[j1 - 1]
            assert a[i:i1] == b[j:j1] if single else set(a[i:i1 - 1]).isdisjoint(b[j:j1 - 1])
            seen += a[i:i1] if single else [a[i1 - 1]]
            i, j = i1, j1
        assert (i, j) == (len(a), len(b)) and seen == sorted(set(a) & set(b))


# --- Conversation repair ----------------------------------------------------------

ROLES = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
STAY = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def brute_repair(turns):
    """Least (cost, audit) and repaired lines from the end; turns are (role, text, must go, truncated)."""
    best = {s: None for s in range(4)}
    for k in range(len(turns), -1, -1):
        new = {}
        for s in range(4):
            options = [(0, "", ())] if k == len(turns) and s in (0, 3) else []
            if k < len(turns):
                role, text, go, late = turns[k]
                c, a, lines = best[s]
                options.append((3 + c, "D" + a, lines))
                if not go:
                    if (s, role[:1]) in STAY:
                        c, a, lines = best[STAY[s, role[:1]]]
                        options.append((late + c, "K" + a, (f"{role}:{text}",) + lines))
                    other, t = ROLES[s]
                    c, a, lines = best[t]
                    options.append((2 + late + c, "R" + a, (f"{other}:{text}",) + lines))
            new[s] = options
        for _ in range(3):  # insertions lead from state to state without a turn
            least = {s: min(new[s]) if new[s] else None for s in range(4)}
            for s in range(4):
                other, t = ROLES[s]
                if least[t]:
                    c, a, lines = least[t]
                    new[s].append((2 + c, "I" + a, (f"{other}:",) + lines))
        best = {s: min(new[s]) for s in range(4)}
    return best[0]


def brute_conversations(rows):
    """The whole query from plain rows (conv_id, turn, role, text)."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        elif fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif fault == 4:
            role = "user"
        if fault:
            held[conv] += [(turn, role, text)] * (2 if fault == 3 else 1)
    out = []
    for conv, turns in held.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).digest()))
        seen, counts, steps = set(), Counter(), []
        for _, role, text in turns:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            steps.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = brute_repair(steps)
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def test_solver_finds_the_first_of_the_cheapest():
    words = list(itertools.chain.from_iterable(itertools.product(turn_repair.KINDS, repeat=n) for n in range(4)))
    rng = random.Random(3)
    words += [tuple(rng.choices(turn_repair.KINDS, k=rng.randint(4, 60))) for _ in range(1500)]
    full = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for word in words:
        turns = [(full.get(k.lower(), "user"), "t", k == "x", int(k.isupper())) for k in word]
        cost, audit, _ = brute_repair(turns)
        assert turn_repair.solve("".join(word)) == (cost, audit), word


def conversation_rows(seed, many=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(many):
        for turn in range(rng.choice([0, 1, 2, 3, 6, 9, 40])):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, "", "Userx"])
            text = rng.choice(["Hi.", "Hi.", "so then", " ", None, "", "x? ", "yes!\n", " ", f"t{turn}."])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, None, turn * 3]), role, text))
    return rows


@pytest.mark.parametrize("size", [1, 2, 7, 512])
def test_repair_matches_plain_version(spark, size):
    rows = conversation_rows(size) + [(500, 3, "user", "again and again")] * 23 + [(501, t % 2, "user", "Ok.") for t in range(40)]
    frame = rows_of(spark, rows, "conv_id long, turn long, role string, text string").repartition(5)
    frame = frame.selectExpr("*", "1 AS block", "2 AS kind", "3 AS n")
    got = [tuple(r) for r in turn_repair.repair(turn_repair.damaged(frame), size).collect()]
    assert sorted(got, key=str) == sorted(brute_conversations(rows), key=str)


def test_query_of_repair(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in QUERIES["op13_turn_repair"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(brute_conversations(rows))


def test_one_long_conversation_is_many_blocks(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Hi.", f"t{t}.", "cut"])) for t in range(5000)]
    frame = rows_of(spark, rows, "conv_id long, turn long, role string, text string")
    turns = turn_repair.damaged(frame)
    assert turn_repair.blocks_of(turn_repair.turn_facts(turns), 64).count() > 60
    got = [tuple(r) for r in turn_repair.repair(turns, 64).collect()]
    assert got == brute_conversations(rows)


def test_repair_of_an_empty_table(spark):
    frame = rows_of(spark, [], "conv_id long, turn long, role string, text string")
    assert turn_repair.repair(turn_repair.damaged(frame)).count() == 0
