"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns words into tags (insult, threat, target, negation, reported speech, clause
end, other). Small transducers read the tags: one keeps the scope of a negation, one that of reported
speech, one the distance of a target. They are composed, state by state as it is met, into one
machine that emits an event for every insult or threat: plain, aimed at someone, negated or reported.
The lexical weight goes to the event, so a matched clause counts and not a word alone: a negated or
quoted insult weighs as its event does. A logistic function with one weight per event gives the score.

The lexicon has common English words, and is extended from labelled rows by words and stems that
belong to toxic texts beyond chance, in varied surroundings (a copied passage shows the same
neighbours each time). Event weights start from prior values and are fitted to the same rows.

Defined cases: a null text is empty; a text without a match scores the base rate; without labels the
prior lexicon and weights are used; repeated rows are scored one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketcast.llm.common import fold, gathered, small_batches, stored, strings, words
from basketcast.llm.labelled import labelled_sample

SAMPLE_ROWS = 20_000      # labelled rows that the model is fitted to, at most
CANDIDATES = 5_000        # learned patterns that are looked at, at most
THRESHOLD = 0.7
MODULUS, HELD_OUT = 3, 1
STEMS = range(4, 9)       # lengths of learned stems

OTHER, STOP, INSULT, THREAT, TARGET, NEGATION, REPORT = range(7)
WORDS = {
    INSULT: ("idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown imbecile fool "
             "filth vermin scumbag creep coward liar jerk bastard bitch asshole dumbass retard retarded degenerate parasite swine pig"),
    THREAT: "kill murder hurt destroy beat stab shoot strangle burn crush smash hang rape attack",
    TARGET: "you your youre u he she they them him her his their these those this that we people everyone",
    NEGATION: "not no never neither nor without isnt arent wasnt dont doesnt nobody hardly nicht kein keine nie ne pas jamais nunca jamas",
    REPORT: "said says say called calls quoted quote wrote claimed accused alleged reported according asked sagte dijo disait",
}
BEFORE, AFTER = 10, 4     # words around a match that the machine reads

# Events of the composed machine; their prior weights, then that of the constant.
EVENTS = ("plain", "aimed", "negated", "reported", "threat")
PRIOR = np.array([3.0, 3.5, 1.0, 1.5, 3.0, -3.5])
PRIOR_SPREAD = 4.0


@dataclass(frozen=True)
class Grammar:
    """Words and stems with tag and weight, and the weights of the events."""

    exact: dict[str, tuple[int, float]]
    stems: dict[str, tuple[int, float]] = field(default_factory=dict)
    weights: tuple[float, ...] = tuple(PRIOR)


def prior_grammar() -> Grammar:
    return Grammar({w: (tag, 1.0) for tag, names in WORDS.items() for w in names.split()})


def negation(state: int, tag: int) -> int:
    """Words left in the scope of a negation."""
    return 3 if tag == NEGATION else 0 if tag == STOP else max(0, state - 1)


def reported(state: int, tag: int) -> int:
    """Words left in the scope of reported speech."""
    return 8 if tag == REPORT else 0 if tag == STOP else max(0, state - 1)


def target(state: int, tag: int) -> int:
    """Words within which a target that was read counts."""
    return 4 if tag == TARGET else 0 if tag == STOP else max(0, state - 1)


PARTS = (negation, reported, target)


class Machine:
    """Lazy composition: product states and their moves are built when first met."""

    def __init__(self, parts=PARTS):
        self.parts = parts
        self.states: dict[tuple, int] = {(0,) * len(parts): 0}
        self.tuples: list[tuple] = [(0,) * len(parts)]
        self.moves: dict[tuple[int, int], tuple[int, int | None]] = {}

    def move(self, state: int, tag: int) -> tuple[int, int | None]:
        key = (state, tag)
        if key not in self.moves:
            before = self.tuples[state]
            after = tuple(part(s, tag) for part, s in zip(self.parts, before))
            if after not in self.states:
                self.states[after] = len(self.tuples)
                self.tuples.append(after)
            self.moves[key] = (self.states[after], self.event(before, tag))
        return self.moves[key]

    @staticmethod
    def event(before: tuple, tag: int) -> int | None:
        if tag not in (INSULT, THREAT):
            return None
        negated, quoted, aimed = before
        if negated:
            return EVENTS.index("negated")
        if quoted:
            return EVENTS.index("reported")
        if tag == THREAT:
            return EVENTS.index("threat")
        return EVENTS.index("aimed" if aimed else "plain")

    def read(self, tags: list[int], weights: list[float]) -> list[float]:
        """Weight of each event over one stretch of tags. A threat needs a target beside it."""
        out, state = [0.0] * len(EVENTS), 0
        for at, (tag, weight) in enumerate(zip(tags, weights)):
            state, event = self.move(state, tag)
            if event is None:
                continue
            near = tags[max(0, at - 4):at + 1 + AFTER]
            if tag == THREAT and TARGET not in near:
                continue
            if event == EVENTS.index("plain") and TARGET in tags[at + 1:at + 3]:
                event = EVENTS.index("aimed")
            out[event] += weight
        return out


def clean_names(distinct: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(distinct), r"[^\pL\pM]+", "")


def tagged(texts: pa.Array, grammar: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tag and weight of each word, its text, and whether a clause ends behind it; works on distinct words."""
    codes, distinct, rows = words(texts)
    names = clean_names(distinct)
    tags, weights = np.zeros(len(names), np.int64), np.zeros(len(names))
    by_length: dict[int, dict] = {}
    for stem, value in grammar.stems.items():
        by_length.setdefault(len(stem), {})[stem] = value
    for table, part in [*((v, pc.utf8_slice_codeunits(names, 0, n)) for n, v in sorted(by_length.items())), (grammar.exact, names)]:
        at = pc.fill_null(pc.index_in(part, value_set=pa.array(list(table), pa.string())), -1).to_numpy()
        hit, values = at >= 0, list(table.values())
        tags[hit] = np.array([v[0] for v in values])[at[hit]]
        weights[hit] = np.array([v[1] for v in values])[at[hit]]
    # A clause ends at a sign behind the word, which belongs to the clause; words without a tag carry the end.
    ends = pc.match_substring_regex(distinct, r"[.!?;]['\")]*$").to_numpy(zero_copy_only=False)
    return (tags[codes] if len(codes) else codes), weights[codes] if len(codes) else np.zeros(0), rows, (ends[codes] if len(codes) else np.zeros(0, bool))


def event_sums(texts: pa.Array, grammar: Grammar) -> np.ndarray:
    """One row per text: the summed weight of each event over its matched clauses."""
    tags, weights, rows, ends = tagged(texts, grammar)
    out, machine = np.zeros((len(texts), len(EVENTS))), Machine()
    hits = np.flatnonzero((tags == INSULT) | (tags == THREAT))
    at = 0
    while at < len(hits):
        first = last = hits[at]
        while at + 1 < len(hits) and hits[at + 1] - last <= AFTER + BEFORE and rows[hits[at + 1]] == rows[first]:
            at, last = at + 1, hits[at + 1]
        at += 1
        low, high = max(0, first - BEFORE), min(len(tags), last + AFTER + 1)
        low, high = low + np.searchsorted(rows[low:first + 1], rows[first]), low + np.searchsorted(rows[low:high], rows[first], "right")
        stretch, heavy = [], []
        for tag, weight, end in zip(tags[low:high].tolist(), weights[low:high].tolist(), ends[low:high].tolist()):
            stretch.append(tag)
            heavy.append(weight)
            if end:
                stretch.append(STOP)
                heavy.append(0.0)
        out[rows[first]] += machine.read(stretch, heavy)
    return out


def features(sums: np.ndarray) -> np.ndarray:
    return np.hstack((np.log1p(sums), np.ones((len(sums), 1))))


def probability(sums: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(sums) @ np.array(weights), -30, 30)))


def fit_weights(sums: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic weights with a normal prior around ``PRIOR``, by Newton steps."""
    x, w = features(sums), PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - (w - PRIOR) / PRIOR_SPREAD
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / PRIOR_SPREAD
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def pattern_counts(sample: DataFrame) -> DataFrame:
    """``pattern`` (a word, or a stem and ``*``) with the number of toxic and clean texts that have it."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches):
            codes, distinct, rows = words(strings(block.column("text")))
            y = block.column("y").to_numpy()
            names = clean_names(distinct)
            for length in (0, *STEMS):
                part = names if not length else pc.utf8_slice_codeunits(names, 0, length)
                coded = part.dictionary_encode()
                # A stem needs a word longer than itself.
                usable = np.array(pc.greater(pc.utf8_length(names), max(length, 2)).to_pylist(), bool)
                of = coded.indices.to_numpy()
                keep = usable[codes] if len(codes) else np.zeros(0, bool)
                pairs = np.unique(of[codes[keep]].astype(np.int64) * (len(block) + 1) + rows[keep])
                pattern, row = pairs // (len(block) + 1), pairs % (len(block) + 1)
                toxic = np.bincount(pattern, y[row], len(coded.dictionary)).astype(np.int64)
                both = np.bincount(pattern, minlength=len(coded.dictionary))
                used = np.flatnonzero(both)
                text = coded.dictionary.take(pa.array(used))
                if length:
                    text = pc.binary_join_element_wise(text, "*", "")
                yield pa.RecordBatch.from_arrays([text, pa.array(toxic[used]), pa.array((both - toxic)[used])], names=["pattern", "toxic", "clean"])

    return sample.mapInArrow(each, "pattern string, toxic long, clean long").groupBy("pattern").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def surroundings(sample: DataFrame, patterns: list[str]) -> dict[str, int]:
    """In how many different neighbourhoods (words before and after) each pattern stands in toxic texts."""
    exact = {p for p in patterns if not p.endswith("*")}
    stems = {p[:-1] for p in patterns if p.endswith("*")}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches):
            found = set()
            for text, y in zip(strings(block.column("text")).to_pylist(), block.column("y").to_pylist()):
                if not y:
                    continue
                names = clean_names(pa.array(text.split(), pa.string())).to_pylist()
                for at, name in enumerate(names):
                    here = [name] if name in exact else []
                    here += [name[:n] + "*" for n in STEMS if len(name) > n and name[:n] in stems]
                    for pattern in here:
                        found.add((pattern, f"{names[at - 1] if at else ''} {names[at + 1] if at + 1 < len(names) else ''}"))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.string())],
                                             names=["pattern", "beside"])

    rows = sample.mapInArrow(each, "pattern string, beside string").groupBy("pattern").agg(F.countDistinct("beside").alias("n"))
    return {r["pattern"]: r["n"] for r in rows.collect()}  # at most one row per candidate


def learned_patterns(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that toxic texts have beyond chance, with their weights."""
    n_toxic, n = sample.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    if not n_toxic or n_toxic == n:
        return {}, {}
    rate = n_toxic / n
    counts = stored(pattern_counts(sample))
    patterns = counts.count()
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    # Log-likelihood gain over the base rate; chance alone reaches the log of the number of patterns.
    gain = F.col("toxic") * F.log(share / rate) + F.col("clean") * F.when(share < 1, F.log((1 - share) / (1 - rate))).otherwise(0.0)
    rows = (counts.filter("toxic >= 3").withColumn("share", share).withColumn("gain", gain)
            .filter((F.col("share") > max(0.5, 2 * rate)) & (F.col("gain") > math.log(max(patterns, 2)) + 3))
            .orderBy(F.desc("gain"), F.desc(F.length("pattern")), "pattern").limit(CANDIDATES).collect())
    varied = surroundings(sample, [r["pattern"] for r in rows]) if rows else {}
    exact, stems = {}, {}
    accepted: dict[str, float] = {}
    # Whole words first among equals, then the longest stem.
    for r in sorted(rows, key=lambda r: (-r["gain"], r["pattern"].endswith("*"), -len(r["pattern"]), r["pattern"])):
        pattern, stem = r["pattern"], r["pattern"].rstrip("*")
        if varied.get(pattern, 0) < 0.5 * r["toxic"] + 1:
            continue
        if any(stem.startswith(s) for s in stems):
            continue
        if pattern.endswith("*") and r["gain"] < 1.2 * sum(g for p, g in accepted.items() if p.startswith(stem)):
            continue
        weight = min(2.0, max(0.3, math.log((r["toxic"] + 0.5) / (r["clean"] + 0.5)) / 3))
        (stems if pattern.endswith("*") else exact)[stem] = weight
        accepted[stem] = r["gain"]
    return exact, stems


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, modulus: int = MODULUS, held_out: int = HELD_OUT) -> Grammar:
    """Grammar from at most ``rows`` labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    sample = stored(labelled_sample(docs, labels, "toxic", modulus, held_out, rows))
    exact, stems = learned_patterns(sample)
    prior = prior_grammar()
    grammar = Grammar(prior.exact | {w: (INSULT, v) for w, v in exact.items()}, {s: (INSULT, v) for s, v in stems.items()})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches):
            sums = event_sums(strings(block.column("text")), grammar)
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in sums.T], block.column("y")], names=[*EVENTS, "y"])

    schema = ", ".join(f"{e} double" for e in EVENTS) + ", y int"
    seen = np.array([tuple(r) for r in sample.mapInArrow(each, schema).collect()], float).reshape(-1, len(EVENTS) + 1)
    seen = seen[np.lexsort(seen.T)]
    return Grammar(grammar.exact, grammar.stems, fit_weights(seen[:, :-1], seen[:, -1]) if len(seen) else tuple(PRIOR))


def clean(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with their own columns."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches):
            yield block.filter(pa.array(probability(event_sums(strings(block.column("text")), grammar), grammar.weights) < threshold))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(each, docs.schema)


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``matched_clauses`` (weight of all events); older columns so named are replaced."""
    small_batches(docs.sparkSession)
    kept = docs.drop("toxicity", "matched_clauses")
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in kept.schema],
                           T.StructField("toxicity", T.DoubleType()), T.StructField("matched_clauses", T.DoubleType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches):
            sums = event_sums(strings(block.column("text")), grammar)
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(probability(sums, grammar.weights)), pa.array(sums.sum(axis=1))],
                                             names=schema.names)

    return kept.mapInArrow(each, schema)


def held_out(doc_id: str = "doc_id", modulus: int = MODULUS, remainder: int = HELD_OUT):
    return fold(doc_id, modulus) == remainder
