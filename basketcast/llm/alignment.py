"""Alignment of two tokenisations of the same text by diagonal run skipping, and corpus-wide link counts.

Tokens are compared by the byte offsets at which they end. From a common end, two ends that agree
again start a one-to-one stretch: with the index shift held, slices of doubling length are compared
until one differs, and halving that one finds where the stretch ends. Where the next ends differ, both
lists are walked to the next common end, the tokens between are one group, and the difference of the
two indices there is the new shift. Inside a group every end but the last belongs to one side only, so
each end closes one pair of tokens whose bytes overlap: a link.

Every document keeps its distinct id pairs with the number of their links, sorted. A pair's count is
the number of documents that hold it; counts are summed inside the map tasks first. The pairs that
most documents hold, at most ``COMMON_PAIRS`` of them (a bound in bytes, whatever the corpus), are
broadcast and looked up in the stored rows; the links of all others go to their counts by a shuffle,
in which no key is frequent, because the frequent ones are those that were broadcast.

Defined cases: texts that are null or empty, or whose tokens of either side do not join to the bytes
of a space and the text, have no tokens: zeros and an empty string. Repeated and null ids stay rows of
their own; an empty table gives an empty result; other columns are ignored. Very long texts are
aligned whole, in memory of a few hundred bytes a token.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketcast.llm.common import blocks, small_batches, stored
from basketcast.llm.vocabularies import UNCUT, ByteVocabulary, PieceMemory, vocabulary

# Pairs (17 bytes each) whose counts are broadcast.
COMMON_PAIRS = 1 << 20
# A pair is one number: the id of the first vocabulary times this, plus the id of the second.
SECOND = 1 << 31

ALIGNED_SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                  "pairs array<long>, times array<int>")


def stretches(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[bool]]:
    """Ends ``i, j`` of all stretches and groups in order, and which of them are one to one.

    The lists of ends are increasing and their last ones are equal.
    """
    i, shift, size = 0, 0, len(a)
    ends_i, ends_j, single = [], [], []
    while i < size:
        j = i + shift
        if a[i] == b[j]:
            at, step = i + 1, 1
            while at < size and a[at:at + step] == b[at + shift:at + shift + step]:
                at, step = at + step, 2 * step
            while step > 1 and at < size:
                step //= 2
                if a[at:at + step] == b[at + shift:at + shift + step]:
                    at += step
            i = min(at, size)
            single.append(True)
        else:
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            shift = j - i
            i += 1
            single.append(False)
        ends_i.append(i)
        ends_j.append(i + shift)
    return ends_i, ends_j, single


def align(a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of all groups in the tokens of either side, and one pair number for each link."""
    ends_i, ends_j, single = (np.array(x) for x in stretches(a_ends.tolist(), b_ends.tolist()))
    # A one-to-one stretch is a group for every token.
    groups = np.where(single, np.diff(ends_i, prepend=0), 1)
    back = np.repeat(np.cumsum(groups), groups) - 1 - np.arange(groups.sum())
    cuts_a, cuts_b = np.repeat(ends_i, groups) - back, np.repeat(ends_j, groups) - back
    # Tokens in groups of several: every end of either side closes one link.
    of_a, of_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
    plain = (of_a == 1) & (of_b == 1)
    other_a, other_b = np.repeat(~plain, of_a), np.repeat(~plain, of_b)
    closed = np.sort(np.concatenate((a_ends[other_a], b_ends[other_b])), kind="stable")
    closed = closed[np.diff(closed, prepend=-1) > 0]
    left = np.concatenate((cuts_a[plain] - 1, np.searchsorted(a_ends, closed)))
    right = np.concatenate((cuts_b[plain] - 1, np.searchsorted(b_ends, closed)))
    return cuts_a, cuts_b, a_ids[left].astype(np.int64) * SECOND + b_ids[right]


class Sides:
    """Two vocabularies over one memory of pieces, and their ids as text."""

    def __init__(self, path_a: str, path_b: str):
        self.sides = [vocabulary(path, special_as_text=True) for path in (path_a, path_b)]
        self.bytes = [side.token_bytes() for side in self.sides]
        self.sizes = [np.array(list(map(len, names)), np.int64) for names in self.bytes]
        self.memory = PieceMemory([side.encode_pieces for side in self.sides], self.bytes)
        # ``id,`` and ``id|`` of the first side, ``id,`` and ``id;`` of the second.
        self.names = [f"{i}{mark}" for names, marks in zip(self.bytes, (",|", ",;")) for mark in marks for i in range(len(names))]

    def whole(self, k: int, text: str) -> np.ndarray:
        """Ids of a space and the text; a vocabulary of pieces puts the space there itself."""
        side = self.sides[k]
        return np.array(side.whole([" " + text if isinstance(side, ByteVocabulary) else text])[0], np.int32)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides; None where either does not spell a space and the text."""
        cut = [None if not t or UNCUT.search(t) or any(side.keeps_whole(t) for side in self.sides) else t for t in texts]
        for text, slots in zip(texts, self.memory.slots([None if t is None else " " + t for t in cut])):
            if not text:
                yield None
            elif slots is not None and self.memory.spelt[slots].all():
                yield self.memory.ids(slots, 0), self.memory.ids(slots, 1)
            else:
                target, ids = b" " + text.encode(), [self.whole(k, text) for k in range(2)]
                spelt = all(b"".join(map(names.__getitem__, i.tolist())) == target and (size[i] > 0).all() for names, size, i in zip(self.bytes, self.sizes, ids))
                yield tuple(ids) if spelt else None

    def group_text(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: tokens of each group, first side and then second, each with the sign behind it."""
        first, second = len(self.bytes[0]), len(self.bytes[1])
        codes = np.empty(len(a) + len(b), np.int64)
        of_a, of_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
        names_a, names_b = a.astype(np.int64), b.astype(np.int64) + 2 * first
        names_a[cuts_a - 1] += first
        names_b[cuts_b - 1] += second
        codes[np.arange(len(a)) + np.repeat(cuts_b - of_b, of_a)] = names_a
        codes[np.arange(len(b)) + np.repeat(cuts_a, of_b)] = names_b
        return "".join(map(self.names.__getitem__, codes.tolist()))[:-1]


_sides: dict[tuple[str, str], Sides] = {}


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: numbers, digest of the groups, distinct pairs and the links of each."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _sides:
            _sides[path_a, path_b] = Sides(path_a, path_b)
        sides = _sides[path_a, path_b]
        for block in blocks(batches):
            rows = []
            for ids in sides.encode([t or "" for t in block.column("text").to_pylist()]):
                if ids is None:
                    rows.append((0, 0, 0, 0, "", [], []))
                    continue
                a, b = ids
                cuts_a, cuts_b, links = align(a, np.cumsum(sides.sizes[0][a]), b, np.cumsum(sides.sizes[1][b]))
                text = sides.group_text(a, b, cuts_a, cuts_b)
                pairs, times = np.unique(links, return_counts=True)
                rows.append((len(a), len(b), len(cuts_a), len(links), hashlib.sha256(text.encode()).hexdigest(), pairs, times.astype(np.int32)))
            columns = list(zip(*rows))
            numbers = [pa.array(c, pa.int64()) for c in columns[:4]]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), *numbers, pa.array(columns[4], pa.string()), pa.array(columns[5], pa.list_(pa.int64())), pa.array(columns[6], pa.list_(pa.int32()))],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ALIGNED_SCHEMA)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, docs, best``: documents that hold the pair, and whether no pair of its first id is in more.

    A window by the first id holds at most the second vocabulary.
    """
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    first = Window.partitionBy(F.shiftright("pair", 31))
    return counts.select("pair", "docs", (F.col("docs") == F.max("docs").over(first)).alias("best"))


def common_bound(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs are in so many documents or more."""
    rows = counts.groupBy((F.length(F.bin("docs")) - 1).alias("power")).count().collect()
    bound, held = 64, 0
    for power, n in sorted(map(tuple, rows), reverse=True):
        held += n
        if held > most:
            break
        bound = power
    return 1 << bound if bound < 63 else (1 << 63) - 1


def link_counts(docs: DataFrame, path_a: str, path_b: str, common: int = COMMON_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document."""
    spark = docs.sparkSession
    aligned = stored(align_documents(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    counts = stored(pair_counts(aligned))
    bound = common_bound(counts, common)
    table = counts.where(F.col("docs") >= bound).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast((table["pair"].to_numpy(), table["docs"].to_numpy(), table["best"].to_numpy()))

    def find(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row index in the batch, pair and times of each list element, its place in the table, and whether it is there."""
        pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
        rows = np.repeat(np.arange(len(batch)), pairs.value_lengths().to_numpy(zero_copy_only=False))
        flat, held = pairs.flatten().to_numpy(), known.value[0]
        place = np.minimum(np.searchsorted(held, flat), max(len(held) - 1, 0))
        return rows, flat, times, place, (held[place] == flat if len(held) else np.zeros(len(flat), bool))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, docs_of, best_of = known.value
        for batch in batches:
            rows, _, times, place, there = find(batch)
            rows, times, place = rows[there], times[there], place[there]
            best, total = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(best, rows, times * best_of[place])
            np.add.at(total, rows, times * docs_of[place])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(best), pa.array(total)], names=["row", "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, flat, times, _, there = find(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(rows[~there])), pa.array(flat[~there]), pa.array(times[~there])], names=["row", "pair", "times"])

    lists = aligned.select("row", "pairs", "times")
    sums = lists.mapInArrow(look_up, "row long, n_best long, count_sum long")
    rare = (lists.mapInArrow(others, "row long, pair long, times int").join(counts.where(F.col("docs") < bound), "pair")
            .select("row", F.when(F.col("best"), F.col("times")).otherwise(0).cast("long").alias("n_best"), (F.col("times") * F.col("docs")).alias("count_sum")))
    sums = sums.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
