"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words (lower case, signs dropped). Rolling
Karp-Rabin hashes of ``SEED`` words find the shared seeds; seeds in a row on one diagonal are a
match. The longest match whose words are all free is marked as a tile, partly covered ones are cut
back to their free parts, and so on until none of ``SEED`` words is left. The share of an item's
words under tiles is its coverage; the order of the tiles does not matter, so a passage with its
sentences moved about is still found.

The benchmark is the stated query set: it meets all rows in blocks of bounded size, one narrow pass
over the documents for each block, without any shuffle. A word that the block does not hold breaks a
seed, so documents are compared by word numbers and nothing else of them is kept.

Defined cases: a null text has no words; an item with fewer than ``SEED`` words is never reported;
repeated items and documents are treated one by one; without items no document is marked; other
columns are kept, except that older ones named like the result are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketcast.llm.common import gathered, small_batches, strings, words

SEED = 5
COVERAGE = 0.5
BLOCK_ITEMS = 5_000
BLOCK_CHARS = 4_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def cleaned(distinct: pa.Array) -> pa.Array:
    """Words in lower case without signs; words of signs alone become empty."""
    return pc.replace_substring_regex(pc.utf8_lower(distinct), r"[^\pL\pN\pM]+", "")


def sequence(texts: pa.Array, vocabulary: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word numbers of all texts in a row (-1: not in the vocabulary), text of each word, the vocabulary."""
    codes, distinct, rows = words(texts)
    names = cleaned(distinct)
    if vocabulary is None:
        vocabulary = names.unique()
    number = pc.fill_null(pc.index_in(names, value_set=vocabulary), -1).to_numpy()
    full = pc.greater(pc.binary_length(names), 0).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    return number[codes[full]], rows[full], vocabulary


def seed_hashes(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of ``SEED`` known words inside one text."""
    n = len(ids) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    unknown = np.concatenate(([0], np.cumsum(ids < 0)))
    starts = np.flatnonzero((unknown[SEED:] == unknown[:n]) & (rows[:n] == rows[SEED - 1:]))
    value = np.zeros(len(starts), np.uint64)
    for k in range(SEED):
        value = (value + ids[starts + k].astype(np.uint64) + np.uint64(1)) * BASE
        value ^= value >> np.uint64(29)
    return starts, value


class Items:
    """One block of the benchmark: words, and the places of each seed."""

    def __init__(self, items: list[tuple]):
        self.keys = [i for i, _ in items]
        self.ids, self.rows, self.vocabulary = sequence(pa.array([t or "" for _, t in items], pa.string()))
        self.size = np.bincount(self.rows, minlength=len(items))
        self.first = np.cumsum(self.size) - self.size
        starts, value = seed_hashes(self.ids, self.rows)
        order = np.argsort(value, kind="stable")
        self.starts, self.value = starts[order], value[order]

    def shared(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a place in the documents and a place in the items with the same seed."""
        starts, value = seed_hashes(ids, rows)
        low = np.searchsorted(self.value, value, "left")
        count = np.searchsorted(self.value, value, "right") - low
        found = np.flatnonzero(count)
        here = np.repeat(starts[found], count[found])
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count[found]) - count[found], count[found])
        there = self.starts[np.repeat(low[found], count[found]) + offset]
        same = np.ones(len(here), bool)
        for k in range(SEED):  # equal hashes are checked word by word
            same &= ids[here + k] == self.ids[there + k]
        return here[same], there[same]


def matches(here: np.ndarray, there: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal runs ``(length, place in item, place in document)`` from seeds on one diagonal."""
    order = np.lexsort((here, here - there))
    here, there = here[order], there[order]
    new = np.flatnonzero((np.diff(here - there, prepend=np.iinfo(np.int64).min) != 0) | (np.diff(here, prepend=-9) != 1))
    length = np.diff(np.append(new, len(here))) + SEED - 1
    return list(zip(length.tolist(), there[new].tolist(), here[new].tolist()))


def tiles(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Greedy tiling of one document with one item: the longest free run first, ties by place."""
    heap = [(-n, i, d) for n, i, d in runs]
    heapq.heapify(heap)
    used_i, used_d, out = set(), set(), []
    while heap:
        n, i, d = heapq.heappop(heap)
        free = [i + k not in used_i and d + k not in used_d for k in range(-n)]
        if all(free):
            used_i.update(range(i, i - n))
            used_d.update(range(d, d - n))
            out.append((-n, i, d))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= SEED:
                    heapq.heappush(heap, (start - k, i + start, d + start))
                start = None
    return out


def covered(items: Items, texts: pa.Array) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
    """``(text, item, coverage, tiles)`` for every pair with a tile; places count from the start of each."""
    ids, rows, _ = sequence(texts, items.vocabulary)
    here, there = items.shared(ids, rows)
    if not len(here):
        return
    pair_row, pair_item = rows[here], items.rows[there]
    order = np.lexsort((pair_item, pair_row))
    here, there, pair_row, pair_item = here[order], there[order], pair_row[order], pair_item[order]
    cuts = np.flatnonzero((np.diff(pair_row, prepend=-1) != 0) | (np.diff(pair_item, prepend=-1) != 0))
    for a, b in zip(cuts, [*cuts[1:], len(here)]):
        row, item = int(pair_row[a]), int(pair_item[a])
        first = int(np.searchsorted(rows, row))
        found = tiles(matches(here[a:b].astype(np.int64), there[a:b].astype(np.int64)))
        start = int(items.first[item])
        yield row, item, sum(t[0] for t in found) / int(items.size[item]), [(n, i - start, d - first) for n, i, d in found]


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, read one partition at a time."""
    held, chars = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        if held and (len(held) >= BLOCK_ITEMS or chars + len(text or "") > BLOCK_CHARS):
            yield Items(held)
            held, chars = [], 0
        held.append((item, text))
        chars += len(text or "")
    if held:
        yield Items(held)


def tile(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """``docs`` with ``leak_items`` (items covered to ``threshold``), ``leak_coverage`` (the largest of any item) and
    ``leak_tiles`` (``item_id, item_start, doc_start, length`` in words, of the reported items)."""
    small_batches(docs.sparkSession)
    tile_type = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("item_start", T.LongType()),
                                          T.StructField("doc_start", T.LongType()), T.StructField("length", T.LongType())]))
    added = {"leak_items": T.ArrayType(T.LongType()), "leak_coverage": T.DoubleType(), "leak_tiles": tile_type}
    arrow_tile = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "item_start", "doc_start", "length")]))
    out = docs.drop(*added)
    for name, kind in added.items():
        out = out.withColumn(name, F.lit(0.0) if name == "leak_coverage" else F.array().cast(kind))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema])

    def search(items: Items):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in gathered(batches):
                found: dict[int, list] = {}
                best = block.column("leak_coverage").to_numpy(zero_copy_only=False).copy()
                for row, item, share, parts in covered(items, strings(block.column("text"))):
                    best[row] = max(best[row], share)
                    if share >= threshold:
                        found.setdefault(row, []).append((items.keys[item], parts))
                leaks, spans = block.column("leak_items"), block.column("leak_tiles")
                if found:
                    leaks, spans = leaks.to_pylist(), spans.to_pylist()
                    for row, pairs in found.items():
                        leaks[row] = leaks[row] + [key for key, _ in pairs]
                        spans[row] = spans[row] + [{"item_id": key, "item_start": i, "doc_start": d, "length": n}
                                                   for key, parts in pairs for n, i, d in parts]
                    leaks, spans = pa.array(leaks, pa.list_(pa.int64())), pa.array(spans, arrow_tile)
                kept = [block.column(n) for n in block.schema.names if n not in added]
                yield pa.RecordBatch.from_arrays([*kept, leaks, pa.array(best), spans], names=schema.names)
        return each

    for items in item_blocks(benchmark):
        out = out.mapInArrow(search(items), schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that cover no item to ``threshold``, with their own columns."""
    small_batches(docs.sparkSession)

    def search(items: Items):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in gathered(batches):
                keep = np.ones(len(block), bool)
                for row, _, share, _ in covered(items, strings(block.column("text"))):
                    keep[row] &= share < threshold
                yield block.filter(pa.array(keep))
        return each

    for items in item_blocks(benchmark):
        docs = docs.mapInArrow(search(items), docs.schema)
    return docs
