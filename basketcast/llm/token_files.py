"""Token-ID files: Parquet list columns written by Spark's own writer, with the layout under control.

Documents are range-sorted by id, tokenised in that order inside the tasks, and written with delta
encoded counters, dictionary encoded id lists, bounded row groups and a page index, so that a reader
of one document or of the counters alone touches few pages. The counters are read without the lists;
start offsets come from one total per file partition and a running sum inside it.

Defined cases: a null text is empty and yields only the end id; repeated ids are ordered by text;
a null id sorts first; an empty table gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketcast.llm.common import BLOCK_BYTES, gathered, small_batches, strings, words

# Words whose ids one Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 700_000
PUNCTUATION = ".,;:!?*#$%&|-_=+()[]{}/\\\"~^`@"
LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    # Ids repeat, counters grow: dictionary for the lists, delta for the numbers.
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}
FILE_SCHEMA = "doc_id long, part int, n_tokens long, ids array<int>"

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Encodes words between white space, each distinct one once.

    Valid for vocabularies that drop white space and split words apart before merging. A word
    ``core + ASCII punctuation`` is split there too, because the vocabulary separates letters from
    signs. Texts that contain a control string are left to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.control = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Empty memory: slot 0 is the empty piece; ``ids[start:start + length]`` belongs to a slot."""
        self.slots: dict[str, int] = {"": 0}
        self.ids, self.start, self.length = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces; those of letters alone go many to a call, cut apart at the word ends."""
        letters = [p for p in pieces if p.isalpha()]
        other = [p for p in pieces if not p.isalpha()]
        groups = [letters[i:i + 1000] for i in range(0, len(letters), 1000)]
        found, names, lengths = [], [], []
        for group, ids in zip(groups, self.plain([" ".join(g) for g in groups])):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                found.append(ids)
                names.extend(group)
                lengths.append(np.diff(cuts, prepend=0))
            else:
                other.extend(group)
        rest = self.plain(other)
        found, names = [self.ids, *found, *rest], names + other
        lengths = np.concatenate([*lengths, np.array([len(i) for i in rest], np.int64)])
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(lengths) - lengths))
        self.length = np.concatenate((self.length, lengths))
        self.ids = np.concatenate(found)
        self.slots.update(zip(names, range(len(self.slots), len(self.slots) + len(names))))

    def pieces(self, distinct: pa.Array) -> np.ndarray:
        """Slots of the two pieces of each word; the second may be the empty one."""
        core = pc.utf8_rtrim(distinct, PUNCTUATION)
        apart = pc.and_(pc.match_substring_regex(core, r"\pL$"), pc.invert(pc.match_substring(distinct, "'")))
        core = pc.if_else(apart, core, distinct)
        cut = pc.not_equal(core, distinct)
        tail = pa.array([w[n:] for w, n in zip(distinct.filter(cut).to_pylist(), pc.utf8_length(core.filter(cut)).to_pylist())], pa.string())
        tail = pc.replace_with_mask(pa.array([""] * len(distinct)), cut, tail)
        coded = pa.concat_arrays([core, tail]).dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.slots) > REMEMBERED:
            self.forget()
        new = [p for p in names if p not in self.slots]
        if new:
            self.learn(new)
        slots = np.fromiter(map(self.slots.__getitem__, names), np.int64, len(names))
        return slots[coded.indices.to_numpy()].reshape(2, -1).T

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        marked = np.zeros(len(texts), bool)
        for control in self.control:
            marked |= pc.match_substring(texts, control, ignore_case=True).to_numpy(zero_copy_only=False)
        if marked.any():
            whole = self.plain(texts.filter(pa.array(marked)).to_pylist())
            flat, sizes = self.encode(pc.if_else(pa.array(marked), "", texts))
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            for i, ids in zip(np.flatnonzero(marked), whole):
                parts[i], sizes[i] = ids, len(ids)
            return np.concatenate(parts), sizes
        codes, distinct, rows = words(texts)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        slots = self.pieces(distinct)[codes]
        n = self.length[slots]
        size = np.bincount(rows, n.sum(axis=1), len(texts)).astype(np.int64)
        full = slots > 0
        slots, n = slots[full], n[full]
        before = np.cumsum(n) - n
        return self.ids[np.repeat(self.start[slots] - before, n) + np.arange(n.sum())], size


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1) -> None:
    """Write ``(doc_id, part, n_tokens, ids)`` in ascending order of id; ``part`` numbers the sorted slices."""
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches, limit=BLOCK_BYTES):
            flat, sizes = encoder(vocabulary).encode(strings(block.column("text")))
            ends = np.cumsum(sizes)
            flat = np.insert(flat, ends, end_id).astype(np.int32)
            offsets = np.concatenate(([0], ends + np.arange(1, len(ends) + 1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("part"), pa.array(sizes + 1), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                names=["doc_id", "part", "n_tokens", "ids"])

    ordered = (docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id")
               .sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id()))
    ordered.mapInArrow(encode, FILE_SCHEMA).write.options(**LAYOUT).parquet(folder)


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens`` from the counters alone; the id lists are not read."""
    counts = spark.read.schema(FILE_SCHEMA).parquet(folder).select("doc_id", "part", "n_tokens")
    parts = counts.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(parts, "part").select(
        "doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Whole files: ``doc_id, part, n_tokens, ids``."""
    return spark.read.schema(FILE_SCHEMA).parquet(folder)


def digests(tokens: DataFrame) -> DataFrame:
    """One row per document of a token file, with offsets and the checksum of its ids as read.

    The running sum needs the file's own order; each part is one sorted slice.
    """
    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = np.ascontiguousarray(lists.flatten().to_numpy(), "<u4")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            sums = [zlib.crc32(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                names=["doc_id", "part", "n_tokens", "ids_crc32"])

    small_batches(tokens.sparkSession)
    rows = tokens.mapInArrow(crc, "doc_id long, part int, n_tokens long, ids_crc32 long")
    parts = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(parts, "part").select(
        "doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
