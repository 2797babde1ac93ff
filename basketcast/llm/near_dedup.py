"""Near duplicates by ProbMinHash over weighted word shingles.

A text is the set of its runs of five words (lower case, signs dropped), each weighted by
``1 + ln(occurrences)``. Every shingle sends arrivals of a Poisson process whose rate is its weight;
each arrival falls into one of ``REGISTERS`` registers, and a register remembers the shingle that
arrived first. A shingle stops once its next arrival is later than all registers of the text. Two
texts agree in a register with the probability Jaccard of their weights. ``BANDS`` bands of
``ROWS`` registers give candidates (a pair at similarity 0.8 is missed with probability 3e-6). Texts
that repeat a shingle have a second set of bands with all weights 1, so this holds for plain
similarity too, whatever the repeats. Every candidate pair is verified with exact similarities before
it counts as a link.

Copies of one word sequence are one text from the start, and links join texts, not rows:

1. buckets of up to ``SMALL`` texts are compared pair by pair, larger ones with two leaders each, and
   links are closed to classes;
2. texts of larger buckets that still hold several classes go through an exact join: two similar texts
   share one of their rarest shingles, which leaves out passages that many texts have. In each such
   shingle all texts meet the first one, as long as this joins classes;
3. families of texts that still share such shingles across classes are compared in full, block by
   block, so no candidate is given up. This last step is quadratic in a family; it is small, because
   only texts that no leader could tell apart get there.

A link is a pair whose distinct shingles have a Jaccard similarity of at least ``SIMILARITY``; the
weights decide which pairs are looked at. A class is a connected set of texts; its id is the smallest
document id in it.

Defined cases: a null text has no words; texts without words are one class; a text of fewer than five
words is one shingle; null ids count as the largest; repeated rows belong to the same class; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketcast.llm.common import dropped, gathered, small_batches, stored, strings, words
from basketcast.llm.tiling import cleaned

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
SMALL = 8                # texts of a bucket that is compared pair by pair
FAMILY_BLOCK = 64        # texts of a block in the last comparison
FLUSH = 100_000          # rows that a task holds before it hands them on
EMPTY = bytes(16)
BITMAP = 32_768          # bits of one row of ``bitmap_construct_agg``
MOST_BITS = 1 << 25      # bits of all rows, 4 MB

MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(value: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit permutation (splitmix64)."""
    value = value + MIX
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every word."""
    codes, distinct, rows = words(texts)
    names = cleaned(distinct).to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(n) if n else 0 for n in names), np.uint64, len(names))
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values = hashes[codes]
    full = values != 0
    return values[full], rows[full].astype(np.int64)


def shingles(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted inside each: text, hash, occurrences."""
    size = np.bincount(rows, minlength=n)
    width = np.minimum(size, SHINGLE)
    first = np.cumsum(size) - size
    starts = np.flatnonzero(np.arange(len(rows)) - first[rows] <= (size - width)[rows]) if len(rows) else np.zeros(0, np.int64)
    of = rows[starts]
    value = np.zeros(len(starts), np.uint64)
    for k in range(SHINGLE):
        here = k < width[of]
        value[here] = mixed(value[here] ^ values[starts[here] + k])
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(value, prepend=np.uint64(0)) != 0)) if len(of) else order
    return of[new], value[new], np.diff(np.append(new, len(of)))


def prob_minhash(of: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """Signature (text x register): the shingle with the earliest arrival; all texts at once, with early termination."""
    earliest = np.full(n * registers, np.inf)
    arrival, live = np.zeros(len(of)), np.arange(len(of))
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    turn = 0
    while len(live):
        turn += 1
        draw = mixed(value[live] ^ mixed(np.full(1, turn, np.uint64)))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 1) / 2.0 ** 53
        arrival = arrival - np.log(uniform) / weight[live]
        # An element whose next arrival is behind all registers of its text has nothing more to say.
        latest = earliest.reshape(n, registers).max(axis=1)
        early = arrival < latest[of[live]]
        live, arrival, draw = live[early], arrival[early], draw[early]
        place = of[live] * registers + (mixed(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, place, arrival)
        seen.append((place, arrival, live))
    signature = np.zeros(n * registers, np.uint64)
    for place, when, element in seen:
        won = earliest[place] == when
        signature[place[won]] = value[element[won]]
    return signature.reshape(n, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One key for each band of a signature."""
    keys = np.zeros((len(signature), BANDS), np.uint64)
    for row in range(ROWS):
        keys = mixed(keys ^ signature[:, row::ROWS])
    return keys


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, bands`` of every row; texts without words have no bands, those with repeats twice as many."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches):
            n = len(block)
            values, rows = word_numbers(strings(block.column("text")))
            of, value, count = shingles(values, rows, n)
            keys = band_keys(prob_minhash(of, value, 1 + np.log(count), n)).astype(np.int64)
            plain, again = keys.copy(), np.bincount(of[count > 1], minlength=n) > 0
            some = again[of]
            if some.any():
                place = np.cumsum(again) - 1
                plain[again] = band_keys(prob_minhash(place[of[some]], value[some], np.ones(int(some.sum())), int(again.sum()))).astype(np.int64)
            size = np.bincount(rows, minlength=n)
            # Weighted bands, and those of equal weights where a repeated shingle makes them differ.
            both = np.hstack((keys, plain))
            same = np.hstack((np.zeros_like(keys, bool), keys == plain))
            used = (np.arange(2 * BANDS) < np.where(again, 2 * BANDS, BANDS)[:, None]) & (size > 0)[:, None]
            bands = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(used.sum(axis=1)))).astype(np.int32), pa.array(both[used], mask=same[used]))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), text_keys(values, size), bands], names=["doc_id", "text_key", "bands"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, text_key binary, bands array<long>")


def text_keys(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """128-bit hash of each text's word sequence."""
    ends = np.cumsum(size)
    return pa.array([xxhash.xxh3_128_digest(values[b - n:b].tobytes()) if n else EMPTY for b, n in zip(ends, size)], pa.binary())


@contextmanager
def sifted(spark: SparkSession) -> Iterator[None]:
    """Joins planned inside sift their larger side by a Bloom filter (of at most 8 MB) of the other before the shuffle, at any size."""
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1t"}
    before = {name: spark.conf.get(prefix + name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(prefix + name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(prefix + name, value)


def shingle_table(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``text_key, hashes`` of the texts named by ``doc_id, text_key``; binary arrays, sorted by hash."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches):
            n = len(block)
            values, rows = word_numbers(strings(block.column("text")))
            of, value, _ = shingles(values, rows, n)
            cuts = np.searchsorted(of, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays(
                [text_keys(values, np.bincount(rows, minlength=n)), pa.array([value[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                names=["text_key", "hashes"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    ids = stored(texts.select(F.col("doc_id").alias("wanted"), F.lit(1).alias("marked")))
    # The mark is always set; as a predicate it lets Spark sift the texts by a Bloom filter of the ids (see ``sifted``).
    found = rows.join(ids.filter("marked > 0"), F.col("doc_id") == F.col("wanted"), "left_semi")
    if not ids.filter("wanted IS NULL").isEmpty():
        found = found.unionByName(rows.filter("doc_id IS NULL"))
    table = found.mapInArrow(each, "text_key binary, hashes binary")
    return table.join(texts.select("text_key"), "text_key", "left_semi").dropDuplicates(["text_key"])


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Plain Jaccard and probability Jaccard of two sorted shingle sets with weights."""
    both, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    union = len(a) + len(b) - len(both)
    plain = len(both) / union if union else 1.0
    if x.max(initial=1.0) == y.max(initial=1.0) == 1.0:
        return plain, plain
    xs, ys = x[at], y[bt]
    only_x, only_y = x.sum() - xs.sum(), y.sum() - ys.sum()
    order = np.argsort(ys / xs, kind="stable")
    xs, ys = xs[order], ys[order]
    ratio = ys / xs
    # Of every union element the larger of x_j / x_i and y_j / y_i: x's part up to the ratio of i, y's part behind it.
    upto = np.searchsorted(ratio, ratio, "right")
    x_sum, y_sum = np.concatenate(([0], np.cumsum(xs))), np.concatenate(([0], np.cumsum(ys)))
    total = (only_x + x_sum[upto]) / xs + (only_y + y_sum[-1] - y_sum[upto]) / ys
    return plain, float((1 / total).sum())


def verified(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """``a, b`` of the pairs that reach the similarity. Links go by distinct shingles, so no occurrences travel with them."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist()):
                a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                keep.append(similarity(a, np.ones(len(a)), b, np.ones(len(b)))[0] >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = table.select(F.col("text_key").alias("a"), F.col("hashes").alias("ha"))
    right = table.select(F.col("text_key").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(each, "a binary, b binary")


def in_order(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def close(links: DataFrame) -> DataFrame:
    """``text_key, label``: the smallest text key of the connected set, for every text with a link.

    Labels go to neighbours and then to the label's own label, until nothing changes; each round is stored.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = before = stored(edges.groupBy(F.col("a").alias("text_key")).agg(F.min("b").alias("m")).select("text_key", F.least("text_key", "m").alias("label")))
    while True:
        offered = edges.join(labels, F.col("b") == F.col("text_key")).groupBy("a").agg(F.min("label").alias("offer"))
        nearer = labels.join(offered, F.col("text_key") == F.col("a"), "left").select(
            "text_key", F.col("label").alias("old"), F.least("label", F.coalesce("offer", "label")).alias("label"))
        own = nearer.select(F.col("text_key").alias("of"), F.col("label").alias("further"))
        jumped = stored(nearer.join(own, F.col("label") == F.col("of"), "left").select(
            "text_key", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = jumped.select("text_key", "label")
        dropped(before)
        before = jumped
        if jumped.filter(F.col("old") != F.col("label")).isEmpty():
            dropped(edges)
            return labels


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.withColumnRenamed("text_key", "k")
    return rows.join(named, F.col("text_key") == F.col("k"), "left").drop("k").withColumn("label", F.coalesce("label", "text_key"))


def bucket_pairs(texts: DataFrame) -> DataFrame:
    """``band, key, a, b``: what is compared in each bucket of several texts.

    Rows are dealt by bucket and sorted, and each bucket streams by: all pairs of up to ``SMALL`` texts
    (without band and key), and of a larger bucket every text ``b`` with its first and its second text.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, large = None, [], False
        bands, keys, a, b = [], [], [], []

        def small() -> None:
            for j, right in enumerate(held):
                for left in held[:j]:
                    bands.append(None)
                    keys.append(None)
                    a.append(left)
                    b.append(right)

        def star(text: bytes) -> None:
            for leader in held[:2]:
                bands.append(bucket[0])
                keys.append(bucket[1])
                a.append(leader)
                b.append(text)

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(bands, pa.int32()), pa.array(keys, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())],
                                             names=["band", "key", "a", "b"])
            for column in (bands, keys, a, b):
                column.clear()
            return out

        for batch in batches:
            for band, key, text in zip(batch.column("band").to_pylist(), batch.column("key").to_pylist(), batch.column("text_key").to_pylist()):
                if (band, key) != bucket:
                    if not large:
                        small()
                    bucket, held, large = (band, key), [], False
                if large:
                    star(text)
                    continue
                held.append(text)
                if len(held) > SMALL:
                    large = True
                    for member in held:
                        star(member)
            if len(a) > FLUSH:
                yield full()
        if not large:
            small()
        if a:
            yield full()

    rows = texts.select("text_key", F.posexplode("bands").alias("band", "key")).filter("key IS NOT NULL").withColumn("band", F.col("band") % BANDS)
    dealt = rows.repartition("band", "key").sortWithinPartitions("band", "key", "text_key")
    return dealt.mapInArrow(each, "band int, key long, a binary, b binary")


def text_classes(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``text_key, label`` for every text in a class of several; ``texts`` has ``text_key, doc_id, bands``."""
    met = stored(bucket_pairs(texts))
    pairs = met.filter("a <> b").select("a", "b").distinct()
    done = stored(pairs.select(*in_order(F.col("a"), F.col("b"))).distinct())
    named = done.select(F.col("a").alias("text_key")).union(done.select("b")).distinct().join(texts.select("text_key", "doc_id"), "text_key")
    named = stored(named)
    with sifted(docs.sparkSession):
        table = stored(shingle_table(docs, named))
    dropped(named)
    links = stored(verified(done, table))
    labels = close(links)
    # Texts of larger buckets in which several classes are left meet once more, now by their rarest shingles.
    large = met.filter("band IS NOT NULL").select("band", "key", F.col("b").alias("text_key")).distinct()
    told = stored(with_labels(large, labels))
    dropped(met)
    several = told.groupBy("band", "key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("band", "key")
    left = stored(told.join(several, ["band", "key"], "left_semi").select("text_key").distinct())
    dropped(told)
    if left.isEmpty():
        return labels
    prefixes = stored(rare_shingles(table.join(left, "text_key", "left_semi")))
    while True:
        # In each shingle all texts meet its first text, as long as this joins classes ...
        met = stored(with_labels(prefixes, labels))  # every round has other labels
        mixed_ones = met.groupBy("shingle").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min(F.struct("text_key", "label")).alias("first"))
        mixed_ones = stored(mixed_ones.filter("l0 <> l1").select("shingle", F.col("first.text_key").alias("with"), F.col("first.label").alias("other")))
        fresh = across(met, mixed_ones, done)
        found = stored(verified(fresh, table))
        if found.isEmpty():
            break
        old = (done, links, labels, met, mixed_ones, fresh, found)
        done, links = stored(done.union(fresh)), stored(links.union(found))
        labels = close(links)
        dropped(*old)
    # ... and at last every text meets those of other classes, block by block.
    rest = stored(met.join(mixed_ones.select("shingle"), "shingle", "left_semi"))
    if rest.isEmpty():
        return labels
    met_first = rest.join(mixed_ones.select("shingle", "with"), "shingle")
    families = close(met_first.select(F.col("text_key").alias("a"), F.col("with").alias("b")).distinct()).withColumnRenamed("label", "family")
    found = stored(linked_blocks(with_labels(families, labels), table))
    return labels if found.isEmpty() else close(links.union(found))


def linked_blocks(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Links between classes among all texts of a family (``text_key, family, label``).

    A family is dealt into blocks of about ``FAMILY_BLOCK`` texts; a row of the join is a pair of blocks, whose
    shared shingles are counted by one matrix product. One link for each pair of classes is enough.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                left, right = row["left"], row["right"]
                sets = [np.frombuffer(t["hashes"], np.uint64) for t in (*left, *right)]
                size = np.array([len(v) for v in sets])
                names, at = np.unique(np.concatenate(sets), return_inverse=True)
                often = np.bincount(at) > 1
                place = np.cumsum(often) - 1
                keep = often[at]
                has = np.zeros((len(sets), int(often.sum())), np.float32)
                has[np.repeat(np.arange(len(sets)), size)[keep], place[at[keep]]] = 1
                n = len(left)
                both = has[:n] @ has[n:].T
                for i, j in np.argwhere(both >= SIMILARITY * (size[:n, None] + size[None, n:] - both) - 1e-6):
                    if left[i]["label"] != right[j]["label"] and both[i, j] / (size[i] + size[n + j] - both[i, j]) >= SIMILARITY:
                        out.append((left[i]["text_key"], right[j]["text_key"]))
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in out], pa.binary()), pa.array([max(p) for p in out], pa.binary())], names=["a", "b"])

    spark = rows.sparkSession
    texts = stored(rows)
    several = texts.groupBy("family").agg(F.count("*").alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1")
    several = stored(several.select("family", F.ceil(F.col("n") / FAMILY_BLOCK).cast("int").alias("blocks")))
    dealt = texts.join(several, "family").withColumn("block", F.pmod(F.hash("text_key"), F.col("blocks")))
    full = dealt.join(table.select("text_key", "hashes"), "text_key").groupBy("family", "block", "blocks").agg(
        F.collect_list(F.struct("text_key", "label", "hashes")).alias("texts"))
    full = stored(full)
    # Each pair of blocks is a row of its own, so that a large family is spread over many tasks.
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = full.select("family", F.col("block").alias("i"), every.alias("j"), F.col("texts").alias("left")).filter("i <= j")
    right = full.select("family", every.alias("i"), F.col("block").alias("j"), F.col("texts").alias("right")).filter("i <= j")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    found = stored(left.join(right, ["family", "i", "j"]).select("left", "right").mapInArrow(each, "a binary, b binary").distinct())
    small_batches(spark)
    return found


def rare_shingles(table: DataFrame) -> DataFrame:
    """``text_key, shingle``: the rarest shingles of each text, so many that two similar texts must share one.

    Of n shingles at most ``n - ceil(SIMILARITY * n)`` may be missing in the other text; one more must be
    common. Rarest first leaves out what many texts share, such as a passage.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(h, np.int64) for h in batch.column("hashes").to_pylist()]
            n = np.array([len(v) for v in sets])
            yield pa.RecordBatch.from_arrays([batch.column("text_key").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.concatenate(sets)),
                                              pa.array(np.repeat(n - np.ceil(SIMILARITY * n - 1e-9).astype(np.int64) + 1, n))],
                                             names=["text_key", "shingle", "wanted"])

    rows = stored(table.select("text_key", "hashes").mapInArrow(each, "text_key binary, shingle long, wanted long"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("texts"))
    rank = F.row_number().over(Window.partitionBy("text_key").orderBy("texts", "shingle"))
    ranked = rows.join(often, "shingle").withColumn("rank", rank).filter(F.col("rank") <= F.col("wanted"))
    return ranked.filter("texts > 1").select("text_key", "shingle")


def across(rows: DataFrame, others: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs of different classes in one shingle that were not compared yet, stored."""
    pairs = rows.join(others, "shingle").filter(F.col("label") != F.col("other"))
    return stored(pairs.select(*in_order(F.col("text_key"), F.col("with"))).distinct().join(done, ["a", "b"], "left_anti"))


def members_of_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, class_id`` for every row."""
    facts = stored(signatures(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "bands")).alias("first")
    texts = stored(facts.groupBy("text_key").agg(first).select("text_key", F.col("first.doc_id").alias("doc_id"), F.col("first.bands").alias("bands")))
    labels = text_classes(docs, texts)
    labelled = with_labels(texts.select("text_key", "doc_id"), labels)
    lowest = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"))).alias("lowest")
    ids = stored(labelled.groupBy("label").agg(lowest).select(F.col("label").alias("l"), F.col("lowest.doc_id").alias("class_id")))
    classes = stored(labelled.join(ids, F.col("label") == F.col("l")).select(F.col("text_key").alias("k"), "class_id"))
    return facts.select("doc_id", "text_key").join(classes, F.col("text_key") == F.col("k")).select("doc_id", "text_key", "class_id")


def near_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id`` for every row of ``docs``."""
    return members_of_classes(docs).select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, the one with the smallest id; of rows that share it, the first by text."""
    members = stored(members_of_classes(docs))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id"))
    gone = members.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and(kept).alias("kept")).filter("n > 1 OR NOT kept")
    gone = stored(gone.withColumnRenamed("doc_id", "kept_id"))
    plain = without(docs, gone.select("kept_id"))
    # An id may also stand on rows that are not in the class it names; then rows are told apart by class.
    ids = gone.filter("n > 1").select("kept_id")
    if ids.isEmpty():
        return plain
    repeated = docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["kept_id"]), "left_semi")
    wanted = members.join(ids, members["doc_id"].eqNullSafe(ids["kept_id"]), "left_semi").filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    keys = wanted.groupBy("doc_id", "class_id").agg(F.min("text_key").alias("text_key")).select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    keyed = with_text_key(repeated)
    chosen = keyed.join(keys, keyed["doc_id"].cast("long").eqNullSafe(keys["kept_id"]) & (keyed["text_key__"] == keys["kept_key"]), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")]))
    chosen = chosen.withColumn("first__", first).filter("first__ = 1").select(*docs.columns)
    return plain.unionByName(chosen)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but the rows with an id in ``ids`` (one column, distinct, stored).

    A bitmap of hashed ids goes to all tasks. Rows that it clears stay where they are; only the others, those with an id
    in ``ids`` and a few more, are moved for an exact join.
    """
    n = ids.count()
    if not n:
        return docs
    bits = min(MOST_BITS, max(BITMAP, 1 << (16 * n).bit_length()))
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    spot = hashed(F.col(ids.columns[0]))
    rows = ids.select(F.floor(spot / BITMAP).alias("part__"), (spot % BITMAP).alias("spot__")).groupBy("part__").agg(F.bitmap_construct_agg("spot__").alias("bits__"))
    key = docs["doc_id"].cast("long")
    marked = docs.withColumn("spot__", hashed(key)).withColumn("part__", F.floor(F.col("spot__") / BITMAP)).join(F.broadcast(rows), "part__", "left")
    byte = F.conv(F.hex(F.substring("bits__", F.floor(F.col("spot__") % BITMAP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    set_ = F.coalesce(F.getbit(byte, (F.col("spot__") % 8).cast("int")), F.lit(0)) == 1
    clear, others = marked.filter(~set_).select(*docs.columns), marked.filter(set_).select(*docs.columns)
    return clear.unionByName(others.join(ids, others["doc_id"].cast("long").eqNullSafe(ids[ids.columns[0]]), "left_anti"))


def with_text_key(docs: DataFrame) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema], T.StructField("text_key__", T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches):
            values, rows = word_numbers(strings(block.column("text")))
            yield pa.RecordBatch.from_arrays([*block.columns, text_keys(values, np.bincount(rows, minlength=len(block)))], names=schema.names)

    return docs.mapInArrow(each, schema)
