"""Quality from bytes: a small convolutional network in numpy.

A first layer of learned filters looks at ``WIDTH`` bytes at every second place. Its responses are
averaged over chunks of 64 bytes that overlap by half and cover the whole text; a second layer of
learned units reads each chunk, the largest response of each unit over all chunks is kept, and a
logistic output combines them. Every byte of a text counts, however long it is; memory is bounded by
the block a task works on.

Training uses a bounded, class-balanced sample of labelled rows; the gradient of a maximum reaches
only the chunk that gave it, so a step costs little more than the forward pass. Scoring adds the
tables of two neighbouring bytes into one, which halves the look-ups.

Defined cases: a null text is empty and is scored as one chunk of zero bytes; without labelled rows of
both classes every score is the share of the class; repeated rows are scored one by one; an empty
table gives no rows; the row order of the sample is fixed, so that fitting again gives the same network.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from basketcast.llm.common import fold, gathered, small_batches, strings
from basketcast.llm.labelled import labelled_sample

SAMPLE_ROWS = 3_000       # labelled rows that the network is fitted to, at most
THRESHOLD = 0.3
MODULUS, HELD_OUT = 5, 0
WIDTH = 6                 # bytes under a filter
STRIDE = 2
FILTERS = 16
UNITS = 16
HALF = 32                 # bytes of half a chunk
PLACES = HALF // STRIDE   # filter places in half a chunk
EPOCHS, BATCH, RATE = 8, 32, 0.01
BLOCK = 1_000_000         # text bytes scored at once


@dataclass(frozen=True)
class Network:
    tables: np.ndarray    # WIDTH x 256 x FILTERS
    bias: np.ndarray      # FILTERS
    units: np.ndarray     # FILTERS x UNITS
    unit_bias: np.ndarray
    out: np.ndarray       # UNITS
    out_bias: float


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in whole half chunks, ``WIDTH`` zeros in front of each, so that no filter sees two texts; first half chunk of each."""
    halves = np.array([(len(t) + WIDTH + HALF - 1) // HALF for t in texts])
    first = np.cumsum(halves) - halves
    data = np.zeros(int(halves.sum()) * HALF + WIDTH, np.uint8)
    for text, start in zip(texts, first):
        data[start * HALF + WIDTH:start * HALF + WIDTH + len(text)] = np.frombuffer(text, np.uint8)
    return data, first


def responses(net: Network, data: np.ndarray) -> np.ndarray:
    """First-layer responses at every second place, before the average; two bytes per look-up."""
    n = (len(data) - WIDTH) // STRIDE
    pairs = data[:-1].astype(np.int64) * 256 + data[1:]
    out = np.broadcast_to(net.bias, (n, FILTERS)).astype(np.float32)
    for k in range(0, WIDTH, 2):
        table = (net.tables[k][:, None, :] + net.tables[k + 1][None, :, :]).reshape(65536, FILTERS)
        out += table[pairs[k:k + STRIDE * n:STRIDE]]
    return np.maximum(out, 0, out=out)


def chunks(conv: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Average over chunks of two half chunks; the last half chunk of a text stands for itself."""
    half = conv.reshape(-1, PLACES, FILTERS).mean(axis=1)
    following = np.vstack((half[1:], half[-1:]))
    last = np.append(first[1:], len(half)) - 1
    following[last] = half[last]
    return (half + following) / 2


def forward(net: Network, texts: list[bytes]) -> np.ndarray:
    data, first = laid_out(texts)
    hidden = np.maximum(chunks(responses(net, data), first) @ net.units + net.unit_bias, 0)
    best = np.maximum.reduceat(hidden, first, axis=0)
    return 1 / (1 + np.exp(-np.clip(best @ net.out + net.out_bias, -30, 30)))


def new_network(rng: np.random.Generator) -> Network:
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    # Bytes of one kind start alike, so that a filter sees kinds before it sees letters.
    kind = np.zeros(256, int)
    for number, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \n\t\r", b".,;:!?", b"\0"), 1):
        kind[list(chars)] = number
    kind[128:] = 7
    tables = draw(WIDTH, 8, FILTERS, scale=0.3)[:, kind, :] + draw(WIDTH, 256, FILTERS, scale=0.1)
    return Network(tables, np.zeros(FILTERS, np.float32), draw(FILTERS, UNITS, scale=0.5), np.zeros(UNITS, np.float32),
                   draw(UNITS, scale=0.3), 0.0)


def gradients(net: Network, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
    data, first = laid_out(texts)
    conv = responses(net, data)
    seen = chunks(conv, first)
    hidden = np.maximum(seen @ net.units + net.unit_bias, 0)
    ends = np.append(first[1:], len(hidden))
    best = np.array([a + hidden[a:b].argmax(axis=0) for a, b in zip(first, ends)])     # chunk of each text and unit
    top = hidden[best, np.arange(UNITS)]
    error = (1 / (1 + np.exp(-np.clip(top @ net.out + net.out_bias, -30, 30))) - y) / len(y)
    grad = {"out": top.T @ error, "out_bias": error.sum()}
    back = error[:, None] * net.out * (top > 0)                                        # texts x UNITS
    grad["unit_bias"] = back.sum(axis=0)
    grad["units"] = np.einsum("tuf,tu->fu", seen[best], back)
    at_chunk = back[:, :, None] * net.units.T[None, :, :]                              # texts x UNITS x FILTERS
    half = np.zeros((len(hidden), FILTERS))
    flat, values = best.ravel(), at_chunk.reshape(-1, FILTERS) / 2
    np.add.at(half, flat, values)
    np.add.at(half, np.minimum(flat + 1, np.repeat(ends - 1, UNITS)), values)
    touched = np.flatnonzero(np.abs(half).max(axis=1) > 0)
    place = (touched[:, None] * PLACES + np.arange(PLACES)).ravel()
    at_place = np.repeat(half[touched] / PLACES, PLACES, axis=0) * (conv[place] > 0)
    grad["bias"] = at_place.sum(axis=0)
    tables = np.empty((WIDTH, 256, FILTERS))
    for k in range(WIDTH):
        letters = data[place * STRIDE + k]
        for f in range(FILTERS):
            tables[k, :, f] = np.bincount(letters, at_place[:, f], 256)
    grad["tables"] = tables
    return grad


def train(texts: list[bytes], y: np.ndarray, seed: int = 7) -> Network:
    """Adam over shuffled batches of whole texts."""
    rng = np.random.default_rng(seed)
    net = new_network(rng)
    values = {k: np.array(getattr(net, k), np.float64) for k in ("tables", "bias", "units", "unit_bias", "out", "out_bias")}
    mean = {k: np.zeros_like(v) for k, v in values.items()}
    square = {k: np.zeros_like(v) for k, v in values.items()}
    step, epochs = 0, max(EPOCHS, -(-300 * BATCH // max(1, len(texts))))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            some = order[start:start + BATCH]
            step += 1
            for key, g in gradients(net, [texts[i] for i in some], y[some]).items():
                mean[key] = 0.9 * mean[key] + 0.1 * g
                square[key] = 0.99 * square[key] + 0.01 * g * g
                values[key] = values[key] - RATE * (mean[key] / (1 - 0.9 ** step)) / (np.sqrt(square[key] / (1 - 0.99 ** step)) + 1e-8)
            net = Network(*[values[k].astype(np.float32) for k in ("tables", "bias", "units", "unit_bias", "out")], float(values["out_bias"]))
    return net


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, modulus: int = MODULUS, held_out: int = HELD_OUT) -> Network | float:
    """Network from at most ``rows`` labelled rows (half of each class where there are enough); a bare share without both classes."""
    sample = labelled_sample(docs, labels, "quality", modulus, held_out, rows, balance=True).collect()
    pairs = sorted((r["text"], r["y"]) for r in sample)
    y = np.array([p[1] for p in pairs], float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    return train([p[0].encode() for p in pairs], y)


def score(docs: DataFrame, net: Network | float) -> DataFrame:
    """``docs`` with ``quality`` (0 to 1); an older column so named is replaced."""
    small_batches(docs.sparkSession)
    kept = docs.drop("quality")
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in kept.schema], T.StructField("quality", T.DoubleType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches, limit=BLOCK):
            texts = [t.encode() for t in strings(block.column("text")).to_pylist()]
            scores = np.full(len(texts), net) if isinstance(net, float) else forward(net, texts)
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(scores.astype(float))], names=schema.names)

    return kept.mapInArrow(each, schema)


def held_out(doc_id: str = "doc_id", modulus: int = MODULUS, remainder: int = HELD_OUT):
    return fold(doc_id, modulus) == remainder
