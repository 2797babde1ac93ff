"""Language-model scores from a hierarchical Pitman-Yor process, its seating sampled by Gibbs.

Every context has a restaurant whose customers are the words that follow it; all context restaurants
share one parent, the restaurant of single words, and that one rests on the uniform base
``1 / (V + 1)``. Each table of a context sends one customer to the parent. The context of a word is the
nearest of the ``CONTEXTS`` commonest words among the four before it; words without such a context fill
restaurant 0. On these rests one more level, with a restaurant for every other word, however rare, that stands
right before a token: it backs off to the token's context, so that no pair of neighbours is left out. There each
word has one table, as in interpolated Kneser-Ney smoothing, so these
restaurants need no sweeps: their counts are taken where all followers of a word come together.

Given how many tables each restaurant has in total, the seatings of different words do not depend on
each other, so a sweep is one narrow pass over the table of words: all customers of every pair of word
and context are seated anew. Only how many tables they take matters, and that number is drawn from its
distribution given the share of the word at the parent (itself drawn from the seating there); the parent
follows in the same way, and the new totals, a few hundred numbers, are summed for the next sweep. The
burn-in lasts until these totals no longer drift. Predictive probabilities are averaged over the sweeps
behind it.

Counts and words come from all documents outside the held-out fold. Tokens of at most ``COMMON``
common words are kept with their document and scored against a table of bounded size; those of all
other words go to their word by one shuffle and their sums go back by another, so no word draws a
large share of the tokens into one task. Which words are common is settled by what each task sees most
of: a word with more than one ``RARE``-th of all tokens is that frequent in some task. These candidates
are then counted over all rows. Words are kept in packs, a row of arrays each, which a sweep reads and writes whole; the pack of an earlier sweep is
dropped once its successor is stored. Nothing that grows with the corpus passes the driver.

Defined cases: a null text has the end token alone; repeated rows are scored one by one; without
documents outside the fold every token has the uniform probability of one; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketcast.llm.common import delete_folder, fold, gathered, new_folder, small_batches, strings, words
from basketcast.session import delete_at_end

MODULUS, HELD_OUT = 7, 2
COMMON = 4_096            # words scored against a broadcast table, the end token among them
CONTEXTS = 255            # words with a restaurant of their own; all other contexts are number 0
REACH = 4                 # words back in which a context is looked for
BURN_IN, SAMPLES = 2, 3   # BURN_IN at least: it goes on until the totals stay
DRIFT = 0.01              # change of the totals in one sweep, beyond their noise, below which they stay
EXACT = 128               # customers up to which numbers of tables are weighed by the recursion
TAIL, TERMS = 6.0, 120    # heavy tail, in which an alternating sum takes the place of the saddle point
SIZES = np.array([2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 40, 48, 64, 80, 96, EXACT])  # that are weighed together
MOVES, FIRST_MOVES = 2, 12  # of a large number of tables in one sweep, and from no number at all
CANCELLED = 1e-7          # share of the largest term below which the alternating sum is not trusted
STRENGTH = 1.0
END = "\n"                # cannot be a word
BLOCK = 8_000_000
PIECE = 4_000_000         # bytes of text that are cut into words at once when tokens are coded
WORD_ROWS = 4_000         # words in one Arrow batch, and in one pack
PACK_BYTES = 16_000_000   # of the rows of one pack, beyond which the next word opens another
SCORED_ROWS = 8_000       # words and rows of their tokens in one Arrow batch
RARE = 20_000             # a word below this share of a task's tokens is no candidate for the common words
LISTED = 4_096            # blocks whose lists of one word are gathered at once
PACKS = 8                 # packs in one Arrow batch of a sweep
BATCH_BYTES = 4_000_000   # of one Arrow batch, whatever its rows: packs and rows of frequent words are large
FLUSH = 200_000           # sums of tokens that a task gathers before it adds them up by document
SUMS = 600_000            # sums of documents that a task holds before it hands them on
HELD = 3_000_000          # tokens of rare words that a task holds to put the places of a word into one row
FOLLOWERS = np.dtype([("block", "<i8"), ("place", "<i4"), ("c", "<u4"), ("n", "<u4"), ("t", "<u4"), ("context", "u1")])
BEHIND = np.dtype([("place", "<i4"), ("context", "u1")])


@contextmanager
def setting(spark, name: str, value: str) -> Iterator[None]:
    """A Spark setting for the jobs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


# --- Arrays in binary columns ------------------------------------------------

def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary column whose row i holds the next ``counts[i]`` values."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int64) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def unpacked(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows in a row, and how many each has; a null row has none."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    sizes = pc.binary_length(column).to_numpy()
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[start:start + int(sizes.sum())] if data is not None else np.zeros(0, np.uint8)
    return raw.copy().view(dtype), sizes // np.dtype(dtype).itemsize


# --- Seating -------------------------------------------------------------------

class Seats:
    """Tables of many dishes at once: the dish of each table (sorted) and its customers."""

    def __init__(self, dish: np.ndarray, size: np.ndarray, rng: np.random.Generator):
        self.dish, self.size, self.rng = dish, size.astype(np.int64), rng

    def spans(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.dish, who, "left"), np.searchsorted(self.dish, who, "right")

    def take_out(self, who: np.ndarray) -> np.ndarray:
        """Remove a random customer of each dish in ``who`` (distinct); which of them left a table empty."""
        first, last = self.spans(who)
        total = np.concatenate(([0], np.cumsum(self.size)))
        drawn = total[first] + (self.rng.random(len(who)) * (total[last] - total[first])).astype(np.int64)
        table = np.searchsorted(total, drawn, "right") - 1
        self.size[table] -= 1
        return self.size[table] == 0

    def seat(self, who: np.ndarray, fresh: np.ndarray, discount: float) -> np.ndarray:
        """Seat one customer of each dish in ``who``; ``fresh`` weighs a new table. Which of them opened one."""
        full = self.size > 0
        self.dish, self.size = self.dish[full], self.size[full]
        first, last = self.spans(who)
        weight = np.concatenate(([0.0], np.cumsum(self.size - discount)))
        old = weight[last] - weight[first]
        drawn = self.rng.random(len(who)) * (old + fresh)
        new = (drawn >= old) | (last == first)
        at = np.searchsorted(weight, weight[first] + drawn, "right") - 1
        at = np.clip(at, first, np.maximum(first, last - 1))[~new]
        self.size[at] += 1
        if new.any():
            dish = np.concatenate((self.dish, who[new]))
            order = np.argsort(dish, kind="stable")
            self.dish, self.size = dish[order], np.concatenate((self.size, np.ones(int(new.sum()), np.int64)))[order]
        return new

    def counts(self, n: int) -> np.ndarray:
        return np.bincount(self.dish[self.size > 0], minlength=n)


def even_tables(customers: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A start: the customers of each dish spread evenly over its tables."""
    dish = np.repeat(np.arange(len(tables)), tables)
    number = np.arange(len(dish)) - np.repeat(np.cumsum(tables) - tables, tables)
    return dish, customers[dish] // tables[dish] + (number < customers[dish] % tables[dish])


def expected_tables(customers: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(1 + fresh * np.log1p((customers - 1) / np.maximum(fresh, 1e-12))), 1, customers).astype(np.int64)


# --- Numbers of tables ---------------------------------------------------------

def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for small numbers behind seven steps of the recursion."""
    small = x.size and x.min() < 10
    y = x + 7.0 if small else x
    square = 1 / (y * y)
    value = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188)))) / y
    if small:
        rising = np.ones_like(y)
        for k in range(1, 8):
            rising = rising * (y - k)
        value = value - np.log(rising)
    return value


def rising_part(v: np.ndarray, discount: float, parts: bool) -> np.ndarray:
    """Log of z q^(d - 1), by 1 - q^d where ``parts``; falls in v = log q."""
    return np.log(-np.expm1(v)) + (discount - 1) * v - (np.log(-np.expm1(discount * v)) if parts else 0.0)


@lru_cache(maxsize=8)
def solutions(discount: float, parts: bool) -> tuple[np.ndarray, np.ndarray]:
    v = np.exp(np.linspace(np.log(700.0), np.log(1e-13), 8_000))
    # Ascending, as np.interp wants it; at the far end rounding hides the slope.
    return np.maximum.accumulate(rising_part(-v, discount, parts)[::-1]), np.log(v)[::-1]


def solved(target: np.ndarray, discount: float, parts: bool) -> np.ndarray:
    """v = log q with ``rising_part`` at ``target``: read from a table, then by Newton's steps."""
    v = -np.exp(np.interp(target, *solutions(discount, parts)))
    for _ in range(3):
        slope = np.exp(v) / np.expm1(v) + discount - 1 - (discount * np.exp(discount * v) / np.expm1(discount * v) if parts else 0.0)
        v = np.clip(v - (rising_part(v, discount, parts) - target) / np.minimum(slope, -1e-12), np.maximum(1.05 * v, -700.0), 0.95 * v)
    return v


@lru_cache(maxsize=8)
def small_seatings(discount: float) -> np.ndarray:
    """Log of the weight of all seatings of n customers at t tables, both up to ``EXACT``, by the recursion."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1], t = 0.0, np.arange(EXACT + 1)
    for n in range(1, EXACT):
        out[n + 1, 1:n + 1] = out[n, 1:n + 1] + np.log(n - discount * t[1:n + 1])
        out[n + 1, 1:] = np.logaddexp(out[n + 1, 1:], out[n, :-1])
    return out


def log_seatings(n: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Log of the weight of all seatings of ``n`` > ``EXACT`` customers at ``t`` tables.

    It is ``n! / (t! d^t)`` times the probability that ``t`` draws with the generating function ``1 - (1 - z)^d``
    add up to ``n``: a saddle point of second order, and in the heavy tail, where that fails, the alternating sum.
    """
    n, t, d = n.astype(float), t.astype(float), discount
    out = np.zeros(len(n))
    inner = np.flatnonzero(t < n)
    n, t = n[inner], t[inner]
    target = np.log(n / t) - np.log(d)
    u = solved(target, d, True)
    z, g = -np.expm1(u), -np.expm1(d * u)
    drop = n * np.log(z) - t * np.log(g)
    # Derivatives of the generating function by log z, as sums of z^i q^(d - i).
    terms, moments = {1: d}, []
    for _ in range(4):
        moments.append(sum(c * z ** i * np.exp((d - i) * u) for i, c in terms.items()) / g)
        following: dict = {}
        for i, c in terms.items():
            following[i] = following.get(i, 0.0) + i * c
            following[i + 1] = following.get(i + 1, 0.0) + (i - d) * c
        terms = following
    m1, m2, m3, m4 = moments
    k2, k3 = m2 - m1 ** 2, m3 - 3 * m1 * m2 + 2 * m1 ** 3
    k4 = m4 - 4 * m1 * m3 - 3 * m2 ** 2 + 12 * m1 ** 2 * m2 - 6 * m1 ** 4
    second = np.maximum((k4 / k2 ** 2 / 8 - 5 * k3 ** 2 / k2 ** 3 / 24) / t, -0.5)
    value = log_gamma(n + 1) - log_gamma(t + 1) - t * np.log(d) - drop - 0.5 * np.log(2 * np.pi * t * k2) + np.log1p(second)
    tail = np.flatnonzero(drop < TAIL)
    tail = tail[np.argsort(t[tail], kind="stable")]
    for at in np.split(tail, range(2_000, len(tail), 2_000)):
        m, k = n[at], t[at]
        j = np.arange(1, min(TERMS, int(k.max(initial=1))) + 1)[:, None]
        chosen = np.cumsum(np.log(np.maximum(k - j + 1, 1e-300) / j), axis=0)
        size = np.where(j <= k, chosen + log_gamma(m - j * d) + (log_gamma(1 + j * d) - np.log(np.pi)), -np.inf)
        top = size.max(axis=0, initial=-np.inf)
        total = ((-1.0) ** (j + 1) * np.sin(np.pi * j * d) * np.exp(size - top)).sum(axis=0)
        # Where the terms cancel or go on beyond the last one, the sum has no digits, and the saddle point holds.
        whole = (total > CANCELLED) & ((k <= len(j)) | (np.exp(size[-1] - top) < 1e-3 * total))
        sums = np.log(np.maximum(total, 1e-300)) + top - log_gamma(k + 1) - k * np.log(d)
        value[at] = np.where(whole | ~np.isfinite(value[at]), sums, value[at])
    out[inner] = value
    return out


def draw_tables(customers: np.ndarray, log_weight: np.ndarray, discount: float, rng: np.random.Generator, tables: np.ndarray | None = None) -> np.ndarray:
    """Number of tables of each dish when all of its customers are seated anew; a new table weighs ``exp(log_weight)``.

    A number t has the weight ``exp(t * log_weight)`` times that of all seatings at t tables. ``tables``: numbers so far.
    """
    out = np.minimum(customers, 1).astype(np.int64)
    table = small_seatings(discount)
    few = np.flatnonzero((customers > 1) & (customers <= EXACT))
    # Numbers of customers of about the same size go together; beyond their own, weights are zero.
    size = np.searchsorted(SIZES, customers[few])
    order = few[np.argsort(size, kind="stable")]
    for same in np.split(order, np.flatnonzero(np.diff(np.sort(size))) + 1):
        for at in np.split(same, range(10_000, len(same), 10_000)):
            if len(at):
                n = int(SIZES[np.searchsorted(SIZES, customers[at[0]])])
                weight = log_weight[at, None] * np.arange(1, n + 1) + table[customers[at], 1:n + 1]
                total = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
                out[at] = 1 + (total[:, :-1] <= rng.random((len(at), 1)) * total[:, -1:]).sum(axis=1)
    many = np.flatnonzero(customers > EXACT)
    for at in np.split(many, range(20_000, len(many), 20_000)):
        if len(at):
            out[at] = draw_many(customers[at], log_weight[at], discount, rng, None if tables is None else tables[at])
    return out


def draw_many(n: np.ndarray, log_weight: np.ndarray, discount: float, rng: np.random.Generator, tables: np.ndarray | None = None) -> np.ndarray:
    """``draw_tables`` for large numbers of customers: a fixed number of moves that leave the distribution as it is.

    A move proposes a number from a logistic distribution around the middle of the compound Poisson sum of n, whatever
    the number before, and accepts it by the ratio of the weights; the proposal is near the distribution and has
    heavier tails, so that nearly every move is accepted and none waits for one.
    """
    u = solved(np.log(n) - log_weight, discount, False)
    middle = np.exp(log_weight - np.log(discount)) * -np.expm1(discount * u)
    variance = middle - n / (1 + (1 - discount) * np.expm1(-u))
    middle = np.clip(np.where(np.isfinite(middle), middle, np.sqrt(n)), 1, n)
    scale = 0.65 * np.sqrt(np.where(np.isfinite(variance), np.maximum(variance, 1.0), middle))

    def below(t: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh((t - middle) / (2 * scale)))

    def chance(t: np.ndarray) -> np.ndarray:
        """Log of the probability that t is proposed; the ends stand for all beyond them."""
        upper, lower = np.where(t < n, below(t + 0.5), 1.0), np.where(t > 1, below(t - 0.5), 0.0)
        # Far from the middle the difference has no digits left; the density has.
        x = np.abs(t - middle) / scale
        return np.where(upper - lower > 1e-9, np.log(np.maximum(upper - lower, 1e-300)), -x - 2 * np.log1p(np.exp(-x)) - np.log(scale))

    now = np.rint(middle).astype(np.int64) if tables is None else np.clip(tables, 1, n).astype(np.int64)
    height = log_seatings(n, now, discount) + now * log_weight - chance(now)
    for _ in range(FIRST_MOVES if tables is None else MOVES):
        draw = rng.random(len(n))
        new = np.clip(np.rint(middle + scale * (np.log(draw) - np.log1p(-draw))), 1, n).astype(np.int64)
        reached = log_seatings(n, new, discount) + new * log_weight - chance(new)
        accepted = np.log(rng.random(len(n))) < reached - height
        now, height = np.where(accepted, new, now), np.where(accepted, reached, height)
    return now


def all_seatings(n: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """``log_seatings`` for any number of customers."""
    few = np.minimum(n, EXACT)
    out = small_seatings(discount)[few, np.minimum(t, few)]
    many = np.flatnonzero(n > EXACT)
    out[many] = log_seatings(n[many], t[many], discount)
    return out


def draw_alone(tables: np.ndarray, customers: np.ndarray, log_weight: np.ndarray, others: np.ndarray, parent_tables: np.ndarray,
               totals: Totals, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of one pair of each word, with ``others`` customers of the word at the parent from elsewhere.

    The share of the word at the parent is summed over, so that a number is not held near the one before. Drawn from
    a slice of all possible numbers that only shrinks.
    """
    value = lambda at, t: (all_seatings(customers[at], t, totals.discount) + t * log_weight[at]
                           + all_seatings(others[at] + t, parent_tables[at], totals.parent_discount))
    low, high = np.maximum(1, parent_tables - others), customers.copy()
    out, todo = tables.copy(), np.flatnonzero(low < high)
    level = np.full(len(customers), np.inf)
    level[todo] = value(todo, out[todo]) - rng.exponential(size=len(todo))
    while len(todo):
        t = low[todo] + (rng.random(len(todo)) * (high - low + 1)[todo]).astype(np.int64)
        inside = value(todo, t) >= level[todo]
        inside |= t == tables[todo]
        less = t < tables[todo]
        low[todo[~inside & less]] = t[~inside & less] + 1
        high[todo[~inside & ~less]] = t[~inside & ~less] - 1
        out[todo[inside]] = t[inside]
        todo = todo[~inside]
    return out


@dataclass(frozen=True)
class Totals:
    """All that words share: sizes of the restaurants, discounts and the base."""

    customers: np.ndarray     # of each context
    tables: np.ndarray        # of each context
    parent_tables: float
    discount: float
    parent_discount: float
    vocabulary: int

    @property
    def base(self) -> float:
        return 1.0 / (self.vocabulary + 1)

    def parent(self, customers, tables):
        """Probability of words in the parent restaurant."""
        rest = (STRENGTH + self.parent_discount * self.parent_tables) * self.base
        return (customers - self.parent_discount * tables + rest) / (STRENGTH + self.tables.sum())

    def fresh(self) -> np.ndarray:
        """Weight of a new table in each context, before the parent's probability."""
        return STRENGTH + self.discount * self.tables

    def back_off(self) -> np.ndarray:
        return self.fresh() / (STRENGTH + self.customers)


def array_of(pack: dict, name: str, dtype) -> np.ndarray:
    return np.frombuffer(pack[name] or b"", dtype)


def sweep(pack: dict, totals: Totals, rng: np.random.Generator, keep: bool) -> tuple[dict, np.ndarray]:
    """``reseated`` for a pack that lists the customers of every table, ``sizes`` and ``parent_sizes``, pair by pair."""
    n_pairs, customers = array_of(pack, "n_pairs", np.int16), array_of(pack, "customers", np.int64)
    word, numbers = np.repeat(np.arange(len(n_pairs)), n_pairs), {"tables": None, "parent_tables": None}
    if pack["sizes"] is not None:
        # The sizes of a pair's tables add up to its customers.
        number = lambda name, seated: np.diff(np.searchsorted(np.cumsum(array_of(pack, name, np.int64)), np.cumsum(seated)), prepend=-1)
        tables = number("sizes", customers)
        numbers = {"tables": tables.tobytes(), "parent_tables": number("parent_sizes", np.bincount(word, tables, len(n_pairs)).astype(np.int64)).tobytes()}
    out, sums = reseated(pack | numbers, totals, rng, keep)
    tables, parent_tables = array_of(out, "tables", np.int64), array_of(out, "parent_tables", np.int64)
    at_parent = np.bincount(word, tables, len(n_pairs)).astype(np.int64)
    return out | {"sizes": even_tables(customers, tables)[1].tobytes(), "parent_sizes": even_tables(at_parent, parent_tables)[1].tobytes()}, sums


def reseated(pack: dict, totals: Totals, rng: np.random.Generator, keep: bool) -> tuple[dict, np.ndarray]:
    """One Gibbs sweep over a pack of words; also the tables of each context and, last, of the parent.

    A pack carries numbers of tables alone, one for each pair and word, however many tables there are.
    """
    n_pairs = array_of(pack, "n_pairs", np.int16)
    contexts, customers = array_of(pack, "contexts", np.uint8), array_of(pack, "customers", np.int64)
    n, word = len(n_pairs), np.repeat(np.arange(len(n_pairs)), n_pairs)
    weight = totals.fresh()[contexts]
    if pack["tables"] is None:  # the first sweep
        spread = np.bincount(word, minlength=n).astype(float)
        tables = expected_tables(customers, weight * totals.parent(spread, np.ones(n))[word])
        parent_tables = np.ones(n, np.int64)
        sums, parents = np.zeros(len(customers), np.int32), np.zeros((n, 0), np.int64)
    else:
        tables, parent_tables = array_of(pack, "tables", np.int64), array_of(pack, "parent_tables", np.int64)
        sums, parents = array_of(pack, "table_sums", np.int32), array_of(pack, "parents", np.int64).reshape(n, -1)
    fresh = (STRENGTH + totals.parent_discount * totals.parent_tables) * totals.base
    # Given the share that the parent gives to a word, its pairs do not depend on each other.
    at_parent, scale = np.bincount(word, tables, n), STRENGTH + totals.tables.sum()
    share = rng.gamma(at_parent - totals.parent_discount * parent_tables + fresh) / scale
    tables = draw_tables(customers, np.log(weight * np.maximum(share, 1e-300)[word]), totals.discount, rng, tables)
    # The largest pair of each word once more, whatever the share.
    most = np.lexsort((customers, word))[np.cumsum(n_pairs, dtype=np.int64) - 1]
    at_parent = np.bincount(word, tables, n).astype(np.int64)
    parent_tables = draw_tables(at_parent, np.full(n, np.log(fresh)), totals.parent_discount, rng, parent_tables)
    tables[most] = draw_alone(tables[most], customers[most], np.log(weight[most] / scale), at_parent - tables[most], parent_tables, totals, rng)
    at_parent = np.bincount(word, tables, n).astype(np.int64)
    parent_tables = draw_tables(at_parent, np.full(n, np.log(fresh)), totals.parent_discount, rng, parent_tables)
    if keep:
        # Customers and tables of each word at the parent, for every kept sweep.
        sums, parents = sums + tables.astype(np.int32), np.hstack((parents, at_parent[:, None], parent_tables[:, None]))
    out = pack | {"tables": tables.astype(np.int64).tobytes(), "parent_tables": parent_tables.astype(np.int64).tobytes(), "table_sums": sums.tobytes(),
                  "parents": np.ascontiguousarray(parents, np.int64).tobytes()}
    return out, np.append(np.bincount(contexts, tables, CONTEXTS + 1), parent_tables.sum()).astype(np.int64)


PACK = ["names", "n_pairs", "contexts", "customers", "tables", "parent_tables", "table_sums", "parents"]
PACK_SCHEMA = ", ".join(f"{c} binary" for c in PACK)


# --- From text to counts ---------------------------------------------------------

def tokens(block: pa.RecordBatch) -> tuple[np.ndarray, list, np.ndarray]:
    """Code of each token with the end of every text, names by code, text of each token."""
    codes, distinct, rows = words(strings(block.column("text")))
    size = np.bincount(rows, minlength=len(block)) if len(rows) else np.zeros(len(block), np.int64)
    ends = np.cumsum(size)
    codes = np.insert(codes.astype(np.int64), ends, len(distinct))
    return codes, pa.concat_arrays([distinct, pa.array([END])]), np.insert(rows.astype(np.int64), ends, np.arange(len(block)))


def occurrences_of_words(block: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """Names of ``tokens`` and how often each comes."""
    codes, distinct, _ = words(strings(block.column("text")))
    return pa.concat_arrays([distinct, pa.array([END])]), np.append(np.bincount(codes, minlength=len(distinct)), len(block))


def frequent_words(docs: DataFrame) -> DataFrame:
    """``word, c``: words that make up a ``RARE``-th of the tokens of some task, with all their tokens."""
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = 0, None
        for block in gathered(batches, limit=BLOCK):
            names, count = occurrences_of_words(block)
            # What a word may have lost before it came (back) counts for it when rare words are let go.
            found = pa.table({"word": names, "c": pa.array(count), "lost": pa.array(np.full(len(names), total / (2 * RARE)))})
            total += int(count.sum())
            held = found if held is None else pa.concat_tables([held, found])
            held = held.group_by("word").aggregate([("c", "sum"), ("lost", "min")]).rename_columns(["word", "c", "lost"])
            held = held.filter(pc.greater_equal(pc.add(held.column("c"), held.column("lost")), total / (2 * RARE)))
        if held is not None:
            often = held.filter(pc.greater_equal(pc.add(held.column("c"), held.column("lost")), total / RARE))
            yield from often.select(["word"]).combine_chunks().to_batches()

    train = docs.filter(~F.col("held_out")).select("text")
    wanted = [r["word"] for r in train.mapInArrow(candidates, "word string").distinct().collect()]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, count = pa.array(wanted, pa.string()), np.zeros(len(wanted), np.int64)
        for block in gathered(batches, limit=BLOCK):
            names, found = occurrences_of_words(block)
            which = pc.fill_null(pc.index_in(names, value_set=table), -1).to_numpy()
            known = which >= 0
            count[which[known]] += found[known]
        used = pa.array(np.flatnonzero(count))
        yield pa.RecordBatch.from_arrays([table.take(used), pa.array(count).take(used)], names=["word", "c"])

    return train.mapInArrow(counts, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def renumbered(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes below ``n`` that occur, ascending, and for every token the place of its code among them."""
    used = np.flatnonzero(np.bincount(codes, minlength=n))
    number = np.zeros(n, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    return used, number[codes]


def contexts_of(numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Context of each token from the context number of every token (0: none)."""
    out = np.zeros(len(numbers), np.uint8)
    for back in range(1, REACH + 1):
        here = (out[back:] == 0) & (rows[back:] == rows[:-back])
        out[back:][here] = numbers[:-back][here]
    return out


def places_of_words(number: int, held: list[tuple]) -> pa.RecordBatch:
    """A row for each word of a block, from the pieces of its texts: their words, and code, place and context of every token."""
    names = pa.concat_arrays([piece[0] for piece in held]).dictionary_encode()
    starts = np.cumsum([0] + [len(piece[0]) for piece in held])
    indices = names.indices.to_numpy()
    codes = np.concatenate([indices[start + piece[1]] for start, piece in zip(starts, held)])
    order = np.argsort(codes, kind="stable")
    place, context = (np.concatenate([piece[i] for piece in held])[order] for i in (2, 3))
    n, count = len(names.dictionary), np.bincount(codes, minlength=len(names.dictionary))
    return pa.RecordBatch.from_arrays(
        [pa.array(["word"] * n, pa.string()), pa.array([number] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()),
         pa.nulls(n, pa.int64()), names.dictionary, packed(place, count), packed(context, count)], names=CODED)


def followers_of_words(number: int, held: list[tuple]) -> pa.RecordBatch:
    """A row for each word, if not one of the contexts, that stands before others: their places and contexts, and their
    names line by line.

    Pieces have names, code of the word before, code, place, context. The end token is an empty line.
    """
    names = pa.concat_arrays([piece[0] for piece in held]).dictionary_encode()
    starts = np.cumsum([0] + [len(piece[0]) for piece in held])
    indices = names.indices.to_numpy()
    before, code = (np.concatenate([indices[start + piece[i]] for start, piece in zip(starts, held)]) for i in (1, 2))
    order = np.argsort(before, kind="stable")
    count = np.bincount(before, minlength=len(names.dictionary))
    used = np.flatnonzero(count)
    n, place = len(used), np.empty(len(order), BEHIND)
    place["place"], place["context"] = (np.concatenate([piece[i] for piece in held])[order] for i in (3, 4))
    lines = pc.replace_with_mask(names.dictionary, pc.equal(names.dictionary, END), "").take(pa.array(code[order]))
    lines = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(count[used]))).astype(np.int32), lines)
    return pa.RecordBatch.from_arrays(
        [pa.array(["next"] * n, pa.string()), pa.array([number] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()),
         pa.nulls(n, pa.int64()), names.dictionary.take(pa.array(used)), packed(place, count[used]), pc.binary_join(lines, "\n").cast(pa.binary())], names=CODED)


def encode(docs: DataFrame, common: list[str], path: str) -> None:
    """Write documents with the tokens of common words (``kind=doc``), the places of all others (``kind=word``), and what
    follows each word that is no context (``kind=next``)."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        table = pa.array(common, pa.string())
        # Texts are cut into words piece by piece; a block, in which documents have their places, is several pieces.
        before, held, following, size = 0, [], [], 0
        for block in gathered(batches, limit=PIECE):
            n = len(block)
            codes, names, rows = tokens(block)
            known = pc.fill_null(pc.index_in(names, value_set=table), -1).to_numpy()
            which = known[codes]
            # The first common words name the contexts; the end token is the last common word.
            numbers = np.where((which >= 0) & (which < min(CONTEXTS, len(common) - 1)), which + 1, 0).astype(np.uint8)
            context = contexts_of(numbers, rows)
            often = which >= 0
            count = np.bincount(rows[often], minlength=n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["doc"] * n, pa.string()), pa.array([number] * n, pa.int64()), pa.array(np.arange(before, before + n, dtype=np.int32)), block.column("doc_id"),
                 block.column("held_out"), pa.array(np.bincount(rows, minlength=n).astype(np.int64)), pa.nulls(n, pa.string()),
                 packed(which[often].astype(np.uint16), count), packed(context[often], count)], names=CODED)
            # Places of held-out documents are negative: they are scored but not counted.
            out = block.column("held_out").to_numpy(zero_copy_only=False)[rows]
            place = np.where(out, ~(rows + before), rows + before).astype(np.int32)
            behind = 1 + np.flatnonzero((numbers[:-1] == 0) & (rows[1:] == rows[:-1]))
            if len(behind):
                used, at = renumbered(np.concatenate((codes[behind - 1], codes[behind])), len(names))
                following.append((names.take(pa.array(used)), at[:len(behind)], at[len(behind):], place[behind], context[behind]))
            codes, place, context = codes[~often], place[~often], context[~often]
            used, codes = renumbered(codes, len(names))
            held.append((names.take(pa.array(used)), codes, place, context))
            before, size = before + n, size + max(len(codes), len(behind))
            if size >= HELD:
                # Neither waits in memory for the other to be written.
                yield places_of_words(number, held)
                held = []
                if following:
                    yield followers_of_words(number, following)
                number, before, following, size = number + 1, 0, [], 0
        if held:
            yield places_of_words(number, held)
        held = []
        if following:
            yield followers_of_words(number, following)
        # Workers live on and would keep the room for texts through all sweeps.
        held = following = block = codes = names = rows = numbers = context = place = behind = None
        pa.default_memory_pool().release_unused()

    schema = "kind string, block long, place int, doc_id long, held_out boolean, n_tokens long, word string, a binary, b binary"
    # One open file for each kind, in place of sorting all rows by it.
    with setting(docs.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", "3"):
        docs.select("doc_id", "held_out", "text").mapInArrow(each, schema).write.option("compression", "zstd").partitionBy("kind").parquet(path)


CODED = ["kind", "block", "place", "doc_id", "held_out", "n_tokens", "word", "a", "b"]


def common_pairs(coded: DataFrame, common: list[str]) -> DataFrame:
    """Packs of the common words: counted inside the tasks, then summed by pair."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(common), CONTEXTS + 1), np.int64)
        for batch in batches:
            which, _ = unpacked(batch.column("a"), np.uint16)
            context, _ = unpacked(batch.column("b"), np.uint8)
            count += np.bincount(which.astype(np.int64) * (CONTEXTS + 1) + context, minlength=count.size).reshape(count.shape)
        word, context = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(common, pa.string()).take(pa.array(word)), pa.array(context.astype(np.int32)), pa.array(count[word, context])],
                                         names=["word", "context", "c"])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, n = batch.column("contexts").flatten().to_numpy().astype(np.uint8), batch.column("contexts").value_lengths().to_numpy()
            yield new_pack(batch.column("word"), context, batch.column("customers").flatten().to_numpy(), n)

    rows = coded.filter("kind = 'doc' AND NOT held_out").select("a", "b").mapInArrow(each, "word string, context int, c long")
    # A word has at most as many pairs as there are contexts.
    pairs = rows.groupBy("word", "context").agg(F.sum("c").alias("c")).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("context", "c"))).alias("p"))
    return pairs.select("word", F.col("p.context").alias("contexts"), F.col("p.c").alias("customers")).mapInArrow(packs, PACK_SCHEMA)


def new_pack(names: pa.Array, contexts: np.ndarray, customers: np.ndarray, n_pairs: np.ndarray) -> pa.RecordBatch:
    """One row with the counts of many words; seating comes with the first sweep."""
    cells = ["\n".join(names.to_pylist()).encode() if n_pairs[:1].size else b"", n_pairs.astype(np.int16).tobytes(), contexts.astype(np.uint8).tobytes(),
             customers.astype(np.int64).tobytes()]
    return pa.RecordBatch.from_arrays([*[pa.array([c], pa.binary()) for c in cells], *[pa.nulls(1, pa.binary())] * 4], names=PACK)


def counted(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """From the contexts of every occurrence, list by list: keys (row * 256 + context) and how often each came."""
    context, n = unpacked(lists.flatten(), np.uint8)
    row = np.repeat(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), n)
    return np.unique(row * 256 + context, return_counts=True)


def whole_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """From rows in order of word, those of ``WORD_ROWS`` words at a time, and which row is the first of a word.

    Rows of more than ``PACK_BYTES`` are handed on with the end of their last word.
    """
    held: list[pa.RecordBatch] = []
    n, last = 0, None

    def joined() -> tuple[pa.RecordBatch, np.ndarray]:
        rows = pa.concat_batches(held)
        word = rows.column("word")
        return rows, np.concatenate(([True], pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)))

    for batch in batches:
        if not len(batch):
            continue
        word = batch.column("word")
        first = np.concatenate(([word[0].as_py() != last], pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)))
        last, start, place = word[-1].as_py(), 0, np.flatnonzero(first)
        while n + len(place) > WORD_ROWS:
            # The next word opens another pack.
            end = int(place[WORD_ROWS - n])
            held.append(batch.slice(start, end - start))
            yield joined()
            held, start, place, n = [], end, place[WORD_ROWS - n:], 0
        held.append(batch.slice(start))
        n += len(place)
        if sum(rows.nbytes for rows in held) > PACK_BYTES:
            n = WORD_ROWS
    if held:
        yield joined()


def other_pairs(coded: DataFrame) -> DataFrame:
    """Packs of all other words. Occurrences of a word are gathered by ``LISTED`` blocks; where there are
    more blocks, the counts of those slices are added up in a second step."""
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, n = unpacked(batch.column("a"), np.int32)
            context, _ = unpacked(batch.column("b"), np.uint8)
            train = place >= 0
            n = np.bincount(np.repeat(np.arange(len(batch)), n)[train], minlength=len(batch))
            out = pa.RecordBatch.from_arrays([batch.column("word"), batch.column("slice"), packed(context[train], n)], names=["word", "slice", "contexts"])
            yield out.filter(pa.array(n > 0))

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first in whole_words(batches):
            context, n = unpacked(rows.column("contexts"), np.uint8)
            word = np.repeat(np.cumsum(first) - 1, n)
            key, count = np.unique(word * 256 + context, return_counts=True)
            yield new_pack(rows.column("word").filter(pa.array(first)), key % 256, count, np.bincount(key // 256, minlength=int(first.sum())))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, count = counted(batch.column("contexts"))
            yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(key // 256)), pa.array((key % 256).astype(np.int32)), pa.array(count)],
                                             names=["word", "context", "c"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, n = batch.column("contexts").flatten().to_numpy().astype(np.uint8), batch.column("contexts").value_lengths().to_numpy()
            yield new_pack(batch.column("word"), context, batch.column("customers").flatten().to_numpy(), n)

    blocks = coded.filter("kind = 'doc' AND place = 0").count()
    slices = 1 + blocks // LISTED
    rows = coded.filter("kind = 'word'").select("word", F.pmod(F.hash("block"), F.lit(slices)).alias("slice"), "a", "b")
    found = rows.mapInArrow(occurrences, "word string, slice int, contexts binary")
    if slices == 1:
        # Rows of a word stand together after sorting; nearly all words have few, which is not worth an aggregate.
        return found.repartition("word", "slice").sortWithinPartitions("word").select("word", "contexts").mapInArrow(packs, PACK_SCHEMA)
    gathered_rows = found.groupBy("word", "slice").agg(F.collect_list("contexts").alias("contexts"))
    pairs = gathered_rows.mapInArrow(sums, "word string, context int, c long").groupBy("word", "context").agg(F.sum("c").alias("c"))
    pairs = pairs.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("context", "c"))).alias("p"))
    pairs = pairs.select("word", F.col("p.context").alias("contexts"), F.col("p.c").alias("customers"))
    return pairs.sortWithinPartitions("word").mapInArrow(merged, PACK_SCHEMA)


def follower_counts(coded: DataFrame) -> DataFrame:
    """``word, followers``: of every token behind a word that is no context, by its own word, block and place, how often the
    word before it has this follower (c) and any (n), how many followers (t), and the token's own context. Rows without a
    word: ``sums`` of pairs seen once and twice.

    All that follows a word comes together in one task; where there are more than ``LISTED`` blocks, a word may
    be too much for that, and Spark adds up and joins the counts.
    """
    def split(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Row, block, place, context and name of each follower."""
        found, n = unpacked(rows.column("a"), BEHIND)
        row = np.repeat(np.arange(len(rows)), n)
        return row, rows.column("block").to_numpy()[row], found["place"], found["context"], pc.split_pattern(rows.column("b").cast(pa.string()), "\n").flatten()

    def by_word(names: pa.Array, code: np.ndarray, block, place, c, n, t, context) -> pa.RecordBatch:
        out = np.empty(len(code), FOLLOWERS)
        for name, value in zip(FOLLOWERS.names, (block, place, c, n, t, context)):
            out[name] = value
        count = np.bincount(code, minlength=len(names))
        used = np.flatnonzero(count)
        names = pc.replace_with_mask(names, pc.equal(names, ""), END).take(pa.array(used))
        return pa.RecordBatch.from_arrays([names, packed(out[np.argsort(code, kind="stable")], count[used]), pa.nulls(len(used), pa.list_(pa.int64()))],
                                          names=["word", "followers", "sums"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2, np.int64)
        for rows, first in whole_words(batches):
            row, block, place, context, names = split(rows)
            names = names.dictionary_encode()
            code, before = names.indices.to_numpy(), (np.cumsum(first) - 1)[row]
            key, at = np.unique(before * len(names.dictionary) + code, return_inverse=True)
            c, n = np.bincount(at, place >= 0, len(key)).astype(np.int64), np.bincount(before, place >= 0)
            t = np.bincount(key // len(names.dictionary), c > 0)
            sums += [(c == 1).sum(), (c == 2).sum()]
            known = n[before] > 0  # a word that is not in the training rows says nothing
            yield by_word(names.dictionary, code[known], block[known], place[known], c[at[known]], n[before[known]], t[before[known]],
                          context[known])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.array([sums.tolist()], pa.list_(pa.int64()))],
                                         names=["word", "followers", "sums"])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, block, place, context, names = split(batch)
            yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(row)), names, pa.array(block), pa.array(place), pa.array(context.astype(np.int32))],
                                             names=["before", "name", "block", "place", "context"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("name").dictionary_encode()
            yield by_word(names.dictionary, names.indices.to_numpy(), *(batch.column(c).to_numpy() for c in FOLLOWERS.names))

    schema = "word string, followers binary, sums array<long>"
    rows = coded.filter("kind = 'next'").select("word", "block", "a", "b")
    if coded.filter("kind = 'doc' AND place = 0").count() <= LISTED:
        return rows.repartition("word").sortWithinPartitions("word").mapInArrow(together, schema)
    tokens_ = rows.mapInArrow(apart, "before string, name string, block long, place int, context int")
    pairs = tokens_.filter("place >= 0").groupBy("before", "name").agg(F.count("*").alias("c"))
    words_ = pairs.groupBy("before").agg(F.sum("c").alias("n"), F.count("*").alias("t"))
    found = tokens_.join(pairs, ["before", "name"], "left").join(words_, "before").select("name", "block", "place", F.coalesce("c", F.lit(0)).alias("c"), "n", "t", "context")
    sums = pairs.agg(F.array(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).alias("sums"))
    return found.mapInArrow(joined, schema).unionByName(sums.select(F.lit(None).cast("string").alias("word"), F.lit(None).cast("binary").alias("followers"), "sums"))


# --- The model -------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    words: DataFrame              # packs behind the last sweep
    common: list[str]
    samples: list[Totals]
    train_tokens: int
    followers: DataFrame          # counts of the level below the contexts
    follower_discount: float


def kneser_ney(ones: float, twos: float) -> float:
    """Discount from how many counts are one and two."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def discount_of(packs: DataFrame) -> tuple[float, float, np.ndarray, int]:
    """Discounts of contexts and parent, customers and tables-to-begin-with of each context, number of words."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * (CONTEXTS + 1) + 5, np.int64)
        for batch in batches:
            for pack in packs_of(batch):
                context, count, n = array_of(pack, "contexts", np.uint8), array_of(pack, "customers", np.int64), array_of(pack, "n_pairs", np.int16)
                sums[:CONTEXTS + 1] += np.bincount(context, count, CONTEXTS + 1).astype(np.int64)
                sums[CONTEXTS + 1:-5] += np.bincount(context, minlength=CONTEXTS + 1)
                sums[-5:] += [(count == 1).sum(), (count == 2).sum(), (n == 1).sum(), (n == 2).sum(), len(n)]
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["sums"])

    sums = summed(packs.select("n_pairs", "contexts", "customers").mapInArrow(each, "sums array<long>"), 2 * (CONTEXTS + 1) + 5)
    return kneser_ney(*sums[-5:-3]), kneser_ney(*sums[-3:-1]), sums[:2 * (CONTEXTS + 1)].reshape(2, -1), int(sums[-1])


def summed(rows: DataFrame, n: int) -> np.ndarray:
    """Sum of equally long arrays, a few hundred numbers, brought to the driver."""
    out = np.zeros(n, np.int64)
    for at, value in rows.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v")).collect():
        out[at] = value
    return out


def fit(docs: DataFrame, path: str) -> Model:
    """Model of the rows of ``docs`` (``doc_id, held_out, text``) outside the fold; the coded tokens go to ``path``."""
    spark = docs.sparkSession
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    top = frequent_words(docs).filter(F.col("word") != END).orderBy(F.desc("c"), "word").limit(COMMON - 1).collect()
    common = [r["word"] for r in top] + [END]
    encode(docs, common, path)
    # From here on rows are words: many of them fit into a batch.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(WORD_ROWS))
    coded = coded_tokens(spark, path)
    at = new_folder(spark, "seating")
    common_pairs(coded, common).unionByName(other_pairs(coded)).write.option("compression", "zstd").parquet(at)
    delete_at_end(spark, at)
    packs = spark.read.schema(PACK_SCHEMA).parquet(at)
    discount, parent_discount, (customers, tables), vocabulary = discount_of(packs)
    totals = Totals(customers, tables, float(vocabulary), discount, parent_discount, vocabulary)
    next_to = new_folder(spark, "followers")
    follower_counts(coded).write.option("compression", "zstd").parquet(next_to)
    delete_folder(spark, f"{path}/kind=next")
    delete_at_end(spark, next_to)
    followers = spark.read.schema("word string, followers binary, sums array<long>").parquet(next_to)
    follower_discount = kneser_ney(*summed(followers.filter("sums IS NOT NULL"), 2))
    samples = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PACKS))
    turn, moving = 0, True
    while len(samples) < SAMPLES:
        keep = turn >= BURN_IN and not moving
        before, earlier = totals, packs
        packs, totals = swept(earlier, totals, turn, keep)
        if turn:
            earlier.unpersist()
        turn, moving = turn + 1, drifting(before, totals)
        if keep:
            samples.append(totals)
            moving = False
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SCORED_ROWS))
    return Model(packs.filter("names IS NOT NULL").select(*PACK), common, samples, int(customers.sum()),
                 followers.filter("word IS NOT NULL").select("word", "followers"), follower_discount)


def drifting(before: Totals, after: Totals) -> bool:
    """Whether the numbers of tables changed by more than their noise and ``DRIFT`` of them."""
    old, new = np.append(before.tables, before.parent_tables), np.append(after.tables, after.parent_tables)
    moved, noise = np.abs(new - old), 4 * np.sqrt(new)
    return bool(moved[:-1].sum() > noise[:-1].sum() + DRIFT * new[:-1].sum() or moved[-1] > noise[-1] + DRIFT * new[-1])


def swept(before: DataFrame, totals: Totals, turn: int, keep: bool) -> tuple[DataFrame, Totals]:
    """All words after a sweep, and the totals that it leaves.

    A sweep is kept on the executors' disks, as it is read once or twice and easily made again from the one before:
    for every file that a task writes to a folder, Hadoop starts processes beside the executor to set its rights.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CONTEXTS + 2, np.int64)
        for batch in batches:
            for pack in packs_of(batch):
                # The same words in a pack draw the same numbers, whichever task has them.
                rng = np.random.default_rng([turn, zlib.crc32(pack["names"] or b""), zlib.crc32(pack["customers"] or b"")])
                out, tables = reseated(pack, totals, rng, keep)
                sums += tables
                yield pa.RecordBatch.from_arrays([*[pa.array([out[c]], pa.binary()) for c in PACK], pa.nulls(1, pa.list_(pa.int64()))], names=[*PACK, "sums"])
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.binary())] * len(PACK), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=[*PACK, "sums"])

    after = before.filter("names IS NOT NULL").select(*PACK).mapInArrow(each, PACK_SCHEMA + ", sums array<long>").persist(StorageLevel.DISK_ONLY)
    sums = summed(after.filter("names IS NULL"), CONTEXTS + 2)
    return after, Totals(totals.customers, sums[:-1], float(sums[-1]), totals.discount, totals.parent_discount, totals.vocabulary)


STATE = ["contexts", "customers", "table_sums", "parents"]
STATE_SCHEMA = "word string, contexts binary, customers binary, table_sums binary, parents binary"


def model_words(packs: DataFrame) -> DataFrame:
    """One row per word of the model."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in packs_of(batch):
                n = array_of(pack, "n_pairs", np.int16)
                if not len(n):
                    continue
                parents = array_of(pack, "parents", np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names_of(pack), pa.string()), packed(array_of(pack, "contexts", np.uint8), n), packed(array_of(pack, "customers", np.int64), n),
                     packed(array_of(pack, "table_sums", np.int32), n), packed(parents, np.full(len(n), len(parents) // len(n)))],
                    names=["word", "contexts", "customers", "table_sums", "parents"])

    return packs.select(*PACK).mapInArrow(each, STATE_SCHEMA)


def packs_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """One pack at a time, as they are large."""
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]


def names_of(pack: dict) -> list[str]:
    """Words of a pack; the end token, itself a line end, shows as two empty names."""
    names = pack["names"].decode().split("\n")
    if len(names) > len(array_of(pack, "n_pairs", np.int16)):
        at = names.index("")
        names[at:at + 2] = [END]
    return names


def coded_tokens(spark, path: str) -> DataFrame:
    return spark.read.schema("block long, place int, doc_id long, held_out boolean, n_tokens long, word string, a binary, b binary, kind string").parquet(path)


# --- Scores ------------------------------------------------------------------------

def predictive(batch: pa.RecordBatch, samples: list[Totals]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the words of a batch: key (row * 256 + context) and averaged probability of each pair, parent probabilities
    (word x sample), tokens of each word. Rows without a model are unknown words."""
    context, n = unpacked(batch.column("contexts"), np.uint8)
    customers, _ = unpacked(batch.column("customers"), np.int64)
    tables, _ = unpacked(batch.column("table_sums"), np.int32)
    found, per_word = unpacked(batch.column("parents"), np.int64)
    seats = np.zeros((len(batch), len(samples), 2))
    seats[per_word > 0] = found.reshape(-1, len(samples), 2)
    parents = np.stack([t.parent(seats[:, s, 0], seats[:, s, 1]) for s, t in enumerate(samples)], axis=1)
    row = np.repeat(np.arange(len(batch)), n)
    first = samples[0]
    own = (customers - first.discount * tables / len(samples)) / (STRENGTH + first.customers[context])
    rest = np.mean([t.back_off()[context] * parents[row, s] for s, t in enumerate(samples)], axis=0) if len(row) else own
    return row * 256 + context, own + rest, parents, np.bincount(row, customers, len(batch))


def with_models(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """From rows in order of word, the model of each first (``d`` is not null): batches, and for each row the row
    with the model of its word, -1 if there is none. A word that goes on in the next batch takes its model along."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        if last is not None and last.column("word")[0] == batch.column("word")[0]:
            batch = pa.concat_batches([last, batch])
        word = batch.column("word")
        first = np.concatenate(([True], pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)))
        start = np.flatnonzero(first)
        known = pc.is_valid(batch.column("d")).to_numpy(zero_copy_only=False)[start]
        yield batch, np.where(known, start, -1)[np.cumsum(first) - 1]
        last = batch.slice(start[-1], 1) if known[-1] else None


def mean_back_off(parents: np.ndarray, samples: list[Totals]) -> np.ndarray:
    """Probability of each word (row) in each context where it was not seen."""
    return parents @ np.array([t.back_off() for t in samples]) / len(samples)


def gains(followers: np.ndarray, parent: np.ndarray, discount: float) -> np.ndarray:
    """What the word before a token adds to its log10 probability in its context, ``parent``."""
    c, n, t = (followers[name].astype(float) for name in ("c", "n", "t"))
    return np.log10((np.maximum(c - discount, 0) / parent + STRENGTH + discount * t) / (STRENGTH + n))


def score(model: Model, path: str) -> DataFrame:
    """Every document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10)."""
    samples, common, n = model.samples, model.common, model.train_tokens
    base_floor = np.log10(n + samples[0].vocabulary + 1)
    wanted = model.words.sparkSession.createDataFrame([(w, i) for i, w in enumerate(common)], "word string, number int")
    # At most COMMON words with CONTEXTS pairs each.
    rows = model_words(model.words).join(F.broadcast(wanted), "word").select("number", "word", "contexts", "customers", "table_sums", "parents").toArrow()
    often = np.zeros((len(common), CONTEXTS + 1), np.float32)
    base, known = np.full(len(common), -base_floor), np.zeros(len(common), np.int64)
    unknown = mean_back_off(np.array([[t.parent(0.0, 0.0) for t in samples]]), samples)
    often[:] = np.log10(unknown)
    for batch in rows.combine_chunks().to_batches():
        key, probability, parents, count = predictive(batch, samples)
        number = batch.column("number").to_numpy()
        often[number] = np.log10(mean_back_off(parents, samples))
        often[number[key // 256], key % 256] = np.log10(probability)
        base[number], known[number] = np.log10(count + 1) - base_floor, count > 0

    def of_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, size = unpacked(batch.column("a"), np.uint16)
            context, _ = unpacked(batch.column("b"), np.uint8)
            row, m = np.repeat(np.arange(len(batch)), size), len(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("place"), batch.column("doc_id"), batch.column("held_out"), batch.column("n_tokens"),
                 pa.array(np.bincount(row, known[which], m).astype(np.int64)), pa.array(np.bincount(row, base[which], m)),
                 pa.array(np.bincount(row, often[which, context], m))], names=names)

    back_off = np.array([t.back_off() for t in samples]).T / len(samples)

    def by_block(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """Rows of blocks from block, place, known, base and score of tokens, added up as far as a task can hold them."""
        held, size, total = [], 0, None

        def added(parts):
            keys = np.concatenate([np.stack(p[:2], axis=1) for p in parts])
            order = np.lexsort(keys.T[::-1])
            keys = keys[order]
            start = np.flatnonzero(np.any(np.diff(keys, axis=0, prepend=-1) != 0, axis=1)) if len(keys) else np.zeros(0, int)
            sums = [np.add.reduceat(np.concatenate([p[i] for p in parts])[order], start) if len(keys) else np.zeros(0) for i in (2, 3, 4)]
            return (keys[start, 0], keys[start, 1], *sums)

        def rows_of(part):
            """One row per block with the sums of its documents."""
            block, count = np.unique(part[0], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(block), packed(part[1].astype(np.int32), count), packed(part[2].astype(np.int32), count),
                                               packed(part[3], count), packed(part[4], count)], names=["block", "places", "known", "base", "score"])

        for part in parts:
            held.append(added([part]))
            size += len(held[-1][0])
            if size > FLUSH:
                held, size, total = [], 0, added(held if total is None else [total, *held])
                if len(total[0]) > SUMS:
                    yield rows_of(total)
                    total = None
        if held or total is not None:
            yield rows_of(added(held if total is None else [total, *held]))

    follower_discount = model.follower_discount

    def gained(column: pa.Array, number: np.ndarray, in_context: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple:
        """Block, place and gain of followers, by the probability of each row's word (``number``) in their contexts."""
        followers, size = unpacked(column, FOLLOWERS)
        place = followers["place"].astype(np.int64)
        none = np.zeros(len(place))
        return (followers["block"], np.where(place < 0, ~place, place), none.astype(np.int64), none,
                gains(followers, in_context(np.repeat(number, size), followers["context"].astype(np.int64)), follower_discount))

    def of_common_followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(common, pa.string())
        yield from by_block(gained(batch.column("followers"), pc.index_in(batch.column("word"), value_set=table).to_numpy(),
                                   lambda word, context: 10.0 ** often[word, context].astype(float)) for batch in batches)

    def of_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_block(part for batch, of in with_models(batches) for part in parts_of(batch, of))

    def parts_of(batch: pa.RecordBatch, of: np.ndarray) -> Iterator[tuple]:
        """Tokens of a batch; ``of``: the row with the model of each row's word, or -1."""
        models = np.flatnonzero(of == np.arange(len(batch)))
        # The last of the models is that of all words without one.
        number = np.full(len(batch) + 1, len(models))
        number[models] = np.arange(len(models))
        state = batch.select(list("abcd")).take(pa.array(np.append(models, -1), mask=np.append(models, -1) < 0))
        key, probability, parents, count = predictive(pa.RecordBatch.from_arrays(state.columns, names=STATE), samples)
        in_text = pc.is_valid(batch.column("block")).to_numpy(zero_copy_only=False)
        behind = ~in_text & pc.is_null(batch.column("d")).to_numpy(zero_copy_only=False)
        found = batch.filter(pa.array(in_text))
        place, size = unpacked(found.column("a"), np.int32)
        context, _ = unpacked(found.column("b"), np.uint8)
        row = np.repeat(number[of][in_text], size)

        def in_context(row: np.ndarray, context: np.ndarray) -> np.ndarray:
            value = (parents[row] * back_off[context]).sum(axis=1)
            if len(key):
                wanted_key = row * 256 + context
                at = np.minimum(np.searchsorted(key, wanted_key), len(key) - 1)
                value = np.where(key[at] == wanted_key, probability[at], value)
            return value

        block = np.repeat(found.column("block").to_numpy(), size)
        yield (block, np.where(place < 0, ~place, place).astype(np.int64), (count > 0).astype(np.int64)[row],
               (np.log10(count + 1) - base_floor)[row], np.log10(in_context(row, context)))
        yield gained(batch.column("a").filter(pa.array(behind)), number[of][behind], in_context)

    def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("places")
            place, n = unpacked(lists.flatten(), np.int32)
            row = np.repeat(np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy()), n)
            key, at = np.unique(row.astype(np.int64) << 32 | place, return_inverse=True)
            known, base, score_ = (np.bincount(at, unpacked(batch.column(c).flatten(), kind)[0], len(key))
                                   for c, kind in (("known", np.int32), ("base", np.float64), ("score", np.float64)))
            m = len(key)
            yield pa.RecordBatch.from_arrays(
                [batch.column("block").take(pa.array(key >> 32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()),
                 pa.array(np.zeros(m, np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score_)], names=names)

    names = ["block", "place", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    schema = "block long, place int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    coded = coded_tokens(model.words.sparkSession, path)
    documents = coded.filter("kind = 'doc'").select("block", "place", "doc_id", "held_out", "n_tokens", "a", "b").mapInArrow(of_common, schema)
    model_rows = model_words(model.words)
    sums = "block long, places binary, known binary, base binary, score binary"
    is_common = F.broadcast(wanted.select("word"))
    # Tokens have a block, places (a) and contexts (b); followers have them in a; models are the rows with a d.
    empty = lambda kind, *columns: [F.lit(None).cast(kind).alias(c) for c in columns]
    rows = coded.filter("kind = 'word'").select("word", "block", "a", "b", *empty("binary", "c", "d"))
    rows = rows.unionByName(model.followers.join(is_common, "word", "left_anti").select("word", *empty("long", "block"), F.col("followers").alias("a"), *empty("binary", "b", "c", "d")))
    rows = rows.unionByName(model_rows.select("word", *empty("long", "block"), *[F.col(c).alias(new) for c, new in zip(STATE, "abcd")]))
    # Sorted together, so that a word's model comes once, before its tokens, and is not copied to each of their rows.
    rows = rows.repartition("word").sortWithinPartitions("word", F.col("d").isNull())
    others = rows.mapInArrow(of_others, sums)
    others = others.unionByName(model.followers.join(is_common, "word", "left_semi").mapInArrow(of_common_followers, sums))
    # The sums of a block are bounded by its tokens; added up, they are one row per document again.
    lists = others.groupBy("block").agg(F.collect_list(F.struct("places", "known", "base", "score")).alias("p"))
    others = lists.select("block", *[F.col(f"p.{c}").alias(c) for c in ("places", "known", "base", "score")]).mapInArrow(added_up, schema)
    return documents.unionByName(others).groupBy("block", "place").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score")).drop("block", "place")


def perplexity(scored: DataFrame) -> DataFrame:
    """``held_out, tokens, perplexity, base_perplexity``."""
    power = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), power("score").alias("perplexity"), power("base_score").alias("base_perplexity"))


def score_documents(docs: DataFrame) -> DataFrame:
    """Fit on the rows outside the held-out fold and score all rows."""
    path = new_folder(docs.sparkSession, "tokens-by-word")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), (fold("doc_id", MODULUS) == HELD_OUT).alias("held_out"))
    # All jobs of the fit store what they make, so the files that they shuffle can go with each of them.
    with setting(docs.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        model = fit(rows, path)
    return score(model, path)
