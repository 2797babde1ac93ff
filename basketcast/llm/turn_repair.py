"""Repair of conversation structure by Hirschberg's divide and conquer over a four-state grammar.

Role initials have to read ``(s?(ua)+)?``: four states (start, after a system turn, after a user turn,
after an assistant turn), of which the first and the last may end. Every turn is kept (0), given the
other role (2) or deleted (3, the only choice for blank and repeated turns), an undeleted truncated
turn costs 1 more, and an empty turn may be put in anywhere (2). Of the cheapest repairs the one whose
edit initials come first as ASCII is wanted.

A turn is one of nine kinds, and a kind is a four by four table: the least cost from state to state and,
for each start, the order of the edit strings that reach it. Each string consumes its turns and ends by
consuming the last, so none is the beginning of another, and the order of two repairs is settled where
their states first differ. Forward vectors (cost and order for each state) and backward vectors (cost to
the end) then meet in the middle of a conversation; of the crossings with the least sum the one whose
forward string comes first is taken, and both halves are solved in the same way. Vectors are kept
relative to their least cost, so that there are only a few dozen of them and a step is one look-up; no
table over turns and states is stored.

On Spark, equal turns are counted first and ranges of sorted turns are cut into blocks of at most
``BLOCK`` turns, so a conversation that holds a third of all rows is many tasks. A block is again a four
by four table, the same divide and conquer over the tables of a conversation's blocks gives the states
between them, and every block is then solved by itself. Texts are read a second time and cross one
shuffle, to be hashed in order as they stream by; a conversation's hash is sequential by its nature.

Defined cases: null texts and roles are one space; turns are ordered by number (null first), role and
SHA-256 of the text, and equal rows stand next to each other; a role counts by its first character, and
an empty one fits nowhere; a null conversation id is one conversation; an id whose turns were all
dropped has zeros and the hash of the empty string; an empty table gives an empty result; other columns
are ignored; very long texts are read by built-in functions and hashed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketcast.llm.common import small_batches, stored

BLOCK = 512
NEVER = 1 << 40
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
# State -> the role that may be put there and the state behind it.
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
# State and role initial -> state, where a turn may stay as it is.
STAYS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
# What is put in behind the last turn, by state.
ENDS = {0: "", 1: "II", 2: "I", 3: ""}
# Kinds of turns: role initial (``o`` for any other), upper case if truncated, ``x`` if it has to go.
KINDS = "suaoSUAOx"

Step = tuple[tuple[tuple[int, int], ...], ...]  # step[start][end] = (cost, order among the strings from start)
Vector = tuple[tuple[int, int], ...]  # vector[state] = (cost, order)


def ranked(costs: Sequence[int], keys: Sequence) -> Vector:
    """Costs with the order of their keys; unreachable states come last."""
    order = sorted((k, i) for i, k in enumerate(keys) if costs[i] < NEVER)
    place = {i: n for n, (_, i) in enumerate(order)}
    return tuple((c, place.get(i, len(costs))) if c < NEVER else (NEVER, len(costs)) for i, c in enumerate(costs))


@lru_cache(None)
def edits(kind: str) -> tuple[tuple[tuple[int, str], ...], ...]:
    """Cheapest and then first edit string of one turn from state to state."""
    best = [[(NEVER, "")] * 4 for _ in range(4)]
    for start in range(4):
        state, before = start, ""
        for _ in range(3):
            cost = 2 * len(before)
            options = [(3, DELETE, state)]
            if kind != "x":
                late = int(kind.isupper())
                if (state, kind.lower()) in STAYS:
                    options.append((late, KEEP, STAYS[state, kind.lower()]))
                options.append((2 + late, REROLE, NEXT[state][1]))
            for extra, letter, end in options:
                best[start][end] = min(best[start][end], (cost + extra, before + letter))
            state, before = NEXT[state][1], before + INSERT
    return tuple(map(tuple, best))


@lru_cache(None)
def turn_step(kind: str) -> Step:
    return tuple(ranked([c for c, _ in row], [e for _, e in row]) for row in edits(kind))


def first_vector(start: int) -> Vector:
    return tuple((0, 0) if s == start else (NEVER, 4) for s in range(4))


@lru_cache(1 << 16)
def forward(vector: Vector, step: Step) -> tuple[Vector, int]:
    """The vector behind a step, relative to its least cost, and that cost."""
    costs, keys = [], []
    for end in range(4):
        cost, order, start = min((vector[s][0] + step[s][end][0], vector[s][1], s) for s in range(4))
        costs.append(min(cost, NEVER))
        keys.append((order, step[start][end][1]))
    least = min(costs)
    return ranked([c - least if c < NEVER else c for c in costs], keys), least


@lru_cache(1 << 16)
def backward(costs: tuple[int, ...], step: Step) -> tuple[int, ...]:
    """Cost from each state to the end, relative to the least."""
    found = [min(step[s][e][0] + costs[e] for e in range(4)) for s in range(4)]
    least = min(found)
    return tuple(c - least if c < NEVER else NEVER for c in found)


def sweep(steps: Sequence[Step], vector: Vector) -> tuple[Vector, int]:
    total = 0
    for step in steps:
        vector, cost = forward(vector, step)
        total += cost
    return vector, total


def crossing(vector: Vector, costs: tuple[int, ...]) -> int:
    """The state with the least sum, and among those the first forward string."""
    return min(range(4), key=lambda s: (vector[s][0] + costs[s], vector[s][1]))


def states_between(steps: Sequence[Step], start: int, end: int) -> list[int]:
    """The state in front of the first step, between all steps, and behind the last: Hirschberg's recursion on a stack."""
    states = [start] * len(steps) + [end]
    work = [(0, len(steps))]
    while work:
        low, high = work.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        vector, _ = sweep(steps[low:middle], first_vector(states[low]))
        costs = tuple(0 if s == states[high] else NEVER for s in range(4))
        for step in reversed(steps[middle:high]):
            costs = backward(costs, step)
        states[middle] = crossing(vector, costs)
        work += [(low, middle), (middle, high)]
    return states


def last_state(steps: Sequence[Step]) -> int:
    """The state in which the best repair leaves the last turn."""
    vector, _ = sweep(steps, first_vector(0))
    return min(range(4), key=lambda s: (vector[s][0] + 2 * len(ENDS[s]), vector[s][1]))


@lru_cache(1 << 14)
def block_step(kinds: str) -> Step:
    """Table of a block of turns."""
    rows = []
    for start in range(4):
        vector, total = sweep([turn_step(k) for k in kinds], first_vector(start))
        rows.append(tuple((c + total if c < NEVER else NEVER, o) for c, o in vector))
    return tuple(rows)


@lru_cache(1 << 14)
def block_edits(kinds: str, start: int, end: int) -> tuple[str, int]:
    """Edit string and cost of a block between two states."""
    states = states_between([turn_step(k) for k in kinds], start, end)
    cells = [edits(k)[s][e] for k, s, e in zip(kinds, states, states[1:])]
    return "".join(e for _, e in cells), sum(c for c, _ in cells)


def solve(kinds: str) -> tuple[int, str]:
    """Cost and edit string of a whole conversation of turn kinds."""
    end = last_state([turn_step(k) for k in kinds])
    audit, cost = block_edits(kinds, 0, end)
    return cost + 2 * len(ENDS[end]), audit + ENDS[end]


# --- On Spark ---------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by the checksum of conversation and turn; ``dropped`` marks those that go."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(fault == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"),
        (fault == 0).alias("dropped"), F.when(fault == 3, 2).otherwise(1).alias("copies"))


def turn_facts(turns: DataFrame) -> DataFrame:
    """Equal turns counted, with what decides their kind: ``conv_id, turn, role, digest, blank, truncated, first, n``."""
    end = F.right(F.rtrim("text", F.lit(" \t\n\v\f\r")), F.lit(1))
    rows = turns.where(~F.col("dropped")).select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (end == "").alias("blank"),
        (~end.isin(".", "!", "?")).alias("truncated"), "copies")
    rows = rows.groupBy("conv_id", "turn", "role", "digest").agg(
        F.max("blank").alias("blank"), F.max("truncated").alias("truncated"), F.sum("copies").alias("n"))
    rows = stored(rows)
    # Nulls come first, so the earliest turn of a text is the least pair of (has a number, number).
    when = F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"))
    earliest = rows.select("conv_id", "role", "digest", when.alias("at")).groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at"))
    earliest = earliest.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"),
                               F.when(F.col("at.numbered"), F.col("at.turn")).alias("t"), F.lit(True).alias("first"))
    same = (rows["conv_id"].eqNullSafe(earliest["c"]) & rows["turn"].eqNullSafe(earliest["t"])
            & (rows["role"] == earliest["r"]) & (rows["digest"] == earliest["d"]))
    return rows.join(earliest, same, "left").drop("c", "r", "d", "t").withColumn("first", F.coalesce("first", F.lit(False)))


BLOCK_SCHEMA = ("conv_id long, block long, turn long, role string, digest binary, kinds string, rows long, low long, high long, "
                "turns long, last_turn long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string")
BLOCK_NAMES = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]


class Block:
    """Turns of one conversation in a row, counted as they come."""

    def __init__(self, conv_id, block, turn, role, digest):
        self.head = (conv_id, block, turn, role, digest)
        self.kinds, self.rows, self.low, self.high, self.turns = [], 0, None, None, 0
        self.last, self.blank, self.duplicate, self.truncated, self.illegal = None, 0, 0, 0, 0
        self.first_role, self.last_role = role[:1], None

    def add(self, turn, role, blank, truncated, fresh, n):
        initial = role[:1]
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.last = turn
        whole = fresh and not blank
        self.blank += n * blank
        self.duplicate += 0 if blank else n - whole
        self.truncated += whole and truncated
        if self.last_role is not None:
            self.illegal += self.last_role + initial not in ("su", "ua", "au")
        self.illegal += (n - 1) * (initial + initial not in ("su", "ua", "au"))
        self.last_role = initial
        if whole:
            kind = initial if initial in ("s", "u", "a") else "o"
            self.kinds.append(kind.upper() if truncated else kind)
        self.kinds.append("x" * (n - whole))
        self.rows += n

    def row(self):
        return (*self.head, "".join(self.kinds), self.rows, self.low, self.high, self.turns, self.last,
                self.blank, self.duplicate, self.truncated, self.illegal, self.first_role, self.last_role)


def blocks_of(facts: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per block of at most ``size`` turns, from sorted ranges; a range may start inside a conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, number = None, [], 0

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(BLOCK_NAMES, r)) for r in done], schema=BLOCK_ARROW)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "blank", "truncated", "first", "n", "part", "piece")]
            for conv_id, turn, role, digest, blank, truncated, first, n, part, piece in zip(*columns):
                if held is None or held.head[0] != conv_id or held.rows + n > size:
                    if held is not None:
                        done.append(held.row())
                    held, number = Block(conv_id, (part << 40) + number, turn, role, digest), number + 1
                held.add(turn, role, blank, truncated, first and piece == 0, n)
            if done:
                yield written()
                done = []
        if held is not None:
            done.append(held.row())
            yield written()

    # More copies of one turn than a block holds are several rows, numbered by piece.
    pieces = F.sequence(F.lit(0), ((F.col("n") - 1) / size).cast("int"))
    facts = facts.select("*", F.explode(pieces).alias("piece")).withColumn("n", F.least(F.col("n") - F.col("piece") * size, F.lit(size)).cast("int"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "piece"]
    facts = facts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    return facts.mapInArrow(run, BLOCK_SCHEMA)


BLOCK_ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]])
                         for n, c in zip(BLOCK_NAMES, BLOCK_SCHEMA.split(", "))])


def runs_by(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple]:
    """Rows of sorted batches as tuples."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names))


def block_states(blocks: DataFrame) -> DataFrame:
    """``block, start, end, ending``: states around each block, and what follows the last one. Only tables of blocks meet here."""
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [[x for row in block_step(k) for cell in row for x in cell] for k in batch.column("kinds").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(flat, pa.list_(pa.int64()))], names=["conv_id", "block", "cells"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(numbers, steps) -> list[tuple]:
            end = last_state(steps)
            states = states_between(steps, 0, end)
            return [(b, s, e, "") for b, s, e in zip(numbers[:-1], states, states[1:])] + [(numbers[-1], states[-2], end, ENDS[end])]

        conv, numbers, steps, done = None, [], [], []
        for conv_id, block, cells in runs_by(batches, ("conv_id", "block", "cells")):
            if numbers and conv_id != conv:
                done += solved(numbers, steps)
                numbers, steps = [], []
                if len(done) > 10_000:
                    yield states_batch(done)
                    done = []
            conv = conv_id
            numbers.append(block)
            pairs = list(zip(cells[::2], cells[1::2]))
            steps.append(tuple(tuple(pairs[4 * s:4 * s + 4]) for s in range(4)))
        if numbers:
            yield states_batch(done + solved(numbers, steps))

    narrow = blocks.select("conv_id", "block", "kinds").mapInArrow(tables, "conv_id long, block long, cells array<long>")
    return (narrow.repartition("conv_id").sortWithinPartitions("conv_id", "block")
            .mapInArrow(meet, "block long, start int, end int, ending string"))


def states_batch(rows: list[tuple]) -> pa.RecordBatch:
    block, start, end, ending = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(ending, pa.string())],
                                      names=["block", "start", "end", "ending"])


def audited(blocks: DataFrame) -> DataFrame:
    """Blocks with their edit string and cost."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            solved = [block_edits(*x) for x in runs_by([batch], ("kinds", "start", "end"))]
            ending = batch.column("ending").to_pylist()
            audit = [a + e for (a, _), e in zip(solved, ending)]
            cost = [c + 2 * len(e) for (_, c), e in zip(solved, ending)]
            kept = [batch.column(n) for n in BLOCK_NAMES]
            yield pa.RecordBatch.from_arrays([*kept, batch.column("start"), pa.array(audit, pa.string()), pa.array(cost, pa.int64())],
                                             names=[*BLOCK_NAMES, "start", "audit", "cost"])

    return blocks.join(block_states(blocks), "block").select(*BLOCK_NAMES, "start", "end", "ending").mapInArrow(
        run, BLOCK_SCHEMA + ", start int, audit string, cost long")


RESULT_SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


class Conversation:
    """One conversation as it streams by: block rows in front of the turns they cover."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.sums = [0] * 5  # blank, duplicate, truncated, illegal, cost
        self.low, self.high, self.turns, self.last_role = None, None, 0, None
        self.audit, self.at, self.text, self.state = [], 0, hashlib.sha256(), 0
        self.edits, self.lines = "", 0

    def line(self, role: str, text: str) -> None:
        self.text.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def insertions(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == INSERT:
            role, self.state = NEXT[self.state]
            self.line(role, "")
            self.at += 1

    def block(self, block: dict) -> None:
        self.insertions()
        for k, name in enumerate(("blank", "duplicate", "truncated", "illegal", "cost")):
            self.sums[k] += block[name]
        if self.last_role is not None:
            self.sums[3] += self.last_role + block["first_role"] not in ("su", "ua", "au")
        self.last_role = block["last_role"]
        if block["low"] is not None:
            self.turns += block["turns"] - (block["low"] == self.high)
            self.low = block["low"] if self.low is None else self.low
            self.high = block["high"]
        self.audit.append(block["audit"])
        self.edits, self.at, self.state = block["audit"], 0, block["start"]

    def turn(self, role: str, text: str) -> None:
        self.insertions()
        edit = self.edits[self.at]
        self.at += 1
        if edit == KEEP:
            self.state = STAYS[self.state, role[:1]]
            self.line(role, text)
        elif edit == REROLE:
            role, self.state = NEXT[self.state]
            self.line(role, text)

    def result(self) -> tuple:
        self.insertions()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.sums, "".join(self.audit), self.text.hexdigest())


def repair(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per conversation of ``damaged`` turns: its faults, the cheapest audit and the hash of the repaired text."""
    small_batches(turns.sparkSession)
    blocks = stored(blocks_of(turn_facts(turns), size))
    found = stored(audited(blocks))
    names = ["conv_id", "kind", "turn", "role", "digest", "text", "block"]
    numbers = ["start", "audit", "cost", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first_role", "last_role"]
    heads = found.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", F.lit("").alias("text"), "block", F.struct(*numbers).alias("facts"))
    said = turns.select(
        "conv_id", F.when(F.col("dropped"), 0).otherwise(2).alias("kind"), F.when(~F.col("dropped"), F.col("turn")).alias("turn"),
        F.when(F.col("dropped"), "").otherwise(F.col("role")).alias("role"), F.unhex(F.sha2("text", 256)).alias("digest"),
        F.when(F.col("dropped"), "").otherwise(F.col("text")).alias("text"), F.lit(0).cast("long").alias("block"), "copies")
    # A dropped row only names its conversation; a turn that was repeated is read twice.
    said = said.select(*names, F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    rows = said.drop("copy").withColumn("facts", F.lit(None).cast(heads.schema["facts"].dataType)).unionByName(heads)
    return read_off(rows, names)


def read_off(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Walk sorted rows; a block of further copies of one turn comes behind the copies that its predecessor covers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, done = None, [], []
        for conv_id, kind, _, role, _, text, _, facts in runs_by(batches, (*names, "facts")):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(finished(now, waiting))
                    if len(done) > 10_000:
                        yield results(done)
                        done = []
                now, waiting = Conversation(conv_id), []
            if kind == 1:
                waiting.append(facts)
            elif kind == 2:
                if waiting and left(now) == 0:
                    now.block(waiting.pop(0))
                now.turn(role, text)
        if now is not None:
            done.append(finished(now, waiting))
        if done:
            yield results(done)

    def left(conversation: Conversation) -> int:
        """Turns that the current block still covers."""
        edits = conversation.edits
        return sum(1 for e in edits[conversation.at:conversation.at + 3] if e != INSERT)

    def finished(conversation: Conversation, waiting: list[dict]) -> tuple:
        for facts in waiting:
            conversation.block(facts)
        return conversation.result()

    def results(done: list[tuple]) -> pa.RecordBatch:
        schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in RESULT_SCHEMA.split(", ")])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    # Dropped rows stand first: they have no turn, an empty role and kind 0.
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "kind", "block"]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, RESULT_SCHEMA)
