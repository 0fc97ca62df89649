"""Repair of conversations: the cheapest edits that give turns in the order (system) (user assistant)*.

Rows become symbols of role and fault. Equal symbols that follow each other are one run,
and a run is advanced through binary powers of its min-plus transition matrix, from the end of
a conversation to its start: what is left to pay from each state. Choices are then unrolled from the
start, the first in the order of their letters that is among the cheapest.

Rows are sorted once by range, so a conversation of any length is spread over partitions, and cut into
chunks. Only the conversations at the ends of a chunk may go on in another one. For these each chunk gives its
runs; they are chained conversation by conversation, backwards for the costs and forwards for the states,
in streams that hold one vector or state. Then all chunks are unrolled on their own. Texts stay in the JVM.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import WORD
from beaconry.session import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# Rows of a chunk, as a power of two.
CHUNK_BITS = 13

# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES = range(4)
# Symbols: a row that has to go, or 1 + 2 * class + truncated, with the classes system, user, assistant, other.
GONE = 0
CLASSES = "sua"
LEGAL = ("su", "ua", "au")
_INSERTED = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}
# Where a turn of a class leads from a state.
_KEPT = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}, 3: {}}
_FAR = 1 << 50
# After the last row: what makes each state a legal end, and its price.
ENDINGS = ("", "ua", "a", "")
LAST = tuple(INSERT * len(e) for e in ENDINGS)

_EDGES = "chunk long, conv {0}, runs binary, last string"
_COSTS = _EDGES + ", costs array<long>, exits array<int>"
_ENTRIES = "chunk long, conv {0}, costs array<long>, enter int, earlier string"
_CHOICES = "at long, before string, edit string, given string, after string, paid long, illegal long"

Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


def apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(a[i][k] + v[k] for k in STATES) for i in STATES)


@lru_cache(None)
def options(symbol: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, price, next state) of what may be done with a row, in the order of the letters; inserts come apart."""
    found = [("D", DELETE, state)]
    if symbol != GONE:
        kind, cut = divmod(symbol - 1, 2)
        if state in _KEPT[kind]:
            found.append(("K", KEEP + TRUNCATED * cut, _KEPT[kind][state]))
        found.append(("R", REROLE + TRUNCATED * cut, _INSERTED[state][0]))
    return tuple(found)


@lru_cache(None)
def power(symbol: int, k: int) -> Matrix:
    """Prices of 2**k rows of a symbol, with inserts before each, from state to state."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    steps = [[_FAR] * 4 for _ in STATES]
    inserts = [[0 if i == j else _FAR for j in STATES] for i in STATES]
    for state in STATES:
        for _, price, to in options(symbol, state):
            steps[state][to] = min(steps[state][to], price)
        inserts[state][_INSERTED[state][0]] = INSERT
    closed = times(times(inserts, inserts), inserts)
    return times(closed, steps)


def advance(symbol: int, n: int, costs: Vector) -> Vector:
    """What is left to pay before a run, from what is left after it."""
    k = 0
    while n >> k:
        if n >> k & 1:
            costs = apply(power(symbol, k), costs)
        k += 1
    return costs


@lru_cache(1 << 16)
def _decide(symbol: int, state: int, after: Vector) -> tuple[str, str, int, int]:
    before, inserted, paid = apply(power(symbol, 0), after), "", 0
    while True:
        left = before[state]
        done = {letter: (price, to) for letter, price, to in options(symbol, state) if price + after[to] == left}
        to, role = _INSERTED[state]
        if "D" not in done and INSERT + before[to] == left:
            state, inserted, paid = to, inserted + role, paid + INSERT
            continue
        letter = min(done)
        price, to = done[letter]
        return inserted, letter, to, paid + price


def decide(symbol: int, state: int, after: Vector) -> tuple[str, str, int, int]:
    """(roles inserted before, letter, next state, price) of the least choice among the cheapest for a row.

    ``after``: what is left to pay after the row. Only its differences matter, and they are few.
    """
    least = min(after)
    return _decide(symbol, state, tuple(x - least for x in after))


def runs_of(symbols: list[int], copies: list[int]) -> list[tuple[int, int]]:
    """Runs (symbol, length). Of equal rows the first counts, the others have to go."""
    parts = []
    for symbol, n in zip(symbols, copies):
        parts.append((symbol, 1))
        if n > 1:
            parts.append((GONE, n - 1))
    return [(symbol, sum(n for _, n in group)) for symbol, group in groupby(parts, key=lambda p: p[0])]


def run_ends(runs: list[tuple[int, int]], costs: Vector) -> list[Vector]:
    """What is left to pay after each run; ``costs`` after the last. The first element is before all of them."""
    ends = [costs]
    for symbol, n in reversed(runs):
        ends.append(advance(symbol, n, ends[-1]))
    return ends[::-1]


def unroll(runs: list[tuple[int, int]], costs: Vector, state: int) -> tuple[list[tuple[str, str, int, int]], int]:
    """(inserted, letter, price, next state) of each row that may stay, in order, and the state after all. Rows that have to go
    are all deleted: inserts never pay before them, as ``I`` comes after ``D``."""
    chosen = []
    for (symbol, n), end in zip(runs, run_ends(runs, costs)[1:]):
        if symbol == GONE:
            continue
        after = [end]
        for _ in range(n - 1):
            after.append(advance(symbol, 1, after[-1]))
        for left in reversed(after):
            inserted, letter, state, price = decide(symbol, state, left)
            chosen.append((inserted, letter, price, state))
    return chosen, state


def _segments(conv: list) -> list[tuple[int, int]]:
    cuts = [i for i in range(len(conv)) if i == 0 or conv[i] != conv[i - 1]] + [len(conv)]
    return list(zip(cuts[:-1], cuts[1:]))


def _table(columns: list, names: str) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in names.split(", ")]
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


def _edges(rows: pa.Table) -> pa.Table:
    """Runs of the first and of the last conversation of a chunk."""
    rows = rows.sort_by("at")
    conv, symbols, copies, initials = (rows[c].to_pylist() for c in ("conv", "symbol", "copies", "initial"))
    parts = _segments(conv)
    ends = sorted({parts[0], parts[-1]})
    packed = [np.array(runs_of(symbols[a:b], copies[a:b]), dtype=np.int64).tobytes() for a, b in ends]
    return pa.table(
        {
            "chunk": rows["chunk"].slice(0, len(ends)),
            "conv": pa.array([conv[a] for a, _ in ends], rows.schema.field("conv").type),
            "runs": pa.array(packed, pa.binary()),
            "last": pa.array([initials[b - 1] for _, b in ends], pa.string()),
        }
    )


def _unpacked(data: bytes) -> list[tuple[int, int]]:
    return [tuple(r) for r in np.frombuffer(data, dtype=np.int64).reshape(-1, 2).tolist()]


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations from the last on: what is left to pay after each, and where it leads from each state."""
    of, costs = object(), LAST
    for batch in batches:
        ends, exits = [], []
        for conv, data in zip(batch.column("conv").to_pylist(), batch.column("runs").to_pylist()):
            runs = _unpacked(data)
            if conv != of:
                of, costs = conv, LAST
            ends.append(list(costs))
            exits.append([unroll(runs, costs, state)[1] for state in STATES])
            costs = run_ends(runs, costs)[0]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(ends, pa.list_(pa.int64())), pa.array(exits, pa.list_(pa.int32()))],
            [*batch.schema.names, "costs", "exits"],
        )


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same parts from the first on: the state each is entered in, and the initial before it."""
    of, state, earlier = object(), 0, None
    for batch in batches:
        enter, before = [], []
        for conv, exits, last in zip(*(batch.column(c).to_pylist() for c in ("conv", "exits", "last"))):
            if conv != of:
                of, state, earlier = conv, 0, None
            enter.append(state)
            before.append(earlier)
            state, earlier = exits[state], last
        yield pa.RecordBatch.from_arrays(
            [batch.column("chunk"), batch.column("conv"), batch.column("costs"), pa.array(enter, pa.int32()), pa.array(before, pa.string())],
            ["chunk", "conv", "costs", "enter", "earlier"],
        )


def _choices(rows: pa.Table, entries: pa.Table) -> pa.Table:
    """The edit of every row of a chunk."""
    rows = rows.sort_by("at")
    known = {e["conv"]: e for e in entries.to_pylist()}
    conv, symbols, copies, initials = (rows[c].to_pylist() for c in ("conv", "symbol", "copies", "initial"))
    ends = rows["ends"].to_pylist()
    before, edit, given, after, paid, illegal = [], [], [], [], [], []
    for a, b in _segments(conv):
        entry = known.get(conv[a])
        costs = tuple(entry["costs"]) if entry else LAST
        chosen, state = unroll(runs_of(symbols[a:b], copies[a:b]), costs, entry["enter"] if entry else 0)
        choice = iter(chosen)
        earlier = entry["earlier"] if entry else None
        for i in range(a, b):
            inserted, letter, price, to = next(choice) if symbols[i] != GONE else ("", "D", DELETE, None)
            before.append(inserted)
            edit.append(letter)
            given.append(("user" if to == 2 else "assistant") if letter == "R" else None)
            paid.append(price + DELETE * (copies[i] - 1))
            illegal.append(copies[i] - 1 + (earlier is not None and earlier + initials[i] not in LEGAL))
            after.append(ENDINGS[state] if i == b - 1 and ends[i] else "")
            paid[-1] += INSERT * len(after[-1])
            earlier = initials[i]
    return _table([rows["at"].to_pylist(), before, edit, given, after, paid, illegal], _CHOICES)


def _rlike(text: str, pattern: str) -> Column:
    return F.col(text).rlike(pattern)


def with_faults(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies, fault, initial, symbol): equal rows once, with their number and their first fault.

    A null role or text is one space. blank: no visible character; duplicate: role and text are in an
    earlier row, by turn; truncated: the last visible character is none of ``.!?``. Faults are those of the first of equal
    rows; unless it is blank the others are duplicates.
    """
    rows = turns.select(
        F.col(f"`{conv_id}`").alias("conv"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
    )
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = materialize(rows.withColumn("digest", F.sha2("text", 256)), "turns")
    # A row for each different turn of a conversation; a null turn is before all others.
    first = rows.groupBy(
        F.col("conv").alias("of"), F.col("role").alias("of_role"), F.col("digest").alias("of_digest")
    ).agg(F.min("turn").alias("least"), F.bool_or(F.col("turn").isNull()).alias("any_null"), F.count("*").alias("n"))
    # Only what occurs more than once is joined, so that rows of no other turn are not dealt by it.
    first = first.where("n > 1").drop("n")
    same = F.col("conv").eqNullSafe(F.col("of")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest"))
    joined = rows.join(first, same, "left")
    earlier = F.coalesce(F.when(F.col("any_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least")), F.lit(False))
    fault = (
        F.when(~_rlike("text", WORD), "blank")
        .when(earlier, "duplicate")
        .when(~_rlike("text", r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(1 + 2 * kind + F.col("fault").isNotNull().cast("int"))
    return joined.select(
        "conv", "turn", "role", "text", "copies", fault.alias("fault"), initial.alias("initial")
    ).withColumn("symbol", symbol.cast("int"))


def edits(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(conv, at, turn, role, text, copies, fault, before, edit, given, after, paid, illegal): the cheapest edits of every row.

    Rows of a conversation are in the order of ``at``: by turn (null first), role, text; equal rows are
    one row with ``copies``, of which all but the first are deleted. ``edit`` is K, D, or R with the role that is ``given``; ``before`` and ``after`` are the initials of the
    turns that are inserted. ``paid`` has the price of all that; ``illegal`` counts
    neighbours that may not follow each other. A null id is a conversation too. No rows give no rows.
    """
    rows = with_faults(turns, conv_id, turn, role, text)
    prefix = F.substring("text", 1, 64)
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role")]
    ranged = rows.repartitionByRange(*order, prefix).sortWithinPartitions(*order, "text")
    ordered = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "ordered")
    kind = ordered.schema["conv"].dataType.simpleString()
    narrow = ordered.select(F.shiftright("at", chunk_bits).alias("chunk"), "at", "conv", "symbol", "copies", "initial")
    parts = narrow.groupBy("chunk").applyInArrow(_edges, _EDGES.format(kind))
    costs = (
        parts.repartition("conv").sortWithinPartitions("conv", F.desc("chunk")).mapInArrow(_backwards, _COSTS.format(kind))
    )
    entries = costs.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_forwards, _ENTRIES.format(kind))
    # A conversation ends with the last of its rows, wherever that is.
    ends = narrow.groupBy("conv").agg(F.max("at").alias("end_at")).select("end_at")
    marked = narrow.join(ends, F.col("at") == F.col("end_at"), "left").withColumn("ends", F.col("end_at").isNotNull()).drop("end_at")
    chosen = marked.groupBy("chunk").cogroup(entries.groupBy("chunk")).applyInArrow(_choices, _CHOICES)
    return ordered.drop("symbol", "initial").join(chosen.withColumnRenamed("at", "of"), F.col("at") == F.col("of")).drop("of")


def repaired(edited: DataFrame) -> DataFrame:
    """(conv, at, step, edit, times, role, text): every edit of ``edits`` in the order of (at, step), with the role and
    text that a turn has after it. ``times``: how many equal rows an edit deletes."""

    def inserted(roles: str) -> Column:
        named = F.transform(
            F.filter(F.split(roles, ""), lambda r: r != ""),
            lambda r: F.struct(
                F.lit("I").alias("edit"),
                F.lit(1).cast("long").alias("times"),
                F.when(r == "u", "user").otherwise("assistant").alias("role"),
                F.lit("").alias("text"),
            ),
        )
        return named

    deleted = (F.col("edit") == "D").cast("long")
    own = F.struct(
        F.col("edit").alias("edit"),
        F.when(deleted == 1, F.col("copies")).otherwise(F.lit(1)).cast("long").alias("times"),
        F.coalesce("given", "role").alias("role"),
        F.col("text").alias("text"),
    )
    rest = F.struct(F.lit("D").alias("edit"), (F.col("copies") - 1).alias("times"), F.col("role").alias("role"), F.col("text").alias("text"))
    extra = F.when((deleted == 0) & (F.col("copies") > 1), F.array(rest)).otherwise(F.slice(F.array(rest), 1, 0))
    every = F.concat(inserted("before"), F.array(own), extra, inserted("after"))
    return edited.select("conv", "at", F.posexplode(every).alias("step", "turn")).select("conv", "at", "step", "turn.*")


def summary(edited: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost) of each conversation of ``edits``. ``gaps``: turns that are missing
    between the first and the last; null turns do not count."""
    copies, fault = F.col("copies"), F.col("fault")
    per_turn = edited.groupBy("conv", "turn").agg(
        F.sum(F.when(fault == "blank", copies).otherwise(0)).alias("blank"),
        F.sum(F.when(fault == "duplicate", copies).when(F.coalesce(fault != "blank", F.lit(True)), copies - 1).otherwise(0)).alias("duplicate"),
        F.sum(F.when(fault == "truncated", 1).otherwise(0)).alias("truncated"),
        F.sum("illegal").alias("illegal"),
        F.sum("paid").alias("cost"),
    )
    counts = [F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    missing = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return per_turn.groupBy("conv").agg(F.coalesce(missing, F.lit(0)).cast("long").alias("gaps"), *counts)


def digests(done: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256) of ``repaired``: the letters of all edits, and the hash of the repaired turns.

    A hash over a conversation is made row by row in its order: the turns go by in a stream, which holds one batch of them.
    """
    kind = done.schema["conv"].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, letters, digest, first = object(), [], hashlib.sha256(), True
        nothing = of
        for batch in batches:
            out = []
            for conv, edit, n, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "edit", "times", "role", "text"))):
                if conv != of:
                    if of is not nothing:
                        out.append((of, "".join(letters), digest.hexdigest()))
                    of, letters, digest, first = conv, [], hashlib.sha256(), True
                letters.append(edit * n)
                if edit != "D":
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            yield _digest_rows(out, batch.schema.field("conv").type)
            kind_of = batch.schema.field("conv").type
        if of is not nothing:
            yield _digest_rows([(of, "".join(letters), digest.hexdigest())], kind_of)

    ordered = done.repartition("conv").sortWithinPartitions("conv", "at", "step")
    return ordered.mapInArrow(stream, f"conv {kind}, audit string, repaired_sha256 string")


def _digest_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], []]
    arrays = [pa.array(columns[0], kind), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["conv", "audit", "repaired_sha256"])
