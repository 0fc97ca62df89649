"""Shards of near equal bytes by histogram sort.

Rows are ordered by a key of two longs. For each boundary between shards, exact
counts of the bytes below evenly spread probe keys narrow the interval that holds
the boundary, all boundaries in one aggregation a round, until a probe meets the
tolerance or the interval has a single key left. Only then rows are exchanged, once.

The first part of the key is the same for rows of a group (here: equal texts), so a
group lies in one shard unless it is larger than the tolerance; only inside such a
group the second part is refined as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.llm.common import parts_for, text_or_empty
from beaconry.session import materialize

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _bytes_below(rows: DataFrame, key: str, size: str, probes: list[int]) -> list[int]:
    """Exact sum of ``size`` over the rows with a key below each of the sorted probes."""
    at = np.array(probes, dtype=np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(at) + 1, dtype=np.int64)
        for batch in batches:
            keys, sizes = (np.asarray(c) for c in batch.columns)
            np.add.at(sums, np.searchsorted(at, keys, side="right"), sizes)
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[full])], ["bin", "bytes"])

    bins = rows.select(key, size).mapInArrow(count, "bin long, bytes long").groupBy("bin").agg(F.sum("bytes"))
    sums = np.zeros(len(at) + 1, dtype=np.int64)
    for n, total in bins.collect():  # at most a row for each probe
        sums[n] = total
    return [int(x) for x in np.cumsum(sums)[:-1]]


def _narrow(
    rows: DataFrame, key: str, size: str, targets: list[int], tolerance: int, total: int, probes: int
) -> list[tuple[int, int, int, int]]:
    """For each target (below, at, key_low, key_high): see ``split``.

    ``low`` and ``high`` are neighbouring boundaries with known bytes below; they end
    as one key apart, or one of them meets the tolerance.
    """
    state = [[LOW, 0, HIGH, total] for _ in targets]

    def open_(n: int) -> bool:
        low, under, high, over = state[n]
        return high - low > 1 and min(targets[n] - under, over - targets[n]) > tolerance

    while any(map(open_, range(len(targets)))):
        asked = sorted(
            {
                state[n][0] + (state[n][2] - state[n][0]) * i // (probes + 1)
                for n in filter(open_, range(len(targets)))
                for i in range(1, probes + 1)
            }
            - {x for s in state for x in (s[0], s[2])}
        )
        if not asked:
            break
        for probe, under in zip(asked, _bytes_below(rows, key, size, asked)):
            for n, target in enumerate(targets):
                if under <= target and probe > state[n][0]:
                    state[n][:2] = probe, under
                if under >= target and probe < state[n][2]:
                    state[n][2:] = probe, under
    return [tuple(s) for s in state]


def split(
    rows: DataFrame, shards: int, major: str, minor: str, size: str, tolerance: float = 0.02, group: float = 0.1, probes: int = 64
) -> list[tuple[int, int]]:
    """Splitters (major, minor): shard n holds the keys from splitter n - 1 on and below splitter n.

    Off by at most ``tolerance`` of an even share of the bytes, or by half of the
    rows with one key. A boundary inside a group of equal major keys moves to the
    group's edge, unless the group has more than ``group`` of an even share.
    """
    total = rows.agg(F.sum(size)).first()[0] or 0
    targets = [total * n // shards for n in range(1, shards)]
    splitters = []
    for target, (low, under, high, over) in zip(
        targets, _narrow(rows, major, size, targets, int(total / shards * tolerance), total, probes)
    ):
        nearest = (low, LOW) if target - under <= over - target else (high, LOW)
        off = min(target - under, over - target)
        if high - low > 1 or off <= total / shards * tolerance or over - under <= total / shards * group:
            splitters.append(nearest)
            continue
        inside = rows.where(F.col(major) == low)
        [(low_2, under_2, high_2, over_2)] = _narrow(
            inside, minor, size, [target - under], int(total / shards * tolerance), over - under, probes
        )
        at = low_2 if target - under - under_2 <= under + over_2 - target else high_2
        splitters.append((low, at))
    return splitters


def _shard(splitters: list[tuple[int, int]], major: str, minor: str) -> Column:
    passed = [
        ((F.col(major) > a) | ((F.col(major) == a) & (F.col(minor) >= b))).cast("int") for a, b in splitters
    ]
    return sum(passed[1:], passed[0]) if passed else F.lit(0)


def histogram_shards(
    rows: DataFrame, shards: int, major: str, minor: str, size: str, slots_each: int = 50_000, **how
) -> DataFrame:
    """The rows with ``shard`` (from 0) and ``slot`` (gapless from 0 in a shard).

    ``major`` and ``minor`` are longs without nulls, ``size`` a long of at least zero.
    Every column of ``rows`` is kept; a column named shard, slot or slot_part is
    replaced. Slots are counted in parts of about ``slots_each`` rows, dealt by key, so no
    task numbers a whole shard. Repeated rows get a slot each. No rows give no rows.
    """
    splitters = split(rows, shards, major, minor, size, **how)
    parts = parts_for(rows.count(), slots_each * shards)
    placed = rows.withColumn("shard", _shard(splitters, major, minor)).withColumn(
        "slot_part", F.pmod(F.xxhash64(major, minor), F.lit(parts)).cast("int")
    )
    before = Window.partitionBy("shard").orderBy("slot_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "slot_part")
        .agg(F.count("*").alias("slot_rows"))
        .select("shard", "slot_part", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("slot_offset"))
    )
    inside = Window.partitionBy("shard", "slot_part").orderBy(major, minor, *sorted(set(rows.columns) - {major, minor}))
    return (
        placed.withColumn("slot_rank", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "slot_part"])
        .withColumn("slot", (F.col("slot_offset") + F.col("slot_rank")).cast("long"))
        .drop("slot_offset", "slot_rank", "slot_part")
    )


def text_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, text_key) of every row, written once.

    ``size``: UTF-8 bytes of the text (none if null) plus one. A null text counts as
    empty in the checksum and the key; other columns are not looked at.
    """
    return materialize(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
            F.xxhash64(text_or_empty(text)).alias("text_key"),
        ),
        "shard-rows",
    )


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of near equal bytes; equal texts stay together unless they are many."""
    rows = text_rows(docs, doc_id, text).withColumn("minor", F.coalesce(F.xxhash64("doc_id"), F.lit(0)))
    return histogram_shards(rows, shards, "text_key", "minor", "size", **how).drop("text_key", "minor")
