"""Documents in groups that ask shards, and are answered.

Operators that look up every position of every text would shuffle far more rows than
there is text. Here documents are dealt once into groups of some megabytes by a hash.
Each group sends one row to each shard with its different keys, packed and sorted, and
gets one row back with the answers in the same order. Copies in a group ask once, so
a key that a third of all documents have comes to its shard once for each group.

Every step on groups reads the same exchange of the texts, which Spark reuses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import parts_for, text_or_empty, total_bytes

GROUP_BYTES = 8 << 20


class Groups:
    """Documents as (g, doc_id, text, rest): ``rest`` holds the columns ``keep``; a null text is empty.

    Within a group documents are in order of id, then text; a null id comes last.
    """

    def __init__(self, docs: DataFrame, doc_id: str, text: str, keep: list[str] = (), each: int | None = None):
        self.n = parts_for(total_bytes(docs, text), each or GROUP_BYTES)
        rest = [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("rest")] if keep else []
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), *rest)
        group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.n)).cast("int").alias("g")
        self.docs = rows.select(group, "*").repartition(self.n, "g")

    def map(self, step: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
        return self.docs.groupBy("g").applyInArrow(lambda key, docs: step(key[0].as_py(), in_order(docs)), schema)

    def answered(self, answers: DataFrame, step: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """``step`` with the documents of a group and the rows of ``answers`` to it."""

        def run(key: tuple, docs: pa.Table, rows: pa.Table) -> pa.Table:
            return step(key[0].as_py(), in_order(docs), rows)

        return self.docs.groupBy("g").cogroup(answers.repartition(self.n, "g").groupBy("g")).applyInArrow(run, schema)

    def shards(self, requests: DataFrame, step: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
        """``step`` with all rows of ``requests`` to a shard."""
        return (
            requests.repartition(self.n, "shard")
            .groupBy("shard")
            .applyInArrow(lambda key, rows: step(key[0].as_py(), rows), schema)
        )


def in_order(docs: pa.Table) -> pa.Table:
    return docs.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])


def column(values: Iterable, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind, from_pandas=False)


def rows_of(fields: dict[str, tuple[Iterable, pa.DataType]]) -> pa.Table:
    return pa.table({name: column(values, kind) for name, (values, kind) in fields.items()})


def unpack(values: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=kind) for x in values.to_pylist()]


def bounds(sorted_shards: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` shards begins in a sorted column, and its end."""
    return np.searchsorted(sorted_shards, np.arange(n + 1))


def spread(hashes: np.ndarray, n: int) -> np.ndarray:
    """Shard of each hash: by its upper bits, so that order by hash is order by shard."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def scattered(hashes: np.ndarray) -> np.ndarray:
    """One to one: smallest hashes, which crowd at zero, spread over all shards."""
    with np.errstate(over="ignore"):
        x = hashes * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def starts(lengths: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64) if len(lengths) else np.empty(0, np.int64)
