"""Benchmark passages in training texts, found by an FM-index for each shard of the texts.

Texts that follow each other in a partition make a shard of some megabytes, copies in it once. Its
index is written to the shared folder, so it is built once however many phrases are searched.
The test phrases are windows of consecutive words of the items. They are dealt into blocks of bounded
size, and every shard is asked for one block after the other. What is found in a text is merged
into spans of words to remove.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import parts_for
from beaconry.llm.fm_index import FmIndex
from beaconry.session import materialize

WINDOW = 10
SHARD_BYTES = 4 << 20
# Bytes of test phrases that are sent to all tasks at once.
BLOCK_BYTES = 32 << 20
# Bytes of a row group of written indexes. Parquet looks at the size of its buffers after a hundred rows only, unless told otherwise: of
# rows of some megabytes it would hold all that a task writes, and a reader would hold all of it at once.
ROW_GROUP_BYTES = 8 << 20
# Occurrences that are located at once.
_AT_ONCE = 1 << 18
# Texts that are taken from a batch at once.
_ROWS_AT_ONCE = 64
# Words: digits, letters, and whatever is beyond ASCII; A-Z lower-cased.
_WORD_RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_PLAIN = bytes(
    b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

_INDEX = "rows array<struct<id:binary,text:int>>, index binary"
_PHRASES = "phrase binary, item string"
_SPANS = "spans array<struct<start:long,end:long>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


def phrases(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(phrase, item): each window of ``window`` words of an item once; an item of fewer words, but not none, is one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                runs = range(max(1, len(words) - window + 1)) if words else ()
                found += dict.fromkeys((b" ".join(words[i : i + window]), item) for i in runs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in found], pa.binary()), pa.array([i for _, i in found], pa.string())], ["phrase", "item"]
            )

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, _PHRASES).distinct()


def build(docs: DataFrame, key: Column, text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(rows, index, shard): an FM-index for each shard, its rows as (key in bytes, number of the text), and its number."""

    def index(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        numbers: dict[str, int] = {}
        of = [numbers.setdefault(text, len(numbers)) for _, text in rows]
        made = FmIndex(words_of(t) for t in numbers)
        ids = [{"id": key, "text": n} for (key, _), n in zip(rows, of)]
        kind = pa.list_(pa.struct([("id", pa.binary()), ("text", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([ids], kind), pa.array([made.dumps()], pa.binary())], ["rows", "index"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            # Of a batch of long texts only some at a time become Python's.
            for part in (batch.slice(at, _ROWS_AT_ONCE) for at in range(0, batch.num_rows, _ROWS_AT_ONCE)):
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    if rows and size + len(row[1]) > shard_bytes:
                        yield index(rows)
                        rows, size = [], 0
                    rows.append(row)
                    # A row costs something even if its text is short.
                    size += len(row[1]) + 64
        if rows:
            yield index(rows)

    rows = docs.select(key.alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(shards, _INDEX).withColumn("shard", F.monotonically_increasing_id())


def stored(index: DataFrame) -> DataFrame:
    """An index, written in row groups of bounded size."""
    each = {"parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
    return materialize(index, "fm-index", **each)


class Phrases:
    """Different phrases of a block, each with its items."""

    def __init__(self, rows: list[tuple[bytes, str | None]]):
        numbers: dict[bytes, int] = {}
        of = np.array([numbers.setdefault(bytes(p), len(numbers)) for p, _ in rows], dtype=np.int64)
        order = np.argsort(of, kind="stable")
        self.items = [rows[i][1] for i in order]
        self.first = np.searchsorted(of[order], np.arange(len(numbers) + 1))
        self.words = [p.split() for p in numbers]
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)

    def encoded(self, index: FmIndex) -> np.ndarray:
        patterns = np.zeros((len(self.words), int(self.lengths.max(initial=0))), dtype=np.int64)
        for row, words in enumerate(self.words):
            patterns[row, : len(words)] = index.encode(words)
        return patterns


def find(index: FmIndex, asked: Phrases) -> tuple[list[list[tuple[int, int]]], list[set]]:
    """For each text of the index: merged spans (start, end) of words in occurrences, and the items that occur."""
    low, high = index.ranges(asked.encoded(index), asked.lengths)
    n_texts = len(index.begin) - 1
    turns = np.zeros(int(index.begin[-1]) + 1, dtype=np.int64)
    items: list[set] = [set() for _ in range(n_texts)]
    pairs = [np.empty(0, np.int64)]
    hits = np.flatnonzero(high > low)
    counts = high[hits] - low[hits]
    ends = np.cumsum(counts)
    for at in range(0, int(counts.sum()), _AT_ONCE):
        n = np.arange(at, min(at + _AT_ONCE, int(ends[-1])))
        which = np.searchsorted(ends, n, side="right")
        phrase = hits[which]
        begin = index.locate(high[phrase] - (ends[which] - n))
        np.add.at(turns, begin, 1)
        np.add.at(turns, begin + asked.lengths[phrase], -1)
        text = np.searchsorted(index.begin, begin, side="right") - 1
        pairs.append(np.unique(text * len(asked.words) + phrase))
    for pair in np.unique(np.concatenate(pairs)).tolist():
        text, phrase = divmod(pair, len(asked.words))
        items[text].update(asked.items[asked.first[phrase] : asked.first[phrase + 1]])
    covered = np.cumsum(turns)[:-1] > 0
    edges = np.diff(np.r_[False, covered, False].astype(np.int8))
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n_texts)]
    for start, end in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
        text = int(np.searchsorted(index.begin, start, side="right") - 1)
        spans[text].append((int(start - index.begin[text]), int(end - index.begin[text])))
    return spans, [i - {None} for i in items]


def search(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(shard, at, id, n_words, spans, items) of every row of an index for one block of phrases, which is sent to all tasks."""
    shared = index.sparkSession.sparkContext.broadcast([tuple(r) for r in asked.toLocalIterator()])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Phrases(shared.value)
        for batch in batches:
            for rows, data, shard in zip(*(batch.column(c) for c in ("rows", "index", "shard"))):
                made = FmIndex.loads(data.as_py())
                spans, items = find(made, known)
                lengths = np.diff(made.begin) - 1
                ids, texts = rows.values.field("id"), np.asarray(rows.values.field("text"))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                each = [[{"start": a, "end": b} for a, b in s] for s in spans]
                take = pa.array(texts, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(texts), shard.as_py()), pa.int64()),
                        pa.array(np.arange(len(texts)), pa.int64()),
                        ids,
                        pa.array(lengths[texts], pa.int64()),
                        pa.array(each, kind).take(take),
                        pa.array([sorted(i) for i in items], pa.list_(pa.string())).take(take),
                    ],
                    ["shard", "at", "id", "n_words", "spans", "items"],
                )

    return index.mapInArrow(ask, f"shard long, at long, id binary, n_words long, {_SPANS}, items array<string>")


def merged(spans: Column) -> Column:
    """Spans in order, joined where they touch."""

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"]), joined).otherwise(
            F.concat(done, F.array(span))
        )

    return F.aggregate(F.array_sort(spans), F.lit([]).cast("array<struct<start:bigint,end:bigint>>"), add)


def contaminated_spans(
    docs: DataFrame,
    items: DataFrame,
    key: Column,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, n_words, spans, items): for every row of ``docs`` its number of words, the merged spans (start, end; words
    from 0, ends exclusive) that are in an occurrence of a window of an item, and the ids of the items whose windows occur.

    ``id`` is ``key`` in bytes. Null and empty texts have no words; an item without words has no
    window. Rows of one item id are one item; windows of items with a null id cover words but name no item. Repeated rows,
    and rows with equal or null keys, each get a row. No rows give no rows, no items no spans.
    """
    asked = materialize(phrases(items, item_id, item_text, window), "phrases")
    total = asked.agg(F.sum(F.octet_length("phrase") + F.coalesce(F.octet_length("item"), F.lit(0)) + 64)).first()[0] or 0
    blocks = parts_for(total, block_bytes)
    index = stored(build(docs, key, text))
    of = F.pmod(F.xxhash64("phrase", "item"), F.lit(blocks))
    found = [search(index, asked.where(of == block)) for block in range(blocks)]
    if blocks == 1:
        return found[0].drop("shard", "at")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    # A row for each block.
    grouped = every.groupBy("shard", "at").agg(
        F.first("id").alias("id"),
        F.first("n_words").alias("n_words"),
        merged(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return grouped.drop("shard", "at")


def cut(text: str | None, spans: list) -> str | None:
    """The text without these spans of words; what stands between two removed words goes too."""
    if text is None or not len(spans):
        return text
    data = text.encode()
    places = [m.span() for m in _WORD_RUN.finditer(data)]
    parts, at = [], 0
    for span in spans:
        parts.append(data[at : places[span["start"]][0]])
        at = places[span["end"] - 1][1]
    return b"".join([*parts, data[at:]]).decode()


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with all spans of ``contaminated_spans`` cut out of the texts. Rows and columns stay, whatever their names."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    number = F.monotonically_increasing_id().cast("string").cast("binary").alias("number")
    rows = materialize(docs.select(whole, F.col(f"`{text}`").alias("text"), number), "numbered")
    found = contaminated_spans(rows, items, F.col("number"), **options).where(F.size("spans") > 0)

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut(t, s if s is not None else ()) for t, s in zip(texts, spans)])

    joined = rows.join(found.select("id", "spans"), F.col("number") == F.col("id"), "left")
    return joined.select(*(without("text", "spans").alias(c) if c == text else F.col(f"whole.`{c}`").alias(c) for c in docs.columns))
