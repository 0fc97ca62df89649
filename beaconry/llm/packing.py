"""Cost-balanced packing of tokenised documents into sequences of a fixed capacity.

A piece of l tokens costs ``linear * l + quadratic * l * l``: attention is paid
within a document. Documents are placed in descending length, each into the
sequence with the lowest cost so far among those with room for it. A document
longer than the capacity fills whole sequences first; a document that no
sequence has room for is cut, and its first part fills the cheapest sequence.

Sequences are balanced among the documents of one round, about
``round_tokens`` tokens that follow each other in a partition. So nothing is
shuffled, memory does not grow with the input or with a hot source, and a lost
task is simply run again. Only the last sequences of a round keep padding, less
than one sequence's worth together.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import text_or_empty

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"
# Strings that the vocabulary has beside its ranks: they are cut out of a text before its words are.
ADDED = {"<|endoftext|>": 50256}
# A single blank between two other characters always begins a new word of the byte-level
# pattern (" ?letters", " ?digits", " ?others"), so the words between such blanks are
# tokenised one by one and most come out of a table.
_RUNS = re.compile(r"\s\s")
_BLANK = re.compile(r"(?<=\S) (?=\S)")


@dataclass(frozen=True)
class Budget:
    capacity: int = 2048
    linear: float = 1.0
    quadratic: float = 1 / 1024
    round_tokens: int = 1 << 21

    def cost(self, length):
        return self.linear * length + self.quadratic * length * length


class WordTable(dict):
    """Ids of words as little-endian unsigned 32-bit numbers, filled on demand; at most ``limit`` words."""

    def __init__(self, encode: Callable[[str], list[int]], limit: int = 300_000):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = self[word] = array("I", self.encode(word)).tobytes()
        return ids


def split_words(text: str) -> list[str]:
    """Pieces whose tokenisations, put together, are that of the text."""
    words = _BLANK.split(text) if text[:1].isspace() or text[-1:].isspace() or _RUNS.search(text) else text.split(" ")
    words[1:] = [" " + word for word in words[1:]]
    return words


def load_tokenizer(path: str, pattern: str) -> Callable[[str], list[int]]:
    """Ids of a text by a byte-level vocabulary file with a rank per line; strings of added tokens are ordinary text here (see ``ids_of``)."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def ids_of(text: str, table: WordTable, added: dict[str, int] = ADDED) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit numbers, those of added tokens included."""
    if not any(token in text for token in added):
        return b"".join(map(table.__getitem__, split_words(text)))
    parts = re.split("(" + "|".join(map(re.escape, added)) + ")", text)
    return b"".join(array("I", [added[p]]).tobytes() if p in added else ids_of(p, table, {}) for p in parts if p)


def place(lengths: list[int], budget: Budget) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths, and the cost of each sequence."""
    capacity = budget.capacity
    pieces, costs = [], []
    tails = []
    for document, length in enumerate(lengths):
        whole = length // capacity * capacity
        for start in range(0, whole, capacity):
            pieces.append((document, start, capacity, len(costs), 0))
            costs.append(budget.cost(capacity))
        if length > whole:
            tails.append((length - whole, document, whole))
    tails.sort(key=lambda t: (-t[0], t[1]))
    first = len(costs)
    open_sequences = -(-sum(t[0] for t in tails) // capacity)
    cost, room = np.zeros(open_sequences), np.full(open_sequences, capacity)
    for length, document, start in tails:
        while length:
            fits = room >= length
            if not fits.any():
                fits = room > 0
            at = int(np.where(fits, cost, np.inf).argmin())
            part = min(length, int(room[at]))
            pieces.append((document, start, part, first + at, capacity - int(room[at])))
            cost[at] += budget.cost(part)
            room[at] -= part
            start, length = start + part, length - part
    return pieces, np.concatenate([np.array(costs, dtype=float), cost])


def pack(
    docs: DataFrame, ranks: str, pattern: str, end_id: int = 1, budget: Budget = Budget(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of all documents with their place: sequence and offset.

    ``ranks`` is the path of a byte-level vocabulary file, the same on every machine,
    ``pattern`` what cuts a text before its pairs are merged; every document's ids end
    with ``end_id``. ``ids`` holds a piece's ids as little-endian unsigned
    32-bit numbers, ``cost`` is what its whole sequence costs. A null text is
    empty: a document of one id. Null ids stay null, repeated rows are packed
    each for itself, other columns are not looked at, no rows give no rows.
    Sequence ids are unique, not gapless.
    """
    words: list[WordTable] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not words:
            words.append(WordTable(load_tokenizer(ranks, pattern)))
        table, end = words[0], array("I", [end_id]).tobytes()
        base, made = TaskContext.get().partitionId() << 36, 0
        names, tokens, held = [], [], 0

        def flush() -> pa.RecordBatch:
            pieces, costs = place([len(t) // 4 for t in tokens], budget)
            columns = list(zip(*pieces))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([names[d] for d in columns[0]], pa.int64()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.int64()),
                    pa.array([tokens[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces], pa.binary()),
                    pa.array([len(tokens[d]) // 4 for d in columns[0]], pa.int64()),
                    pa.array(base + made + np.array(columns[3]), pa.int64()),
                    pa.array(columns[4], pa.int64()),
                    pa.array(costs[np.array(columns[3])], pa.float64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "cost"],
            ), len(costs)

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = body.as_py()
                names.append(name)
                tokens.append(ids_of(body, table) + end if body else end)
                held += len(tokens[-1]) // 4
                if held >= budget.round_tokens:
                    out, used = flush()
                    yield out
                    made += used
                    names, tokens, held = [], [], 0
        if names:
            yield flush()[0]

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, SCHEMA)
