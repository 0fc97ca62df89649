"""Spelling variants: words one edit apart, by blocked products of letter counts.

Two words that differ by one inserted, deleted or replaced letter have letter counts at a squared distance of at
most two, |a|^2 + |b|^2 - 2 a.b. Words are dealt into blocks by how many letters of each of a few classes they have:
one edit leads to the same block or to one in which one class has one more, or one has one more and another one
less. So each block is compared with itself and with these neighbours, of its own length and the next. In a task the blocks are
split again in the same way, and the matrix product of two small blocks gives all distances in them. What
is near enough is verified letter by letter. A task returns one row for each word: how many near
words it has there, and the best; pairs are never written.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.session import materialize

LETTERS, LEAST_LETTERS, LEAST_COUNT, MULTIPLE = "A-Za-zÀ-ÿ", 7, 2, 10
# One in so many occurrences loses a letter.
DAMAGE = 31
# Words of a block on either side of a task; larger ones are split into parts.
BLOCK_WORDS = 20_000
COARSE = (3, 4, 5, 6)
# Different words a task counts before it hands them on.
_COUNTED = 400_000
# Products held at once.
_CELLS = 1 << 22
_LOWER = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
# Letters of a-z by how common they are, so that classes have about equal shares.
_BY_USE = "enatiorhsulcdfgbmzwypkqxjv"

_COUNTS = "word string, n long"
_NEAR = "word string, n_near long, form string, form_n long"


def classes(m: int) -> list[str]:
    """All letters in ``m`` classes, dealt to and fro in the order of their use."""
    letters = _BY_USE + "".join(map(chr, range(0xC0, 0x100)))
    turn = [*range(m), *reversed(range(m))]
    return ["".join(x for i, x in enumerate(letters) if turn[i % (2 * m)] == c) for c in range(m)]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", damage: int = DAMAGE) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least seven letters and two occurrences overall.

    An occurrence for which ``damage`` divides the crc32 of ``doc_id:run`` loses one letter; with 0 none does. A null id is
    written as nothing, a null text has no words.
    """
    run = re.compile(f"[{LETTERS}]{{{LEAST_LETTERS},}}")

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = run.findall(text.encode().translate(_LOWER).decode())
                if damage:
                    seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for i, word in enumerate(words):
                        h = zlib.crc32(word.encode(), seed)
                        if h % damage == 0:
                            at = h % len(word)
                            words[i] = word[:at] + word[at + 1 :]
                counts.update(words)
                if len(counts) > _COUNTED:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    found = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(count, _COUNTS)
    long_enough = found.where(F.length("word") >= LEAST_LETTERS)
    return long_enough.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def signature(word: str, m: int) -> Column:
    """How many letters of each class a word has."""
    return F.array(*(F.length(word) - F.length(F.translate(word, letters, "")) for letters in classes(m)))


def neighbours(own: Column, m: int) -> Column:
    """The blocks in which a word is looked for: those that an edit leads from to its own, one of each two directions."""

    def changed(up: int | None, down: int | None) -> Column:
        return F.array(*(F.get(own, i) - F.lit(int(i == up)) + F.lit(int(i == down)) for i in range(m)))

    moves = [changed(None, None), *(changed(i, None) for i in range(m))]
    return F.array(*moves, *(changed(i, j) for i in range(m) for j in range(i + 1, m)))


class Side:
    """Words of one length: code points, letter counts, and fine blocks."""

    def __init__(self, words: list[str], m: int):
        length = len(words[0]) if words else 0
        self.codes = np.array(words, dtype=f"<U{max(1, length)}").view(np.uint32).reshape(len(words), max(1, length))
        column = np.where(self.codes < 128, self.codes - 97, self.codes - 0xC0 + 26).astype(np.int64)
        self.counts = np.zeros((len(words), 26 + 64), dtype=np.float32)
        at = np.arange(len(words))
        for i in range(length):
            self.counts[at, column[:, i]] += 1
        weights = class_weights(m)
        letter_of = np.zeros(26 + 64, dtype=np.uint64)
        for c, letters in enumerate(classes(m)):
            for x in letters:
                letter_of[ord(x) - 97 if ord(x) < 128 else ord(x) - 0xC0 + 26] = weights[c]
        with np.errstate(over="ignore"):
            code = (self.counts.astype(np.uint64) * letter_of).sum(axis=1, dtype=np.uint64)
        self.order = np.argsort(code, kind="stable")
        code = code[self.order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
        ends = np.r_[first, len(code)][1:]
        self.blocks = {int(code[a]): self.order[a:b] for a, b in zip(first, ends)}
        self.norms = (self.counts**2).sum(axis=1)


def class_weights(m: int) -> np.ndarray:
    """A number for each class: a block's code is the sum of its letters' numbers, so an edit changes it by a known amount."""
    return np.array([zlib.crc32(b"class %d" % i) << 32 | zlib.crc32(b"letters %d" % i) | 1 for i in range(m)], dtype=np.uint64)


def near_pairs(left: Side, right: Side, longer: bool, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places on the left, on the right) of words one edit apart; those on the right have one letter more if ``longer``."""
    weights = [int(w) for w in class_weights(m)]
    moves = weights if longer else [0, *(a - b for a in weights for b in weights if a != b)]
    full = 1 << 64
    for code, mine in left.blocks.items():
        there = [right.blocks[c] for move in moves if (c := (code + move) % full) in right.blocks]
        if not there:
            continue
        others = np.concatenate(there)
        height = max(1, _CELLS // len(others))
        for a in range(0, len(mine), height):
            part = mine[a : a + height]
            products = left.counts[part] @ right.counts[others].T
            distance = left.norms[part][:, None] + right.norms[others][None, :] - 2 * products
            rows, columns = np.nonzero(distance <= 2)
            u, v = part[rows], others[columns]
            same = one_edit(left.codes[u], right.codes[v], longer)
            yield u[same], v[same]


def one_edit(a: np.ndarray, b: np.ndarray, longer: bool) -> np.ndarray:
    """Whether each row of ``b`` is the row of ``a`` with one letter replaced, or inserted."""
    if not longer:
        return (a != b).sum(axis=1) == 1
    ahead = np.cumprod(a == b[:, :-1], axis=1).sum(axis=1)
    behind = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= a.shape[1]


def _compare(left: pa.Table, right: pa.Table) -> pa.Table:
    """Near words in blocks: per word their number and the best of them, by count and then by code points."""
    empty = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "form": pa.array([], pa.string()), "form_n": pa.array([], pa.int64())})
    if not left.num_rows or not right.num_rows:
        return empty
    own, own_n = left["word"].to_pylist(), np.asarray(left["n"])
    words, n = right["word"].to_pylist(), np.asarray(right["n"])
    m = 6 if len(own) < 20_000 else 8
    every = np.array(own + words, dtype=object)
    both_n = np.r_[own_n, n]
    # The place of a word in the order of preference; a word may be on both sides.
    order = sorted(range(len(every)), key=lambda i: (-both_n[i], every[i]))
    preference = np.empty(len(every), dtype=np.int64)
    preference[order] = np.arange(len(every))
    near, best = np.zeros(len(every), dtype=np.int64), np.full(len(every), len(every), dtype=np.int64)
    mine, size = Side(own, m), len(own[0])
    for longer in (False, True):
        chosen = np.array([i for i, w in enumerate(words) if len(w) == size + longer], dtype=np.int64)
        if not len(chosen):
            continue
        others = Side([words[i] for i in chosen], m)
        # In its own block a pair is met twice and counted once.
        inside = np.asarray(right["own"])[chosen]
        for u, v in near_pairs(mine, others, longer, m):
            at = chosen[v]
            once = ~inside[v] | (every[u] < every[len(own) + at])
            u, at = u[once], len(own) + at[once]
            near += np.bincount(u, minlength=len(every)) + np.bincount(at, minlength=len(every))
            np.minimum.at(best, u, preference[at])
            np.minimum.at(best, at, preference[u])
    got = np.flatnonzero(near)
    forms = [order[p] for p in best[got]]
    return pa.table(
        {
            "word": pa.array(every[got].tolist(), pa.string()),
            "n_near": pa.array(near[got], pa.int64()),
            "form": pa.array([every[i] for i in forms], pa.string()),
            "form_n": pa.array(both_n[forms], pa.int64()),
        }
    )


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near ones: their number, the one with the largest count
    (of equal ones the smallest), and its count. ``words`` has (word, n), each word once."""
    for m in COARSE:
        blocks = words.groupBy(signature("word", m).alias("block")).count()
        if (blocks.agg(F.max("count")).first()[0] or 0) <= block_words:
            break
    own = words.select("word", "n", signature("word", m).alias("own_block"))
    left = own.select(F.col("own_block").alias("block"), "word", "n")
    right = own.select(F.explode(neighbours(F.col("own_block"), m)).alias("block"), "own_block", "word", "n")
    # New names for the same columns: Spark takes the two sides apart by them.
    right = right.select(
        "block", F.col("word").alias("word"), F.col("n").alias("n"), (F.col("block") == F.col("own_block")).alias("own")
    )
    lefts = materialize(left.groupBy("block").agg(F.count("*").alias("n_left")), "blocks")
    # Blocks without words of their own have nothing to compare with.
    right = right.join(lefts.select("block"), "block", "left_semi")
    rights = right.groupBy("block").agg(F.count("*").alias("n_right"))
    sizes = materialize(lefts.join(rights, "block"), "block-sizes")
    largest = sizes.agg(F.max("n_left"), F.max("n_right")).first()
    key = ["block"]
    if (largest[0] or 0) > block_words or (largest[1] or 0) > 8 * block_words:
        # Both sides of a large block in parts; each part meets each.
        key = ["block", "row", "column"]
        down, across = F.ceil(F.col("n_left") / block_words).cast("int"), F.ceil(F.col("n_right") / (8 * block_words)).cast("int")
        part = F.xxhash64("word")
        left = left.join(sizes, "block").select(
            "block", "word", "n", F.pmod(part, down).cast("int").alias("row"), F.explode(F.sequence(F.lit(0), across - 1)).alias("column")
        )
        right = right.join(sizes, "block").select(
            "block", "word", "n", "own", F.pmod(part, across).cast("int").alias("column"), F.explode(F.sequence(F.lit(0), down - 1)).alias("row")
        )
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_compare, _NEAR)
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), F.col("form")))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return near.select("word", "n_near", "best.form", "best.form_n")


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where forms lead in the end. Every round doubles the steps that have been followed."""
    roots = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    while roots.where("open").limit(1).count():
        ahead = roots.select(F.col("word").alias("at"), F.col("root").alias("to"))
        joined = roots.join(ahead, F.col("root") == F.col("at"), "left")
        roots = materialize(
            joined.select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("open")), "roots"
        )
    return roots.drop("open")


def variants(words: DataFrame, multiple: int = MULTIPLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of (word, n).

    ``form`` is the near word with the largest count (of equal ones the smallest), where that is at least ``multiple`` times
    the word's own; ``root`` is where forms lead in the end, the word itself without one. Counts
    grow along forms, so they lead in no circle. No words give no rows.
    """
    words = materialize(words.select("word", "n"), "words")
    near = near_words(words, block_words)
    known = F.col("form_n") >= multiple * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(known, F.col("form")).alias("form"),
        F.when(known, F.col("form_n")).alias("form_n"),
    )
    joined = materialize(joined, "variants")
    roots = with_roots(joined.where("form is not null"))
    return joined.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
