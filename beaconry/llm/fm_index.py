"""An FM-index over sequences of words: backward search by wavelet-tree ranks, places from sampled suffix positions.

Every sequence ends in a mark that sorts before all words and differs from all other marks, so
that no suffix runs on into the next sequence and copies are told apart by their order.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterable

import numpy as np

SAMPLE = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in their order, by doubling: only suffixes that still tie are sorted again.

    The last symbol occurs once, so that no two suffixes tie to the end.
    """
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64)
    bits = max(1, int(symbols.max()).bit_length())
    depth = max(1, min(4, 62 // bits, n))
    key = np.zeros(n, dtype=np.int64)
    for j in range(depth):
        key <<= bits
        key[: n - j] |= symbols[j:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.r_[True, key[1:] != key[:-1]]
    del key
    rank = np.empty(n, dtype=np.int64)
    slots = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(first, slots, 0))
    tied = slots[~(first & np.r_[first[1:], True])]
    while len(tied):
        suffixes = order[tied]
        pair = rank[suffixes] * n + rank[suffixes + depth]
        by = np.argsort(pair, kind="stable")
        suffixes, pair = suffixes[by], pair[by]
        order[tied] = suffixes
        first = np.r_[True, pair[1:] != pair[:-1]]
        rank[suffixes] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
        tied = tied[~(first & np.r_[first[1:], True])]
        depth *= 2
    return order


class Bits:
    """A bit vector with the number of ones before each place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.ones = np.r_[0, np.cumsum(np.bitwise_count(self.words))[:-1]].astype(np.int32)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place ``at`` (0 to the length)."""
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[at >> 6] + np.bitwise_count(self.words[at >> 6] & below).astype(np.int64)


class WaveletTree:
    """Symbols by their bits from the highest on, a bit vector for each level."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels, self.zeros = [], []
        rest = symbols
        for shift in reversed(range(max(1, (size - 1).bit_length()))):
            ones = (rest >> shift) & 1 == 1
            self.levels.append(Bits(ones))
            self.zeros.append(int(len(rest) - ones.sum()))
            rest = np.concatenate([rest[~ones], rest[ones]])
        # Where each symbol begins below the last level.
        self.begin = np.full(size, 0, dtype=np.int64)
        if len(rest):
            first = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
            self.begin[rest[first]] = first

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place ``at``."""
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(at)
            up = (symbols >> (len(self.levels) - 1 - level)) & 1 == 1
            at = np.where(up, zeros + ones, at - ones)
        return at - self.begin[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before it."""
        symbols = np.zeros(len(at), dtype=np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            up = bits.get(at)
            ones = bits.rank(at)
            symbols = symbols << 1 | up
            at = np.where(up, zeros + ones, at - ones)
        return symbols, at - self.begin[symbols]


class FmIndex:
    """Index of word sequences. Words are numbered in order of appearance; symbol 0 stands for every mark.

    The sequences are gone through once, and their words are not kept.
    """

    def __init__(self, sequences: Iterable[list[bytes]]):
        self.names: dict[bytes, int] = {}
        names, numbers, lengths = self.names, array("i"), array("q")
        for sequence in sequences:
            numbers.extend([names.setdefault(w, len(names) + 1) for w in sequence])
            lengths.append(len(sequence))
        words, lengths, marks = np.array(numbers, dtype=np.int32), np.array(lengths, dtype=np.int64), len(lengths)
        del numbers
        # A sequence's place in the text; its mark follows its words.
        self.begin = np.r_[0, np.cumsum(lengths + 1)]
        symbols = np.empty(len(words) + marks, dtype=np.int32)
        is_mark = np.zeros(len(symbols), dtype=bool)
        is_mark[self.begin[1:] - 1] = True
        symbols[~is_mark] = words + marks - 1
        symbols[is_mark] = np.arange(marks)
        order = suffix_order(symbols)
        size = len(names) + 1
        plain = symbols
        plain[is_mark] = 0
        plain[~is_mark] = words
        del words
        self.before = np.r_[0, np.cumsum(np.bincount(plain, minlength=size))]
        self.tree = WaveletTree(plain[order - 1] if len(order) else plain, size)
        sampled = order % SAMPLE == 0
        sampled |= np.isin(order, self.begin[:-1])
        self.sampled, self.positions = Bits(sampled), order[sampled].astype(np.int32)

    def dumps(self) -> bytes:
        return pickle.dumps(self, protocol=5)

    @staticmethod
    def loads(data: bytes) -> "FmIndex":
        return pickle.loads(data)

    def encode(self, words: list[bytes]) -> list[int]:
        """Numbers of words; 0 for those the index does not have."""
        return [self.names.get(w, 0) for w in words]

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern (a row of word numbers, padded on the right)."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.begin[-1], dtype=np.int64)
        inside = np.arange(patterns.shape[1])[None, :] < lengths[:, None]
        dead = (lengths == 0) | ((patterns == 0) & inside).any(axis=1)
        high[dead] = 0
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((high > low) & (lengths > step))
            if not len(live):
                break
            word = patterns[live, lengths[live] - 1 - step]
            for ends in (low, high):
                ends[live] = self.before[word] + self.tree.rank(word, ends[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back in the text until a sampled position."""
        found, steps = np.empty(len(rows), dtype=np.int64), 0
        ahead, at = np.arange(len(rows)), rows
        while len(ahead):
            here = self.sampled.get(at)
            found[ahead[here]] = self.positions[self.sampled.rank(at[here])] + steps
            ahead, at = ahead[~here], at[~here]
            symbols, earlier = self.tree.access(at)
            at = self.before[symbols] + earlier
            steps += 1
        return found
