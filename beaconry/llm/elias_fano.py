"""Monotone sequences in Elias-Fano form and a two-level n-gram trie of them, all flat numpy arrays that may be mapped from files."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

import numpy as np

U = np.uint64


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the set bit number ``rank`` (from 0) in each word."""
    place = np.zeros(len(words), dtype=np.uint64)
    rank = rank.astype(np.uint64)
    for width in (32, 16, 8, 4, 2, 1):
        low = words >> place & U((1 << width) - 1)
        below = np.bitwise_count(low).astype(np.uint64)
        right = rank >= below
        rank = np.where(right, rank - below, rank)
        place = place + np.where(right, U(width), U(0))
    return place.astype(np.int64)


def _mapped(levels, folder: str):
    """The dataclass with its arrays, and those of its parts, written to ``folder`` and mapped from there, read only."""

    def one(name: str, value):
        path = os.path.join(folder, name)
        if isinstance(value, Monotone):
            os.mkdir(path)
            return _mapped(value, path)
        if not isinstance(value, np.ndarray):
            return value
        np.save(f"{path}.npy", value)
        return np.load(f"{path}.npy", mmap_mode="r")

    return replace(levels, **{f.name: one(f.name, getattr(levels, f.name)) for f in fields(levels)})


@dataclass
class Monotone:
    """Non-decreasing integers: low bits packed one after the other, high bits as gaps in unary."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    zeros_before: np.ndarray  # unset bits before each word of ``high``

    @classmethod
    def of(cls, values: np.ndarray) -> Monotone:
        values = values.astype(np.uint64)
        n = len(values)
        reach = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (reach // max(1, n)).bit_length() - 1)
        upper = (values >> U(low_bits)).astype(np.int64)
        places = upper + np.arange(n)
        size = (int(upper[-1]) + n if n else 0) + 2
        bits = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        zeros = 64 - np.bitwise_count(high).astype(np.int64)
        low = np.zeros(-(-n * low_bits // 64) + 2, dtype=np.uint64)
        if low_bits:
            part = values & U((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = shift > U(64 - low_bits)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U(64) - shift[over]))
        return cls(n, low_bits, low, high, np.r_[0, np.cumsum(zeros)])

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), dtype=np.uint64)
        bit = at * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        rest = np.where(shift > 0, self.low[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return (self.low[word] >> shift | rest) & U((1 << self.low_bits) - 1)

    def _ones_before_zero(self, rank: np.ndarray) -> np.ndarray:
        """Set bits before the unset bit number ``rank`` (from 0); all of them if there is none."""
        rank_known = np.minimum(rank, self.zeros_before[-1] - 1)
        word = np.searchsorted(self.zeros_before, rank_known, side="right") - 1
        place = 64 * word + _select_in_word(~self.high[word], rank_known - self.zeros_before[word])
        return np.where(rank < self.zeros_before[-1], np.minimum(place - rank_known, self.n), self.n)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """Values at positions."""
        ones_before = 64 * np.arange(len(self.zeros_before)) - self.zeros_before
        word = np.searchsorted(ones_before, at, side="right") - 1
        place = 64 * word + _select_in_word(self.high[word], at - ones_before[word])
        return ((place - at).astype(np.uint64) << U(self.low_bits)) | self._low(at)

    def next_geq(self, values: np.ndarray) -> np.ndarray:
        """Position of the first element that is not below each value: successor search."""
        values = values.astype(np.uint64)
        upper = (values >> U(self.low_bits)).astype(np.int64)
        begin = np.where(upper > 0, self._ones_before_zero(np.maximum(upper - 1, 0)), 0)
        end = self._ones_before_zero(upper)
        part = values & U((1 << self.low_bits) - 1)
        while True:  # halve the run of elements with the same high bits
            open_ = np.flatnonzero(begin < end)
            if not len(open_):
                return begin
            middle = (begin[open_] + end[open_]) >> 1
            below = self._low(middle) < part[open_]
            begin[open_] = np.where(below, middle + 1, begin[open_])
            end[open_] = np.where(below, end[open_], middle)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, -1 where it is not an element."""
        if not self.n or not len(values):
            return np.full(len(values), -1, dtype=np.int64)
        at = self.next_geq(values)
        there = np.minimum(at, self.n - 1)
        return np.where((at < self.n) & (self[there] == values.astype(np.uint64)), at, -1)


# Steps of a tenth of a thousandth of a decade; the largest number stands for zero.
STEP, ZERO = 4000.0, (1 << 16) - 1


def quantise(probabilities: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities, rounded down so that they never add up to more than one."""
    with np.errstate(divide="ignore"):
        steps = np.ceil(-np.log10(probabilities) * STEP - 1e-9)
    return np.where(probabilities > 0, np.clip(steps, 0, ZERO - 1), ZERO).astype(np.uint16)


def restore(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == ZERO, 0.0, 10.0 ** (-codes.astype(np.float64) / STEP))


@dataclass
class Trie:
    """Contexts, pointers to their successors, successors relative to those of the context before, and quantised probabilities."""

    contexts: Monotone  # hashes
    pointers: Monotone
    names: Monotone  # hashes of all successors
    successors: Monotone  # name, counted on from the last successor of the context before
    discounted: np.ndarray  # code of max(count - discount, 0) / tokens after the context
    left: np.ndarray  # code of the weight left to the lower order, for each context

    @classmethod
    def of(cls, contexts: np.ndarray, owner: np.ndarray, names: np.ndarray, counts: np.ndarray, discount: float) -> Trie:
        """From sorted context hashes and successors (owner, name, count) sorted by owner and name."""
        different, name = np.unique(names, return_inverse=True)
        tokens = np.bincount(owner, weights=counts, minlength=len(contexts))
        kinds = np.bincount(owner, weights=counts > 0, minlength=len(contexts))
        after = np.maximum(tokens, 1)
        last = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True]) if len(owner) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[-1, last])
        base = np.r_[0, np.cumsum(name[last] + 1)[:-1]] if len(last) else last
        return cls(
            Monotone.of(contexts),
            Monotone.of(np.r_[0, np.cumsum(np.bincount(owner, minlength=len(contexts)))]),
            Monotone.of(different),
            Monotone.of(np.repeat(base, sizes) + name),
            quantise(np.maximum(counts - discount, 0) / after[owner]) if len(owner) else np.empty(0, np.uint16),
            quantise(np.where(tokens > 0, discount * kinds / after, 1.0)),
        )

    def mapped(self, folder: str) -> Trie:
        """The same trie with every level in files of an empty folder, mapped from there: lookups read the pages they touch."""
        return _mapped(self, folder)

    def weights(self, contexts: np.ndarray) -> np.ndarray:
        """Codes of the weight that contexts leave to the lower order; all of it for unknown ones."""
        at = self.contexts.find(contexts)
        return np.where(at >= 0, self.left[np.maximum(at, 0)] if self.contexts.n else 0, 0).astype(np.uint16)

    def probabilities(self, contexts: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Codes of the discounted probabilities of names after contexts; zero where unseen."""
        head = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(contexts) else np.empty(0, np.int64)
        run = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(contexts)]))
        owner, name = self.contexts.find(contexts[head]), self.names.find(names)
        codes = np.full(len(contexts), ZERO, dtype=np.uint16)
        known = np.flatnonzero((owner[run] >= 0) & (name >= 0))
        if len(known):
            run, name, owner = run[known], name[known], np.maximum(owner, 0)
            begin, end = self.pointers[owner].astype(np.int64), self.pointers[owner + 1].astype(np.int64)
            base = np.where(begin > 0, self.successors[np.maximum(begin - 1, 0)] + U(1), U(0))
            at = self.successors.find(base[run] + name.astype(np.uint64))
            # Beyond the context's own run of successors begins that of the next one.
            inside = (at >= begin[run]) & (at < end[run])
            codes[known[inside]] = self.discounted[at[inside]]
        return codes
