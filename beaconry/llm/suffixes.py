"""Exact substring dedup: suffixes sorted deep and shallow.

Whether a string of ``length`` bytes also starts in an earlier document is read off
sorted suffixes. Sorting every suffix of the corpus in one order is not needed: strings
that are equal have the same smallest run of ``ANCHOR`` bytes by hash, the anchor, so they
meet in the shard of their anchor. Two rounds of questions (see ``groups``) keep what is
moved small: first which anchors at least two documents have, then, only for
those, the bytes around them.

A shard sorts its suffixes by multikey quicksort, eight bytes a step, down to
``SHALLOW`` bytes; groups that still agree are ordered by blind tries, which compare only
the bytes at which strings branch and check one leaf.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm import groups
from beaconry.llm.groups import Groups, bounds, rows_of, scattered, spread, starts, unpack

LENGTH, ANCHOR, SHALLOW = 50, 24, 24
# Bytes hashed at a time.
BLOCK = 1 << 20
PARTS = 16
REACH = LENGTH - ANCHOR + 1  # anchors that begin inside a string
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
LAST = (1 << 63) - 1

_ASK = "g int, shard long, keys binary, shared binary"
_KNOWN = "g int, shard int, answer binary"
_SEND = "g int, shard long, sizes binary, parts binary, bytes binary, owners binary, state binary"
_MASKS = "g int, shard long, answer binary"


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position, as big-endian numbers: their order is that of the bytes."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))[at].byteswap()


class BlindTrie:
    """Strings of one length in order, by a trie whose nodes know only where and on which bytes strings branch."""

    def __init__(self, first: bytes):
        self.root: list | bytes = first

    def add(self, string: bytes) -> None:
        node = self.root
        while isinstance(node, list):  # blind: bytes between the branches are not looked at
            at, edges, below = node
            n = bisect_left(edges, string[at])
            node = below[n] if n < len(edges) and edges[n] == string[at] else below[0]
        differ = next((i for i, (a, b) in enumerate(zip(string, node)) if a != b), None)
        if differ is None:
            return
        parent, place, here = None, 0, self.root
        while isinstance(here, list) and here[0] < differ:
            place = bisect_left(here[1], string[here[0]])
            parent, here = here, here[2][place]
        if isinstance(here, list) and here[0] == differ:
            n = bisect_left(here[1], string[differ])
            here[1].insert(n, string[differ])
            here[2].insert(n, string)
            return
        pair = sorted([(string[differ], 0, string), (node[differ], 1, here)])
        branch = [differ, [p[0] for p in pair], [p[2] for p in pair]]
        if parent is None:
            self.root = branch
        else:
            parent[2][place] = branch

    def __iter__(self):
        ahead = [self.root]
        while ahead:
            node = ahead.pop()
            if isinstance(node, list):
                ahead += reversed(node[2])
            else:
                yield node


def sort_suffixes(data: np.ndarray, at: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of ``length`` bytes at positions ``at``, and whether each in that order differs from the one before.

    ``data`` needs eight bytes beyond the last string.
    """
    n = len(at)
    order = np.arange(n)
    new = np.zeros(n + 1, dtype=bool)
    new[[0, n]] = True
    # Multikey quicksort: only runs of strings that agree so far go on.
    for depth in range(0, shallow, 8):
        alone = new[:-1] & new[1:]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        run = np.cumsum(new[:-1])[open_]
        key = words_at(data, at[order[open_]] + depth)
        if depth + 8 > length:
            key >>= np.uint64(8 * (depth + 8 - length))
        sub = np.lexsort((key, run)) if depth else np.argsort(key, kind="stable")
        order[open_], key, run = order[open_[sub]], key[sub], run[sub]
        new[open_[1:]] |= (key[1:] != key[:-1]) | (run[1:] != run[:-1])
    if shallow < length:
        _deep(data, at, order, new, length, shallow)
    return order, new[:-1]


def _deep(data: np.ndarray, at: np.ndarray, order: np.ndarray, new: np.ndarray, length: int, depth: int) -> None:
    """Order the runs that agree in ``depth`` bytes: equal strings are put together, different ones go through a blind trie."""
    open_ = np.flatnonzero(~(new[:-1] & new[1:]))
    if not len(open_):
        return
    run = np.cumsum(new[:-1])[open_]
    places = at[order[open_]]
    offsets = [*range(depth, length - 7, 8), length - 8]
    mixed = np.zeros(len(open_), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for offset in offsets:
            mixed = (mixed ^ words_at(data, places + offset)) * _MIX[0]
            mixed ^= mixed >> np.uint64(29)
    sub = np.lexsort((mixed, run))
    run, mixed, places = run[sub], mixed[sub], places[sub]
    differs = (mixed[1:] != mixed[:-1]) | (run[1:] != run[:-1])
    for offset in offsets:  # strings with one hash are compared
        word = words_at(data, places + offset)
        differs |= word[1:] != word[:-1]
    kind = np.cumsum(np.r_[True, differs]) - 1
    first = np.flatnonzero(np.r_[True, differs])
    kind_run = run[first]
    rank = np.zeros(len(first), dtype=np.int64)
    begins = np.flatnonzero(np.r_[True, kind_run[1:] != kind_run[:-1]])
    ends = np.r_[begins[1:], len(first)]
    for begin, end in zip(begins[ends - begins > 1], ends[ends - begins > 1]):
        strings = [data[places[f] + depth : places[f] + length].tobytes() for f in first[begin:end]]
        trie = BlindTrie(strings[0])
        for string in strings[1:]:
            trie.add(string)
        place = {string: i for i, string in enumerate(trie)}
        rank[begin:end] = [place[string] for string in strings]
    last = np.lexsort((rank[kind], run))
    order[open_] = order[open_[sub[last]]]
    kind = rank[kind[last]]
    run = run[last]
    new[open_[1:]] |= (kind[1:] != kind[:-1]) | (run[1:] != run[:-1])


class Runs:
    """The strings of a group's texts, in runs of neighbours with the same anchor."""

    def __init__(self, docs: pa.Table):
        texts = docs["text"].cast(pa.large_binary()).combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        buffer = texts.buffers()[2] if len(texts) else None
        size = int(ends[-1] - ends[0])
        self.data = np.zeros(size + 192, dtype=np.uint8)
        if size:
            self.data[:size] = np.frombuffer(buffer, dtype=np.uint8)[ends[0] : ends[-1]]
        self.begin, self.lengths = ends[:-1] - ends[0], np.diff(ends)
        self.ids = np.array([LAST if i is None else i for i in docs["doc_id"].to_pylist()], dtype=np.int64)
        parts = [self._block(at, min(BLOCK, size - at)) for at in range(0, size - LENGTH + 1, BLOCK)]
        empty = np.empty(0, np.int64)
        self.first, self.count, self.doc = (np.concatenate([empty, *(p[i] for p in parts)]) for i in range(3))
        self.keys = np.concatenate([empty.astype(np.uint64), *(p[3] for p in parts)])

    def _block(self, base: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs (first string, strings, document, key of the anchor) of the strings that begin in a block of the bytes."""
        length = size + REACH - 1
        data = self.data[base : base + length + ANCHOR + 8]
        windows = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        with np.errstate(over="ignore"):
            hashes = np.zeros(length, dtype=np.uint64)
            for offset, odd in zip(range(0, ANCHOR, 8), _MIX):
                hashes ^= windows[offset : offset + length]
                hashes *= odd
                hashes ^= hashes >> np.uint64(32)
        # Smallest hash of each string's anchors, the first among equals.
        best, place, width = hashes, np.arange(length, dtype=np.int32), 1
        while width < REACH:
            step = min(width, REACH - width)
            right = best[step:] < best[:-step]
            best, place = np.where(right, best[step:], best[:-step]), np.where(right, place[step:], place[:-step])
            width += step
        at = np.arange(base, base + size)
        doc = np.searchsorted(self.begin, at, side="right") - 1
        whole = np.flatnonzero(at + LENGTH <= (self.begin + self.lengths)[doc])
        if not len(whole):
            empty = np.empty(0, np.int64)
            return empty, empty, empty, empty.astype(np.uint64)
        fresh = np.r_[True, (place[whole[1:]] != place[whole[:-1]]) | (np.diff(whole) != 1) | (doc[whole[1:]] != doc[whole[:-1]])]
        begins = np.flatnonzero(fresh)
        first = whole[begins]
        return base + first, np.diff(np.r_[begins, len(whole)]), doc[first], scattered(hashes[place[first]])


def _ask(n: int):
    def step(g: int, docs: pa.Table) -> pa.Table:
        runs = Runs(docs)
        order = np.lexsort((runs.ids[runs.doc], runs.keys))
        keys, ids = runs.keys[order], runs.ids[runs.doc][order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
        last = np.r_[first[1:], len(keys)] - 1 if len(first) else first
        shared = ids[first] != ids[last] if len(first) else np.empty(0, bool)
        keys = keys[first]
        cuts = bounds(spread(keys, n), n)
        # 48 bits of a key are enough to ask; a key more than needed costs only its bytes.
        short = np.empty(len(keys), dtype=[("low", "<u4"), ("high", "<u2")])
        short["low"], short["high"] = (keys >> np.uint64(16)) & np.uint64(0xFFFFFFFF), keys >> np.uint64(48)
        pairs = list(zip(cuts[:-1], cuts[1:]))
        return rows_of(
            {
                "g": ([g] * n, pa.int32()),
                "shard": (range(n), pa.int64()),
                "keys": ([short[a:b].tobytes() for a, b in pairs], pa.binary()),
                "shared": ([np.packbits(shared[a:b]).tobytes() for a, b in pairs], pa.binary()),
            }
        )

    return step


def _know(shard: int, rows: pa.Table) -> pa.Table:
    """Which of the keys of each group some other document has as well, a bit for each."""
    packed = unpack(rows["keys"], [("low", "<u4"), ("high", "<u2")])
    keys = np.concatenate([x["low"].astype(np.uint64) | x["high"].astype(np.uint64) << np.uint64(32) for x in packed])
    shared = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(rows["shared"].to_pylist(), packed)])
    _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
    wanted = np.zeros(len(times), dtype=bool)
    wanted[at[shared > 0]] = True
    wanted |= times > 1
    cuts = np.cumsum([0, *map(len, packed)])
    return rows_of(
        {
            "g": (rows["g"].to_pylist(), pa.int32()),
            "shard": ([shard] * len(rows), pa.int32()),
            "answer": ([np.packbits(wanted[at[a:b]]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
        }
    )


def _part(keys: np.ndarray, n: int) -> np.ndarray:
    """A shard sorts its suffixes in this many parts, one after the other: ranges of its keys, so sorted keys have sorted parts."""
    return (spread(keys, n * PARTS) % PARTS).astype(np.uint8)


def planes(numbers: np.ndarray) -> bytes:
    """All lowest bytes, then all next ones: upper bytes, mostly alike, compress well in the shuffle."""
    return np.ascontiguousarray(numbers).view("u1").reshape(len(numbers), numbers.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(size, -1).T).reshape(-1).view(kind)


def pack_state(first: np.ndarray, count: np.ndarray, opens: np.ndarray, later: np.ndarray) -> bytes:
    """What a group notes of its runs: where they are, which open a new entry, and which ask for a later document."""
    n = np.array([len(first)], "<u8").tobytes()
    return b"".join(
        [n, planes(first.astype("<u4")), count.astype("u1").tobytes(), np.packbits(opens).tobytes(), np.packbits(later).tobytes()]
    )


def unpack_state(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first, count, entry, later."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    n = int(np.frombuffer(data[:8], "<u8")[0])
    cuts = np.cumsum([8, 4 * n, n, -(-n // 8), -(-n // 8)])
    first, count, opens, later = (data[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
    bits = [np.unpackbits(np.frombuffer(x, "u1"), count=n) for x in (opens, later)]
    entry = np.cumsum(bits[0], dtype=np.int64) - 1
    return from_planes(first, "<u4").astype(np.int64), np.frombuffer(count, "u1").astype(np.int64), entry, bits[1].astype(bool)


def _send(n: int):
    def step(g: int, docs: pa.Table, answers: pa.Table) -> pa.Table:
        runs = Runs(docs)
        keys, at = np.unique(runs.keys, return_inverse=True)
        cuts = bounds(spread(keys, n), n)
        answers = answers.sort_by("shard").to_pylist()
        wanted = [np.unpackbits(np.frombuffer(r["answer"], np.uint8), count=b - a) for r, a, b in zip(answers, cuts[:-1], cuts[1:])]
        wanted = np.concatenate(wanted).astype(bool) if wanted else np.empty(0, bool)
        mine = np.flatnonzero(wanted[at]) if len(keys) else np.empty(0, int)
        first, count, doc, key = runs.first[mine], runs.count[mine], runs.doc[mine], runs.keys[mine]
        size = count + LENGTH - 1
        # Runs with the same bytes ask once, for the document with the smallest id.
        width = LENGTH + REACH - 1
        strings = np.lib.stride_tricks.sliding_window_view(runs.data, width)[first]
        strings[np.arange(width)[None, :] >= size[:, None]] = 0
        ids = runs.ids[doc]
        mixed = np.zeros(len(mine), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for word in np.pad(strings, ((0, 0), (0, -width % 8))).view("<u8").T:
                mixed = (mixed ^ word) * _MIX[1]
                mixed ^= mixed >> np.uint64(31)
            mixed ^= size.astype(np.uint64) * _MIX[2]
        shard = spread(key, n)
        order = np.lexsort((np.arange(len(mine)), ids, mixed, key, shard))
        same = np.zeros(len(mine), dtype=bool)
        a, b = order[1:], order[:-1]
        if len(order):
            same[1:] = (key[a] == key[b]) & (mixed[a] == mixed[b]) & (size[a] == size[b]) & (strings[a] == strings[b]).all(axis=1)
        entry_of = np.cumsum(~same) - 1 if len(order) else np.empty(0, np.int64)
        heads = order[~same] if len(order) else order
        later = ids[order] > ids[heads][entry_of] if len(order) else np.empty(0, bool)
        state = pack_state(first[order], count[order], ~same, later)
        places = bounds(shard[heads], n)
        pairs = list(zip(places[:-1], places[1:]))
        inside = np.arange(width)[None, :] < size[heads][:, None]
        return rows_of(
            {
                "g": ([g] * (n + 1), pa.int32()),
                "shard": ([*range(n), -1 - g], pa.int64()),
                "sizes": ([*(count[heads[a:b]].astype("u1").tobytes() for a, b in pairs), b""], pa.binary()),
                "parts": ([*(_part(key[heads[a:b]], n).tobytes() for a, b in pairs), b""], pa.binary()),
                "bytes": ([*(strings[heads[a:b]][inside[a:b]].tobytes() for a, b in pairs), b""], pa.binary()),
                "owners": ([*(planes(ids[heads[a:b]]) for a, b in pairs), b""], pa.binary()),
                "state": ([*[b""] * n, state], pa.binary()),
            }
        )

    return step


def _masks(shard: int, rows: pa.Table) -> pa.Table:
    """For each string of each run, whether a document with a smaller id has it; what a group noted for itself goes back."""
    if shard < 0:
        return rows_of({"g": (rows["g"].to_pylist(), pa.int32()), "shard": ([shard] * len(rows), pa.int64()), "answer": (rows["state"].to_pylist(), pa.binary())})
    counts = unpack(rows["sizes"], "u1")
    count = np.concatenate(counts).astype(np.int64)
    data = np.frombuffer(b"".join([*rows["bytes"].to_pylist(), bytes(96)]), dtype=np.uint8)
    owner = np.concatenate([from_planes(x, "<i8") for x in rows["owners"].to_pylist()])
    begin, part = starts(count + LENGTH - 1), np.concatenate(unpack(rows["parts"], "u1"))
    masks = np.zeros(len(count), dtype=np.uint32)
    for n in range(PARTS):
        own = np.flatnonzero(part == n)
        if not len(own):
            continue
        run = np.repeat(own, count[own])
        offset = np.arange(len(run)) - np.repeat(starts(count[own]), count[own])
        order, new = sort_suffixes(data, begin[run] + offset)
        owners = owner[run[order]]
        least = np.minimum.reduceat(owners, np.flatnonzero(new))[np.cumsum(new) - 1]
        covered = order[owners > least]
        np.bitwise_or.at(masks, run[covered], np.uint32(1) << offset[covered].astype(np.uint32))
    cuts = np.cumsum([0, *map(len, counts)])
    return rows_of(
        {
            "g": (rows["g"].to_pylist(), pa.int32()),
            "shard": ([shard] * len(rows), pa.int64()),
            "answer": ([masks[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
        }
    )


def _cut(g: int, docs: pa.Table, answers: pa.Table) -> pa.Table:
    answers = sorted(answers.to_pylist(), key=lambda r: r["shard"])
    at_first, count, entry, later = unpack_state(b"".join(r["answer"] for r in answers if r["shard"] < 0))
    masks = np.frombuffer(b"".join(r["answer"] for r in answers if r["shard"] >= 0), dtype=np.uint32)
    texts = docs["text"].cast(pa.binary()).to_pylist()
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begin = starts(lengths)
    total = int(lengths.sum())
    edges = np.zeros(total + 1, dtype=np.int32)
    first = np.repeat(at_first, count)
    offset = np.arange(len(first)) - np.repeat(starts(count), count)
    mask = np.where(later, np.uint32(0xFFFFFFFF), masks[entry] if len(masks) else np.uint32(0))
    hit = (np.repeat(mask, count) >> offset.astype(np.uint32) & np.uint32(1)).astype(bool)
    at = (first + offset)[hit]
    np.add.at(edges, at, 1)
    np.add.at(edges, at + LENGTH, -1)
    removed = np.cumsum(edges[:-1]) > 0
    spans, kept = [], []
    for text, a, n in zip(texts, begin, lengths):
        own = removed[a : a + n]
        if own.any():
            turns = np.flatnonzero(np.diff(np.r_[False, own, False]))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turns[::2], turns[1::2])])
            kept.append(np.frombuffer(text, np.uint8)[~own].tobytes())
        else:
            spans.append([])
            kept.append(text)
    return rows_of(
        {
            "doc_id": (docs["doc_id"].to_pylist(), pa.int64()),
            "n_bytes": (lengths, pa.int64()),
            "spans": (spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept": (kept, pa.binary()),
        }
    )


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row.

    Removed is each byte covered by a 50-byte string that also starts in a document with a
    smaller id; strings are those of the input. ``spans`` are the maximal removed runs
    of bytes, ``kept`` the other bytes. Rows with the same id are no earlier
    documents for each other, a null id is after all others; a null text is empty, texts
    under 50 bytes stay whole. Other columns are not looked at. No rows give no rows.
    """
    dealt = Groups(docs, doc_id, text, each=groups.GROUP_BYTES // 2)
    known = dealt.shards(dealt.map(_ask(dealt.n), _ASK), _know, _KNOWN)
    sent = dealt.answered(known, _send(dealt.n), _SEND)
    masks = dealt.shards(sent, _masks, _MASKS)
    return dealt.answered(
        masks, _cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    )


def digest(rows: DataFrame) -> DataFrame:
    """What ``without_repeats`` returns, in numbers and a checksum."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
