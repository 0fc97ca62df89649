"""SimHash fingerprints and their links, found by pigeonring filtering.

The 64 bits are a ring of four segments of 16. If two fingerprints differ in at
most three bits, then some segment begins a chain in which the first l segments
together differ in at most l * 3 / 4 bits, for l = 1 to 4: the first segment not
at all, the first two in one bit, the first three in two. So one half of the
second segment is equal as well, and a fingerprint is looked up under eight
keys of 24 bits: four beginnings, two halves. Candidates must keep the budgets
along the chain before all bits are compared.

Keys that many fingerprints share are refined: of the 40 bits that the key
leaves open at most three differ, so five of eight blocks of five bits are
equal, and under such a key of 49 bits there are at most 32,768 different
fingerprints, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import text_or_empty
from beaconry.llm.components import components
from beaconry.session import materialize

DISTANCE = 3
SEGMENTS = [((1 << 16) - 1) << (16 * i) for i in range(4)]
# Fingerprints under one key from which on the key is refined.
CROWD = 4096
# Min-hashes that link texts beside the fingerprints.
BANDS, IN_BAND = 14, 5
_RANDOM = np.random.default_rng(7).integers(0, 1 << 64, (BANDS * IN_BAND, 2), dtype=np.uint64)
_PERMUTATIONS = [(flip, odd | np.uint64(1)) for flip, odd in _RANDOM]
# Shingle hashes of one class that a task compares.
CLASS_BYTES = 16 << 20


def shingles(text: bytes, width: int) -> list[bytes]:
    """Runs of ``width`` words, A-Z lower-cased, joined by a space; all words together if there are fewer."""
    words = text.lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(run) for run in zip(*(words[i:] for i in range(width)))]


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the hashes have it; zero for none."""
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _rehash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n``-th fingerprint; the first has XXH64 itself."""
    if not n:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes ^ np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        for shift in (32, 29):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def fingerprints(
    docs: DataFrame, width: int = 3, seed: int = 42, number: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, prints): ``number`` fingerprints of the shingles' XXH64, as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            found = np.zeros((batch.num_rows, number), dtype=np.uint64)
            for row, text in enumerate(batch.column(1)):
                hashes = np.array([digest(s, seed) for s in shingles(text.as_py(), width)], dtype="<u8")
                found[row] = [fingerprint(_rehash(hashes, n)) for n in range(number)]
            prints = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * number), pa.array(found.reshape(-1).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "prints"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, prints array<long>")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _tables() -> list[tuple[int, int]]:
    """(first segment, mask of the bits of a key) of the eight tables."""
    return [(i, SEGMENTS[i] | (0xFF << (16 * ((i + 1) % 4) + 8 * half))) for i in range(4) for half in range(2)]


def _refinements(mask: int) -> list[int]:
    """Masks with five of the eight blocks of open bits beside those of ``mask``."""
    free = [bit for bit in range(64) if not mask >> bit & 1]
    blocks = [sum(1 << bit for bit in free[i : i + 5]) for i in range(0, 40, 5)]
    return [mask | sum(chosen) for chosen in combinations(blocks, 5)]


def _keys(masks: list[tuple[int, int]]) -> Column:
    """One key for each (table, mask): the table and the masked bits."""
    return F.array(
        *(
            F.struct(F.lit(table).alias("table"), F.col("print").bitwiseAND(F.lit(_signed(mask))).alias("bits"))
            for table, mask in masks
        )
    )


def forest(prints: np.ndarray, first: int) -> list[tuple[int, int]]:
    """Links that connect those of ``prints`` which chains from segment ``first`` connect, a tree for each group.

    Goes from print to print, and compares each with those not reached yet.
    """
    budgets = []
    seen = 0
    for length in range(1, 5):
        seen |= SEGMENTS[(first + length - 1) % 4]
        budgets.append((np.uint64(seen), length * DISTANCE // 4))
    links, rest, ahead = [], prints[1:], [prints[0]]
    while len(rest):
        if not ahead:
            ahead, rest = [rest[0]], rest[1:]
            continue
        here = ahead.pop()
        differ = rest ^ here
        near = np.arange(len(rest))
        for mask, budget in budgets:
            near = near[np.bitwise_count(differ[near] & mask) <= budget]
            if not len(near):
                break
        if len(near):
            links += [(int(here), int(p)) for p in rest[near]]
            ahead += list(rest[near])
            rest = np.delete(rest, near)
    return links


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of links among rows with the same fingerprint number and key; rows come sorted by them."""

    def turns(columns: list[np.ndarray]) -> np.ndarray:
        changes = [c[1:] != c[:-1] for c in columns[:3]]
        return np.flatnonzero(np.r_[True, changes[0] | changes[1] | changes[2]])

    def links(columns: list[np.ndarray]) -> pa.RecordBatch:
        number, _, _, prints, first = columns
        begins = turns(columns)
        ends = np.r_[begins[1:], len(number)]
        found, of = [], []
        for begin, end in zip(begins[ends - begins > 1], ends[ends - begins > 1]):
            tree = forest(prints[begin:end], int(first[begin]))
            found += tree
            of += [int(number[begin])] * len(tree)
        pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["number", "a", "b"])

    held = None
    for batch in batches:
        columns = [np.asarray(c) for c in batch.columns]
        columns[3] = columns[3].view(np.uint64)
        held = columns if held is None else [np.concatenate(pair) for pair in zip(held, columns)]
        if not len(held[0]):
            continue
        cut = int(turns(held)[-1])  # the last key may go on in the next batch
        if cut:
            yield links([c[:cut] for c in held])
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield links(held)


def near_links(prints: DataFrame) -> DataFrame:
    """Links (number, a, b) that connect all of the different (number, print) of one number at ``DISTANCE`` or fewer differing bits.

    Not every pair: under a key, a tree connects those that the key's pairs connect.
    """
    tables = _tables()
    key = ["number", "table", "bits"]
    keyed = prints.select(
        "number", F.explode(_keys([(t, mask) for t, (_, mask) in enumerate(tables)])).alias("key"), "print"
    ).select("number", "key.table", "key.bits", "print")
    crowded = keyed.groupBy(*key).count().where(F.col("count") > CROWD).drop("count")
    plain = keyed.join(crowded, key, "left_anti").select(*key, "print")
    # 448 rows, whatever the input.
    finer = prints.sparkSession.createDataFrame(
        [(t, 1000 * (t + 1) + n, _signed(m)) for t, (_, mask) in enumerate(tables) for n, m in enumerate(_refinements(mask))],
        "table int, finer int, mask long",
    )
    hot = keyed.join(crowded, key).join(F.broadcast(finer), "table")
    rows = plain.union(
        hot.select("number", F.col("finer").alias("table"), F.col("print").bitwiseAND(F.col("mask")).alias("bits"), "print")
    )
    table = F.when(F.col("table") >= 1000, F.floor(F.col("table") / 1000) - 1).otherwise(F.col("table"))
    return (
        rows.withColumn("first", F.shiftright(table.cast("int"), 1))
        .repartition(*key)
        .sortWithinPartitions(*key, "print")
        .mapInArrow(_link_runs, "number int, a long, b long")
    )


def _print_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect the nodes (node, prints) of which any fingerprints are near."""
    each = nodes.select("node", F.posexplode("prints").alias("number", "print"))
    # A fingerprint's node: the smallest of those that have it.
    heads = materialize(each.groupBy("number", "print").agg(F.min("node").alias("head")), "heads")
    same = each.join(heads, ["number", "print"]).select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = near_links(heads.select("number", "print"))
    for end in ("a", "b"):
        of = heads.select(F.col("number"), F.col("print").alias(end), F.col("head").alias(f"head_{end}"))
        near = near.join(of, ["number", end])
    return same.union(near.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))


def _classes(prints: DataFrame) -> DataFrame:
    """(prints, node, class) of the different lists of fingerprints: linked where any of them are near."""
    nodes = prints.groupBy("prints").agg(F.min("doc_id").alias("least"))
    nodes = materialize(nodes.withColumn("node", F.xxhash64("prints")), "prints")
    return nodes.join(components(_print_links(nodes)), "node").withColumnRenamed("component", "class")


def near_classes(docs: DataFrame, width: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Documents are linked at three or fewer differing bits; ``component_id`` is the
    smallest id that links lead to, the document's own included. Texts without
    words (empty, null, blanks) have fingerprint zero and are linked like any
    other. A repeated row is kept as often as it comes; rows with a null id are
    linked, and count as the smallest id only where a class has no other. Other
    columns are not looked at. No rows give no rows.
    """
    prints = materialize(fingerprints(docs, width, seed, 1, doc_id, text), "fingerprints")
    named = _classes(prints)
    least = named.groupBy("class").agg(F.min("least").alias("component_id"))
    named = named.join(least, "class").select("prints", "component_id")
    return prints.join(named, "prints").select("doc_id", F.element_at("prints", 1).alias("fingerprint"), "component_id")


def _hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles(text, width)], dtype="<u8")


def min_hashes(hashes: np.ndarray) -> list[int]:
    """``BANDS`` hashes of ``IN_BAND`` min-hashes each, as signed longs: texts of similarity s share one with 1 - (1 - s^IN_BAND)^BANDS."""
    with np.errstate(over="ignore"):
        least = np.array([((hashes ^ flip) * odd).min() for flip, odd in _PERMUTATIONS], dtype="<u8").reshape(BANDS, IN_BAND)
    return [xxhash.xxh64_intdigest(band.tobytes(), n) - (1 << 63) for n, band in enumerate(least)]


def _band_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of the nodes (node, bands) to the smallest one with the same band."""
    each = materialize(nodes.select("node", F.explode("bands").alias("band")), "bands")
    heads = each.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    return each.join(heads, "band").select(F.col("node").alias("a"), F.col("head").alias("b"))


def _sketches(rows: DataFrame, width: int, seed: int, number: int) -> DataFrame:
    """(digest, doc_id, prints, bands) of the texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for digest, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = _hashes(text, width, seed)
                if len(hashes):
                    prints = np.array([fingerprint(_rehash(hashes, n)) for n in range(number)], dtype=np.uint64)
                    made.append((digest, doc, prints.view(np.int64), min_hashes(hashes)))
            kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = zip(*made) if made else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["digest", "doc_id", "prints", "bands"])

    return rows.select("digest", "doc_id", "text").mapInArrow(run, "digest binary, doc_id long, prints array<long>, bands array<long>")


def _grams(rows: DataFrame, width: int, seed: int) -> DataFrame:
    """(class, least, digest, grams): the different shingles' hashes, sorted, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.unique(_hashes(t.as_py(), width, seed)).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(grams, pa.binary())], ["class", "least", "digest", "grams"])

    return rows.select("class", "least", "digest", "text").mapInArrow(run, "class long, least long, digest binary, grams binary")


def alike(keeper: np.ndarray, grams: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of these sets of hashes (sorted, none empty) have a Jaccard similarity of at least ``similarity`` with the keeper's."""
    sizes = np.array([len(g) for g in grams])
    values = np.concatenate(grams)
    at = np.minimum(np.searchsorted(keeper, values), len(keeper) - 1)
    both = np.add.reduceat((keeper[at] == values).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
    return both >= similarity * (sizes + len(keeper) - both) - 1e-9


def _least_first(similarity: float):
    """Of a class the first text stays and what is like it goes; then the first of the rest, until none is left."""

    def step(texts: pa.Table) -> pa.Table:
        texts = texts.sort_by([("least", "ascending"), ("digest", "ascending")])
        ids, digests = texts["least"].to_pylist(), texts["digest"].to_pylist()
        grams = [np.frombuffer(g, dtype="<u8") for g in texts["grams"].to_pylist()]
        rest, gone, of = np.arange(len(ids)), [], []
        while len(rest) > 1:
            keeper, rest = rest[0], rest[1:]
            copies = alike(grams[keeper], [grams[i] for i in rest], similarity)
            gone += [digests[i] for i in rest[copies]]
            of += [ids[keeper]] * int(copies.sum())
            rest = rest[~copies]
        return pa.table({"digest": pa.array(gone, pa.binary()), "of": pa.array(of, pa.int64())})

    return step


def _copies_of(members: DataFrame, similarity: float) -> DataFrame:
    """(digest, of) of ``members`` (class, least, digest, grams): the texts that go, and the id of the text that they are like.

    Classes of up to ``CLASS_BYTES`` are compared in a task each. Of larger ones a round finds what is like
    the first text, spread over all tasks, until what is left is small enough.
    """
    found = []
    order = F.struct(F.coalesce("least", F.lit((1 << 63) - 1)), "digest")
    while True:
        sums = members.groupBy("class").agg(F.sum(F.octet_length("grams")).alias("bytes"), F.min_by(F.struct("least", "digest", "grams"), order).alias("first"))
        sums = materialize(sums, "class-sizes")
        small = members.join(sums.where(F.col("bytes") <= CLASS_BYTES).select("class"), "class", "left_semi")
        found.append(materialize(small.groupBy("class").applyInArrow(_least_first(similarity), "digest binary, of long"), "copies"))
        large = sums.where(F.col("bytes") > CLASS_BYTES)
        if large.isEmpty():
            break

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keepers, grams = batch.column("keeper").to_pylist(), batch.column("grams").to_pylist()
                near = [bool(alike(np.frombuffer(k, "<u8"), [np.frombuffer(g, "<u8")], similarity)[0]) for k, g in zip(keepers, grams)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class", "least", "digest", "grams", "of")), pa.array(near)], ["class", "least", "digest", "grams", "of", "near"])

        firsts = large.select("class", F.col("first.least").alias("of"), F.col("first.digest").alias("first"), F.col("first.grams").alias("keeper"))
        pairs = members.join(firsts, "class").where("digest <> first").drop("first")
        seen = materialize(pairs.mapInArrow(run, "class long, least long, digest binary, grams binary, of long, near boolean"), "compared")
        found.append(seen.where("near").select("digest", "of"))
        members = seen.where("not near").select("class", "least", "digest", "grams")
    copies = found[0]
    for more in found[1:]:
        copies = copies.union(more)
    return copies


def near_copies(
    docs: DataFrame,
    width: int = 5,
    number: int = 8,
    similarity: float = 0.8,
    seed: int = 42,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, component_id, digest): the rows whose texts are copies or near-copies of that of ``component_id``, a kept row.

    Of equal texts only the smallest id can stay. Three differing bits find few near-copies
    of similarity 0.8, with eight fingerprints as well: texts are linked if any of ``number``
    fingerprints are near, or if they share one of ``BANDS`` bands of min-hashes. Links are
    candidates only. Of a class the smallest id stays, and the texts go whose
    shingles have a Jaccard similarity of at least ``similarity`` with its text's; then the same
    with what is left, until no two that stay are so alike. Texts without words are no copies
    of each other. A null id comes after all others. ``digest`` (SHA-256 of the text) tells
    rows with the same id apart. The rest as in ``near_classes``.
    """
    last = F.lit((1 << 63) - 1)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), last).alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    sketches = materialize(_sketches(rows, width, seed, number), "sketches")
    nodes = sketches.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("prints").alias("prints"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.xxhash64("digest")), "texts")
    classes = materialize(components(_print_links(nodes).union(_band_links(nodes))), "classes")
    crowds = classes.groupBy("component").count().where("count > 1").select("component")
    named = classes.join(crowds, "component").select("node", F.col("component").alias("class"))
    members = nodes.join(named, "node").select("class", "least", F.col("digest").alias("of_digest"))
    chosen = rows.join(members, (F.col("digest") == F.col("of_digest")) & F.col("doc_id").eqNullSafe(F.col("least")))
    grams = materialize(_grams(chosen, width, seed).dropDuplicates(["digest"]), "grams")
    texts = nodes.join(_copies_of(grams, similarity), "digest", "left").select("digest", "least", "of")
    gone = sketches.join(texts, "digest").where("of is not null or doc_id <> least")
    kept = F.coalesce("of", "least")
    return gone.select(F.nullif("doc_id", last).alias("doc_id"), F.nullif(kept, last).alias("component_id"), "digest")
