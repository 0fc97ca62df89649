"""Winnowing: document fingerprints that are sure to meet in any long shared passage.

Every run of ``k`` code points gets a rolling hash, and of every ``window``
consecutive hashes the smallest is kept, the rightmost among equal ones, with its
position. Two texts that share ``window + k - 1`` consecutive code points share a kept
hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import parts_for, text_or_empty

K, WINDOW = 12, 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def rolling_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` codes: a polynomial, put together from runs of half the length, then mixed."""
    hashes, length, base = codes.astype(np.uint64) + np.uint64(1), 1, _BASE
    total, done = None, 0
    rest, n = k, len(codes) - k + 1
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                part = hashes[done : done + n]
                total = part.copy() if total is None else total * base + part
                done += length
            rest >>= 1
            if rest:
                hashes = hashes[:-length] * base + hashes[length:]
                base, length = base * base, length * 2
        total ^= total >> np.uint64(32)
        total *= _MIX
        return total ^ (total >> np.uint64(29))


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes (32 bits) and their positions. A text shorter than a window keeps its least hash, one shorter
    than ``k`` the hash of all of it, an empty text nothing."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    if not len(codes):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    hashes = (rolling_hashes(codes, min(k, len(codes))) >> np.uint64(32)).astype(np.uint32)
    window = min(window, len(hashes))
    # The position in the low bits, counted down, so that the rightmost of equal hashes is the least.
    places = np.arange(len(hashes), dtype=np.uint64)
    least = (hashes.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - places)
    width = 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    kept = least[np.r_[True, least[1:] != least[:-1]]]
    return (kept >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF))).astype(np.int64)


def printed(hashes: np.ndarray) -> str:
    """A fingerprint as text: eight hex digits for each kept hash, in order of position."""
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the hashes of either fingerprint that both have; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    union = len(np.union1d(a, b))
    return (len(a) + len(b) - union) / union if union else 1.0


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint, hashes, positions) of every row; a null text is empty, other columns are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            kept = [winnow(t, k, window) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([printed(h) for h, _ in kept], pa.string()),
                    pa.array([h.astype(np.int64) for h, _ in kept], pa.list_(pa.int64())),
                    pa.array([p for _, p in kept], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_chars", "fingerprint", "hashes", "positions"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string, hashes array<long>, positions array<long>")


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, positions array<long>"
)


def edited_fingerprints(
    docs: DataFrame,
    k: int = K,
    window: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
    rows_each: int = 5000,
) -> DataFrame:
    """Every document's fingerprint, with the positions of its hashes, beside that of its edited text and of the next document.

    The edited text has its last quarter (rounded down) replaced by the first as many
    code points of the next document in order of id, or all of them if it has fewer;
    after the last document comes the first. Rows with the same id follow each other
    in order of their texts, a null id comes first, a null text is empty; a single row is
    its own next. Other columns are not looked at, no rows give no rows.

    The ids alone are cut into ranges of about ``rows_each`` rows, at ids that exist: no
    cut goes through a double, which has no ids above 2^53. The
    first row of a range also goes to the range before it, so one exchange of the
    texts is enough, and no task holds more than two texts at a time.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    n_rows, n_ids, least = ids.agg(F.count("*"), F.count("doc_id"), F.min("doc_id")).first()
    ranges = parts_for(n_rows, rows_each)
    begins = []
    if ranges > 1 and n_ids:
        placed = ids.where("doc_id is not null").repartitionByRange(ranges, "doc_id").withColumn("range", F.spark_partition_id())
        begins = [r["begin"] for r in placed.groupBy("range").agg(F.min("doc_id").alias("begin")).collect()]
    cuts = np.array(sorted(c for c in begins if c > least), dtype=np.int64)
    with_null = n_ids < n_rows

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            values = batch.column(0).fill_null(0).to_numpy()
            bucket = np.where(known, np.searchsorted(cuts, values, side="right"), 0)
            begins = known & (bucket > 0)
            begins[begins] = values[begins] == cuts[bucket[begins] - 1]
            first = ~known if with_null else known & (values == least)
            own, lent, turned = np.arange(len(values)), np.flatnonzero(begins), np.flatnonzero(first)
            take = np.concatenate([own, lent, turned])
            to = np.concatenate([bucket, bucket[lent] - 1, np.full(len(turned), len(cuts))])
            out = pa.Table.from_batches([batch]).take(pa.array(take)).combine_chunks()
            yield from out.append_column("bucket", pa.array(to, pa.int32())).append_column(
                "borrowed", pa.array(np.arange(len(take)) >= len(own))
            ).to_batches()

    def ended(last: tuple | None) -> None:
        if last:
            raise ValueError(f"document {last[1]} ends range {last[0]}, and no row follows it")

    def print_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by bucket, the borrowed ones last; each is printed once the row after it is known."""
        made: list[tuple] = []
        last = None  # bucket, id, text, hashes and positions of the row that waits
        for batch in batches:
            for name, text, bucket, borrowed in zip(*(c.to_pylist() for c in batch.columns)):
                if last and last[0] == bucket:
                    kept, places = winnow(text, k, window)
                    _, before_name, before, before_kept, before_places = last
                    n = len(before)
                    edited = before[: n - n // 4] + text[: n // 4]
                    edited_kept = winnow(edited, k, window)[0]
                    made.append(
                        (
                            before_name,
                            n,
                            hashlib.sha256(edited.encode()).hexdigest(),
                            printed(before_kept),
                            printed(edited_kept),
                            likeness(before_kept, edited_kept),
                            likeness(before_kept, kept),
                            before_places,
                        )
                    )
                    if len(made) >= 1000:
                        yield _batch(made)
                        made = []
                    last = None if borrowed else (bucket, name, text, kept, places)
                    continue
                ended(last)
                last = None if borrowed else (bucket, name, text, *winnow(text, k, window))
        ended(last)
        if made:
            yield _batch(made)

    dealt = rows.mapInArrow(deal, "doc_id long, text string, bucket int, borrowed boolean")
    return (
        # A range to a task: a hash of their numbers would leave tasks empty and give others several.
        dealt.repartitionById(ranges, "bucket")
        .sortWithinPartitions("bucket", "borrowed", F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(print_runs, EDITED)
    )


def _batch(made: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
    names = [field.split()[0] for field in EDITED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made), kinds)], names)
