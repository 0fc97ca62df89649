"""Operators over long ordered histories, cut so that no task holds a whole one.

A class, key or source may hold a large share of all rows. Windows here are
therefore partitioned by (key, slice of the order), with the rows a frame needs
from the neighbouring slice copied over, or with a cut-off found from counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sequence numbers per slice: a window task holds at most about this many rows.
SLICE = 1_000_000


def _slice_of(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def slice_counts(
    rows: DataFrame, by: tuple[str, ...], seq: str = "seq", width: int = SLICE, more: list[Column] | None = None
) -> DataFrame:
    """Rows per group and slice of the sequence: what cut-offs are found from."""
    counted = [F.count(F.lit(1)).alias("_rows"), *(more or [])]
    return rows.groupBy(*by, _slice_of(seq, width).alias("_slice")).agg(*counted)


def _cutoff(slices: DataFrame, n: int, by: tuple[str, ...], width: int) -> DataFrame:
    """Per group, the start of the newest slices that together hold ``n`` rows."""
    grouped = slices.groupBy(*by, "_slice").agg(F.sum("_rows").alias("_rows"))
    newer = Window.partitionBy(*by).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    counted = grouped.withColumn("_newer", F.coalesce(F.sum("_rows").over(newer), F.lit(0)))
    needed = counted.where(F.col("_newer") < n)
    return needed.groupBy(*by).agg((F.min("_slice") * width).alias("_from"))


def last_n(rows: DataFrame, n: int, seq: str = "seq", width: int = SLICE, slices: DataFrame | None = None) -> DataFrame:
    """The ``n`` rows with the highest ``seq`` (unique integers).

    Rows are counted per slice of the sequence first (or taken from ``slices``,
    which may be finer); only the newest slices are then read in full. The
    cut-off reaches the scan as a pushed-down filter. It leaves at most
    ``n + width`` rows to sort.
    """
    counted = slice_counts(rows, (), seq, width) if slices is None else slices
    cutoff = _cutoff(counted, n, (), width).select("_from").scalar()
    return rows.where(F.col(seq) >= cutoff).orderBy(F.desc(seq)).limit(n)


def last_n_per_class(
    rows: DataFrame,
    n: int,
    by: str,
    classes: tuple[str, ...],
    seq: str = "seq",
    width: int = SLICE,
    slices: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` newest rows of each of the named classes.

    The cut-offs are one row per named class, which is what makes them safe to
    broadcast. At most ``n + width`` rows per class reach the window. ``slices``
    may bring the counts, with ``by`` among their groups.
    """
    named = F.col(by).isin(*classes)
    counted = slice_counts(rows, (by,), seq, width) if slices is None else slices
    cutoffs = _cutoff(counted.where(named), n, (by,), width)
    recent = rows.where(named).join(F.broadcast(cutoffs), by).where(F.col(seq) >= F.col("_from")).drop("_from")
    newest = Window.partitionBy(by).orderBy(F.desc(seq))
    return recent.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def positions(rows: DataFrame, by: str, seq: str = "seq", width: int = SLICE) -> DataFrame:
    """Adds ``position``: 0, 1, 2, ... per ``by`` in the order of ``seq``.

    Row numbers are taken inside slices; the slices' offsets come from their
    counts, one row per (group, slice).
    """
    sliced = rows.withColumn("_slice", _slice_of(seq, width))
    earlier = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(by, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(by, "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy(by, "_slice").orderBy(seq)
    numbered = sliced.withColumn("_row", F.row_number().over(within))
    return (
        numbered.join(offsets, [by, "_slice"])
        .withColumn("position", F.col("_offset") + F.col("_row") - 1)
        .drop("_slice", "_row", "_offset")
    )


def rolling_hit_rate(
    results: DataFrame, by: str, hit: Column, n: int = 200, seq: str = "seq", width: int = SLICE
) -> DataFrame:
    """Share of hits among the last ``n`` results of the group, at every result."""
    width = max(width, n)  # a slice holds the whole frame
    narrow = results.select(by, seq, hit.cast("int").alias("hit"))
    placed = positions(narrow, by, seq, width).withColumn("_chunk", _slice_of("position", width))
    # The last n - 1 rows of a chunk are also needed, as history, in the next one.
    tail = F.col("position") % width >= width - (n - 1)
    targets = F.when(tail, F.array("_chunk", F.col("_chunk") + 1)).otherwise(F.array("_chunk"))
    spread = placed.withColumn("_in", F.explode(targets))
    # Running hits minus those of n rows before: a frame that slides over n rows
    # would be added up again for every row.
    along = Window.partitionBy(by, "_in").orderBy("position")
    running = spread.withColumn("_hits", F.sum("hit").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    hits = F.col("_hits") - F.coalesce(F.lag("_hits", n).over(along), F.lit(0))
    rolled = running.select(
        by, seq, "_chunk", "_in", hits.alias("hits"), F.least(F.lit(n), F.col("position") + 1).alias("window_size")
    )
    own = rolled.where(F.col("_chunk") == F.col("_in"))
    return own.select(by, seq, F.round(F.col("hits") / F.col("window_size"), 4).alias("hit_rate"), "window_size")


def trailing_throughput(
    events: DataFrame, by: str, ts_us: str = "ts_us", seconds: int = 10, slice_seconds: int = 60
) -> DataFrame:
    """Adds ``throughput``: events of the group per second over the trailing seconds.

    Events are first counted per instant, so a burst costs one row per
    microsecond at most. Each instant then adds its events when they happen and
    takes them away when they fall out of reach; the rate is the running total.
    It is taken inside slices of time, to which the totals of the slices before
    are added, one row per (group, slice).
    """
    reach, width = seconds * 1_000_000, slice_seconds * 1_000_000
    instants = events.groupBy(by, ts_us).agg(F.count(F.lit(1)).alias("_n"))
    # An event still counts at the very end of its reach: it leaves after what happens then.
    enters = F.struct(F.col(ts_us).alias("_at"), F.lit(0).alias("_turn"), F.col("_n").alias("_change"))
    leaves = F.struct((F.col(ts_us) + reach).alias("_at"), F.lit(1).alias("_turn"), (-F.col("_n")).alias("_change"))
    changes = instants.select(by, F.inline(F.array(enters, leaves))).withColumn("_slice", _slice_of("_at", width))
    earlier = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        changes.groupBy(by, "_slice")
        .agg(F.sum("_change").alias("_net"))
        .select(by, "_slice", F.coalesce(F.sum("_net").over(earlier), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy(by, "_slice").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    running = changes.withColumn("_total", F.sum("_change").over(within)).join(offsets, [by, "_slice"])
    rates = running.where(F.col("_turn") == 0).select(
        by, F.col("_at").alias(ts_us), ((F.col("_total") + F.col("_offset")) / float(seconds)).alias("throughput")
    )
    # One rate per instant: an instant with very many events is split by the skew join.
    return events.join(rates, [by, ts_us])


def previous_row(rows: DataFrame, by: str, order: str, columns: tuple[str, ...], width: int) -> DataFrame:
    """Adds ``previous_<column>`` from the row before, per group; null in the first row.

    ``order`` is unique within a group. Slices of ``width`` are read apart; the
    first row of a slice takes the last row of the slice before it.
    """
    sliced = rows.withColumn("_slice", _slice_of(order, width))
    before = Window.partitionBy(by).orderBy("_slice")
    # One row per (group, slice).
    last = sliced.groupBy(by, "_slice").agg(*[F.max_by(c, order).alias(c) for c in columns])
    entering = last.select(by, "_slice", *[F.lag(c).over(before).alias(f"_entering_{c}") for c in columns])
    within = Window.partitionBy(by, "_slice").orderBy(order)
    lagged = sliced.select(
        "*",
        (F.row_number().over(within) == 1).alias("_opens"),
        *[F.lag(c).over(within).alias(f"_before_{c}") for c in columns],
    ).join(entering, [by, "_slice"])

    def previous(name: str) -> Column:
        return F.when(F.col("_opens"), F.col(f"_entering_{name}")).otherwise(F.col(f"_before_{name}"))

    return lagged.select(*rows.columns, *[previous(c).alias(f"previous_{c}") for c in columns])


def eviction_rate(samples: DataFrame, start_us: int, by: str = "policy", width_us: int = 86_400_000_000) -> DataFrame:
    """Evictions per minute since the sample before; the first counts from zero at ``start_us``."""
    paired = previous_row(samples, by, "sample_us", ("sample_us", "evicted_keys"), width_us)
    since = F.col("sample_us") - F.coalesce("previous_sample_us", F.lit(start_us))
    evicted = F.col("evicted_keys") - F.coalesce("previous_evicted_keys", F.lit(0))
    rate = F.when(since > 0, F.round(evicted * 60e6 / since, 2))
    return paired.select(*samples.columns, rate.alias("rate_per_min"))
