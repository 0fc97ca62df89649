"""Mixing sources to target token shares by entropy balancing.

A document of x tokens in source s is taken at the rate min(cap, exp(t_s * x)):
of all rates between 0 and ``cap`` whose tokens add up to the source's target, these
stay closest to 1 in relative entropy. The dual is convex with one variable per source;
its Newton steps run on counts per (source, size), all sources in one aggregation a
round, each step kept inside an interval that is known to hold the solution.

Rates become copies by rounding running totals in order of size: the tokens taken differ
from the rates' tokens by no more than about the largest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.llm.common import WORD, parts_for, text_or_empty
from beaconry.session import materialize

# exp() of more than this is above any cap in use.
STEEPEST = 50.0


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text_or_empty(text), F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """(source, source_size, weight): weights repeat over the sources in order of code points, null last.

    ``sources`` has a row per source. The order is counted in ranges: no task ranks them all.
    """
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "sources")
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select(
        "range",
        F.coalesce(
            F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )
    rank = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    place = F.pmod(F.col("before") + F.col("rank"), F.lit(len(weights))).cast("int")
    return (
        ranged.withColumn("rank", rank)
        .join(before, "range")
        .select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), place + 1).alias("weight"))
    )


def targets(sources: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, source_size, weight, target): all tokens shared by weight, no source above ``cap`` times its size.

    The excess of sources at their cap is shared again by weight among the others, until none is above.
    """
    sources = sources.withColumn("limit", F.col("source_size") * F.lit(cap))
    share, done = 0.0, False
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while not done:
        # Sources whose share is not below their limit are full; the rest share what is left.
        full = F.col("weight") * F.lit(share) >= F.col("limit")
        left, weight = sources.agg(
            F.lit(float(total)) - F.coalesce(F.sum(F.when(full, F.col("limit"))), F.lit(0.0)),
            F.sum(F.when(~full, F.col("weight"))),
        ).first()
        new = left / weight if weight else share
        share, done = new, new <= share * (1 + 1e-12)
    return sources.withColumn("target", F.least(F.col("limit"), F.col("weight") * F.lit(share))).drop("limit")


def solve(cells: DataFrame, sources: DataFrame, cap: float, tolerance: float = 0.5, rounds: int = 200) -> DataFrame:
    """(source, tilt): the dual variables, per token.

    ``cells``: (source, size, n) counts of documents; ``sources``: (source, source_size, target).
    Ends once every source's expected tokens are within ``tolerance`` of its target or its
    interval has no more numbers between its ends. The interval of a source at its cap
    runs to where every document of at least one token is at the cap.
    """
    scale = F.lit(STEEPEST)
    state = sources.where("source_size > 0").select(
        "source", "target", F.lit(0.0).alias("tilt"), (-scale).alias("low"), scale.alias("high"), F.lit(False).alias("done")
    )
    for _ in range(rounds):
        state = materialize(state, "tilts")
        if state.where("not done").isEmpty():
            break
        tilted = F.col("tilt") * F.col("size")
        rate = F.least(F.lit(cap), F.exp(F.least(tilted, F.lit(STEEPEST))))
        tokens = F.col("n") * F.col("size") * rate
        sums = (
            cells.join(state.where("not done"), cells["source"].eqNullSafe(state["source"]))
            .groupBy(state["source"].alias("of"))
            .agg(F.sum(tokens).alias("tokens"), F.sum(F.when(rate < cap, tokens * F.col("size")).otherwise(0.0)).alias("slope"))
        )
        over = F.col("tokens") > F.col("target")
        step = F.when(F.col("slope") > 0, F.col("tilt") - (F.col("tokens") - F.col("target")) / F.col("slope"))
        state = (
            state.join(sums, state["source"].eqNullSafe(sums["of"]), "left")
            .withColumn("low", F.when(~over, F.col("tilt")).otherwise(F.col("low")))
            .withColumn("high", F.when(over, F.col("tilt")).otherwise(F.col("high")))
            .withColumn("step", step)
            .withColumn("half", (F.col("low") + F.col("high")) / 2)
            .withColumn(
                "next",
                F.when((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step")).otherwise(F.col("half")),
            )
            .withColumn(
                "now_done",
                F.col("done")
                | (F.abs(F.col("tokens") - F.col("target")) <= tolerance)
                | (F.col("high") - F.col("low") <= F.abs(F.col("half")) * 1e-15),
            )
            .select(
                "source",
                "target",
                F.when(F.col("now_done"), F.col("tilt")).otherwise(F.col("next")).alias("tilt"),
                "low",
                "high",
                F.col("now_done").alias("done"),
            )
        )
    return state.select("source", "tilt")


def mix(rows: DataFrame, weighted: DataFrame | None = None, cap: int = 3, seed: int = 42, salt_rows: int = 20_000) -> DataFrame:
    """``rows`` (doc_id, source, size) with source_size, target, rate and ``copies`` (0 to ``cap``).

    ``weighted`` gives (source, source_size, weight); by default the weights 5, 2, 1 in turn.
    A null source is a source like any other. Documents without tokens are taken once:
    they cost nothing. Repeated rows are taken each for itself. Other columns stay.
    No rows give no rows. The same rows give the same copies.
    """
    cells = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    if weighted is None:
        weighted = cycled_weights(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    sources = materialize(targets(weighted, cap), "targets")
    tilts = solve(cells, sources, cap)
    named = sources.join(
        tilts.withColumnRenamed("source", "tilted"), F.col("source").eqNullSafe(F.col("tilted")), "left"
    ).drop("tilted")
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.coalesce(F.col("tilt"), F.lit(0.0)) * F.col("size"), F.lit(STEEPEST))))
    # A cell is dealt into salts, so that many equal sizes are not numbered in one task.
    salts = parts_for(rows.count(), salt_rows)
    salt = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(salts)).cast("int")
    salted = rows.withColumn("salt", salt)
    by_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_salt = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    rated = (
        cells.join(named.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(1.0))
        .withColumn("before_size", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(by_size), F.lit(0.0)))
        .select("of", F.col("size").alias("of_size"), "source_size", "target", "rate", "before_size")
    )
    parts = (
        salted.groupBy("source", "size", "salt")
        .agg(F.count("*").alias("n"))
        .withColumn("before_salt", F.coalesce(F.sum("n").over(by_salt), F.lit(0)))
        .select(F.col("source").alias("of"), F.col("size").alias("of_size"), F.col("salt").alias("of_salt"), "before_salt")
    )
    places = parts.join(
        rated.withColumnRenamed("of", "r").withColumnRenamed("of_size", "r_size"),
        F.col("of").eqNullSafe(F.col("r")) & (F.col("of_size") == F.col("r_size")),
    ).drop("r", "r_size")
    rank = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ranked = salted.withColumn("rank", rank)
    through = F.col("before_size") + (F.col("before_salt") + F.col("rank")) * F.col("rate")
    before = F.col("before_size") + (F.col("before_salt") + F.col("rank") - 1) * F.col("rate")
    copies = F.when(
        F.col("size") > 0, F.least(F.lit(cap), F.floor(through + 0.5) - F.floor(before + 0.5))
    ).otherwise(1)
    return (
        ranked.join(
            places,
            F.col("source").eqNullSafe(F.col("of"))
            & (F.col("size") == F.col("of_size"))
            & (F.col("salt") == F.col("of_salt")),
        )
        .withColumn("copies", copies.cast("long"))
        .drop("of", "of_size", "of_salt", "salt", "rank", "before_size", "before_salt")
    )


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] = ()) -> DataFrame:
    """(doc_id, source, size) and the columns ``keep``: the words of every text, written once; a null text has none."""
    names = F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source")
    return materialize(docs.select(*names, words(text).alias("size"), *keep), "sizes")
