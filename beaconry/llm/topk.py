"""Exact top-k search by a Voronoi join.

Data and queries are grouped by their nearest pivot. Pivots are data vectors, so a query's k-th
best score among them bounds its result from below; a group's radius bounds from above
what the group can score: q . x <= q . p + |q| * radius. Data of a group goes only to the
query groups with a query that the group may still serve, and those pairs are solved
locally.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconry.llm.common import parts_for
from beaconry.session import materialize

MAX_PIVOTS = 256


def quantised(vectors: DataFrame, factor: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, ints): floor(factor * x) of each component as a double.

    Rows with a null vector, a null or non-finite component, or one whose multiple has
    no 64-bit integer take no part; a null id takes no part either.
    """
    real = F.transform(F.col(vector), lambda x: x.cast("double") * factor)
    fine = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(9.2e18)))
    return vectors.where(F.col(vec_id).isNotNull() & fine).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(real, lambda x: F.floor(x).cast("long")).alias("ints")
    )


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(x, dtype=np.int64) for x in column], dtype=np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where no partial sum can exceed 2**53."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if reach < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best_ids(scores: np.ndarray, ids: pd.Series, query: int, k: int) -> list[tuple[int, int]]:
    """(id, score) of the ``k`` best different ids but the query's own; an id counts with its best score, ties go to the smaller id."""
    n = k + 1
    while True:
        # The n best values with all ties of the last: enough if they hold k ids.
        least = np.partition(scores, -n)[-n] if len(scores) > n else scores.min()
        best: dict[int, int] = {}
        for j in np.flatnonzero(scores >= least):
            for i in ids.iat[j]:
                if i != query:
                    best[int(i)] = max(best.get(int(i), int(scores[j])), int(scores[j]))
        if len(best) >= k or len(scores) <= n:
            return sorted(best.items(), key=lambda item: (-item[1], item[0]))[:k]
        n *= 4


def top_scores(
    data: DataFrame, queries: DataFrame, k: int = 5, rows_each: int = 2048, queries_each: int = 512, seed: int = 42
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products.

    ``data`` and ``queries`` have (vec_id, ints). A query's own id is no candidate; ties go to
    the smaller id. Vectors of another length than the query's are no candidates. Repeated
    rows of one id and vector count once; an id with several vectors counts with its best.
    Scores beyond 64 bits wrap around. No queries, or no candidates, give no rows.
    """
    dims = F.size("ints").alias("dims")
    # Of equal vectors only the k + 1 smallest ids can be in a result (one may be the query's own).
    copies = Window.partitionBy("ints").orderBy("vec_id")
    ids = data.select("vec_id", "ints").distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    different = materialize(
        ids.groupBy("ints").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ints", "ids", dims), "vectors"
    )
    asked = materialize(queries.select("vec_id", "ints", dims).distinct(), "queries")
    sizes = different.groupBy("dims").agg(F.count("*").alias("n")).join(
        asked.groupBy("dims").agg(F.count("*").alias("n_queries")), "dims"
    )
    results = None
    for dimension, n, n_queries in sizes.orderBy("dims").collect():  # a row for each length of vectors
        found = _search(
            different.where(F.col("dims") == dimension).drop("dims"),
            asked.where(F.col("dims") == dimension).drop("dims"),
            k,
            min(MAX_PIVOTS, parts_for(n, rows_each, 2 * k)),
            rows_each,
            parts_for(n_queries, queries_each),
            queries_each,
            seed,
        )
        results = found if results is None else results.union(found)
    if results is None:
        results = data.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        results.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _search(
    data: DataFrame, queries: DataFrame, k: int, n_pivots: int, rows_each: int, n_groups: int, queries_each: int, seed: int
) -> DataFrame:
    spark = data.sparkSession
    chosen = data.orderBy(F.xxhash64("ints", F.lit(seed)), "ints").limit(n_pivots).collect()  # at most MAX_PIVOTS rows
    pivots = _matrix([row["ints"] for row in chosen])
    # Ids that no earlier pivot has: what a query's scores with the pivots bound are different ids.
    known: set[int] = set()
    pivot_ids = []
    for row in chosen:
        pivot_ids.append(set(row["ids"]) - known)
        known.update(row["ids"])
    n_ids = np.array([len(names) for names in pivot_ids], dtype=np.int64)
    real = pivots.astype(np.float64)
    lengths = (real**2).sum(axis=1)

    def nearest(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = vectors.astype(np.float64)
        at = (lengths - 2 * (x @ real.T)).argmin(axis=1)
        return at, np.sqrt(((x - real[at]) ** 2).sum(axis=1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("ints").to_pylist())
            if not len(vectors):
                continue
            at, away = nearest(vectors)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at.astype(np.int32)), pa.array(away)], [*batch.schema.names, "cell", "away"]
            )

    cells = materialize(data.mapInArrow(assign, "ints array<long>, ids array<long>, cell int, away double"), "cells")
    # A row for each pivot: radius, and the blocks its data is dealt into.
    summary = {c: (r, parts_for(n, rows_each)) for c, r, n in cells.groupBy("cell").agg(F.max("away"), F.count("*")).collect()}
    radius = np.array([summary.get(c, (-np.inf, 0))[0] for c in range(len(pivots))])
    blocks = np.array([summary.get(c, (0.0, 0))[1] for c in range(len(pivots))])
    # Query groups are runs of neighbouring pivots, each dealt by id into parts of about queries_each.
    parts = max(1, n_groups)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, ids = _matrix(batch.column("ints").to_pylist()), np.asarray(batch.column("vec_id"))
            if not len(vectors):
                continue
            scores = products(vectors, pivots)
            own = np.array([[i in names for names in pivot_ids] for i in ids.tolist()])
            order = np.argsort(-scores, axis=1, kind="stable")
            reached = np.cumsum(np.take_along_axis(n_ids[None, :] - own, order, axis=1), axis=1) >= k
            last = np.take_along_axis(scores, np.take_along_axis(order, reached.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]
            floor = np.where(reached[:, -1], last, np.iinfo(np.int64).min)
            norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
            reach = scores + norms[:, None] * radius[None, :]
            # A little room for rounding of the bound.
            needs = (reach + 1e-6 * (1 + np.abs(reach)) >= floor[:, None]) & (blocks > 0)
            at, _ = nearest(vectors)
            group = at.astype(np.int64) * parts // max(1, len(pivots))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(group), pa.array([np.flatnonzero(x) for x in needs], pa.list_(pa.int32()))],
                [*batch.schema.names, "part", "cells"],
            )

    planned = materialize(
        queries.mapInArrow(plan, "vec_id long, ints array<long>, part long, cells array<int>"), "plan"
    )
    sizes = planned.groupBy("part").agg(F.count("*").alias("in_part"))
    planned = planned.join(sizes, "part").withColumn(
        "part",
        F.col("part") * 1_000_000 + F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("in_part") / queries_each).cast("long")),
    )
    salted = planned.select(F.col("part"), "vec_id", "ints", F.explode("cells").alias("cell"))
    counts = spark.createDataFrame(
        [(int(c), int(b)) for c, b in enumerate(blocks) if b], "cell int, blocks int"
    )
    block = F.pmod(F.xxhash64("ints"), F.col("blocks").cast("long"))
    dealt = cells.join(F.broadcast(counts), "cell").withColumn("block", block)
    needed = salted.select(F.col("cell").alias("of"), F.col("part").alias("to")).distinct()
    copies = dealt.join(needed, F.col("cell") == F.col("of")).select("to", "of", F.col("block").alias("at"), "ints", "ids")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block")
    wanted = salted.join(F.broadcast(counts), "cell").select("part", "cell", every, "vec_id", "ints")

    def solve(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(rows):
            scores = products(_matrix(asked["ints"]), _matrix(rows["ints"]))
            for query, line in zip(asked["vec_id"], scores):
                found += [(query, i, s) for i, s in best_ids(line, rows["ids"], query, k)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    return (
        wanted.groupBy("part", "cell", "block")
        .cogroup(copies.groupBy("to", "of", "at"))
        .applyInPandas(solve, "query_id long, vec_id long, score long")
    )
