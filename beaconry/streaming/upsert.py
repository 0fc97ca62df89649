"""A table of parquet files in which the newest batch wins, key by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMMIT = T.StructType([T.StructField("upto", T.LongType())])


class UpsertTable:
    """Batches under ``batches/batch_id=<n>``; the row of a key in the highest batch counts.

    Writing a batch again replaces it, so a replayed micro-batch changes nothing.
    ``compact`` folds the batches up to one of them into a base. Readers use a
    base only once its commit row exists, and always add the batches after it;
    a compaction that dies half way, or runs beside a writer, loses nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str) -> None:
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self._stored = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
        # Where the table is new, an empty batch and an empty commit log make it readable.
        empty = spark.createDataFrame([], schema)
        empty.write.mode("ignore").parquet(f"{self.path}/batches/batch_id=-1")
        spark.createDataFrame([], _COMMIT).write.mode("ignore").parquet(f"{self.path}/commits")

    def write_batch(self, rows: DataFrame, batch_id: int) -> None:
        """Rows in the declared schema: reordered, widened, absent columns null. A missing key is an error."""
        if self.key not in rows.columns:
            raise ValueError(f"rows have no column {self.key}")
        key = F.coalesce(F.col(self.key), F.raise_error(F.lit(f"{self.key} is null")))
        keyed = rows.withColumn(self.key, key).to(self.schema)
        keyed.write.mode("overwrite").parquet(f"{self.path}/batches/batch_id={batch_id}")

    def _read(self, folder: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def compacted_upto(self) -> int:
        """The last batch in the newest finished base; -1 without one."""
        commits = self._read("commits", _COMMIT)
        return commits.agg(F.coalesce(F.max("upto"), F.lit(-1)).alias("upto")).first()["upto"]

    def history(self, upto: int | None = None) -> DataFrame:
        """The base and the batches after it, with ``batch_id``."""
        base = self.compacted_upto()
        if upto is not None and upto < base:
            raise ValueError(f"batches up to {base} have been folded together")
        rows = self._read("batches", self._stored).where(F.col("batch_id") > base)
        if upto is not None:
            rows = rows.where(F.col("batch_id") <= upto)
        if base >= 0:
            rows = rows.unionByName(self._read(f"base/upto={base}", self._stored))
        return rows

    def latest(self, upto: int | None = None) -> DataFrame:
        """One row per key, as of batch ``upto`` or now."""
        return self._newest(upto).select(*[f"`{f.name}`" for f in self.schema.fields])

    def _newest(self, upto: int | None) -> DataFrame:
        # Column by column: on numbers and times that is a hash aggregation, in
        # which one row per key and task goes into the shuffle.
        others = [name for name in self._stored.fieldNames() if name != self.key]
        newest = [F.max_by(F.col(f"`{name}`"), "batch_id").alias(name) for name in others]
        return self.history(upto).groupBy(self.key).agg(*newest)

    def compact(self, upto: int) -> None:
        """Fold the batches up to ``upto`` into a base, unless a base has them already."""
        if self.compacted_upto() >= upto:
            return
        self._newest(upto).write.mode("overwrite").parquet(f"{self.path}/base/upto={upto}")
        commit = self.spark.range(1).select(F.lit(upto).cast("long").alias("upto"))
        commit.write.mode("append").parquet(f"{self.path}/commits")

    def compact_every(self, batches: int, batch_id: int) -> None:
        """Fold the batches before ``batch_id`` once there are ``batches`` of them since the last base."""
        if batch_id - 1 - self.compacted_upto() >= batches:
            self.compact(batch_id - 1)
