"""Batch readers of events, buildings and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.schemas import BUILDING, RAW_EVENT, SNAPSHOT


def read_raw_events(spark: SparkSession, path: str, fmt: str = "json", streaming: bool = False) -> DataFrame:
    """Raw events from JSON lines or parquet. Columns that are absent are null."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(RAW_EVENT).format(fmt).load(path)


def read_buildings(
    spark: SparkSession, path: str, header: tuple[str, ...] = tuple(BUILDING.fieldNames()), spread: int | None = None
) -> DataFrame:
    """The four building columns of CSV files whose header line is ``header``.

    A header that differs from it is an error. Gzip files are each read by one
    task; ``spread`` distributes their rows over that many partitions after the
    scan.
    """
    known = {f.name: f.dataType.simpleString() for f in BUILDING.fields}
    schema = ", ".join(f"`{name}` {known.get(name, 'string')}" for name in header)
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    kept = rows.select(*BUILDING.fieldNames())
    return kept.repartition(spread) if spread else kept


def load_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot documents below ``path``, one file each.

    A file holds the document itself or wraps it in ``summary``. Without a label
    inside, the label comes from the file name ``snap_<label>.json``. ``extra`` has the settings
    that are known, ``extra_all`` all there are, as a variant.
    """
    fields = [*SNAPSHOT.fields]
    # The text of ``extra``, whatever its keys.
    kinds = ", ".join(f"`{f.name}` {'string' if f.name == 'extra' else f.dataType.simpleString()}" for f in fields)
    schema = f"{kinds}, summary struct<{kinds.replace('` ', '`: ')}>"
    files = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    named = F.nullif(F.regexp_extract(F.input_file_name(), r"snap_([^/]+)\.json$", 1), F.lit(""))
    is_wrapped = F.col("summary").isNotNull()
    columns = {f.name: F.when(is_wrapped, F.col(f"summary.{f.name}")).otherwise(F.col(f.name)) for f in fields}
    columns["label"] = F.coalesce(columns["label"], named)
    extra = columns["extra"]
    columns["extra"] = F.from_json(extra, SNAPSHOT["extra"].dataType)
    columns["extra_all"] = F.try_parse_json(extra)
    return files.select(*[column.alias(name) for name, column in columns.items()])


def extra_value(name: str, kind: str) -> Column:
    """A setting of a loaded snapshot, declared or not; null where it is absent or of another kind."""
    return F.try_variant_get("extra_all", f"$.{name}", kind)
