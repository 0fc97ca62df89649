"""Small helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but space and the ASCII control blanks; bytes.split() cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def identity(doc_id: str, text: str) -> Column:
    """A key for a row: rows equal in id and text share it, so that a repeated row is one document."""
    return F.xxhash64(F.col(doc_id), F.coalesce(F.sha2(text_or_empty(text), 256)))


def parts_for(total: int, each: int, least: int = 1) -> int:
    """How many parts of about ``each`` a total needs."""
    return max(least, -(-int(total) // each))


def total_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
