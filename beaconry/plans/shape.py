"""Plain column types for results that are compared with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as epoch microseconds."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            column = F.unix_micros(column)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles that depend on the order of summation, rounded."""
    return df.withColumns({name: F.round(F.col(f"`{name}`"), n) for name, n in digits.items()})


def open_window(df: DataFrame) -> DataFrame:
    """The window struct as two columns."""
    return df.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *df.drop("window").columns
    )
