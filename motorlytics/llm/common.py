"""Shared column expressions and stage storage.

Text conventions: a null text counts as empty; white space is
``[\\x20\\x09-\\x0D]``; only A-Z are lower-cased.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlytics.sources.io import shared_path

WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: A side of at most this many bytes may be broadcast; its rows are counted first.
BROADCAST_BYTES = 16 << 20


def text_of(col: Column | str = "text") -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit(""))


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z, nothing else. ``lower`` does the same, faster, on pure ASCII."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(
        F.translate(col, string.ascii_uppercase, string.ascii_lowercase))


def strip_white(col: Column) -> Column:
    return F.trim(col, F.lit(WHITE))


def words_of(col: Column) -> Column:
    """Words of a text as an array (empty for a text without words)."""
    return F.filter(F.split(col, WHITE_CLASS + "+"), lambda w: w != "")


def hash128(col: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds; together they identify a value at corpus scale."""
    return F.xxhash64(col), F.xxhash64(F.lit(7), col)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the
    lineage, survives lost executors, and its rows can be counted cheaply."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if ``df`` (a stored table) is counted to be small;
    a larger one is left to a shuffled join, which AQE splits on hot keys."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
