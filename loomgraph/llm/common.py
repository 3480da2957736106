"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.scratch import Tables as Scratch
from loomgraph.sources.shipping import ship

__all__ = ["Scratch", "WORD", "id_remainder", "no_clash", "own_name", "own_names", "parts_for", "plain_names", "plan_bytes", "quoted", "release_memory", "remainder_is", "row_key", "ship", "utf8", "word_count"]

#: A word in the contracts: a run of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan: for a file scan, the bytes of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """Shuffle partitions: the session's number, more where the input calls for more."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(plan_bytes(df) / bytes_each))


def release_memory() -> None:
    """In a worker, between large pieces of work: give freed memory back, which allocators keep otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def id_remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo divisor; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(divisor)


def remainder_is(id_col: str, divisor: int, value: int) -> Column:
    """False for a null id, so rows without an id are never held out."""
    return F.coalesce(id_remainder(id_col, divisor) == F.lit(value), F.lit(False))


def word_count(text: Column) -> Column:
    """Number of words of a text, long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def own_name(name: str) -> str:
    """What own_names makes of a column's name."""
    return f"__own_{name}"


def own_names(df: DataFrame) -> DataFrame:
    """df with names that no helper column has, so that columns of any name can be joined with them."""
    return df.toDF(*map(own_name, df.columns))  # by place: renaming one by one would rename a column that is named so already again


def quoted(name: str) -> str:
    """A column's name as Spark's parser takes it, whatever signs it has."""
    return f"`{name.replace('`', '``')}`"


def plain_names(names: list[str]) -> list[Column]:
    """The columns of own_names(df) under their names in df."""
    return [F.col(quoted(own_name(c))).alias(c) for c in names]


def no_clash(id_col: str, *outputs: str) -> None:
    """The id's column keeps its name in a result, so it can't be one of the others there."""
    if id_col in outputs:
        raise ValueError(f"{id_col} is the name of a result column")


def row_key(id_col: str, text_col: str) -> Column:
    """struct<id, long, short>: the id, which may be null or repeated, and 96 bits of hashes of the text."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("long"), F.hash(text_col).alias("short"))


def utf8(text: str) -> Column:
    """A text column as its UTF-8 bytes, empty for null: what the Arrow stages read."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")
