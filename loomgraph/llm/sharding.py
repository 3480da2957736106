"""Sharding by weighted rendezvous hashing.

Every row goes to the shard with the highest score -weight / ln(u), u being a hash of the
row's key and the shard's number in (0, 1). A shard's score doesn't depend on the other
shards, so adding one moves rows only into it, and a weight's share of the rows is its share
of all weights. The assignment is a projection: no shuffle, no state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, plan_bytes

#: Rows of one identical (id, text) that one row of the slot table expands to at a time.
_RUN = 4096


def record_key(id_col: str, text_col: str) -> Column:
    """The stable key: the id's text, or for a null id the checksum of the text."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("crc:"), text_crc32(text_col).cast("string")))


def text_crc32(text_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number, 0 to len(weights) - 1; ties (only of equal hashes) go to the higher number."""
    scored = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit(f"#{shard}"))), 11)
        unit = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))
        scored.append(F.struct((F.lit(-float(weight)) / F.ln(unit)).alias("score"), F.lit(shard).alias("shard")))
    return F.greatest(*scored)["shard"] if len(scored) > 1 else F.lit(0)


def assign_shards(
    df: DataFrame,
    weights: Sequence[float] = (1.0,) * 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    out_col: str = "shard",
) -> DataFrame:
    """df with its shard as a last column; a column of that name is replaced. Rows with equal ids share a shard."""
    return df.withColumn(out_col, rendezvous(record_key(id_col, text_col), weights))


def shard_slots(
    df: DataFrame,
    n_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int | None = None,
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of df.

    size is UTF-8 bytes plus one, slot numbers a shard's rows from 0 without gaps in the order
    of a hash of the key, grown_shard is the shard among one more. Null texts count as empty.
    Rows equal in id, size and checksum are counted before the shuffle and expanded after it,
    so a repeated row makes no hot task; slots are ranks inside `buckets` hash ranges of each
    shard plus the ranges' offsets, a table of n_shards * buckets rows at most, which is the
    proven bound of the one broadcast here. By default there is a bucket for each 16 MB of the
    input, 1024 at least and 65536 at most, so that a range is one task's work. Rows of equal key
    share a shard and have consecutive slots; texts of any length are read whole. An empty
    table gives an empty result.
    """
    buckets = buckets or max(1024, min(65_536, plan_bytes(df) // (n_shards * 16_000_000)))
    key = record_key("__id", text_col)
    slim = df.select(F.col(id_col).alias("__id"), F.col(text_col)).select(
        "__id",
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
        text_crc32(text_col).alias("text_crc32"),
        key.alias("__key"),
    )
    placed = slim.groupBy("__id", "size", "text_crc32", "__key").agg(F.count(F.lit(1)).alias("__n"))
    placed = placed.select(
        "*",
        rendezvous(F.col("__key"), [1.0] * n_shards).alias("shard"),
        rendezvous(F.col("__key"), [1.0] * (n_shards + 1)).alias("grown_shard"),
        F.xxhash64("__key").alias("__h"),
    ).withColumn("__bucket", F.floor((F.shiftrightunsigned("__h", 11).cast("double") / F.lit(float(2**53))) * buckets).cast("int"))
    # The order is that of the unsigned hash, whose buckets are consecutive ranges.
    spark = df.sparkSession
    placed = Scratch(spark, "slots").write(placed, "placed")
    sums = placed.groupBy("shard", "__bucket").agg(F.sum("__n").alias("__rows"))
    upto = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", "__bucket", F.coalesce(F.sum("__rows").over(upto), F.lit(0)).alias("__offset"))
    order = Window.partitionBy("shard", "__bucket").orderBy(F.shiftrightunsigned("__h", 1), "__h", "__key", "__id", "size", "text_crc32")
    ranked = placed.withColumn("__before", F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    based = ranked.join(F.broadcast(offsets), ["shard", "__bucket"]).withColumn("__first", F.col("__offset") + F.col("__before"))
    runs = based.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / _RUN))))
    last = F.least(F.col("__n"), (F.col("__run") + 1) * _RUN) - 1
    rows = runs.withColumn("slot", F.explode(F.sequence(F.col("__first") + F.col("__run") * _RUN, F.col("__first") + last)))
    return rows.select(
        F.col("__id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard")
    )


def write_shards(df: DataFrame, path: str, weights: Sequence[float] = (1.0,) * 16, files_per_shard: int = 64, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write df as a dataset with one folder per shard, each shard spread over files_per_shard tasks."""
    placed = assign_shards(df, weights, id_col, text_col)
    spread = F.pmod(F.xxhash64(record_key(id_col, text_col), F.monotonically_increasing_id()), F.lit(files_per_shard))
    placed.withColumn("__spread", spread).repartition(len(weights) * files_per_shard, "shard", "__spread").drop("__spread").write.partitionBy("shard").parquet(path)
