"""Importance resampling of documents towards a target distribution.

Features are runs of one to n consecutive words, hashed to buckets by CRC-32. One scan of a text
keeps a ring of running zlib states, one for each of the last n starts; every further word
extends each of them by a space and the word, so no run is ever put together. The buckets of a
text are written once and give the bucket totals as well as each document's weight: the mean
gain, the log ratio of a bucket's share in the target and in the documents. A Gumbel term from a
seeded hash of the id makes the highest scores a sample without replacement.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, no_clash, ship, utf8
from loomgraph.sources.records import numbered

#: A word, once A to Z are lower case: ASCII digits, a to z and all beyond ASCII, of UTF-8 bytes.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

OUTPUTS = ("n_features", "weight", "score", "rank")


def text_buckets(text: bytes, runs: int, buckets: int) -> tuple[int, list[int]]:
    """Number of words, and the bucket of every run of one to `runs` consecutive words."""
    ring: list[int] = []  # states of the runs that end at the last word and can still grow, the oldest start first
    found: list[int] = []
    words = 0
    for words, match in enumerate(_WORD.finditer(text.lower()), 1):  # noqa: B007
        word = match[0]
        spaced = b" " + word
        states = [crc32(spaced, state) for state in ring]
        states.append(crc32(word))
        found += [state % buckets for state in states]
        ring = states[max(0, len(states) - runs + 1) :]
    return words, found


def _bucket_rows(texts: DataFrame, runs: int, buckets: int) -> DataFrame:
    """(id, words, buckets): buckets as packed unsigned 16 or 32-bit numbers."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, packed = [], []
            for cell in batch.column(1):
                count, found = text_buckets(cell.as_py(), runs, buckets)
                words.append(count)
                packed.append(np.array(found, kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(packed, pa.binary())], names=["id", "words", "buckets"])

    return texts.mapInArrow(scan, f"id {texts.schema['id'].dataType.simpleString()}, words long, buckets binary")


def _unpacked(batch: pa.RecordBatch, column: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All bucket numbers of a batch, and where each row's begin and end."""
    cells = batch.column(column).to_pylist()
    kind = np.dtype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    ends = np.concatenate([[0], np.cumsum([len(c) // kind.itemsize for c in cells])]).astype(np.int64)
    return np.frombuffer(b"".join(cells), kind), ends


def _totals(rows: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, name): how often each bucket occurs; every task adds up its rows first, so it sends `buckets` rows at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            counts += np.bincount(_unpacked(batch, 0, buckets)[0], minlength=buckets)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[there], pa.int64())], names=["bucket", "n"])

    return rows.select("buckets").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(documents: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of (bucket, s) and (bucket, t): floor(1000 ln(((t + 1) (S + buckets)) / ((s + 1) (T + buckets)))); buckets that no text has are left out."""
    both = documents.join(target, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    up = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.col("all_t") + buckets).cast("double")
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.ln(up / down)).cast("long").alias("gain"))


def _weights(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, words, n_features, weight) of bucket rows."""
    shared = rows.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            flat, ends = _unpacked(batch, 2, len(table))
            upto = np.concatenate([[0], np.cumsum(table[flat])])
            sizes, sums = np.diff(ends), upto[ends[1:]] - upto[ends[:-1]]
            weights = np.where(sizes > 0, sums // np.maximum(sizes, 1), 0)  # // floors
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], names=["id", "words", "n_features", "weight"])

    return rows.select("id", "words", "buckets").mapInArrow(weigh, f"id {rows.schema['id'].dataType.simpleString()}, words long, n_features long, weight long")


def gumbel(id_col: str, seed: str) -> Column:
    """floor(-1000 ln(-ln(u))), u in (0, 1) from the first 32 bits of the SHA-256 of `seed:id`; a null id counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    unit = (bits + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(unit))).cast("long")


def resample(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    runs: int = 2,
    buckets: int = 10_000,
    share: tuple[int, int] = (25, 100),
    least_words: int = 20,
    seed: str = "7",
) -> DataFrame:
    """(id, n_features, weight, score, rank) for every row of df; rank numbers the rows that are drawn.

    Of the N rows with at least `least_words` words floor(N * share) are drawn, those with the
    highest scores; ties go to the smaller id, null first, and among rows of equal id as they come.
    Null texts and texts without words have no features, weight 0 and are never drawn; repeated rows
    are scored alike and ranked apart. Texts of any length are scanned whole. An empty target gives every bucket its
    gain against a uniform target; an empty table gives an empty result. Further columns are left out;
    id_col must not be named like an output.

    Broadcast are the gains, `buckets` numbers whatever the input, at most 2^20. The ranking is a
    range-partitioned sort of five numbers a row.
    """
    no_clash(id_col, *OUTPUTS)
    if not 0 < buckets <= 1 << 20 or runs < 1:
        raise ValueError("1 to 2^20 buckets and runs of at least one word")
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "resampling")
    rows = scratch.write(_bucket_rows(df.select(F.col(id_col).alias("id"), utf8(text_col)), runs, buckets), "buckets")
    wanted = _bucket_rows(target.select(F.lit(0).alias("id"), utf8(target_text_col)), runs, buckets)
    gains = np.zeros(buckets, np.int64)
    for r in bucket_gains(_totals(rows, buckets, "s"), _totals(wanted, buckets, "t"), buckets).collect():  # `buckets` rows at most
        gains[r["bucket"]] = r["gain"]
    scored = _weights(rows, gains).withColumn("eligible", F.col("words") >= least_words).withColumn("score", F.col("weight") + gumbel("id", seed))
    slim = scored.select("id", "n_features", "weight", "score", "eligible", (-F.col("score")).alias("down"), (~F.col("eligible")).alias("late"))
    slim = scratch.write(slim, "scored").withColumn("row", F.monotonically_increasing_id())
    drawn = slim.where("eligible").count() * share[0] // share[1]
    placed = numbered(slim, "late", "down", "id", "row")
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("seq") <= drawn, F.col("seq")).cast("long").alias("rank"))


def drawn(df: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of df themselves, columns unchanged; needs ids that are unique and not null."""
    id_col = options.get("id_col", "doc_id")
    ids = resample(df, target, **options).where("rank IS NOT NULL").select(F.col(id_col).alias("__drawn"))
    return df.join(ids, F.col(id_col) == F.col("__drawn"), "left_semi")
