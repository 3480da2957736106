"""Sinks: split outputs, manifests, staged publication, versioned tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _fs(spark, path)
    return fs.exists(jpath)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One object a line; refuses to replace what is there unless told."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_report(rows: DataFrame, path: str, most: int = 10_000) -> None:
    """A small table as one indented JSON document, written whole in the driver; refused beyond `most` rows."""
    found = [r.asDict(True) for r in rows.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} rows are no report")
    jpath, fs = _fs(rows.sparkSession, path)
    stream = fs.create(jpath, False)
    stream.write(bytearray(json.dumps(found, ensure_ascii=False, indent=2, default=str).encode()))
    stream.close()


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def split_rejects(df: DataFrame, accepted: str, rejected: str, problems: str = "problems") -> tuple[int, int]:
    """Write rows without problems and rows with them, each as Parquet; the counts of both, from one pass."""
    staged = f"{accepted}.{uuid.uuid4().hex}"
    df.withColumn("__ok", F.size(problems) == 0).write.partitionBy("__ok").parquet(staged)
    spark = df.sparkSession
    both = spark.read.schema(df.withColumn("__ok", F.lit(True)).schema).parquet(staged)
    both.where("__ok").drop("__ok").write.mode("errorifexists").parquet(accepted)
    both.where("NOT __ok").drop("__ok").write.mode("errorifexists").parquet(rejected)
    counts = {r["__ok"]: r["count"] for r in both.groupBy("__ok").count().collect()}
    jpath, fs = _fs(spark, staged)
    fs.delete(jpath, True)
    return counts.get(True, 0), counts.get(False, 0)


def fingerprint(df: DataFrame, *keys: str) -> DataFrame:
    """One row (rows, digest): an order-free digest of the rows' canonical JSON, by pre-aggregated xor and sum."""
    row = F.to_json(F.struct(*[F.col(c) for c in (keys or sorted(df.columns))]))
    hashed = df.select(F.xxhash64(row).alias("h"))
    return hashed.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", F.hex(F.bit_xor("h")), F.sum(F.col("h").cast("decimal(38,0)")).cast("string")).alias("digest"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _staged(df: DataFrame, path: str, valid: Callable[[DataFrame], bool], least: int) -> bool:
    """df written to a path of its own and checked there; what fails is deleted."""
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    if written.count() >= least and valid(written):
        return True
    jpath, fs = _fs(df.sparkSession, path)
    fs.delete(jpath, True)
    return False


def publish(df: DataFrame, path: str, valid: Callable[[DataFrame], bool] = lambda _: True, least: int = 0) -> bool:
    """Write beside the target, check what was written, and only then put it in the target's place.

    Returns whether it was published; fewer than `least` rows are refused as well. What stood
    there before is kept until the new folder is in place, and put back if that fails. Between
    the two renames the target is absent: where readers must never see that, use publish_version.
    """
    spark, staged = df.sparkSession, f"{path}.staged-{uuid.uuid4().hex}"
    if not _staged(df, staged, valid, least):
        return False
    (source, fs), (target, _) = _fs(spark, staged), _fs(spark, path)
    aside = _fs(spark, f"{path}.previous-{uuid.uuid4().hex}")[0]
    had = fs.exists(target) and fs.rename(target, aside)
    if fs.rename(source, target):
        if had:
            fs.delete(aside, True)
        return True
    if had and not fs.rename(aside, target):
        raise OSError(f"{path} could not be replaced; its rows are in {aside}")
    fs.delete(source, True)
    return False


_POINTER = "CURRENT"


def publish_version(df: DataFrame, root: str, valid: Callable[[DataFrame], bool] = lambda _: True, least: int = 0) -> str | None:
    """Publish df as a version under root; its name, or None where it was refused.

    Readers follow a pointer file, which one rename replaces, so they see the old version or
    the new one. Versions are never changed or deleted here.
    """
    spark, version = df.sparkSession, f"version-{uuid.uuid4().hex}"
    if not _staged(df, f"{root}/{version}", valid, least):
        return None
    jvm = spark.sparkContext._jvm
    (fresh, fs), (pointer, _) = _fs(spark, f"{root}/{_POINTER}-{version}"), _fs(spark, f"{root}/{_POINTER}")
    stream = fs.create(fresh, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = option
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(fresh), fs.makeQualified(pointer), options)
    return version


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The version of publish_version that readers should see."""
    version = spark.read.option("wholetext", True).text(f"{root}/{_POINTER}").first()["value"]
    return spark.read.parquet(f"{root}/{version}")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """current with the rows of changes put in for those of equal keys, the others added.

    A null key equals a null key. Of changes that share a key the last by `order` counts, or
    without one the greatest row, so every key has one row of changes.
    """
    rest = [c for c in changes.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in ([order] if order else []) + sorted(rest)]) if rest or order else F.lit(0)
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__row")).select(*keys, "__row.*") if rest else changes.distinct()
    gone = last.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    kept = current.join(gone, same, "left_anti")
    return kept.unionByName(last.select(*changes.columns), allowMissingColumns=True)


def write_version(df: DataFrame, path: str, version: Column | str, key: str) -> None:
    """Replace one graph_version's partition of a table; its keys must be unique."""
    rows = df.withColumn("graph_version", F.lit(version) if isinstance(version, str) else version)
    repeated = rows.groupBy(key).count().where("count > 1")
    if not repeated.isEmpty():
        raise ValueError(f"repeated {key}")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_version").parquet(path)


def activate(current: DataFrame, version: str, at: str) -> DataFrame:
    """The one-row pointer table after activating a version: an equal one leaves the previous pointer as it is."""
    return current.select(
        "name",
        F.lit(version).alias("graph_version"),
        F.when(F.col("graph_version").eqNullSafe(F.lit(version)), F.col("previous_version")).otherwise(F.col("graph_version")).alias("previous_version"),
        F.lit(at).alias("activated_at"),
    )
