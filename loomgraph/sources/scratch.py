"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL, _CLEANUP = "_loomgraph_local_scratch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_settings = threading.Lock()  # held while a write has a setting of its own
_open = threading.local()


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread makes inside are deleted at the end; only results written elsewhere outlive it."""
    outer, _open.made = getattr(_open, "made", None), []
    try:
        yield
    finally:
        made, _open.made = _open.made, outer
        for tables in made:
            tables.drop()
            atexit.unregister(tables.drop)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder if all of Spark runs on this machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(spark.sparkContext, _LOCAL):
        setattr(spark.sparkContext, _LOCAL, tempfile.mkdtemp(prefix="loomgraph-"))
    return getattr(spark.sparkContext, _LOCAL)


class Tables:
    """Tables of one call, in a folder of its own. A written table cuts the lineage of what reads it."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/loomgraph-{label}-{uuid.uuid4().hex}"
        atexit.register(self.drop)
        if getattr(_open, "made", None) is not None:
            _open.made.append(self)

    def write_measured(self, df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, tuple]:
        """df as a table, and aggregates of its rows taken while it is written.

        A task that is run again may be counted again, so measures should only decide whether
        to go on.
        """
        seen = Observation()
        table = self.write(df.observe(seen, *[m.alias(f"m{k}") for k, m in enumerate(measures)]), name)
        return table, tuple(seen.get[f"m{k}"] for k in range(len(measures)))

    def write(self, df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
        """df as a table, read again; drop_shuffles: free its shuffle files as soon as it is written."""
        target = f"{self.path}/{name}"
        if not drop_shuffles:
            df.write.mode("overwrite").parquet(target)
            return self.spark.read.schema(df.schema).parquet(target)
        with _settings:
            before = self.spark.conf.get(_CLEANUP)
            try:
                self.spark.conf.set(_CLEANUP, "true")
                df.write.mode("overwrite").parquet(target)
            finally:
                self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(target)

    def drop(self, name: str | None = None) -> None:
        """Delete one table or, at the driver's end, all: results that are read lazily may still need them before."""
        try:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the gateway may be gone at exit
            pass
