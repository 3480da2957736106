"""A corpus pipeline of five of the llm operators, each stage written and read again.

Quality classifier, SimHash near-duplicates, benchmark decontamination, mixing sources to
target weights, sharding. Each stage works on all rows that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, mixing, quality, sharding, simhash
from loomgraph.llm.common import Scratch, quoted
from loomgraph.llm.queries import ACCEPT, quality_model
from loomgraph.sources.scratch import released


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    mark = "score"
    while mark in docs.columns:  # documents may have a column of any name
        mark = f"_{mark}"
    scored = quality.score_quality(docs, quality_model(spark, docs, sf_dir), keep=docs.columns, out_col=mark)
    return scored.where(F.col(mark) >= ACCEPT).select(*map(quoted, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return sharding.assign_shards(docs)


STAGES = [
    ("quality classifier", accept_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: A discriminant fitted by linear algebra, fingerprints by XXH64 and edit distances aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over documents, each stage written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with released(spark):  # what a stage writes on its way isn't read after it
            docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
