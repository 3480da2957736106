"""Deterministic sampling: hash order in place of a seeded generator, so results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.records import numbered


def hash_order(seed: int, *keys: str) -> Column:
    """A random-like order that any engine can repeat: the MD5 of the seed and the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def uniform(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows in hash order; a top-n, so no full sort."""
    return df.orderBy(hash_order(seed, *keys), *keys).limit(n)


def round_robin(df: DataFrame, buckets: Sequence[str], order: Sequence[Column], n: int, bucket_order: Sequence[Column] | None = None) -> DataFrame:
    """n rows taken in rounds, one from each bucket a round, buckets in order.

    Equal to ordering by (rank in the bucket, bucket), of which only the first n rows are wanted:
    ranks beyond n are cut inside each task before the shuffle.
    """
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*buckets).orderBy(*order))).where(F.col("__rank") <= n)
    return ranked.orderBy("__rank", *(bucket_order or [F.col(b) for b in buckets])).limit(n).drop("__rank")


def challenge(df: DataFrame, limit: int, primary: int, seed: int, keys: Sequence[str], exact: Column, confident: float = 0.9) -> DataFrame:
    """`primary` random rows and, apart from them, hard ones: low confidence and inexact evidence first, rare relations first.

    Adds sample_group and requires_second_review, the latter for a fifth of the rows.
    """
    first = uniform(df, min(primary, limit), seed, *keys).withColumn("sample_group", F.lit("primary_random"))
    rest = df.join(first.select(*keys), list(keys), "left_anti")
    sizes = df.groupBy("relation").agg(F.count(F.lit(1)).alias("__size"))
    order = [F.col("computed_confidence") >= confident, exact, F.col("computed_confidence"), hash_order(seed + 1, *keys)]
    hard = round_robin(rest.join(sizes, "relation"), ["relation"], order, max(0, limit - primary), [F.col("__size"), F.col("relation")])
    both = first.unionByName(hard.drop("__size").withColumn("sample_group", F.lit("challenge")))
    # A bounded sample (limit rows), so one window over it is no concern.
    place = F.row_number().over(Window.orderBy(hash_order(seed + 2, *keys), *keys))
    total = F.count(F.lit(1)).over(Window.partitionBy())
    return both.withColumn("requires_second_review", place <= F.bround(total * 0.2, 0))


def review_rows(df: DataFrame, *order: str) -> DataFrame:
    """Records as flat review rows with blank label columns and an ordinal id in the given total order, its number four digits wide at least."""
    blank = ["support_label", "entity_1_correct", "entity_2_correct", "relation_correct", "direction_correct", "evidence_span_correct", "error_type", "review_notes", "reviewer_id", "review_date", "second_support_label", "second_reviewer_id", "second_review_date", "adjudicated_label", "adjudication_notes"]
    return numbered(df, *order).select(
        F.format_string("SMA-RE-%04d", "seq").alias("candidate_id"),
        "sample_group",
        F.when(F.col("requires_second_review"), "yes").otherwise("no").alias("requires_second_review"),
        "source_pmid",
        F.col("entity_1.name").alias("entity_1_name"),
        F.col("entity_1.type").alias("entity_1_type"),
        "relation",
        F.col("entity_2.name").alias("entity_2_name"),
        F.col("entity_2.type").alias("entity_2_type"),
        "evidence_text",
        "computed_confidence",
        "extracted_by",
        F.lit("pending_review").alias("review_status"),
        *[F.lit("").alias(c) for c in blank],
    )


def cluster_bootstrap(df: DataFrame, cluster: str, hit: Column, replications: int = 2000, seed: int = 20261002) -> DataFrame:
    """One row (low, high): 95 % interval of the share of hits, whole clusters drawn with replacement.

    Clusters are first summed to (n, hits). Drawing as many clusters as there are is, for each
    cluster, a Poisson(1) number of draws as their number grows; those come from hashes of
    (replicate, cluster), so replicates are partial sums and no cluster list is copied about.
    The ends are elements of the sorted replicates, not interpolated.
    """
    sums = df.groupBy(F.col(cluster).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("k"))
    unit = F.conv(F.substring(hash_order(seed, "r", "c"), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(12):  # Poisson(1) by its distribution function
        total += p
        steps.append(F.when(unit > total, 1).otherwise(0))
        p /= k + 1
    draws = steps[0]
    for s in steps[1:]:
        draws = draws + s
    drawn = sums.select("c", "n", "k", F.explode(F.sequence(F.lit(0), F.lit(replications - 1))).alias("r")).withColumn("d", draws)
    shares = drawn.groupBy("r").agg(F.try_divide(F.sum(F.col("d") * F.col("k")).cast("double"), F.sum(F.col("d") * F.col("n")).cast("double")).alias("share"))
    ordered = shares.where("share IS NOT NULL").agg(F.sort_array(F.collect_list("share")).alias("s"))  # `replications` numbers
    return ordered.select(F.get("s", F.floor(F.lit(0.025) * (F.size("s") - 1)).cast("int")).alias("low"), F.get("s", F.floor(F.lit(0.975) * (F.size("s") - 1)).cast("int")).alias("high"))
