"""Integrity checks. Each gives the rows that violate it, so an empty result is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.identity import compatible


def provenance(edges: DataFrame, records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges and groups of records that don't match: (keys, problem). Needs evidence_count and pmids on the edges."""
    groups = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sort_array(F.collect_set("source_pmid")).alias("__pmids"))
    joined = edges.select(*keys, "evidence_count", "pmids").join(groups, list(keys), "full_outer")
    problem = (
        F.when(F.col("__n").isNull(), "edge_without_records")
        .when(F.col("evidence_count").isNull(), "records_without_edge")
        .when(F.col("evidence_count") != F.col("__n"), "count_differs")
        .when(F.sort_array("pmids") != F.col("__pmids"), "ids_differ")
    )
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").select(*keys, "problem")


def aligned_rows(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(seq, problem): rows that only one side has, and rows whose columns differ; what a zip would take for granted."""
    a = left.select("seq", F.struct(*columns).alias("__a"))
    b = right.select("seq", F.struct(*columns).alias("__b"))
    joined = a.join(b, "seq", "full_outer")
    problem = F.when(F.col("__a").isNull(), "left_missing").when(F.col("__b").isNull(), "right_missing").when(~F.col("__a").eqNullSafe(F.col("__b")), "differs")
    return joined.select("seq", problem.alias("problem")).where("problem IS NOT NULL")


def identity_invariants(before: DataFrame, after: DataFrame, exact: bool = True) -> DataFrame:
    """(seq, problem) of rows in which alignment changed more than spelling."""
    fixed = aligned_rows(
        before.select("seq", "source_pmid", "relation", "evidence_text", F.col("entity_1.type").alias("t1"), F.col("entity_2.type").alias("t2")),
        after.select("seq", "source_pmid", "relation", "evidence_text", F.col("entity_1.type").alias("t1"), F.col("entity_2.type").alias("t2")),
        ["source_pmid", "relation", "evidence_text", "t1", "t2"],
    )
    b = after.select("seq", F.col("entity_1").alias("__1"), F.col("entity_2").alias("__2"))
    both = before.join(b, "seq")
    same = compatible(F.col("entity_1.type"), F.col("entity_1.name"), F.col("__1.name"), exact) & compatible(F.col("entity_2.type"), F.col("entity_2.name"), F.col("__2.name"), exact)
    return fixed.unionByName(both.where(~same).select("seq", F.lit("identity_differs").alias("problem")))


def conflicting_payloads(df: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """Keys that stand for more than one payload."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(*payload)).alias("payloads")).where("payloads > 1")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reconcile(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, duplicates counted, with `side`."""
    stored = stored.select(*expected.columns)
    return expected.exceptAll(stored).withColumn("side", F.lit("expected_only")).unionByName(stored.exceptAll(expected).withColumn("side", F.lit("stored_only")))


def protected_columns(rows: DataFrame, frozen: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, problem): rows added, lost, repeated, or changed in a protected column."""
    a = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(*columns)).alias("__a"))
    joined = a.join(frozen.select(key, F.struct(*columns).alias("__b")), key, "full_outer")
    problem = (
        F.when(F.col("__b").isNull(), "unknown_id").when(F.col("__a").isNull(), "lost_id").when(F.col("__n") > 1, "repeated_id").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    )
    return joined.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def endpoints_exist(edges: DataFrame, nodes: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Endpoints of edges that are no node."""
    return edges.select(F.explode(F.array(a, b)).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")


def leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand on more than one side of a split."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("sides")).where("sides > 1")
