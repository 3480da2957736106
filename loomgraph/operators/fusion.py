"""Fusing records into edges, and relations that contradict each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scoring, vocabulary
from loomgraph.functions.vocabulary import DEFAULT, Vocabulary
from loomgraph.sources.scratch import Tables

EDGE = ("name_1", "type_1", "relation", "name_2", "type_2")
PAIR = ("name_1", "type_1", "name_2", "type_2")


def flat(df: DataFrame) -> DataFrame:
    """Records with their signature as five plain columns, and only what fusing needs; valid, where df has problems."""
    valid = [(F.size(F.array_remove("problems", "evidence_text_empty")) == 0).alias("valid")] if "problems" in df.columns else []
    return df.select(
        F.col("entity_1.name").alias("name_1"),
        F.col("entity_1.type").alias("type_1"),
        "relation",
        F.col("entity_2.name").alias("name_2"),
        F.col("entity_2.type").alias("type_2"),
        "source_pmid",
        "extracted_by",
        "computed_confidence",
        "seq",
        *valid,
    )


def fuse(records: DataFrame, vocab: Vocabulary = DEFAULT, digits: int = 3) -> DataFrame:
    """One row for each signature of flat records.

    Every aggregate is algebraic, so tasks combine before the one shuffle and no list of
    records is ever built: maximum, sum and count of confidences, sets of ids and engines.
    A hub entity is no hot key, the key being the whole signature.
    """
    grouped = records.groupBy(*EDGE).agg(
        F.sort_array(F.collect_set("source_pmid")).alias("pmids"),
        F.sort_array(F.collect_set("extracted_by")).alias("engines"),
        F.count(F.lit(1)).alias("evidence_count"),
        F.max("computed_confidence").alias("__max"),
        F.avg("computed_confidence").alias("__mean"),
        F.min("seq").alias("first_seq"),
        (F.bool_and("valid") if "valid" in records.columns else F.bool_and(F.lit(True))).alias("__valid"),
    )
    value = scoring.fused_score(F.col("__max"), F.col("__mean"), F.size("pmids"), F.size("engines"), F.col("__valid"), digits)
    return grouped.withColumns({"computed_confidence": value, "relation_polarity": vocabulary.polarity(F.col("relation"), vocab)}).drop("__max", "__mean", "__valid")


def in_order(edges: DataFrame) -> DataFrame:
    return edges.orderBy(*[F.lower(c) for c in EDGE], "first_seq")


def relation_conflicts(edges: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """(pair, relations): ordered typed pairs whose relations contradict each other."""
    sets = edges.groupBy(*PAIR).agg(F.sort_array(F.collect_set("relation")).alias("relations"))
    return sets.where(vocabulary.conflicting(F.col("relations"), vocab))


def with_review_status(edges: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """edges with review_status, conflict_reason and conflict_relations from their pair's conflicts.

    A pair has at most as many edges as there are relations, so its set is a window's: edges are
    derived once and moved once.
    """
    relations = F.sort_array(F.collect_set("relation").over(Window.partitionBy(*PAIR)))
    seen = edges.withColumn("conflict_relations", relations)
    hit = vocabulary.conflicting(F.col("conflict_relations"), vocab)
    return seen.withColumns({"review_status": F.when(hit, "needs_review").otherwise("unreviewed"), "conflict_reason": F.when(hit, "relation_polarity_conflict"), "conflict_relations": F.when(hit, F.col("conflict_relations"))})


def conflict_evidence(conflicts: DataFrame, edges: DataFrame) -> DataFrame:
    """Each relation of each conflict with its edge's evidence."""
    each = conflicts.select(*PAIR, F.explode("relations").alias("relation"))
    return each.join(edges, list(EDGE), "left")


def ablation(conditions: dict[str, DataFrame], vocab: Vocabulary = DEFAULT) -> DataFrame:
    """(condition, records, edges, nodes, pairs, self_loops, conflicts) of the same fusion over several inputs."""
    out = None
    for name, records in conditions.items():
        # Two aggregations follow; what they need of the edges is written once.
        edges = Tables(records.sparkSession, "ablation").write(fuse(records, vocab).select(*EDGE, "evidence_count"), name)
        # Either side is distinct first: an entity has many edges, and most are gone before the union.
        sides = [edges.select(F.col(f"type_{n}").alias("t"), F.col(f"name_{n}").alias("n")).distinct() for n in ("1", "2")]
        nodes = sides[0].unionAll(sides[1]).distinct().agg(F.count(F.lit(1)).alias("nodes"))
        pairs = edges.groupBy(*PAIR).agg(vocabulary.conflicting_rows(F.col("relation"), vocab).alias("conflict"), F.count(F.lit(1)).alias("n"), F.sum("evidence_count").alias("records"))
        same = (F.col("name_1") == F.col("name_2")) & (F.col("type_1") == F.col("type_2"))
        counts = pairs.agg(
            F.sum("records").cast("bigint").alias("records"),
            F.sum("n").cast("bigint").alias("edges"),
            F.count(F.lit(1)).alias("pairs"),
            F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)).cast("bigint").alias("self_loops"),
            F.count_if("conflict").alias("conflicts"),
        )
        row = counts.join(F.broadcast(nodes)).select(F.lit(name).alias("condition"), "records", "edges", "nodes", "pairs", "self_loops", "conflicts")
        out = row if out is None else out.unionByName(row)
    return out
