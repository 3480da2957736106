"""The versioned property graph: building a version's records, putting them in, reading them back.

A version is node and edge rows that carry its name; a one-row table points to the active one.
Evidence records are a table of their own, keyed by edge, so that an edge with many of them is
many rows and not one long value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import identity, vocabulary
from loomgraph.functions.vocabulary import DEFAULT, Vocabulary
from loomgraph.operators import checks, fusion
from loomgraph.sources.records import numbered
from loomgraph.sources.sinks import upsert

# Names of the sources and namespaces of a version's records.
LITERATURE, EXTERNAL = "literature", "opentargets"
SOURCES = {LITERATURE: "Literature_NLP", EXTERNAL: "OpenTargets"}
EXTERNAL_RELATION = "ASSOCIATED_WITH"


def _ends(df: DataFrame, version: str) -> DataFrame:
    """Edge rows (name_n, type_n, source_id_n, namespace) with their endpoints as node rows n1 and n2."""
    out = df
    for n in ("1", "2"):
        name, kind, outside = F.trim(f"name_{n}"), F.col(f"type_{n}"), F.coalesce(f"source_id_{n}", F.lit(""))
        local = identity.entity_id(F.col("namespace"), kind, F.when(outside != "", outside).otherwise(name))
        out = out.withColumn(
            f"n{n}",
            F.struct(
                F.concat(F.lit(f"{version}:"), local).alias("entity_key"),
                local.alias("entity_id"),
                F.lit(version).alias("graph_version"),
                name.alias("name"),
                kind.alias("type"),
                "namespace",
                outside.alias("source_id"),
                identity.authority(kind, name, identity.NCBI).alias("ncbi_gene"),
                identity.authority(kind, name, identity.ENSEMBL).alias("ensembl"),
            ),
        )
    return out


def external_edges(associations: DataFrame) -> DataFrame:
    """Gene-disease associations (gene_symbol, target_id, disease_id, score) as edge rows of their own namespace."""
    return associations.select(
        F.lit(EXTERNAL).alias("namespace"),
        F.col("gene_symbol").alias("name_1"), F.lit("Gene").alias("type_1"), F.col("target_id").alias("source_id_1"),
        F.lit(EXTERNAL_RELATION).alias("relation"),
        F.col("disease_id").alias("name_2"), F.lit("Disease").alias("type_2"), F.col("disease_id").alias("source_id_2"),
        F.coalesce("score", F.lit(0.0)).alias("confidence"),
        F.lit(None).cast("array<string>").alias("evidence_pmids"),
        F.lit(None).cast("bigint").alias("evidence_count"),
        F.lit("not_applicable").alias("review_status"),
    )


def literature_edges(fused: DataFrame, records: DataFrame) -> DataFrame:
    """Fused edges as edge rows. An edge needs review if it is in conflict or any of its records (columns of EDGE, review_flags) has a flag."""
    flagged = records.groupBy(*fusion.EDGE).agg(F.bool_or(F.size("review_flags") > 0).alias("__flagged"))
    pending = F.coalesce("__flagged", F.lit(False)) | (F.col("review_status") == "needs_review")
    return fused.join(flagged, list(fusion.EDGE), "left").select(
        F.lit(LITERATURE).alias("namespace"),
        "name_1", "type_1", F.lit("").alias("source_id_1"), "relation", "name_2", "type_2", F.lit("").alias("source_id_2"),
        F.col("computed_confidence").alias("confidence"),
        F.col("pmids").alias("evidence_pmids"),
        F.col("evidence_count").cast("bigint").alias("evidence_count"),
        F.when(pending, "needs_review").otherwise("screened_candidate").alias("review_status"),
    )


def build(edge_rows: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a version: one row for each entity_key, edges with edge_key, source and the keys a and b of their ends."""
    ends = _ends(edge_rows, version)
    nodes = ends.select(F.explode(F.array("n1", "n2")).alias("n")).select("n.*").distinct()
    source = vocabulary.lookup(SOURCES, F.col("namespace"))
    a, b = F.col("n1.entity_key"), F.col("n2.entity_key")
    edges = ends.select(
        identity.edge_key(F.lit(version), source, a, F.col("relation"), b).alias("edge_key"),
        F.lit(version).alias("graph_version"), source.alias("source"), a.alias("a"), "relation", b.alias("b"),
        "confidence", "evidence_pmids", "evidence_count", "review_status",
    )
    return nodes, edges


def problems(fused: DataFrame, records: DataFrame, edge_rows: DataFrame, nodes: DataFrame, edges: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """(problem, key) of all that forbids an import; an empty result is a pass.

    Edges and evidence that don't match, entities without a type of the vocabulary or a name,
    relations that aren't canonical, an entity_key for two payloads, an edge_key for two edges.
    """

    def found(df: DataFrame, problem: Column, key: Column) -> DataFrame:
        return df.select(problem.alias("problem"), key.cast("string").alias("key"))

    evidence = checks.provenance(fused, records, fusion.EDGE)
    out = found(evidence, F.col("problem"), F.to_json(F.struct(*fusion.EDGE)))
    bad = nodes.where((vocabulary.label(F.col("type"), vocab) == "Unknown") | (F.col("name") == ""))
    out = out.unionAll(found(bad, F.lit("invalid_entity"), F.col("entity_key")))
    odd = edge_rows.where(vocabulary.relation(F.col("relation"), vocab) != F.col("relation"))
    out = out.unionAll(found(odd, F.lit("relation_not_canonical"), F.col("relation")))
    twice = nodes.groupBy("entity_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = out.unionAll(found(twice, F.lit("entity_key_conflict"), F.col("entity_key")))
    return out.unionAll(found(checks.repeated_keys(edges, "edge_key"), F.lit("edge_key_repeated"), F.col("edge_key")))


def assertions(records: DataFrame, version: str) -> DataFrame:
    """The evidence of a version's literature edges as rows: edge_key, seq and what a record says; JSON by records_json()."""
    rows = records.select(F.lit(LITERATURE).alias("namespace"), F.lit("").alias("source_id_1"), F.lit("").alias("source_id_2"), *fusion.EDGE, "seq", "source_pmid", "evidence_text", "review_flags")
    ends = _ends(rows, version)
    key = identity.edge_key(F.lit(version), F.lit(SOURCES[LITERATURE]), F.col("n1.entity_key"), F.col("relation"), F.col("n2.entity_key"))
    return ends.select(key.alias("edge_key"), "seq", "source_pmid", "evidence_text", "review_flags")


def records_json(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with assertion_records_json, for systems that want the evidence inside; as long as an edge has records."""
    listed = rows.groupBy("edge_key").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "source_pmid", "evidence_text", "review_flags")))).alias("assertion_records_json"))
    return edges.join(listed, "edge_key", "left")


def upsert_nodes(current: DataFrame, changes: DataFrame) -> DataFrame:
    return upsert(current, changes, ["entity_key"])


def upsert_edges(current: DataFrame, changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges put in by edge_key, those whose two ends are nodes; others have nothing to join and are left out."""
    keys = nodes.select(F.col("entity_key").alias("__key"))
    matched = changes
    for end in ("a", "b"):
        matched = matched.join(keys, F.col(end) == F.col("__key"), "left_semi")
    return upsert(current, matched, ["edge_key"])


def nodes_of(nodes: DataFrame, version: str) -> DataFrame:
    return nodes.where(F.col("graph_version") == version)


def edges_of(nodes: DataFrame, edges: DataFrame, version: str) -> DataFrame:
    """A version's edges with name and type of both ends."""
    out = edges.where(F.col("graph_version") == version)
    for end in ("a", "b"):
        side = nodes_of(nodes, version).select(F.col("entity_key").alias(end), F.col("name").alias(f"{end}_name"), F.col("type").alias(f"{end}_type"))
        out = out.join(side, end)
    return out


def active(pointer: DataFrame, rows: DataFrame, name: str = "active") -> DataFrame:
    """Rows of the active version; the pointer has one row."""
    chosen = pointer.where(F.col("name") == name).select(F.col("graph_version").alias("__version"))
    return rows.join(F.broadcast(chosen), F.col("graph_version") == F.col("__version")).drop("__version")


def version_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_version, nodes, distinct_nodes, edges, distinct_edges, without_evidence, needs_review) of every version."""
    n = nodes.groupBy("graph_version").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("entity_key").alias("distinct_nodes"))
    bare = (F.col("source") == SOURCES[LITERATURE]) & (F.coalesce(F.size("evidence_pmids"), F.lit(0)) <= 0)
    e = edges.groupBy("graph_version").agg(
        F.count(F.lit(1)).alias("edges"), F.count_distinct("edge_key").alias("distinct_edges"), F.count_if(bare).alias("without_evidence"), F.count_if(F.col("review_status") == "needs_review").alias("needs_review")
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("nodes", "distinct_nodes", "edges", "distinct_edges", "without_evidence", "needs_review")]
    return n.join(e, "graph_version", "full_outer").select("graph_version", *zero)


def count_by(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def named(nodes: DataFrame, names: list[str], kind: str | None = None, namespace: str = LITERATURE) -> DataFrame:
    """Nodes by name, type and namespace."""
    found = nodes.where(F.col("name").isin(names) & (F.col("namespace") == namespace))
    return found if kind is None else found.where(F.col("type") == kind)


def between(nodes: DataFrame, edges: DataFrame, first: str, second: str, source: str | None = None) -> DataFrame:
    """Edges from one name to another, whatever the relation."""
    a, b = (nodes.where(F.col("name") == x).select("entity_key") for x in (first, second))
    out = edges if source is None else edges.where(F.col("source") == source)
    return out.join(a.withColumnRenamed("entity_key", "a"), "a", "left_semi").join(b.withColumnRenamed("entity_key", "b"), "b", "left_semi")


def assemble(edge_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for a viewer: nodes with dense numbers from 0, edges between numbers."""
    side = lambda n: F.struct("namespace", F.col(f"type_{n}").alias("type"), F.col(f"name_{n}").alias("name"), F.coalesce(f"source_id_{n}", F.lit("")).alias("source_id"))
    rows = edge_rows.withColumns({"__1": side("1"), "__2": side("2")})
    each = rows.select(F.explode(F.array("__1", "__2")).alias("n")).select("n.*").distinct()
    nodes = numbered(each, "namespace", "type", "name", "source_id").withColumn("node_id", F.col("seq") - 1).drop("seq")
    out = rows
    for n, end in (("1", "a"), ("2", "b")):
        keyed = nodes.select(F.struct("namespace", "type", "name", "source_id").alias(f"__{n}"), F.col("node_id").alias(end))
        out = out.join(keyed, f"__{n}").drop(f"__{n}")
    return nodes, out.select("a", "b", "relation", F.col("namespace").alias("source"), "confidence", "evidence_pmids", "evidence_count", "review_status")
