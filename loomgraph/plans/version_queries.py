"""Queries of the versioned graph, the audit and the record operators around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text, vocabulary
from loomgraph.operators import audit, evaluation, evidence, fusion, records, versions
from loomgraph.plans import views
from loomgraph.plans.registry import query, table
from loomgraph.sources.scratch import Tables

_VERSION = "typed-v2-1"


def _id(namespace: str, kind: str, name: str) -> str:
    return f"""sha256('["{namespace}","{kind}","' || {name} || '"]')"""


# Literature edges are the coarse fused edges, one in seven of whose records has a flag; external ones are customers and nations.
_EXTERNAL_SQL = "SELECT 'C' || c_custkey AS gene_symbol, 'T' || c_custkey AS target_id, 'D' || c_nationkey AS disease_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS score FROM customer"
_EDGE_ROWS_SQL = f"""
SELECT 'literature' AS namespace, e.name_1, 'Drug' AS type_1, '' AS source_1, e.relation, e.name_2, 'Disease' AS type_2, '' AS source_2, computed_confidence AS confidence, pmids, evidence_count,
       CASE WHEN flagged OR conflict THEN 'needs_review' ELSE 'screened_candidate' END AS review_status
FROM (SELECT *, bool_or(relation = 'IMPROVES') OVER p AND bool_or(relation = 'WORSENS') OVER p AS conflict FROM ({views.fused_sql(True)}) WINDOW p AS (PARTITION BY name_1, name_2)) e
JOIN (SELECT name_1, relation, name_2, bool_or(seq % 7 = 0) AS flagged FROM ({views.triples_sql(True)}) GROUP BY ALL) f USING (name_1, relation, name_2)
UNION ALL SELECT 'opentargets', gene_symbol, 'Gene', target_id, 'ASSOCIATED_WITH', disease_id, 'Disease', disease_id, coalesce(score, 0.0), NULL, NULL, 'not_applicable' FROM ({_EXTERNAL_SQL})
"""
_KEYED_SQL = f"""
SELECT *, '{_VERSION}:' || CASE namespace WHEN 'literature' THEN {_id("literature", "Drug", "name_1")} ELSE {_id("opentargets", "Gene", "source_1")} END AS a,
       '{_VERSION}:' || CASE namespace WHEN 'literature' THEN {_id("literature", "Disease", "name_2")} ELSE {_id("opentargets", "Disease", "source_2")} END AS b,
       CASE namespace WHEN 'literature' THEN 'Literature_NLP' ELSE 'OpenTargets' END AS source FROM ({_EDGE_ROWS_SQL})
"""
_EDGES_SQL = f"""SELECT sha256('["{_VERSION}","' || source || '","' || a || '","' || relation || '","' || b || '"]') AS edge_key, '{_VERSION}' AS graph_version, * FROM ({_KEYED_SQL})"""
_NODES_SQL = f"""
SELECT DISTINCT a AS entity_key, substr(a, {len(_VERSION) + 2}) AS entity_id, '{_VERSION}' AS graph_version, name_1 AS name, type_1 AS type, namespace, source_1 AS source_id FROM ({_KEYED_SQL})
UNION SELECT DISTINCT b, substr(b, {len(_VERSION) + 2}), '{_VERSION}', name_2, type_2, namespace, source_2 FROM ({_KEYED_SQL})
"""


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = views.scored(spark, sf_dir, True)
    rows = scored.select(F.col("entity_1.name").alias("name_1"), F.col("entity_1.type").alias("type_1"), "relation", F.col("entity_2.name").alias("name_2"), F.col("entity_2.type").alias("type_2"), "source_pmid", "extracted_by", "computed_confidence", "seq", "evidence_text")
    return rows.withColumn("review_flags", F.when(F.col("seq") % 7 == 0, F.array(F.lit("short_fragment"))).otherwise(F.array().cast("array<string>")))


def _associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    return c.select(name("C", "c_custkey").alias("gene_symbol"), name("T", "c_custkey").alias("target_id"), name("D", "c_nationkey").alias("disease_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal").cast("double")).alias("score"))


def _edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flat(spark, sf_dir)
    fused = fusion.with_review_status(fusion.fuse(rows, digits=9))
    return versions.literature_edges(fused, rows).unionByName(versions.external_edges(_associations(spark, sf_dir)))


def _version(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return versions.build(_edge_rows(spark, sf_dir), _VERSION)


@query(_NODES_SQL)
def import_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _version(spark, sf_dir)[0].drop("ncbi_gene", "ensembl")


@query(f"SELECT edge_key, graph_version, source, a, relation, b, round(confidence, 9) AS confidence, pmids AS evidence_pmids, evidence_count, review_status FROM ({_EDGES_SQL})")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _version(spark, sf_dir)[1].withColumns({"evidence_pmids": F.array_join("evidence_pmids", ","), "confidence": F.bround("confidence", 9)})


@query("SELECT 'count_differs' AS problem, count(*) AS n FROM (SELECT DISTINCT name_1, relation, name_2 FROM (" + views.triples_sql(True) + ") WHERE CAST(substr(name_1, 2) AS BIGINT) % 10 = 0) UNION ALL SELECT 'relation_not_canonical', count(*) FROM customer UNION ALL SELECT 'invalid_entity', count(*) FROM nation")
def import_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was tampered with here must be found: counts of some edges, a relation's name, a type."""
    rows = _flat(spark, sf_dir)
    fused = fusion.with_review_status(fusion.fuse(rows, digits=9))
    fused = fused.withColumn("evidence_count", F.col("evidence_count") + F.when(F.substring("name_1", 2, 20).cast("bigint") % 10 == 0, 1).otherwise(0))
    outside = versions.external_edges(_associations(spark, sf_dir)).withColumns({"relation": F.lit("associated-with"), "type_2": F.lit("Patient")})
    edge_rows = versions.literature_edges(fused, rows).unionByName(outside)
    nodes, edges = versions.build(edge_rows, _VERSION)
    return versions.problems(fused, rows, edge_rows, nodes, edges).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT e.edge_key, seq, t.source_pmid, t.evidence_text, seq % 7 = 0 AS flagged FROM ({views.triples_sql(True)}) t JOIN ({_EDGES_SQL}) e USING (name_1, relation, name_2) WHERE e.namespace = 'literature'")
def import_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.assertions(_flat(spark, sf_dir), _VERSION).select("edge_key", "seq", "source_pmid", "evidence_text", (F.size("review_flags") > 0).alias("flagged"))


@query(f"""
WITH e AS ({_EDGES_SQL}), kept AS (SELECT edge_key FROM e WHERE namespace = 'literature' AND CAST(substr(name_2, 2) AS BIGINT) % 2 = 0), gone AS (SELECT a FROM e WHERE name_1 = 'S1')
SELECT edge_key, CASE WHEN edge_key IN (SELECT edge_key FROM kept) AND a NOT IN (SELECT a FROM gone) THEN 'changed' ELSE review_status END AS review_status FROM e WHERE namespace = 'literature'
""")
def upserted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to half of the parts are put in anew; those from one supplier find no node and stay as they are.

    Nodes, edges and changes come from one table of edge rows, written once; the lists of evidence take no part.
    """
    rows = Tables(spark, "upserted").write(_edge_rows(spark, sf_dir).drop("evidence_pmids"), "rows", drop_shuffles=True)
    nodes, edges = versions.build(rows.withColumn("evidence_pmids", F.lit(None).cast("array<string>")), _VERSION)
    edges = edges.drop("evidence_pmids").where("source = 'Literature_NLP'")
    even = nodes.where("namespace = 'literature' AND type = 'Disease' AND CAST(substr(name, 2) AS BIGINT) % 2 = 0").select(F.col("entity_key").alias("b"))
    changes = edges.join(even, "b", "left_semi").withColumn("review_status", F.lit("changed"))
    return versions.upsert_edges(edges, changes, nodes.where("name <> 'S1'")).select("edge_key", "review_status")


@query(f"SELECT edge_key, name_1 AS a_name, type_1 AS a_type, relation, name_2 AS b_name, type_2 AS b_type FROM ({_EDGES_SQL})")
def edges_of_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _version(spark, sf_dir)
    other = edges.where("source = 'OpenTargets'").withColumn("graph_version", F.lit("older"))
    return versions.edges_of(nodes, edges.unionByName(other), _VERSION).select("edge_key", "a_name", "a_type", "relation", "b_name", "b_type")


@query(f"""
WITH e AS ({_EDGES_SQL}), n AS ({_NODES_SQL})
SELECT '{_VERSION}' AS graph_version, (SELECT count(*) FROM n) AS nodes, (SELECT count(DISTINCT entity_key) FROM n) AS distinct_nodes, count(*) AS edges, count(DISTINCT edge_key) AS distinct_edges,
       0 AS without_evidence, count(*) FILTER (review_status = 'needs_review') AS needs_review FROM e
UNION ALL SELECT 'older', 0, 0, count(*), count(DISTINCT edge_key), count(*), 0 FROM e WHERE namespace = 'literature' AND review_status <> 'needs_review'
""")
def version_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _version(spark, sf_dir)
    older = edges.where("source = 'Literature_NLP' AND review_status <> 'needs_review'").withColumns({"graph_version": F.lit("older"), "evidence_pmids": F.array().cast("array<string>")})
    return versions.version_counts(nodes, edges.unionByName(older))


@query(f"SELECT namespace, type, count(*) AS n FROM ({_NODES_SQL}) GROUP BY ALL")
def active_nodes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two versions, the one that the pointer names."""
    nodes, _ = _version(spark, sf_dir)
    both = nodes.unionByName(nodes.withColumn("graph_version", F.lit("older")))
    pointer = spark.createDataFrame([("active", _VERSION, "older")], "name string, graph_version string, previous_version string")
    return versions.count_by(versions.active(pointer, both), "namespace", "type")


@query(f"SELECT name, entity_key FROM ({_NODES_SQL}) WHERE namespace = 'literature' AND type = 'Drug' AND name IN ('S1', 'S2')")
def named_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.named(_version(spark, sf_dir)[0], ["S1", "S2"], "Drug").select("name", "entity_key")


@query(f"SELECT relation, pmids AS evidence_pmids FROM ({_EDGES_SQL}) WHERE name_1 = 'S1' AND name_2 = 'P3' AND namespace = 'literature'")
def edges_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _version(spark, sf_dir)
    return versions.between(nodes, edges, "S1", "P3", "Literature_NLP").select("relation", F.array_join("evidence_pmids", ",").alias("evidence_pmids"))


@query(f"""
WITH n AS (SELECT *, row_number() OVER (ORDER BY namespace, type, name, source_id) - 1 AS node_id FROM ({_NODES_SQL}))
SELECT x.node_id AS a, y.node_id AS b, e.relation, e.namespace AS source FROM ({_EDGES_SQL}) e JOIN n x ON x.entity_key = e.a JOIN n y ON y.entity_key = e.b
""")
def assembled_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.assemble(_edge_rows(spark, sf_dir))[1].select("a", "b", "relation", "source")


_RAW = "CASE o_orderpriority WHEN '1-URGENT' THEN 'treated-with' WHEN '2-HIGH' THEN 'no such' WHEN '3-MEDIUM' THEN 'improves' ELSE '' END"


@query(f"""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'TREATS' WHEN '3-MEDIUM' THEN 'IMPROVES' ELSE 'ASSOCIATED_WITH' END AS relationship,
       CASE o_orderstatus WHEN 'F' THEN 'Gene' WHEN 'O' THEN 'Drug' ELSE 'Unknown' END AS label FROM orders
""")
def safe_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", " genes").when(F.col("o_orderstatus") == "O", "Drug").otherwise("Patient")
    return table(spark, sf_dir, "orders").select("o_orderkey", vocabulary.relationship(F.expr(_RAW)).alias("relationship"), vocabulary.label(kind).alias("label"))


# Records whose evidence and own score stand in other places, and some that aren't valid.
_LOOSE_SQL = """
SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'first' WHEN 1 THEN 'second' WHEN 2 THEN 'third' ELSE '' END AS evidence,
       CASE event_id % 5 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.25::DOUBLE WHEN 2 THEN 1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE END AS own, event_id % 6 = 0 AS bad FROM events
"""


def _loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("seq"),
        e.cast("string").alias("source_pmid"),
        F.struct(F.concat(F.lit("g"), (e % 50).cast("string")).alias("name"), F.when(e % 6 == 0, "Patient").otherwise("Gene").alias("type")).alias("entity_1"),
        F.lit("CAUSES").alias("relation"),
        F.struct(F.concat(F.lit("d"), (e % 3).cast("string")).alias("name"), F.lit("Disease").alias("type")).alias("entity_2"),
        F.when(e % 4 == 0, "first").when(e % 4 == 1, "").alias("evidence_text"),
        F.when(e % 4 == 1, "second").alias("evidence_sentence"),
        F.struct(F.when(e % 4 != 3, "third").alias("text")).alias("evidence"),
        F.when(e % 5 == 0, "0.9").otherwise("n/a").alias("llm_confidence"),
        F.when(e % 5 == 1, "0.25").alias("confidence"),
        F.when(e % 5 == 2, 7.0).alias("self_confidence"),
        F.when(e % 5 == 3, "0.5").alias("confidence_score"),
        F.lit("LLM_x").alias("extracted_by"),
    )


@query(f"""
SELECT seq, evidence, round_even(0.38::DOUBLE * coalesce(own, 0.78::DOUBLE) + CASE WHEN evidence = '' THEN 0.24::DOUBLE * 0.55::DOUBLE ELSE 0.24::DOUBLE END
  + 0.24::DOUBLE * (1 - 0.25::DOUBLE * (CASE WHEN bad THEN 1 ELSE 0 END + CASE WHEN evidence = '' THEN 1 ELSE 0 END)) + 0.14::DOUBLE * 0.78::DOUBLE, 6) AS computed_confidence FROM ({_LOOSE_SQL})
""")
def loose_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.normalize_and_score(_loose(spark, sf_dir), digits=6)
    return out.select("seq", F.col("evidence_text").alias("evidence"), "computed_confidence")


@query(f"""
WITH s AS (SELECT name_1, relation, name_2, source_pmid, extracted_by, computed_confidence AS c, seq % 5 <> 0 AS valid FROM ({views.scored_sql(True)}))
SELECT name_1, relation, name_2, round(0.42::DOUBLE * max(c) + 0.18::DOUBLE * avg(c) + 0.18::DOUBLE * least(1.0::DOUBLE, 0.45::DOUBLE + 0.12::DOUBLE * (count(DISTINCT source_pmid) - 1))
  + 0.14::DOUBLE * least(1.0::DOUBLE, 0.55::DOUBLE + 0.25::DOUBLE * (count(DISTINCT extracted_by) - 1)) + 0.08::DOUBLE * CASE WHEN bool_and(valid) THEN 1.0::DOUBLE ELSE 0.65::DOUBLE END, 9) AS computed_confidence FROM s GROUP BY ALL
""")
def fused_with_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.when(F.col("seq") % 5 == 0, F.array(F.lit("relation_invalid"))).when(F.col("seq") % 3 == 0, F.array(F.lit("evidence_text_empty"))).otherwise(F.array().cast("array<string>"))
    rows = fusion.flat(views.scored(spark, sf_dir, True).withColumn("problems", codes))
    return fusion.fuse(rows, digits=9).select("name_1", "relation", "name_2", F.bround("computed_confidence", 9).alias("computed_confidence"))


@query("SELECT count(*) AS records, count(*) FILTER (event_id % 10 = 1) AS bad_json_lines, count(*) FILTER (event_id % 10 IN (2, 3)) AS invalid_triples, false AS valid FROM events WHERE event_id % 10 <> 0")
def validated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 10
    good = F.format_string('{"source_pmid": "%d", "entity_1": {"name": "A", "type": "Gene"}, "relation": "CAUSES", "entity_2": {"name": "B", "type": "Disease"}}', "event_id")
    line = F.when(kind == 0, "  ").when(kind == 1, F.expr("left('{\"source_pmid\": 1', 12)")).when(kind == 2, "[1, 2]").when(kind == 3, F.replace(good, F.lit("CAUSES"), F.lit("no such"))).otherwise(good)
    return audit.validate_lines(table(spark, sf_dir, "events").select(line.alias("line")))


# Orders as records: one row for each number, customers in a hundred groups, orders in fifty.
_ORDERS_SQL = """
SELECT o_orderkey AS seq, CAST(o_orderkey AS VARCHAR) AS source_pmid, 'S' || (o_custkey % 100) AS name_1, 'P' || (o_orderkey % 50) AS name_2, 'line ' || (o_orderkey % 4) AS evidence_text,
       CASE o_orderstatus WHEN 'F' THEN 'IMPROVES' WHEN 'O' THEN 'WORSENS' ELSE 'CAUSES' END AS relation FROM orders
"""


def _order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = lambda letter, key, kind: F.struct(F.concat(F.lit(letter), key.cast("string")).alias("name"), F.lit(kind).alias("type"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderkey").cast("string").alias("source_pmid"),
        entity("S", F.col("o_custkey") % 100, "Drug").alias("entity_1"),
        F.when(F.col("o_orderstatus") == "F", "IMPROVES").when(F.col("o_orderstatus") == "O", "WORSENS").otherwise("CAUSES").alias("relation"),
        entity("P", F.col("o_orderkey") % 50, "Disease").alias("entity_2"),
        F.concat(F.lit("line "), (F.col("o_orderkey") % 4).cast("string")).alias("evidence_text"),
        F.lit("LLM_x").alias("extracted_by"),
        F.lit(0.5).alias("computed_confidence"),
    )


@query(f"""
WITH t AS ({_ORDERS_SQL}), known AS (SELECT source_pmid AS pmid, seq FROM t WHERE seq % 3 <> 0), edges AS (SELECT DISTINCT name_1, relation, name_2 FROM t)
SELECT 'abstracts' AS file, 'duplicate_pmids' AS "check", (SELECT count(*) FROM known WHERE seq % 50 = 1) AS n
UNION ALL SELECT f, 'records', (SELECT count(*) FROM t) FROM (VALUES ('raw'), ('mapped'), ('aligned')) v(f)
UNION ALL SELECT f, 'schema_invalid', CASE f WHEN 'raw' THEN (SELECT count(*) FROM t WHERE seq % 11 = 0) ELSE 0 END FROM (VALUES ('raw'), ('mapped'), ('aligned')) v(f)
UNION ALL SELECT f, 'missing_sources', (SELECT count(*) FROM t WHERE seq % 3 = 0) FROM (VALUES ('raw'), ('mapped'), ('aligned')) v(f)
UNION ALL SELECT 'evidence_location', CASE WHEN seq % 3 = 0 THEN 'missing_source' WHEN seq % 4 IN (1, 2) THEN 'exact' WHEN seq % 4 = 3 THEN 'case_whitespace_match' ELSE 'not_located' END, count(*) FROM t GROUP BY 1, 2
UNION ALL SELECT 'fused', 'count_differs', count(*) FROM edges WHERE CAST(substr(name_1, 2) AS BIGINT) % 10 = 0
UNION ALL SELECT 'fused', 'repeated_edges', 0
UNION ALL SELECT 'aligned', 'unexpected_field_changes', count(*) FROM t WHERE seq % 13 = 0
UNION ALL SELECT 'aligned', 'changed_name_mappings', count(DISTINCT name_2) FROM t
UNION ALL SELECT 'conflicts', 'missing_relation_sources', count(*) FROM (SELECT name_1, name_2 FROM t GROUP BY ALL HAVING bool_or(relation = 'IMPROVES') AND bool_or(relation IN ('WORSENS', 'CAUSES')))
""")
def input_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All inputs of an evaluation, faults planted in each."""
    rows = _order_records(spark, sf_dir)
    raw = rows.withColumn("relation", F.when(F.col("seq") % 11 == 0, "no such").otherwise(F.col("relation")))
    renamed = F.struct(F.concat(F.lit("part "), F.substring("entity_2.name", 2, 20)).alias("name"), F.col("entity_2.type").alias("type"))
    mapped = rows.withColumn("entity_2", renamed)
    aligned = mapped.withColumn("evidence_text", F.when(F.col("seq") % 13 == 0, "other").otherwise(F.col("evidence_text")))
    abstracts = rows.where("seq % 3 <> 0").select(F.col("source_pmid").alias("pmid"), "seq", F.lit("line 1 and line 2").alias("title"), F.lit("LINE  3").alias("abstract"))
    abstracts = abstracts.unionByName(abstracts.where("seq % 50 = 1")).drop("seq")
    fused = fusion.fuse(fusion.flat(aligned))
    conflicts = fusion.relation_conflicts(fused).withColumn("relations", F.concat("relations", F.array(F.lit("TREATS"))))
    fused = fused.withColumn("evidence_count", F.col("evidence_count") + F.when(F.substring("name_1", 2, 20).cast("bigint") % 10 == 0, 1).otherwise(0))
    return audit.audit(abstracts, raw, mapped, aligned, fused, conflicts)


@query("SELECT o_orderkey // 200 * 0 + (rn - 1) // 200 AS batch, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM (SELECT DISTINCT o_orderkey FROM orders)) GROUP BY 1")
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.id_batches(table(spark, sf_dir, "orders"), "o_orderkey", 200)


_DECIDED = "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'partial' ELSE NULL END AS support, doc_id % 5 <> 0 AS right_way, doc_id % 7 = 0 AS open, doc_id % 2 = 0 AS whole FROM documents"


@query(f"SELECT id AS candidate_id, coalesce(support = 'direct', false) AND right_way AND NOT open AND whole AS accepted FROM ({_DECIDED})")
def model_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    abstract = F.concat(F.lit('First result 1.5 holds. Second one ("number '), F.col("doc_id").cast("string"), F.lit('") stands here!" Third  is\nlast'))
    quote = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(' Second one ("number '), F.col("doc_id").cast("string"), F.lit('") stands here!" Third  is'))).otherwise(F.lit("Second one"))
    decision = F.struct(
        F.when(F.col("doc_id") % 3 == 0, "direct").when(F.col("doc_id") % 3 == 1, "partial").alias("support"),
        F.lit(True).alias("entity_types_correct"),
        (F.col("doc_id") % 5 != 0).alias("direction_correct"),
        F.lit(True).alias("conditions_preserved"),
        F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("dose"))).otherwise(F.array().cast("array<string>")).alias("missing_conditions"),
        F.lit("abstract").alias("source_field"),
        quote.alias("evidence_quote"),
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("candidate_id"), evaluation.decision_accepted(decision, F.lit(""), abstract).alias("accepted"))


@query(f"""
WITH m AS (SELECT id, coalesce(support = 'direct', false) AND right_way AND NOT open AND whole AS accepted FROM ({_DECIDED}) WHERE id % 11 <> 0)
SELECT doc_id AS candidate_id, true AS all_predictions, coalesce(quality = 1, false) AS previous_evidence_triage, coalesce(quality = 1 AND toxic = 0, false) AS context_type_screen,
       coalesce(accepted, false) AS model_direct_screen, coalesce(accepted, false) AND coalesce(quality = 1, false) AS combined_screen
FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN m ON id = doc_id
""")
def gates_of_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("candidate_id"))
    good = F.col("quality") == 1
    screens = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("candidate_id"), good.alias("eligible"), (good & (F.col("toxic") == 0)).alias("candidate"))
    return evaluation.candidate_gates(docs, screens, model_decisions(spark, sf_dir).where("candidate_id % 11 <> 0"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS sample_group, CASE WHEN toxic = 1 THEN 'direction' WHEN quality = 0 THEN 'not_recorded' ELSE 'none' END AS error_type, count(*) AS n FROM labels GROUP BY ALL")
def error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("toxic") == 1, "direction").when(F.col("quality") == 0, "  ").otherwise("none")
    rows = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("sample_group"), error.alias("error_type"))
    return evaluation.error_histogram(rows, "sample_group")


@query("""
WITH t AS (SELECT CASE quality WHEN 1 THEN '2' ELSE '0' END AS a, CASE WHEN toxic = 1 THEN '0' ELSE '2' END AS b FROM labels WHERE doc_id % 4 = 0), n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b) AS same FROM t),
m AS (SELECT sum(x.c * y.c) AS lr FROM (SELECT a, count(*) AS c FROM t GROUP BY 1) x JOIN (SELECT b, count(*) AS c FROM t GROUP BY 1) y ON a = b)
SELECT CAST(n AS BIGINT) AS pairs, round(same / n, 9) AS raw_agreement, round((same / n - lr / (n * n)) / (1 - lr / (n * n)), 9) AS cohen_kappa FROM n, m
""")
def agreement_before_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.col("doc_id") % 4 == 0
    rows = table(spark, sf_dir, "labels").withColumns(
        {
            "sample_group": F.lit("primary_random"),
            "support_label": F.when(F.col("quality") == 1, "2").otherwise("0"),
            "second_support_label": F.when(second, F.when(F.col("toxic") == 1, "0").otherwise("2")).otherwise(""),
            "second_reviewer_id": F.when(second, "r2").otherwise(""),
            "second_review_date": F.when(second, "2026-01-02").otherwise(""),
            "review_status": F.lit("completed"),
            "requires_second_review": F.when(second, "yes").otherwise("no"),
            **{c: F.lit("x") for c in ("reviewer_id", "review_date", "error_type", "review_notes", "adjudication_notes")},
            "adjudicated_label": F.lit("2"),
            **{c: F.lit("yes") for c in evaluation.CHECKS},
        }
    )
    return evaluation.review_agreement(rows).withColumns({c: F.bround(c, 9) for c in ("raw_agreement", "cohen_kappa")})


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'unclear' END AS span_label, left(o_orderpriority, 4) AS short, CASE WHEN o_orderkey % 5 = 0 THEN 'not available' ELSE printf('%.1f%%', (o_orderkey % 8) / 8.0 * 100) END AS share, '| ' || o_orderkey || ' | ' || o_orderstatus || ' |' AS line FROM orders")
def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.col("o_orderkey") % 4
    label = F.when(way == 0, " yes ").when(way == 1, "不合格").when(way == 2, "无法判断").otherwise("maybe")
    share = F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 8) / 8.0)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", evaluation.span_label(label).alias("span_label"), text.truncated(F.col("o_orderpriority"), 4).alias("short"), text.percent(share).alias("share"), text.markdown_row(F.col("o_orderkey"), F.col("o_orderstatus")).alias("line")
    )


@query(f"""
WITH n AS (SELECT name_1 AS "Novel_Gene", relation AS "Relation_Type", name_2 AS "Context_Entity", count(DISTINCT source_pmid) AS m FROM ({views.triples_sql()}) WHERE extracted_by LIKE '%LLM%' AND name_2 IN ('P1', 'P2', 'P3', 'P4', 'P5')
  AND name_1 NOT IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal >= 5000) GROUP BY ALL)
SELECT row_number() OVER (ORDER BY m DESC, "Novel_Gene", "Relation_Type", "Context_Entity") AS rank, "Novel_Gene", "Relation_Type", "Context_Entity" FROM n
""")
def novelty_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.plans.queries import novelty_rank

    return evaluation.novelty_in_order(novelty_rank(spark, sf_dir)).select("rank", "Novel_Gene", "Relation_Type", "Context_Entity")


_SENTENCES = (
    ("1-URGENT", "Nusinersen therapy was approved for spinal muscular atrophy. It is new.", (("Nusinersen", "TREATS", "Spinal Muscular Atrophy"),)),
    ("2-HIGH", "Risdiplam did not treat SMA. Evrysdi improved motor function and survival!", (("Risdiplam", "IMPROVES", "motor function"), ("Risdiplam", "IMPROVES", "survival"))),
    ("3-MEDIUM", "A deletion in SMN1 causes SMA? Spinraza, dosed in patients with SMA, restores muscle weakness.", (("SMN1", "ASSOCIATED_WITH", "Spinal Muscular Atrophy"), ("Nusinersen", "TREATS", "Spinal Muscular Atrophy"), ("Nusinersen", "IMPROVES", "muscle weakness"))),
    ("5-LOW", "No significant link of SMN2 with SMA. Zolgensmax treats SMAB.", ()),
)


@query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS source_pmid, e1, relation, e2 FROM orders JOIN (VALUES "
    + ", ".join(f"('{p}', '{a}', '{r}', '{b}')" for p, _, found in _SENTENCES for a, r, b in found)
    + ") v(p, e1, relation, e2) ON o_orderpriority = p"
)
def cue_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule extractor's own lexicon and cues over sentences of known content."""
    said = F.lit(None).cast("string")
    for priority, sentence, _ in _SENTENCES:
        said = F.when(F.col("o_orderpriority") == priority, sentence).otherwise(said)
    found = evidence.rule_triples(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("pmid"), said.alias("abstract")))
    return found.select("source_pmid", F.col("entity_1.name").alias("e1"), "relation", F.col("entity_2.name").alias("e2"))
