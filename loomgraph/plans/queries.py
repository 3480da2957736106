"""One query for each operator family, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import identity, scoring, text, vocabulary
from loomgraph.operators import alignment, checks, evaluation, evidence, fusion, graph, records, sampling, topics
from loomgraph.plans import views
from loomgraph.plans.registry import query, table
from loomgraph.streaming import records as streams


def _listed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


def _edges(spark: SparkSession, sf_dir: str, coarse: bool) -> DataFrame:
    return fusion.fuse(fusion.flat(views.scored(spark, sf_dir, coarse)), digits=9)


_POLARITY = "CASE relation WHEN 'IMPROVES' THEN 'positive' WHEN 'WORSENS' THEN 'negative' ELSE 'neutral' END"


# Fusion


@query(f"SELECT *, {_POLARITY} AS relation_polarity FROM ({views.fused_sql(True)})")
def fuse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(_edges(spark, sf_dir, True), "pmids", "engines")


_CONFLICTS = f"""
SELECT name_1, type_1, name_2, type_2, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM ({views.triples_sql()})
GROUP BY ALL HAVING bool_or(relation = 'IMPROVES') AND bool_or(relation = 'WORSENS')
"""


@query(_CONFLICTS)
def relation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(fusion.relation_conflicts(fusion.flat(views.scored(spark, sf_dir))), "relations")


@query(f"""
SELECT e.name_1, e.relation, e.name_2, evidence_count, CASE WHEN c.relations IS NULL THEN 'unreviewed' ELSE 'needs_review' END AS review_status,
       CASE WHEN c.relations IS NOT NULL THEN 'relation_polarity_conflict' END AS conflict_reason, c.relations AS conflict_relations
FROM ({views.fused_sql()}) e LEFT JOIN ({_CONFLICTS}) c USING (name_1, type_1, name_2, type_2)
""")
def fused_with_review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.with_review_status(_edges(spark, sf_dir, False))
    return _listed(out, "conflict_relations").select("name_1", "relation", "name_2", "evidence_count", "review_status", "conflict_reason", F.when(F.col("conflict_reason").isNotNull(), F.col("conflict_relations")).alias("conflict_relations"))


@query(f"""
SELECT c.name_1, c.name_2, r.relation, f.evidence_count, f.pmids FROM ({_CONFLICTS}) c
JOIN (SELECT DISTINCT name_1, name_2, relation FROM ({views.triples_sql()})) r USING (name_1, name_2)
LEFT JOIN ({views.fused_sql()}) f ON f.name_1 = c.name_1 AND f.name_2 = c.name_2 AND f.relation = r.relation
""")
def conflict_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir, False)
    return _listed(fusion.conflict_evidence(fusion.relation_conflicts(edges), edges), "pmids").select("name_1", "name_2", "relation", "evidence_count", "pmids")


def _ablation_sql(name: str, change: str) -> str:
    return f"""
    SELECT '{name}' AS condition, (SELECT count(*) FROM t{name}) AS records, (SELECT count(*) FROM (SELECT DISTINCT name_1, relation, name_2 FROM t{name})) AS edges,
      (SELECT count(*) FROM (SELECT 1 AS s, name_1 FROM t{name} UNION SELECT 2, name_2 FROM t{name})) AS nodes,
      (SELECT count(*) FROM (SELECT DISTINCT name_1, name_2 FROM t{name})) AS pairs, 0 AS self_loops,
      (SELECT count(*) FROM (SELECT name_1, name_2 FROM t{name} GROUP BY ALL HAVING bool_or(relation = 'IMPROVES') AND bool_or(relation = 'WORSENS'))) AS conflicts"""


@query(
    "WITH traw AS (" + views.triples_sql() + "), tdictionary AS (SELECT * REPLACE ('S' || (CAST(substr(name_1, 2) AS BIGINT) // 2) AS name_1) FROM traw), "
    "taligned AS (SELECT * REPLACE ('P' || (CAST(substr(name_2, 2) AS BIGINT) // 10) AS name_2) FROM tdictionary) "
    + " UNION ALL ".join(_ablation_sql(n, "") for n in ("raw", "dictionary", "aligned"))
)
def ablation_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fusion.flat(views.scored(spark, sf_dir))
    mapped = raw.withColumn("name_1", F.concat(F.lit("S"), F.floor(F.substring("name_1", 2, 20).cast("bigint") / 2).cast("string")))
    aligned = mapped.withColumn("name_2", F.concat(F.lit("P"), F.floor(F.substring("name_2", 2, 20).cast("bigint") / 10).cast("string")))
    return fusion.ablation({"raw": raw, "dictionary": mapped, "aligned": aligned})


# Records


@query(f"SELECT source_pmid, name_1, name_2, relation, seq, computed_confidence FROM ({views.scored_sql()})")
def raw_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scored(spark, sf_dir).select("source_pmid", F.col("entity_1.name").alias("name_1"), F.col("entity_2.name").alias("name_2"), "relation", "seq", "computed_confidence")


_RAW_RELATION = "CASE o_orderpriority WHEN '1-URGENT' THEN 'treated-with' WHEN '2-HIGH' THEN ' Co-occurs  with ' WHEN '3-MEDIUM' THEN 'improves' WHEN '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END"


@query(f"""
SELECT o_orderkey, k AS relation_key, coalesce(CASE WHEN k = 'TREATED_WITH' THEN 'TREATS' WHEN k IN ('CO_OCCURS_WITH', 'IMPROVES') THEN k END, '') AS relation,
       CASE WHEN k IN ('TREATED_WITH', 'IMPROVES') THEN 'positive' WHEN k = 'CO_OCCURS_WITH' THEN 'neutral' ELSE 'unknown' END AS polarity
FROM (SELECT o_orderkey, regexp_replace(regexp_replace(upper({_RAW_RELATION}), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS k FROM orders)
""")
def normalize_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(_RAW_RELATION)
    named = vocabulary.relation(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", vocabulary.relation_key(raw).alias("relation_key"), named.alias("relation"), vocabulary.polarity(named).alias("polarity"))


_RAW_TYPE = "CASE p_type WHEN 'ECONOMY' THEN 'Gene' WHEN 'SMALL' THEN ' proteins ' WHEN 'MEDIUM' THEN 'DRUG' WHEN 'PROMO' THEN 'Patient' WHEN 'STANDARD' THEN NULL ELSE 'mutation' END"


@query("""
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Gene' WHEN 'SMALL' THEN 'Protein' WHEN 'MEDIUM' THEN 'Drug' WHEN 'PROMO' THEN '' WHEN 'STANDARD' THEN '' ELSE 'Variant' END AS entity_type FROM part
""")
def normalize_entity_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", vocabulary.entity_type(F.expr(_RAW_TYPE)).alias("entity_type"))


def _event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_id").cast("string")).alias("source_pmid"),
        F.when(F.col("event_id") % 17 != 0, F.struct(F.concat(F.lit("  user   "), F.col("user_id").cast("string")).alias("name"), F.when(kind == "error", "Patient").otherwise("gene").alias("type"))).alias("entity_1"),
        F.when(kind == "click", "treated-with").when(kind == "view", "Improves").when(kind == "signup", "TREATS_MENTION").when(kind == "purchase", "binds to").otherwise("CAUSES").alias("relation"),
        F.struct(kind.alias("name"), F.lit("Disease").alias("type")).alias("entity_2"),
        F.get_json_object("props", "$.k").alias("evidence_text"),
        F.lit(None).cast("string").alias("llm_confidence"),
        F.lit("LLM_x").alias("extracted_by"),
    )


@query("""
WITH e AS (SELECT event_id, event_type, user_id, event_id % 11 = 0 AS no_id, event_id % 17 = 0 AS no_1, event_type = 'purchase' AS bad_relation, event_type = 'error' AS bad_type,
                  coalesce(trim(json_extract_string(props, '$.k')), '') = '' AS no_text FROM events)
SELECT event_id AS seq, concat_ws(',', CASE WHEN no_id THEN 'missing_source_pmid' END, CASE WHEN no_1 THEN 'entity_1_not_object' END,
         CASE WHEN NOT no_1 AND bad_type THEN 'entity_1.type_invalid' END, CASE WHEN bad_relation THEN 'relation_invalid' END, CASE WHEN no_text THEN 'evidence_text_empty' END) AS problems,
       CASE event_type WHEN 'click' THEN 'TREATS' WHEN 'view' THEN 'IMPROVES' WHEN 'signup' THEN 'TREATS' WHEN 'purchase' THEN '' ELSE 'CAUSES' END AS relation,
       CASE event_type WHEN 'click' THEN 'TREATED_WITH' WHEN 'signup' THEN 'TREATS_MENTION' END AS relation_original,
       CASE WHEN no_1 THEN '' ELSE 'user ' || user_id END AS name_1, CASE WHEN no_1 OR bad_type THEN '' ELSE 'Gene' END AS type_1
FROM e
""")
def reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.normalize(_event_records(spark, sf_dir))
    return _listed(out, "problems").select("seq", "problems", "relation", "relation_original", F.col("entity_1.name").alias("name_1"), F.col("entity_1.type").alias("type_1"))


@query(f"""
SELECT count(*) AS records, count(*) FILTER (extracted_by NOT LIKE 'LLM%') AS invalid, count(DISTINCT source_pmid) AS unique_pmids,
       count(*) - count(DISTINCT (source_pmid, lower(name_1), upper(relation), lower(name_2))) AS duplicates FROM ({views.scored_sql(True)})
""")
def stage_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.stage_validation(views.scored(spark, sf_dir, True), ("LLM",))


@query(f"SELECT extracted_by, count(*) AS records, count(DISTINCT source_pmid) AS pmids FROM ({views.triples_sql()}) GROUP BY 1")
def engine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.triples(spark, sf_dir).groupBy("extracted_by").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("source_pmid").alias("pmids"))


@query(f"""
WITH t AS (SELECT *, CASE WHEN extracted_by LIKE 'LLM%' THEN 0 ELSE 1 END AS stage FROM ({views.triples_sql(True)}))
SELECT source_pmid, name_1, relation, name_2, stage, seq FROM t
QUALIFY row_number() OVER (PARTITION BY source_pmid || '_' || lower(name_1) || '_' || upper(relation) || '_' || lower(name_2) ORDER BY stage, seq) = 1
""")
def merge_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.triples(spark, sf_dir, True)
    model = F.col("extracted_by").startswith("LLM")
    merged = records.merge_stages(rows.where(model), rows.where(~model), excluded=())
    return merged.select("source_pmid", F.col("entity_1.name").alias("name_1"), "relation", F.col("entity_2.name").alias("name_2"), "stage", "seq")


@query("""
SELECT part, chunk, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq
FROM (SELECT event_id + 1 AS seq, CASE WHEN event_id + 1 <= 3000 THEN 'llm' ELSE 'rule' END AS part, event_id // 250 AS chunk FROM events) GROUP BY ALL
""")
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"))
    parts = records.chunks(records.head_split(rows, 3000), 250)
    return parts.groupBy("part", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events) WHERE seq > 1000 AND seq <= 1500")
def offset_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.sources.records import numbered, slice_rows

    return slice_rows(numbered(table(spark, sf_dir, "events"), "ts", "event_id"), 1000, 500).select("event_id", "event_type")


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_existing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.unseen(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT event_id, coalesce(regexp_extract(props, '[012]', 0), '') AS digit, coalesce(TRY_CAST(regexp_extract(props, '[012]', 0) AS INTEGER), 0) AS grade, least(1.0::DOUBLE, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50) >= 0.75 AS accepted, round(least(1.0::DOUBLE, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50), 9) AS confidence FROM events")
def json_verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("```json\n{\"supported\": true, \"evidence_text\": \"x\", \"confidence\": "), (F.get_json_object("props", "$.k").cast("double") / 50).cast("string"), F.lit("}\n```"))
    v = text.verdict(reply)
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", "[012]", 0).alias("digit"), text.first_grade(F.col("props")).alias("grade"), text.accepted(v).alias("accepted"), F.bround(v["confidence"], 9).alias("confidence"))


@query("SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '1') || ',' || lpad(CAST(o_custkey AS VARCHAR), 8, '2') AS ids, 2 AS n FROM orders")
def pmid_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ids whose digits were parted by thousands separators, put together again."""
    digits = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 8, "1"), F.lpad(F.col("o_custkey").cast("string"), 8, "2"))
    broken = F.concat(F.substring(digits, 1, 1), *[F.concat(F.lit(","), F.substring(digits, i, 3)) for i in range(2, 17, 3)])
    ids = text.repaired_ids(broken)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(ids, ",").alias("ids"), F.size(ids).alias("n"))


# Identity and alignment

_DICTIONARY = "SELECT 'Gene' AS type, lower(n_name) AS alias, 'Nation ' || n_nationkey AS canonical FROM nation UNION ALL SELECT 'Disease', 'seg ' || n_nationkey, 'Segment type ' || (n_nationkey % 5) FROM nation"
_CITIZENS = """
SELECT c_custkey AS seq, upper(n_name) AS name_1, 'seg ' || c_nationkey AS name_2 FROM customer JOIN nation ON c_nationkey = n_nationkey
"""


def _citizens(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select(
        F.col("c_custkey").alias("seq"),
        F.col("c_custkey").cast("string").alias("source_pmid"),
        F.struct(F.upper("n_name").alias("name"), F.lit("Gene").alias("type")).alias("entity_1"),
        F.lit("ASSOCIATED_WITH").alias("relation"),
        F.struct(F.concat(F.lit("seg "), F.col("c_nationkey").cast("string")).alias("name"), F.lit("Disease").alias("type")).alias("entity_2"),
    )


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    genes = nation.select(F.lit("Gene").alias("type"), F.lower("n_name").alias("alias"), F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("canonical"))
    return genes.unionByName(nation.select(F.lit("Disease").alias("type"), F.concat(F.lit("seg "), F.col("n_nationkey").cast("string")).alias("alias"), F.concat(F.lit("Segment type "), (F.col("n_nationkey") % 5).cast("string")).alias("canonical")))


# A canonical name that adds a subtype is another identity, so the guard leaves every segment as it is.
@query(f"SELECT seq, 'Nation ' || n_nationkey AS name_1, name_2, true AS changed_1, false AS changed_2 FROM ({_CITIZENS}) JOIN nation ON upper(n_name) = name_1")
def dictionary_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.map_dictionary(_citizens(spark, sf_dir), _dictionary(spark, sf_dir))
    return out.select("seq", F.col("entity_1.name").alias("name_1"), F.col("entity_2.name").alias("name_2"), "changed_1", "changed_2")


@query("SELECT 'Gene' AS type, count(*) AS hits FROM customer UNION ALL SELECT 'Disease', 0")
def mapping_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.mapping_hits(alignment.map_dictionary(_citizens(spark, sf_dir), _dictionary(spark, sf_dir)))


# Names in three spellings: as they are, upper case, wide blanks.
_SPELLED = """
SELECT l_orderkey * 8 + l_linenumber AS seq, CAST(l_orderkey AS VARCHAR) AS source_pmid,
       CASE l_linenumber % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE replace(p_name, ' ', '  ') END AS name_1,
       'Supplier ' || (l_suppkey % 10) AS name_2 FROM lineitem JOIN part ON l_partkey = p_partkey
"""
_NAMES = f"SELECT 'Drug' AS type, name_1 AS name FROM ({_SPELLED}) UNION ALL SELECT 'Disease', name_2 FROM ({_SPELLED})"
_CANONICAL = f"""
SELECT type, name, n AS frequency, first_value(name) OVER (PARTITION BY type, regexp_replace(lower(name), '\\s+', ' ', 'g') ORDER BY n DESC, length(name), lower(name), name) AS canonical
FROM (SELECT type, name, count(*) AS n FROM ({_NAMES}) GROUP BY ALL)
"""


def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    way = F.col("l_linenumber") % 3
    name = F.when(way == 0, F.col("p_name")).when(way == 1, F.upper("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("  ")))
    return both.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.col("l_orderkey").cast("string").alias("source_pmid"),
        F.struct(name.alias("name"), F.lit("Drug").alias("type")).alias("entity_1"),
        F.struct(F.concat(F.lit("Supplier "), (F.col("l_suppkey") % 10).cast("string")).alias("name"), F.lit("Disease").alias("type")).alias("entity_2"),
    )


@query(f"SELECT type, name, count(*) AS frequency FROM ({_NAMES}) GROUP BY ALL")
def typed_name_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.name_frequency(_spelled(spark, sf_dir))


@query(_CANONICAL)
def alignment_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_map(_spelled(spark, sf_dir), exact=False)


@query(f"SELECT c.canonical AS name_1, s.name_2, count(*) AS n FROM ({_SPELLED}) s JOIN ({_CANONICAL}) c ON c.type = 'Drug' AND c.name = s.name_1 GROUP BY ALL")
def apply_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spelled(spark, sf_dir)
    out = alignment.apply_alignment(rows, alignment.alignment_map(rows, exact=False))
    return out.groupBy(F.col("entity_1.name").alias("name_1"), F.col("entity_2.name").alias("name_2")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT 'Drug' AS type, name_1 AS name_before, canonical AS name_after, count(DISTINCT o) AS records, count(DISTINCT source_pmid) AS pmids
FROM (SELECT o_orderkey AS o, CAST(o_custkey AS VARCHAR) AS source_pmid, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN lower(o_orderpriority) ELSE o_orderpriority || ' ' END AS name_1 FROM orders)
JOIN (SELECT name, first_value(name) OVER (PARTITION BY trim(lower(name)) ORDER BY n DESC, length(name), lower(name), name) AS canonical
      FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN lower(o_orderpriority) ELSE o_orderpriority || ' ' END AS name, count(*) AS n FROM orders GROUP BY ALL)) ON name = name_1
WHERE name_1 <> canonical GROUP BY ALL
""")
def alignment_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.col("o_orderkey") % 3
    name = F.when(way == 0, F.col("o_orderpriority")).when(way == 1, F.lower("o_orderpriority")).otherwise(F.concat("o_orderpriority", F.lit(" ")))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").cast("string").alias("source_pmid"),
        F.struct(name.alias("name"), F.lit("Drug").alias("type")).alias("entity_1"),
        F.struct(F.lit("x").alias("name"), F.lit("Disease").alias("type")).alias("entity_2"),
    )
    return alignment.alignment_changes(rows, alignment.apply_alignment(rows, alignment.alignment_map(rows, exact=False)))


@query("SELECT name, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM (SELECT 'K' || l_suppkey AS name, 'Drug' AS type FROM lineitem UNION ALL SELECT 'K' || l_partkey, 'Disease' FROM lineitem) GROUP BY 1 HAVING count(DISTINCT type) > 1")
def multi_type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    def entity(key: str, kind: str):
        return F.struct(F.concat(F.lit("K"), F.col(key).cast("string")).alias("name"), F.lit(kind).alias("type"))

    rows = table(spark, sf_dir, "lineitem").select(entity("l_suppkey", "Drug").alias("entity_1"), entity("l_partkey", "Disease").alias("entity_2"))
    return _listed(alignment.multi_type_names(rows), "types")


@query("""
SELECT 'supplier' AS kind, s_suppkey AS key, sha256('["literature","Drug","' || s_name || '"]') AS id, NULL AS reason FROM supplier
UNION ALL SELECT 'part', p_partkey, sha256('["external","Gene","' || p_name || '"]'), CASE WHEN p_partkey % 3 = 0 THEN 'different_authoritative_gene_ids' END FROM part
""")
def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), identity.entity_id(F.lit("literature"), F.lit("Drug"), F.col("s_name")).alias("id"), F.lit(None).cast("string").alias("reason"))
    other = F.when(F.col("p_partkey") % 3 == 0, "SMN2").otherwise("smn1")
    parts = table(spark, sf_dir, "part").select(F.lit("part"), F.col("p_partkey"), identity.entity_id(F.lit("external"), F.lit("Gene"), F.col("p_name")), identity.conflict(F.lit("Gene"), F.lit("SMN1"), other))
    return suppliers.unionAll(parts)


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, sha256('[\"v1\",\"literature\",\"S' || l_suppkey || '\",\"' || l_returnflag || '\",\"P' || l_partkey || '\"]') AS edge_key FROM lineitem")
def edge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", identity.edge_key(F.lit("v1"), F.lit("literature"), a, F.col("l_returnflag"), b).alias("edge_key"))


@query("""
WITH s AS (SELECT a.label, a.vec_id, b.vec_id AS candidate, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
           FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT label AS type, vec_id AS name, candidate, round(sim, 6) AS similarity FROM s WHERE sim >= 0.1
QUALIFY row_number() OVER (PARTITION BY label, vec_id ORDER BY sim DESC, candidate) = 1
""")
def cosine_best_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = alignment.best_neighbours(table(spark, sf_dir, "embeddings"), 0.1, "label", "vec_id", "embedding")
    return best.withColumn("similarity", F.bround("similarity", 6))


# Evaluation


@query(f"""
WITH mine AS (SELECT DISTINCT extracted_by, name_1, name_2 FROM ({views.triples_sql()})), truth AS (SELECT DISTINCT name_1, name_2 FROM ({views.triples_sql()}) WHERE relation = 'IMPROVES'),
c AS (SELECT extracted_by, count(*) AS extracted, (SELECT count(*) FROM truth) AS expected, count(t.name_1) AS true_positives FROM mine LEFT JOIN truth t USING (name_1, name_2) GROUP BY 1)
SELECT *, extracted - true_positives AS false_positives, expected - true_positives AS false_negatives, round(true_positives / extracted, 9) AS precision, round(true_positives / expected, 9) AS recall,
  round(2.0 * true_positives / (extracted + expected), 9) AS f1 FROM c
""")
def baseline_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.flat(views.scored(spark, sf_dir))
    truth = rows.where(F.col("relation") == "IMPROVES")
    out = evaluation.set_metrics(rows, truth, ["name_1", "name_2"], "extracted_by")
    return out.withColumns({c: F.bround(c, 9) for c in ("precision", "recall", "f1")})


@query(f"""
WITH t AS (SELECT *, name_1 AS gene FROM ({views.scored_sql()}) WHERE extracted_by LIKE '%LLM%' AND name_2 IN ('P1', 'P2', 'P3', 'P4', 'P5'))
SELECT min(name_1) AS "Novel_Gene", relation AS "Relation_Type", name_2 AS "Context_Entity", string_agg(DISTINCT source_pmid, ', ' ORDER BY source_pmid) AS "Evidence_PMIDs",
  count(DISTINCT source_pmid) AS "Number_of_Mentions", round(avg(computed_confidence), 4) AS "Confidence_Score"
FROM t WHERE name_1 NOT IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal >= 5000) GROUP BY name_1, relation, name_2
""")
def novelty_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.scored(spark, sf_dir).withColumn("entity_1", F.struct(F.col("entity_1.name").alias("name"), F.lit("Gene").alias("type")))
    known = table(spark, sf_dir, "supplier").where("s_acctbal >= 5000").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("gene"))
    return evaluation.novelty(rows, known, ["p1", "p2", "p3", "p4", "p5"])


@query()
def fuzzy_baseline_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type")
    baseline = parts.where(F.col("p_type") == "PROMO").select(F.concat("p_name", F.lit("s")).alias("truth")).distinct()
    return evaluation.fuzzy_set_metrics(parts, baseline, "p_name", "truth", "p_brand")


_COUNTS = "count(*) AS n, count(DISTINCT source_pmid) AS unique_pmids, count(*) FILTER (support_label = '2') AS label_2, count(*) FILTER (support_label = '1') AS label_1, count(*) FILTER (support_label = '0') AS label_0, count(*) FILTER (support_label = 'U') AS \"label_U\""
_Z = "1.959963984540054::DOUBLE"


def _wilson_sql(k: str, n: str) -> str:
    center, radius, scale = f"({k}/{n} + {_Z}*{_Z}/({n}*2))", f"{_Z}*sqrt(({k}/{n})*(1-{k}/{n})/{n} + {_Z}*{_Z}/({n}*{n}*4))", f"(1+{_Z}*{_Z}/{n})"
    return f"round(greatest(0, {center}/{scale} - {radius}/{scale}), 9) AS wilson_low, round(least(1, {center}/{scale} + {radius}/{scale}), 9) AS wilson_high"


@query(f"""
WITH c AS (SELECT sample_group, {_COUNTS} FROM ({views.REVIEWS_SQL}) GROUP BY 1), r AS (SELECT *, (n - "label_U")::DOUBLE AS res FROM c)
SELECT * EXCLUDE (res), round(label_2 / res, 9) AS strict_support, round((label_2 + label_1) / res, 9) AS lenient_support, round("label_U" / n, 9) AS unknown_fraction,
  round(label_2 / n, 9) AS strict_low, round((label_2 + "label_U") / n, 9) AS strict_high, {_wilson_sql("label_2", "res")} FROM r
""")
def support_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.support_statistics(views.reviews(spark, sf_dir), "sample_group")
    rates = ("strict_support", "lenient_support", "unknown_fraction", "strict_low", "strict_high", "wilson_low", "wilson_high")
    return out.withColumns({c: F.bround(c, 9) for c in rates})


@query(f"""
WITH r AS ({views.REVIEWS_SQL}), g AS (SELECT *, 'nonempty' AS gate, n_chars > 0 AS keep FROM r UNION ALL SELECT *, 'long', n_chars >= 1500 FROM r),
a AS (SELECT gate, sample_group, 'all' AS split, keep, span_label, support_label FROM g UNION ALL SELECT gate, sample_group, split, keep, span_label, support_label FROM g),
c AS (SELECT gate, sample_group, split, count(*) AS n, count(*) FILTER (span_label = 'yes' AND keep) AS tp, count(*) FILTER (span_label = 'no' AND keep) AS fp, count(*) FILTER (span_label = 'no' AND NOT keep) AS tn,
  count(*) FILTER (span_label = 'yes' AND NOT keep) AS fn, count(*) FILTER (keep) AS retained, count(*) FILTER (keep AND support_label <> 'U') AS resolved, count(*) FILTER (keep AND support_label = '2') AS strict FROM a GROUP BY ALL)
SELECT gate, sample_group, split, n, tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 9) AS ppv, round(tp / nullif(tp + fn, 0), 9) AS sensitivity, round(tn / nullif(tn + fp, 0), 9) AS specificity,
  retained, round(retained / n, 9) AS retention, round(strict / nullif(resolved, 0), 9) AS strict_among_retained FROM c
""")
def gate_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.gate_confusion(views.reviews(spark, sf_dir), {"nonempty": F.col("n_chars") > 0, "long": F.col("n_chars") >= 1500}, "sample_group", "split")
    return out.withColumns({c: F.bround(c, 9) for c in ("ppv", "sensitivity", "specificity", "retention", "strict_among_retained")})


_POISSON = " + ".join(f"CASE WHEN u > {t}::DOUBLE THEN 1 ELSE 0 END" for t in [sum(0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800, 39916800)[: k + 1]) for k in range(12)])


@query(f"""
WITH s AS (SELECT source_pmid AS c, count(*) AS n, count(*) FILTER (support_label = '2') AS k FROM ({views.REVIEWS_SQL}) GROUP BY 1),
d AS (SELECT r, n, k, CAST(('0x' || substr(md5('7:' || r || ':' || c), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM s, range(400) t(r)),
x AS (SELECT r, sum(({_POISSON}) * k) / nullif(sum(({_POISSON}) * n), 0) AS share FROM d GROUP BY r), l AS (SELECT list_sort(list(share)) AS s FROM x WHERE share IS NOT NULL)
SELECT round(s[CAST(floor(0.025::DOUBLE * (len(s) - 1)) AS BIGINT) + 1], 9) AS low, round(s[CAST(floor(0.975::DOUBLE * (len(s) - 1)) AS BIGINT) + 1], 9) AS high FROM l
""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.cluster_bootstrap(views.reviews(spark, sf_dir), "source_pmid", F.col("support_label") == "2", 400, 7)
    return out.select(F.bround("low", 9).alias("low"), F.bround("high", 9).alias("high"))


@query("""
WITH t AS (SELECT quality::VARCHAR AS a, (1 - toxic)::VARCHAR AS b FROM labels), n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b) AS same FROM t),
m AS (SELECT sum(x.c * y.c) AS lr FROM (SELECT a, count(*) AS c FROM t GROUP BY 1) x JOIN (SELECT b, count(*) AS c FROM t GROUP BY 1) y ON a = b)
SELECT CAST(n AS BIGINT) AS pairs, round(same / n, 9) AS raw_agreement, round((same / n - lr / (n * n)) / (1 - lr / (n * n)), 9) AS cohen_kappa FROM n, m
""")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.cohen_kappa(table(spark, sf_dir, "labels").withColumn("b", F.lit(1) - F.col("toxic")), "quality", "b")
    return out.withColumns({c: F.bround(c, 9) for c in ("raw_agreement", "cohen_kappa")})


@query("SELECT toxic AS grp, count(*) AS n, round(avg(CASE WHEN g = 2 THEN 1.0 ELSE 0 END), 9) AS strict, round(avg(CASE WHEN g >= 1 THEN 1.0 ELSE 0 END), 9) AS lenient, round(avg(g), 9) AS mean FROM (SELECT toxic, quality * 2 - doc_id % 2 * quality AS g FROM labels) GROUP BY 1")
def graded_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = table(spark, sf_dir, "labels").select(F.col("toxic").alias("grp"), (F.col("quality") * 2 - F.col("doc_id") % 2 * F.col("quality")).alias("g"))
    return evaluation.graded_accuracy(graded, "g", "grp").withColumns({c: F.bround(c, 9) for c in ("strict", "lenient", "mean")})


_REVIEW_ROWS = """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'primary_random' ELSE 'challenge' END AS sample_group, CASE WHEN quality = 1 AND toxic = 0 THEN '2' ELSE '0' END AS label, doc_id % 2 = 0 OR doc_id % 9 <> 0 AS done FROM labels
"""


@query(f"""
WITH c AS (SELECT sample_group, count(*) AS sample_count, count(*) FILTER (done) AS final_count, count(*) FILTER (done AND label = '2') AS final_2, 0 AS final_1, count(*) FILTER (done AND label = '0') AS final_0, 0 AS "final_U" FROM ({_REVIEW_ROWS}) GROUP BY 1)
SELECT *, sample_count = final_count AS ready, CASE WHEN sample_count = final_count THEN round(final_2 / (final_0 + final_2), 9) END AS strict_rate, CASE WHEN sample_count = final_count THEN round(final_2 / (final_0 + final_2), 9) END AS lenient_rate FROM c
""")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    even = F.col("doc_id") % 2 == 0
    done = even | (F.col("doc_id") % 9 != 0)
    blank = {c: F.lit("") for c in ("second_support_label", "adjudicated_label", "second_reviewer_id", "second_review_date", "adjudication_notes")}
    rows = labels.withColumns(
        {
            "sample_group": F.when(even, "primary_random").otherwise("challenge"),
            "support_label": F.when(done, F.when(good, "2").otherwise("0")).otherwise(""),
            "review_status": F.when(done, "completed").otherwise("pending_review"),
            "requires_second_review": F.lit("no"),
            "reviewer_id": F.lit("r1"),
            "review_date": F.lit("2026-01-01"),
            "error_type": F.lit("none"),
            "review_notes": F.lit("note"),
            **{c: F.lit("yes") for c in evaluation.CHECKS},
            **blank,
        }
    )
    out = evaluation.review_summary(rows)
    return out.select("sample_group", "sample_count", "final_count", "final_2", "final_1", "final_0", "final_U", "ready", F.bround("strict_rate", 9).alias("strict_rate"), F.bround("lenient_rate", 9).alias("lenient_rate"))


@query("""
SELECT count(*) AS queued, count(*) AS reviewed, count(*) FILTER (quality = 1) AS correct, 0 AS problems, round(count(*) FILTER (quality = 1) / count(*), 9) AS accuracy FROM labels
""")
def mapping_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_id"), F.when(F.col("quality") == 1, "correct").otherwise("incorrect").alias("judgment"))
    out = evaluation.mapping_accuracy(labels, labels, "judgment")
    return out.select("queued", "reviewed", "correct", "problems", F.bround("accuracy", 9).alias("accuracy"))


# Sampling

_PRIORITY = ["o_orderpriority", "o_orderstatus"]


@query("""
SELECT o_orderkey, o_orderpriority, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
ORDER BY rn, o_orderpriority, o_orderstatus LIMIT 400
""")
def stratified_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.round_robin(table(spark, sf_dir, "orders"), _PRIORITY, [F.desc("o_totalprice"), F.col("o_orderkey")], 400)
    return out.select("o_orderkey", *_PRIORITY)


_CANDIDATES = f"SELECT name_1, name_2, relation, max(computed_confidence) AS computed_confidence FROM ({views.scored_sql()}) GROUP BY ALL"


@query(f"""
WITH c AS ({_CANDIDATES}), p AS (SELECT * FROM c ORDER BY md5('42:' || name_1 || ':' || name_2 || ':' || relation), name_1, name_2, relation LIMIT 150),
r AS (SELECT * FROM c WHERE (name_1, name_2, relation) NOT IN (SELECT (name_1, name_2, relation) FROM p)), z AS (SELECT relation, count(*) AS size FROM c GROUP BY 1),
h AS (SELECT r.*, size, row_number() OVER (PARTITION BY relation ORDER BY computed_confidence >= 0.9, ends_with(name_2, '7'), computed_confidence, md5('43:' || name_1 || ':' || name_2 || ':' || relation)) AS rn FROM r JOIN z USING (relation)),
b AS (SELECT name_1, name_2, relation, 'primary_random' AS sample_group FROM p UNION ALL SELECT name_1, name_2, relation, 'challenge' FROM (SELECT * FROM h ORDER BY rn, size, relation LIMIT 50))
SELECT *, row_number() OVER (ORDER BY md5('44:' || name_1 || ':' || name_2 || ':' || relation), name_1, name_2, relation) <= 40 AS requires_second_review FROM b
""")
def challenge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["name_1", "name_2", "relation"]
    candidates = fusion.flat(views.scored(spark, sf_dir)).groupBy(*keys).agg(F.max("computed_confidence").alias("computed_confidence"))
    return sampling.challenge(candidates, 200, 150, 42, keys, F.col("name_2").endswith("7")).select(*keys, "sample_group", "requires_second_review")


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform(table(spark, sf_dir, "documents"), 100, 42, "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, CASE WHEN CAST(('0x' || substr(sha256('20261002:' || doc_id), 1, 8)) AS BIGINT) % 10 < 3 THEN 'development' ELSE 'test' END AS split FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.hash_split(F.col("doc_id").cast("string")).alias("split"))


@query("SELECT source AS source, count(DISTINCT CASE WHEN CAST(('0x' || substr(sha256('20261002:' || doc_id), 1, 8)) AS BIGINT) % 10 < 3 THEN 'development' ELSE 'test' END) AS sides FROM documents GROUP BY 1 HAVING sides > 1")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("split", text.hash_split(F.col("doc_id").cast("string")))
    return checks.leakage(rows, "source")


# Text and evidence

_SENTENCES = r"""SELECT doc_id, trim(regexp_replace(unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))), '\s+', ' ', 'g')) AS sentence FROM documents"""


@query(f"SELECT doc_id, count(*) AS n, sum(length(sentence))::BIGINT AS chars, min(sentence) AS first_sentence FROM ({_SENTENCES}) WHERE sentence <> '' GROUP BY 1")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("sentence"))
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("chars"), F.min("sentence").alias("first_sentence"))


_DRUG = (("erth", "Erth"), ("thand", "Thand"), ("einer", "Thand"))
_GENE = (("ofth", "OFTH"), ("la", "LA"))
_ILL = (("the", "The Condition"), ("de", "Condition De"))
_SIGN = (("was", "was"), ("que", "que"))


def _term_sql(terms) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN '{n}' END" for t, n in terms) + "], lambda x: x IS NOT NULL)"


@query(f"""
WITH s AS (SELECT doc_id, sentence, lower(sentence) AS low FROM ({_SENTENCES}) WHERE sentence <> '' AND NOT regexp_matches(sentence, '(^| )not( |$)')),
t AS (SELECT *, {_term_sql(_DRUG)} AS d, {_term_sql(_GENE)} AS g, ({_term_sql(_ILL)})[1] AS i, {_term_sql(_SIGN)} AS p FROM s),
r AS (SELECT doc_id, sentence, unnest(d) AS e1, 'TREATS' AS relation, i AS e2 FROM t WHERE i IS NOT NULL AND regexp_matches(sentence, 'in')
  UNION ALL SELECT doc_id, sentence, e1, 'IMPROVES', unnest(p) FROM (SELECT doc_id, sentence, unnest(d) AS e1, p FROM t WHERE regexp_matches(sentence, 'on'))
  UNION ALL SELECT doc_id, sentence, unnest(g), 'ASSOCIATED_WITH', i FROM t WHERE i IS NOT NULL AND regexp_matches(sentence, 're'))
SELECT CAST(doc_id AS VARCHAR) AS source_pmid, e1, relation, e2, count(*) AS n FROM r GROUP BY ALL
""")
def rule_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("pmid"), F.col("text").alias("abstract"))
    found = evidence.rule_triples(docs, _DRUG, _GENE, _ILL, _SIGN, treat="in", improve="on", associate="re", negation="(^| )not( |$)")
    return found.groupBy("source_pmid", F.col("entity_1.name").alias("e1"), "relation", F.col("entity_2.name").alias("e2")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, item_id, position(b.text IN d.text) - 1 AS start FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def locate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as quotes, every document as a source."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return evidence.quote_places(table(spark, sf_dir, "documents"), items, "doc_id", "item_id")


@query(rf"""
WITH q AS (SELECT *, trim(coalesce(evidence_text, '')) AS quote FROM ({views.QUOTES_SQL}))
SELECT seq, CASE WHEN NOT has_source THEN 'missing_source' WHEN quote = '' THEN 'missing_evidence' WHEN contains(abstract, quote) THEN 'exact'
  WHEN contains(trim(regexp_replace(lower(abstract), '[\s\x0B]+', ' ', 'g')), trim(regexp_replace(lower(quote), '[\s\x0B]+', ' ', 'g'))) THEN 'case_whitespace_match' ELSE 'not_located' END AS status,
  quote <> '' AND contains(lower(' ' || coalesce(abstract, '')), lower(quote)) AS joined_match
FROM q
""")
def locate_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.quotes(spark, sf_dir)
    return q.select("seq", evidence.location_simple(F.col("evidence_text"), F.col("title"), F.col("abstract"), F.col("has_source")).alias("status"), evidence.exact_in_joined(F.col("evidence_text"), F.col("title"), F.col("abstract")).alias("joined_match"))


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores before work in Python that costs far more than moving them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq")


@query()
def locate_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.locate(_spread(views.quotes(spark, sf_dir)))
    close = F.col("location.suggestion")
    return found.select("seq", "location.status", F.size("location.segments").alias("segments"), F.get("location.segments", F.lit(0))["start"].alias("start"), F.bround(close["similarity"], 4).alias("similarity"), close["start"].alias("suggested_start"))


@query()
def fuzzy_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sentences of passages, misquoted, against the documents that hold them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    held = docs.join(locate_exact(spark, sf_dir), "doc_id").join(items, "item_id")
    rows = held.select(
        (F.col("doc_id") * 1000 + F.col("item_id") % 1000).alias("seq"),
        F.lit("").alias("title"),
        F.col("text").alias("abstract"),
        F.lit(True).alias("has_source"),
        F.concat(F.split_part("quote", F.lit("."), F.lit(1)), F.lit(" or so")).alias("evidence_text"),
    )
    return evidence.locate(_spread(rows)).select("seq", "location.status", F.bround("location.suggestion.similarity", 4).alias("similarity"))


@query()
def evidence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.validate(_spread(views.quotes(spark, sf_dir)))
    return out.select("seq", "status", F.array_join("flags", ",").alias("flags"), "traceable", "eligible", F.col("suggestion.start").alias("suggested_start"))


@query()
def assertion_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.screen(_spread(views.quotes(spark, sf_dir)))
    return out.select("seq", "status", F.array_join("flags", ",").alias("flags"), F.size("contexts").alias("contexts"), "review_status")


@query("SELECT flag, count(*) AS n FROM (SELECT unnest([CASE WHEN length(text) < 400 THEN 'short' END, CASE WHEN contains(text, chr(10)) THEN 'lines' END, CASE WHEN lang <> 'en' THEN 'foreign' END]) AS flag FROM documents) WHERE flag IS NOT NULL GROUP BY 1")
def flag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array_compact(F.array(F.when(F.length("text") < 400, "short"), F.when(F.contains("text", F.lit("\n")), "lines"), F.when(F.col("lang") != "en", "foreign")))
    return evidence.flag_histogram(table(spark, sf_dir, "documents").select(flags.alias("flags")))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.white_space_tokens(F.col("text")).alias("tokens"))


# Topics


@query("SELECT label AS topic, count(*) AS count FROM embeddings WHERE label <> -1 GROUP BY 1 HAVING count(*) >= 20")
def topic_counts_rare_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.rare_first(table(spark, sf_dir, "embeddings").withColumnRenamed("label", "topic"), least=20)


@query("""
SELECT p_brand, '("part") AND (' || string_agg('"' || p_name || '"', ' OR ' ORDER BY n DESC, p_name) || ')' AS query
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS rn FROM (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL)) WHERE rn <= 5 GROUP BY 1
""")
def topic_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_name"))).where("rank <= 5")
    terms = ranked.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("rank", "p_name"))).alias("t"))
    return terms.select("p_brand", topics.boolean_query(F.col("t.p_name"), 5, "part").alias("query"))


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: length(x) >= 2) AS w FROM documents),
g AS (SELECT doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w),
t AS (SELECT DISTINCT doc_id, unnest(g) AS term FROM g)
SELECT term, count(*) AS documents FROM t GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.85 * (SELECT count(*) FROM documents)
""")
def ngram_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.term_frequencies(table(spark, sf_dir, "documents"), "text", 2, 5, 0.85)


@query("""
WITH c AS (SELECT p_brand AS topic, unnest(string_split(p_name, ' ')) AS term FROM part), n AS (SELECT topic, term, count(*) AS n FROM c GROUP BY ALL),
a AS (SELECT term, sum(n) AS a FROM n GROUP BY 1), b AS (SELECT topic, sum(n) AS b FROM n GROUP BY 1), s AS (SELECT n.*, n / b * ln(1 + (SELECT avg(b) FROM b) / a) AS w FROM n JOIN a USING (term) JOIN b USING (topic))
SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY round(w, 9) DESC, term) AS rank, term, round(w, 9) AS weight FROM s QUALIFY rank <= 15
""")
def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = topics.class_terms(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "topic"), "topic", "p_name")
    return out.withColumn("weight", F.bround("weight", 9))


@query()
def vector_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.vector_topics(table(spark, sf_dir, "embeddings"), "embedding", 10).select("vec_id", "topic")


# Graph


@query(f"SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ({views.EDGES_SQL}) UNION ALL SELECT dst FROM ({views.EDGES_SQL})) GROUP BY 1")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(views.part_graph(spark, sf_dir)[1])


@query(f"SELECT src, dst, key, weight FROM ({views.EDGES_SQL}) WHERE src = dst")
def self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.self_loops(views.part_graph(spark, sf_dir)[1])


@query("SELECT o_custkey AS id FROM orders WHERE false UNION SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst"))
    return graph.isolates(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), edges)


@query(f"""
WITH e AS ({views.EDGES_SQL}), n AS ({views.NODES_SQL}), i AS (SELECT count(*) AS isolated FROM n WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e))
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, round(2.0 * (SELECT count(*) FROM e) / (SELECT count(*) FROM n), 9) AS average_degree, isolated, round(isolated / (SELECT count(*) FROM n), 9) AS isolated_ratio FROM i
""")
def topology_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.topology(*views.part_graph(spark, sf_dir)).withColumns({c: F.bround(c, 9) for c in ("average_degree", "isolated_ratio")})


_CHAIN = "SELECT p_partkey AS src, lead(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS dst FROM part"


def _chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    edges = part.select(F.col("p_partkey").alias("src"), F.lead("p_partkey").over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")).alias("dst")).where("dst IS NOT NULL")
    return part.select(F.col("p_partkey").alias("id")), edges


@query(f"""
WITH RECURSIVE e AS (SELECT src, dst FROM ({_CHAIN}) WHERE dst IS NOT NULL UNION SELECT dst, src FROM ({_CHAIN}) WHERE dst IS NOT NULL),
r AS (SELECT p_partkey AS id, p_partkey AS m FROM part UNION SELECT e.dst, r.m FROM r JOIN e ON r.id = e.src) SELECT id, min(m) AS component FROM r GROUP BY 1
""")
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.weak_components(*_chains(spark, sf_dir))


@query(f"""
WITH RECURSIVE e AS (SELECT src, dst FROM ({_CHAIN}) WHERE dst IS NOT NULL), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r AS (SELECT p_partkey AS id, p_partkey AS m FROM part UNION SELECT u.dst, r.m FROM r JOIN u ON r.id = u.src), c AS (SELECT id, min(m) AS m FROM r GROUP BY 1), s AS (SELECT m, count(*) AS n FROM c GROUP BY 1)
SELECT sum(n)::BIGINT AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e) AS pairs, count(*) AS components, max(n) AS largest, round(1 - max(n) / sum(n), 9) AS outside_largest, 0 AS self_loops FROM s
""")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_summary(*_chains(spark, sf_dir)).withColumn("outside_largest", F.bround("outside_largest", 9))


def _pagerank_sql(rounds: int) -> str:
    sql = f"""WITH e AS (SELECT src, dst, sum(weight) AS w FROM ({views.GEO_SQL}) GROUP BY ALL), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), n AS (SELECT count(*)::DOUBLE AS n FROM v),
    o AS (SELECT src, sum(w) AS o FROM e GROUP BY 1), r0 AS (SELECT id, 1 / n AS r FROM v, n)"""
    for k in range(rounds):
        sql += f""", r{k + 1} AS (SELECT v.id, 0.15::DOUBLE / n + 0.85::DOUBLE * ((SELECT coalesce(sum(r), 0) FROM r{k} WHERE id NOT IN (SELECT src FROM o)) / n + coalesce(c.c, 0)) AS r
        FROM n, v LEFT JOIN (SELECT e.dst, sum(p.r * e.w / o.o) AS c FROM e JOIN o USING (src) JOIN r{k} p ON p.id = e.src GROUP BY 1) c ON c.dst = v.id)"""
    return sql + f" SELECT id, round(r, 9) AS rank FROM r{rounds}"


@query(_pagerank_sql(8))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(*views.geo_graph(spark, sf_dir), tolerance=0.0, most_rounds=8).select("id", F.bround("rank", 9).alias("rank"))


@query()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.communities(*views.geo_graph(spark, sf_dir))


@query(f"""
WITH e AS (SELECT DISTINCT src, dst FROM ({views.GEO_SQL}) UNION SELECT dst, src FROM ({views.GEO_SQL})), h AS (SELECT 's1' AS id, 0 AS hop UNION ALL SELECT dst, 1 FROM e WHERE src = 's1' UNION ALL SELECT b.dst, 2 FROM e a JOIN e b ON a.dst = b.src WHERE a.src = 's1')
SELECT id, min(hop) AS hop FROM h GROUP BY 1
""")
def neighbourhood_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = views.geo_graph(spark, sf_dir)[1]
    return graph.neighbourhood(edges, spark.createDataFrame([("s1",)], "id string"))


@query(f"SELECT DISTINCT unnest([src, dst]) AS id FROM ({views.EDGES_SQL}) WHERE key IN ('R') AND weight >= 49")
def selected_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.select_by_property(views.part_graph(spark, sf_dir)[1].where("weight >= 49"), "key", ["R"])


@query(f"""
SELECT a.src, a.dst, a.key, max(a.weight) AS weight FROM ({views.EDGES_SQL}) a WHERE a.key = 'A' GROUP BY ALL
""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel records of one (source, target, key), the last by weight standing for all."""
    edges = views.part_graph(spark, sf_dir)[1].where("key = 'A'")
    return edges.groupBy("src", "dst", "key").agg(F.max_by("weight", "weight").alias("weight"))


# Checks and versions


@query(f"""
SELECT name_1, relation, name_2, CASE WHEN CAST(substr(name_1, 2) AS BIGINT) % 2 = 0 THEN 'count_differs' ELSE 'records_without_edge' END AS problem
FROM (SELECT DISTINCT name_1, relation, name_2 FROM ({views.triples_sql(True)})) WHERE CAST(substr(name_1, 2) AS BIGINT) % 10 IN (0, 5)
""")
def provenance_join_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check must find the edges that were tampered with here, and no others."""
    rows = fusion.flat(views.scored(spark, sf_dir, True))
    number = F.substring("name_1", 2, 20).cast("bigint")
    edges = fusion.fuse(rows).where(number % 10 != 5).withColumn("evidence_count", F.col("evidence_count") + F.when(number % 10 == 0, 1).otherwise(0))
    return checks.provenance(edges, rows, fusion.EDGE).select("name_1", "relation", "name_2", "problem")


@query("""
WITH a AS (SELECT p_partkey, p_name FROM part), b AS (SELECT p_partkey, CASE WHEN p_partkey % 100 = 7 THEN upper(p_name) ELSE p_name END AS p_name FROM part WHERE p_partkey % 250 <> 3)
SELECT *, 'expected_only' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'stored_only' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
""")
def reconcile_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    b = a.where("p_partkey % 250 <> 3").withColumn("p_name", F.when(F.col("p_partkey") % 100 == 7, F.upper("p_name")).otherwise(F.col("p_name")))
    return checks.reconcile(a, b)


@query("SELECT c_custkey AS seq, CASE WHEN c_custkey % 50 = 1 THEN 'right_missing' ELSE 'differs' END AS problem FROM customer WHERE c_custkey % 50 IN (1, 2)")
def aligned_rows_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), "c_name")
    right = left.where("seq % 50 <> 1").withColumn("c_name", F.when(F.col("seq") % 50 == 2, F.lit("x")).otherwise(F.col("c_name")))
    return checks.aligned_rows(left, right, ["c_name"])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'lost_id' ELSE 'changed' END AS problem FROM supplier WHERE s_suppkey % 9 IN (0, 1)")
def protected_columns_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    frozen = table(spark, sf_dir, "supplier")
    rows = frozen.where("s_suppkey % 9 <> 0").withColumn("s_name", F.when(F.col("s_suppkey") % 9 == 1, F.lit("x")).otherwise(F.col("s_name")))
    return checks.protected_columns(rows, frozen, "s_suppkey", ["s_name", "s_nationkey"])


@query("SELECT p_name AS p_name, count(DISTINCT (p_brand, p_type)) AS payloads FROM part GROUP BY 1 HAVING count(DISTINCT (p_brand, p_type)) > 1")
def conflicting_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.conflicting_payloads(table(spark, sf_dir, "part"), "p_name", ["p_brand", "p_type"])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'new' ELSE s_name END AS s_name FROM supplier UNION ALL SELECT 1000000 + n_nationkey, n_name FROM nation")
def versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.sources.sinks import upsert

    current = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    changes = current.where("s_suppkey % 4 = 0").withColumn("s_name", F.lit("new")).unionByName(table(spark, sf_dir, "nation").select((F.lit(1000000) + F.col("n_nationkey")).cast("bigint").alias("s_suppkey"), F.col("n_name").alias("s_name")))
    return upsert(current, changes, ["s_suppkey"])


@query("SELECT key AS source, count(*) AS edges, count(*) FILTER (weight > 45) AS needs_review, count(*) FILTER (dst IS NULL) AS without_ids FROM (" + views.EDGES_SQL + ") GROUP BY 1")
def edge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = views.part_graph(spark, sf_dir)[1]
    return edges.groupBy(F.col("key").alias("source")).agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.expr("weight > 45")).alias("needs_review"), F.count_if(F.expr("dst IS NULL")).alias("without_ids"))


# Extensions: streaming forms, here on their batch equivalents


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.bround("total", 4))


@query("""
WITH s AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM g GROUP BY user_id, k
""")
def ext_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"))
