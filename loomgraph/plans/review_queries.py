"""Review rows, records out of them, records with their sources, edges in their order, and nodes put into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import evidence, fusion, records, sampling, versions
from loomgraph.plans import views
from loomgraph.plans.registry import query, table

_FLAT = ("source_pmid", "entity_1_name", "entity_1_type", "relation", "entity_2_name", "entity_2_type", "evidence_text")


@query(f"""
SELECT printf('SMA-RE-%04d', row_number() OVER (ORDER BY seq, name_1, name_2, relation, computed_confidence, extracted_by)) AS candidate_id, CASE relation WHEN 'IMPROVES' THEN 'challenge' ELSE 'primary' END AS sample_group, CASE WHEN seq % 5 = 0 THEN 'yes' ELSE 'no' END AS requires_second_review,
  source_pmid, name_1 AS entity_1_name, type_1 AS entity_1_type, relation, name_2 AS entity_2_name, type_2 AS entity_2_type, evidence_text, computed_confidence, extracted_by, 'pending_review' AS review_status, '' AS support_label
FROM ({views.scored_sql()})
""")
def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records as rows of a review sheet."""
    rows = views.scored(spark, sf_dir).withColumns({"sample_group": F.when(F.col("relation") == "IMPROVES", "challenge").otherwise("primary"), "requires_second_review": F.col("seq") % 5 == 0, "place": F.col("seq"), "n1": F.col("entity_1.name"), "n2": F.col("entity_2.name")})
    sheet = sampling.review_rows(rows, "place", "n1", "n2", "relation", "computed_confidence", "extracted_by")
    return sheet.select("candidate_id", "sample_group", "requires_second_review", *_FLAT, "computed_confidence", "extracted_by", "review_status", "support_label")


@query(f"""
SELECT source_pmid, evidence_text, relation, '{{"name":"' || name_1 || '","type":"' || type_1 || '"}}' AS entity_1, '{{"name":"' || name_2 || '","type":"' || type_2 || '"}}' AS entity_2 FROM ({views.triples_sql()})
""")
def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat review rows as records, their entities as JSON."""
    flat = views.triples(spark, sf_dir).select(*[F.col(c.replace("_name", ".name").replace("_type", ".type")).alias(c) for c in _FLAT])
    return records.nested(flat).withColumns({e: F.to_json(e) for e in ("entity_1", "entity_2")})


@query("""
SELECT l.doc_id AS seq, CAST(l.doc_id * 2 AS VARCHAR) AS source_pmid, d.source AS title, length(d.text) AS abstract_chars, d.doc_id IS NOT NULL AS has_source
FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 <> 0) d ON d.doc_id = l.doc_id * 2
""")
def joined_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled ids as records, two thirds of the documents as sources, so that many records have none."""
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), (F.col("doc_id") * 2).cast("string").alias("source_pmid"))
    sources = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("pmid"), F.col("source").alias("title"), F.col("text").alias("abstract"))
    return evidence.join_sources(rows, sources).select("seq", "source_pmid", "title", F.length("abstract").cast("long").alias("abstract_chars"), "has_source")


@query(f"""
SELECT row_number() OVER (ORDER BY lower(name_1), lower(type_1), lower(relation), lower(name_2), lower(type_2), first_seq) AS place, name_1, relation, name_2, first_seq
FROM ({views.fused_sql(True)}) QUALIFY place <= 500
""")
def edges_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 fused edges of the report's order, with their places."""
    edges = fusion.fuse(fusion.flat(views.scored(spark, sf_dir, True)), digits=9)
    top = fusion.in_order(edges).limit(500).withColumn("place", F.monotonically_increasing_id() + 1)  # one partition, sorted
    return top.select("place", "name_1", "relation", "name_2", "first_seq")


@query("""
WITH c AS (SELECT 'e' || p_partkey AS entity_key, arg_max(p_name || ' v' || v, v) AS name FROM (SELECT *, unnest([1, 2]) AS v FROM (SELECT p_partkey * 2 AS p_partkey, p_name FROM part WHERE p_partkey % 3 = 0)) GROUP BY 1)
SELECT 'e' || p_partkey AS entity_key, p_name AS name, 'current' AS origin FROM part WHERE 'e' || p_partkey NOT IN (SELECT entity_key FROM c) UNION ALL SELECT entity_key, name, 'changed' FROM c
""")
def upserted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of parts with changes put in, some of them new, each twice: the greater row counts."""
    key = lambda c: F.concat(F.lit("e"), c.cast("string")).alias("entity_key")
    parts = table(spark, sf_dir, "part")
    current = parts.select(key(F.col("p_partkey")), F.col("p_name").alias("name"), F.lit("current").alias("origin"))
    twice = parts.where("p_partkey % 3 = 0").withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))
    changes = twice.select(key(F.col("p_partkey") * 2), F.concat("p_name", F.lit(" v"), F.col("v").cast("string")).alias("name"), F.lit("changed").alias("origin"))
    return versions.upsert_nodes(current, changes)
