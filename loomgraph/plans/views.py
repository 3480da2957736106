"""Driver tables as the engine's records, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.records import score
from loomgraph.plans.registry import table

#: Line items as records: supplier, relation by return flag, part, order as source, line status as engine.
TRIPLES_SQL = """
SELECT CAST(l_orderkey AS VARCHAR) AS source_pmid, 'S' || l_suppkey AS name_1, 'Drug' AS type_1,
       CASE l_returnflag WHEN 'A' THEN 'IMPROVES' WHEN 'R' THEN 'WORSENS' ELSE 'ASSOCIATED_WITH' END AS relation,
       'P' || (l_partkey{modulo}) AS name_2, 'Disease' AS type_2, 'line ' || l_linenumber AS evidence_text,
       1 - l_discount * 5 AS own, CASE l_linestatus WHEN 'O' THEN 'LLM_open' ELSE 'Rule_Candidate' END AS extracted_by,
       l_orderkey * 8 + l_linenumber AS seq
FROM lineitem
"""

#: The same with the raw score.
SCORED_SQL = """
SELECT *, round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
         0.38::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, own)) + 0.24::DOUBLE * 1.0 + 0.24::DOUBLE * 1.0
         + 0.14::DOUBLE * CASE WHEN extracted_by LIKE 'LLM%' THEN 0.78::DOUBLE ELSE 0.45::DOUBLE END)), 3) AS computed_confidence
FROM ({triples})
"""

#: Fused edges of scored records.
FUSED_SQL = """
SELECT name_1, type_1, relation, name_2, type_2, string_agg(DISTINCT source_pmid, ',' ORDER BY source_pmid) AS pmids,
       string_agg(DISTINCT extracted_by, ',' ORDER BY extracted_by) AS engines, count(*) AS evidence_count, min(seq) AS first_seq,
       round(least(1.0::DOUBLE, 0.42::DOUBLE * max(computed_confidence) + 0.18::DOUBLE * avg(computed_confidence)
         + 0.18::DOUBLE * least(1.0::DOUBLE, 0.45::DOUBLE + 0.12::DOUBLE * (count(DISTINCT source_pmid) - 1))
         + 0.14::DOUBLE * least(1.0::DOUBLE, 0.55::DOUBLE + 0.25::DOUBLE * (count(DISTINCT extracted_by) - 1)) + 0.08::DOUBLE), 9) AS computed_confidence
FROM ({scored}) GROUP BY ALL
"""


def triples_sql(coarse: bool = False) -> str:
    return TRIPLES_SQL.format(modulo=" % 50" if coarse else "")


def scored_sql(coarse: bool = False) -> str:
    return SCORED_SQL.format(triples=triples_sql(coarse))


def fused_sql(coarse: bool = False) -> str:
    return FUSED_SQL.format(scored=scored_sql(coarse))


def triples(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """Records of line items; coarse: parts in 50 groups, so that edges have several records."""
    part = F.col("l_partkey") % 50 if coarse else F.col("l_partkey")
    flag = F.when(F.col("l_returnflag") == "A", "IMPROVES").when(F.col("l_returnflag") == "R", "WORSENS").otherwise("ASSOCIATED_WITH")

    def entity(letter: str, key, kind: str):
        return F.struct(F.concat(F.lit(letter), key.cast("string")).alias("name"), F.lit(kind).alias("type"))

    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("source_pmid"),
        entity("S", F.col("l_suppkey"), "Drug").alias("entity_1"),
        flag.alias("relation"),
        entity("P", part, "Disease").alias("entity_2"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("evidence_text"),
        (F.lit(1) - F.col("l_discount") * 5).alias("llm_confidence"),
        F.when(F.col("l_linestatus") == "O", "LLM_open").otherwise("Rule_Candidate").alias("extracted_by"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )


def scored(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """triples with computed_confidence; they are valid as they stand, so without problems."""
    return score(triples(spark, sf_dir, coarse).withColumn("problems", F.expr("array()").cast("array<string>"))).drop("problems")


#: Supplier-part edges with both kinds of id in one space, and their nodes.
EDGES_SQL = "SELECT l_suppkey AS src, l_partkey AS dst, l_returnflag AS key, l_quantity AS weight FROM lineitem"
NODES_SQL = "SELECT p_partkey AS id FROM part UNION SELECT s_suppkey FROM supplier"


def part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).union(table(spark, sf_dir, "supplier").select("s_suppkey")).distinct()
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("key"), F.col("l_quantity").alias("weight"))
    return nodes, edges


#: Suppliers, nations and regions as one small weighted graph.
GEO_SQL = """
SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 1.0::DOUBLE + s_suppkey % 3 AS weight FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2.0::DOUBLE FROM nation
UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 1.0::DOUBLE FROM nation WHERE n_nationkey % 2 = 0
"""


def geo_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def name(letter: str, key: str):
        return F.concat(F.lit(letter), F.col(key).cast("string"))

    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    edges = (
        supplier.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"), (F.lit(1.0) + F.col("s_suppkey") % 3).alias("weight"))
        .unionAll(nation.select(name("n", "n_nationkey"), name("r", "n_regionkey"), F.lit(2.0)))
        .unionAll(nation.where("n_nationkey % 2 = 0").select(name("r", "n_regionkey"), name("n", "n_nationkey"), F.lit(1.0)))
    )
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges


#: One quote for each document: its first sentence, altered in five ways; every seventh source is missing.
QUOTES_SQL = """
SELECT doc_id AS seq, CAST(doc_id AS VARCHAR) AS source_pmid, CASE WHEN doc_id % 7 <> 0 THEN text END AS abstract, doc_id % 7 <> 0 AS has_source,
       CASE doc_id % 5 WHEN 0 THEN head WHEN 1 THEN translate(head, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
         WHEN 2 THEN NULL WHEN 3 THEN 'Absent words. ' || head ELSE replace(head, ' ', '  ') END AS evidence_text
FROM (SELECT *, split_part(text, '.', 1) || '.' AS head FROM documents)
"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("head", F.concat(F.split_part("text", F.lit("."), F.lit(1)), F.lit(".")))
    way, there = F.col("doc_id") % 5, F.col("doc_id") % 7 != 0
    quote = (
        F.when(way == 0, F.col("head"))
        .when(way == 1, F.translate("head", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        .when(way == 3, F.concat(F.lit("Absent words. "), "head"))
        .when(way == 4, F.replace("head", F.lit(" "), F.lit("  ")))
    )

    def entity(n: int, kind: str):
        return F.struct(F.coalesce(F.get(F.split("head", " "), F.lit(n)), F.lit("")).alias("name"), F.lit(kind).alias("type"))

    return docs.select(
        F.col("doc_id").alias("seq"),
        F.col("doc_id").cast("string").alias("source_pmid"),
        F.lit("").alias("title"),
        F.when(there, F.col("text")).alias("abstract"),
        there.alias("has_source"),
        quote.alias("evidence_text"),
        F.lit("CAUSES").alias("relation"),
        entity(0, "Gene").alias("entity_1"),
        entity(1, "Disease").alias("entity_2"),
    )


#: Labelled documents as reviewed candidates.
REVIEWS_SQL = """
SELECT 'C' || l.doc_id AS candidate_id, d.source AS source_pmid, d.lang AS sample_group,
       CASE WHEN l.doc_id % 11 = 0 THEN 'U' WHEN quality = 1 AND toxic = 0 THEN '2' WHEN quality = 1 THEN '1' ELSE '0' END AS support_label,
       CASE WHEN toxic = 1 THEN 'no' WHEN l.doc_id % 13 = 0 THEN 'unclear' ELSE 'yes' END AS span_label, n_chars,
       CASE WHEN CAST(('0x' || substr(sha256('20261002:' || d.source), 1, 8)) AS BIGINT) % 10 < 3 THEN 'development' ELSE 'test' END AS split
FROM labels l JOIN documents d USING (doc_id)
"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.functions.text import hash_split

    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    good = F.col("quality") == 1
    label = F.when(F.col("doc_id") % 11 == 0, "U").when(good & (F.col("toxic") == 0), "2").when(good, "1").otherwise("0")
    return both.select(
        F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("candidate_id"),
        F.col("source").alias("source_pmid"),
        F.col("lang").alias("sample_group"),
        label.alias("support_label"),
        F.when(F.col("toxic") == 1, "no").when(F.col("doc_id") % 13 == 0, "unclear").otherwise("yes").alias("span_label"),
        "n_chars",
        hash_split(F.col("source")).alias("split"),
    )
