"""Graph operators over the whole supplier-part graph of the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import evaluation, fusion, graph
from loomgraph.plans import views
from loomgraph.plans.registry import query, table

#: Suppliers and parts as nodes of their own.
_PARTS_SQL = "SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_quantity AS weight FROM lineitem UNION ALL SELECT 'p' || p_partkey, 's' || (p_partkey % 7 + 1), 2.0::DOUBLE FROM part WHERE p_partkey % 3 = 0"


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    name = lambda letter, key: F.concat(F.lit(letter), key.cast("string"))
    sold = table(spark, sf_dir, "lineitem").select(name("s", F.col("l_suppkey")).alias("src"), name("p", F.col("l_partkey")).alias("dst"), F.col("l_quantity").cast("double").alias("weight"))
    back = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(name("p", F.col("p_partkey")), name("s", F.col("p_partkey") % 7 + 1), F.lit(2.0))
    # Keys are made distinct as numbers, before they become names: most rows go there.
    items, third = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    suppliers = items.select(F.col("l_suppkey").alias("key")).distinct().unionAll(third.select(F.col("p_partkey") % 7 + 1))
    parts = items.select(F.col("l_partkey").alias("key")).distinct().unionAll(third.select("p_partkey"))
    nodes = suppliers.select(name("s", F.col("key")).alias("id")).unionAll(parts.select(name("p", F.col("key"))))
    return nodes.distinct(), sold.unionAll(back)


def _pagerank_sql(rounds: int) -> str:
    sql = f"""WITH e AS MATERIALIZED (SELECT src, dst, sum(weight) AS w FROM ({_PARTS_SQL}) GROUP BY ALL), v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), n AS (SELECT count(*)::DOUBLE AS n FROM v),
    o AS MATERIALIZED (SELECT src, sum(w) AS o FROM e GROUP BY 1), r0 AS (SELECT id, 1 / n AS r FROM v, n)"""
    for k in range(rounds):
        sql += f""", r{k + 1} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE / n + 0.85::DOUBLE * ((SELECT coalesce(sum(r), 0) FROM r{k} WHERE id NOT IN (SELECT src FROM o)) / n + coalesce(c.c, 0)) AS r
        FROM n, v LEFT JOIN (SELECT e.dst, sum(p.r * e.w / o.o) AS c FROM e JOIN o USING (src) JOIN r{k} p ON p.id = e.src GROUP BY 1) c ON c.dst = v.id)"""
    return sql + f" SELECT id, round(r, 9) AS rank FROM r{rounds}"


@query(_pagerank_sql(6))
def pagerank_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(*_parts(spark, sf_dir), tolerance=0.0, most_rounds=6).select("id", F.bround("rank", 9).alias("rank"))


@query()
def communities_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.communities(*_parts(spark, sf_dir))


@query(f"""
WITH e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS w FROM ({_PARTS_SQL}) WHERE src <> dst GROUP BY 1, 2),
p AS (SELECT CAST(substr(a, 2) AS BIGINT) % 7 AS x, CAST(substr(b, 2) AS BIGINT) % 7 AS y, w FROM e), k AS (SELECT c, sum(w) AS k FROM (SELECT x AS c, w FROM p UNION ALL SELECT y, w FROM p) GROUP BY 1), m AS (SELECT sum(w) AS m, sum(w) FILTER (x = y) AS inside FROM p)
SELECT round(inside / m - (SELECT sum(k * k) FROM k) / (4 * m * m), 9) AS modularity FROM m
""")
def modularity_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity of a given partition, by key modulo seven."""
    nodes, edges = _parts(spark, sf_dir)
    labels = nodes.select("id", (F.substring("id", 2, 20).cast("bigint") % 7).alias("community"))
    return graph.modularity(edges, labels).select(F.bround("modularity", 9).alias("modularity"))


@query(f"""
SELECT sha256('["literature","Drug","' || name_1 || '"]') AS src, sha256('["literature","Disease","' || name_2 || '"]') AS dst, 'literature:' || relation AS key, arg_max(computed_confidence, seq) AS weight
FROM ({views.scored_sql(True)}) GROUP BY name_1, name_2, relation
""")
def multigraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a typed multigraph, the last of each (source, target, key) standing for all."""
    rows = fusion.flat(views.scored(spark, sf_dir, True)).withColumnRenamed("seq", "first_seq")
    return graph.graph_from_edges(rows)[1]


def _condition_sql(name: str, suppliers: str) -> str:
    t = f"(SELECT {suppliers} AS src, name_2 AS dst, relation FROM ({views.triples_sql(True)}))"
    return f"""
    SELECT '{name}' AS condition, (SELECT count(*) FROM {t}) AS records, (SELECT count(*) FROM (SELECT DISTINCT src, relation, dst FROM {t})) AS edges, sum(n)::BIGINT AS nodes,
      (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM {t})) AS pairs, round(2.0 * (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM {t})) / sum(n), 9) AS average_degree, count(*) AS components, max(n) AS largest,
      round(1 - max(n) / sum(n), 9) AS outside_largest, 0 AS self_loops,
      round(1 - (SELECT count(*) FROM (SELECT DISTINCT src, relation, dst FROM {t})) / (SELECT count(*) FROM (SELECT DISTINCT name_1, relation, name_2 FROM ({views.triples_sql(True)}))), 9) AS compression_vs_raw
    FROM (SELECT m, count(*) AS n FROM (WITH RECURSIVE u AS (SELECT src, dst FROM {t} UNION SELECT dst, src FROM {t}), r AS (SELECT src AS id, src AS m FROM u UNION SELECT u.dst, r.m FROM r JOIN u ON r.id = u.src) SELECT id, min(m) AS m FROM r GROUP BY 1) GROUP BY 1)"""


@query(_condition_sql("raw", "name_1") + " UNION ALL " + _condition_sql("dictionary", "'S' || (CAST(substr(name_1, 2) AS BIGINT) // 2)"))
def condition_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fusion.flat(views.scored(spark, sf_dir, True))
    mapped = raw.withColumn("name_1", F.concat(F.lit("S"), F.floor(F.substring("name_1", 2, 20).cast("bigint") / 2).cast("string")))
    out = graph.condition_metrics({"raw": raw, "dictionary": mapped})
    return out.withColumns({c: F.bround(c, 9) for c in ("average_degree", "outside_largest", "compression_vs_raw")})


@query(f"""
WITH t AS (SELECT DISTINCT extracted_by, lower(name_1) AS gene FROM ({views.triples_sql(True)}) WHERE name_2 IN ('P1', 'P2')), truth AS (SELECT lower('S' || s_suppkey) AS gene FROM supplier WHERE s_acctbal >= 0),
c AS (SELECT extracted_by, count(*) AS extracted, (SELECT count(*) FROM truth) AS expected, count(truth.gene) AS true_positives FROM t LEFT JOIN truth USING (gene) GROUP BY 1)
SELECT *, extracted - true_positives AS false_positives, expected - true_positives AS false_negatives, round(true_positives / extracted, 9) AS precision, round(true_positives / expected, 9) AS recall,
  round(2.0 * true_positives / (extracted + expected), 9) AS f1 FROM c
""")
def disease_gene_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes linked with a disease in either direction, against a baseline; every other record the other way round."""
    rows = views.triples(spark, sf_dir, True).withColumn("entity_1", F.struct(F.concat(F.lit(" "), "entity_1.name").alias("name"), F.lit("Gene").alias("type")))
    turned = F.col("seq") % 2 == 0
    rows = rows.select("extracted_by", F.when(turned, F.col("entity_2")).otherwise(F.col("entity_1")).alias("entity_1"), F.when(turned, F.col("entity_1")).otherwise(F.col("entity_2")).alias("entity_2"))
    truth = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("gene"))
    out = evaluation.set_metrics(evaluation.disease_genes(rows, ["P1", "p2"]), truth, ["gene"], "extracted_by")
    return out.withColumns({c: F.bround(c, 9) for c in ("precision", "recall", "f1")})


@query("""
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN '#e74c3c' WHEN 'SMALL' THEN '#2ecc71' WHEN 'MEDIUM' THEN '#3498db' ELSE '#95a5a6' END AS colour,
       CASE WHEN p_size % 5 = 0 THEN 12.0::DOUBLE ELSE greatest(12.0::DOUBLE, least(65.0::DOUBLE, p_size::DOUBLE)) END AS size FROM part
""")
def viewer_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_type") == "ECONOMY", "Gene").when(F.col("p_type") == "SMALL", "DRUG").when(F.col("p_type") == "MEDIUM", "Rare disease")
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kind.alias("type"), "p_size")
    scored = nodes.where("p_size % 5 <> 0").select("id", (F.col("p_size") / 1000).alias("rank"), F.lit(1).alias("community"))
    return graph.with_metrics(nodes.drop("p_size"), scored).select(F.col("id").alias("p_partkey"), "colour", "size")
