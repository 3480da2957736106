import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import alignment, checks, evidence, fusion, graph, records
from loomgraph.sources.records import TRIPLE

SCHEMA = "seq bigint, source_pmid string, entity_1 struct<name:string,type:string>, relation string, entity_2 struct<name:string,type:string>, evidence_text string, llm_confidence string, extracted_by string"


def triple(seq, pmid, e1, relation, e2, evidence_text="Evidence here.", own="0.9", engine="LLM_x"):
    return (seq, pmid, e1, relation, e2, evidence_text, own, engine)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_normalize_reports_problems_and_keeps_rows(spark):
    rows = [
        triple(1, "1", (" A  b ", "Patient"), "TREATS_MENTION", ("C", "disease")),
        triple(2, None, None, "nonsense", ("", "Gene"), ""),
    ]
    out = {r["seq"]: r for r in records.normalize(frame(spark, rows)).collect()}
    assert out[1]["problems"] == ["entity_1.type_invalid"] and out[1]["entity_1"]["name"] == "A b"
    assert out[1]["relation"] == "TREATS" and out[1]["relation_original"] == "TREATS_MENTION"
    assert out[2]["problems"] == ["missing_source_pmid", "entity_1_not_object", "entity_2.name_empty", "relation_invalid", "evidence_text_empty"]
    assert records.normalize(frame(spark, [])).count() == 0


def test_conflict_end_to_end(spark):
    rows = [
        triple(1, "1", ("SMN1", "Gene"), "IMPROVES", ("Walking", "Phenotype"), own="0.85"),
        triple(2, "2", ("SMN1", "Gene"), "WORSENS", ("Walking", "Phenotype"), own="0.7"),
        triple(3, "2", ("SMN1", "Gene"), "WORSENS", ("Walking", "Phenotype"), own="0.7", engine="Rule_Candidate"),
    ]
    good = records.accepted(records.normalize_and_score(frame(spark, rows)))
    edges = fusion.with_review_status(fusion.fuse(fusion.flat(good)))
    found = {r["relation"]: r for r in edges.collect()}
    assert set(found) == {"IMPROVES", "WORSENS"}
    assert all(r["review_status"] == "needs_review" and r["conflict_relations"] == ["IMPROVES", "WORSENS"] for r in found.values())
    assert found["WORSENS"]["evidence_count"] == 2 and found["WORSENS"]["engines"] == ["LLM_x", "Rule_Candidate"] and found["WORSENS"]["pmids"] == ["2"]
    assert fusion.relation_conflicts(edges).count() == 1
    assert checks.provenance(fusion.fuse(fusion.flat(good)), fusion.flat(good), fusion.EDGE).count() == 0


def test_merge_leaves_rule_records_out_and_keeps_the_first(spark):
    a = frame(spark, [triple(1, "1", ("X", "Gene"), "TREATS", ("Y", "Drug"), "first"), triple(2, "1", ("x", "Protein"), "treats", ("y", "Drug"), "second")])
    b = frame(spark, [triple(1, "1", ("X", "Gene"), "TREATS", ("Y", "Drug"), "third"), triple(2, "9", ("Q", "Gene"), "TREATS", ("Y", "Drug"), engine="Rule_Candidate")])
    assert [r["evidence_text"] for r in records.merge_stages(a, b).collect()] == ["first"]


def test_dictionary_guard(spark):
    rows = frame(spark, [triple(1, "1", ("spinraza", "Drug"), "TREATS", ("SMA", "Disease"))])
    dictionary = spark.createDataFrame([("Drug", "Spinraza", "Nusinersen"), ("Disease", "sma", "SMA type 1")], "type string, alias string, canonical string")
    out = alignment.map_dictionary(rows, dictionary).first()
    assert out["entity_1"]["name"] == "Nusinersen" and out["changed_1"]
    assert out["entity_2"]["name"] == "SMA" and not out["changed_2"]


def test_alignment_is_typed_and_prefers_frequent_names(spark):
    rows = [triple(i, str(i), (n, t), "TREATS", ("d", "Disease")) for i, (n, t) in enumerate([("SHARED", "Gene"), ("shared", "Gene"), ("SHARED", "Gene"), ("shared", "Protein"), ("shared", "Protein"), ("SHARED", "Protein")])]
    found = {(r["type"], r["name"]): r["canonical"] for r in alignment.alignment_map(frame(spark, rows)).collect()}
    assert found[("Gene", "shared")] == "SHARED" and found[("Protein", "SHARED")] == "shared"
    aligned = alignment.apply_alignment(frame(spark, rows), alignment.alignment_map(frame(spark, rows)))
    assert checks.identity_invariants(frame(spark, rows), aligned).count() == 0


def test_graph_of_edges(spark):
    edges = spark.createDataFrame([("A", "Gene", "R", "B", "Drug", 0.5, 1), ("A", "Gene", "S", "B", "Drug", 0.7, 2), ("B", "Drug", "R", "C", "Disease", 0.9, 3)], "name_1 string, type_1 string, relation string, name_2 string, type_2 string, computed_confidence double, first_seq bigint")
    nodes, links = graph.graph_from_edges(edges)
    assert nodes.count() == 3 and links.count() == 3
    s = graph.graph_summary(nodes, links).first()
    assert (s["nodes"], s["edges"], s["pairs"], s["components"]) == (3, 3, 2, 1)


def test_pagerank_against_power_iteration(spark):
    import numpy as np

    pairs = [("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 1.0), ("a", "b", 1.0)]
    ids = ["a", "b", "c", "d", "e"]
    m = np.zeros((5, 5))
    for s, t, w in pairs:
        m[ids.index(t), ids.index(s)] += w
    out = m.sum(0)
    r = np.full(5, 0.2)
    for _ in range(200):
        r = 0.15 / 5 + 0.85 * ((m / np.where(out > 0, out, 1)) @ r + r[out == 0].sum() / 5)
    found = graph.pagerank(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "src string, dst string, weight double"), tolerance=1e-9)
    assert {x["id"]: round(x["rank"], 6) for x in found.collect()} == {i: round(v, 6) for i, v in zip(ids, r)}


def test_communities_of_two_cliques(spark):
    pairs = [(a, b, 1.0) for group in ([1, 2, 3, 4], [5, 6, 7, 8]) for a in group for b in group if a < b] + [(4, 5, 0.1)]
    nodes, edges = spark.range(1, 10), spark.createDataFrame(pairs, "src bigint, dst bigint, weight double")
    found = {r["id"]: r["community"] for r in graph.communities(nodes, edges).collect()}
    assert {found[i] for i in (1, 2, 3, 4)} == {0} and {found[i] for i in (5, 6, 7, 8)} == {1} and found[9] == 2
    assert graph.modularity(edges, graph.communities(nodes, edges)).first()[0] > 0.4


def test_neighbourhood(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src bigint, dst bigint")
    start = spark.createDataFrame([(2,)], "id bigint")
    assert {(r[0], r[1]) for r in graph.neighbourhood(edges, start).collect()} == {(2, 0), (1, 1), (3, 1), (4, 2)}
    assert {(r[0], r[1]) for r in graph.neighbourhood(edges, start, 1, directed=True).collect()} == {(2, 0), (3, 1)}


def test_rule_triples(spark):
    abstracts = spark.createDataFrame(
        [("1", "Nusinersen therapy was approved for spinal muscular atrophy. It improves motor function with risdiplam."), ("2", "Nusinersen did not treat SMA."), ("3", "SMN1 deletion causes SMA."), ("4", None)],
        "pmid string, abstract string",
    )
    found = {(r["source_pmid"], r["entity_1"]["name"], r["relation"], r["entity_2"]["name"]) for r in evidence.rule_triples(abstracts).collect()}
    assert found == {("1", "Nusinersen", "TREATS", "Spinal Muscular Atrophy"), ("1", "Risdiplam", "IMPROVES", "motor function"), ("3", "SMN1", "ASSOCIATED_WITH", "Spinal Muscular Atrophy")}


def test_readers_and_sinks(spark, tmp_path):
    from loomgraph.sources import records as readers
    from loomgraph.sources import sinks

    path = tmp_path / "rows.jsonl"
    path.write_text('{"source_pmid": "1", "relation": "TREATS"}\n\nbroken\n[1]\n{"source_pmid": "2"}\n')
    good, errors = readers.read_jsonl_tolerant(spark, str(path), TRIPLE)
    assert [(r["seq"], r["source_pmid"]) for r in good.orderBy("seq").collect()] == [(1, "1"), (5, "2")]
    assert [(r["line"], r["error"]) for r in errors.orderBy("line").collect()] == [(3, "invalid_json"), (4, "not_an_object")]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(path), TRIPLE).collect()
    rows = spark.createDataFrame([(1, ["x"]), (2, [])], "id bigint, problems array<string>")
    assert sinks.split_rejects(rows, str(tmp_path / "ok"), str(tmp_path / "bad")) == (1, 1)
    assert sinks.publish(rows, str(tmp_path / "out"), least=3) is False
    assert sinks.publish(rows, str(tmp_path / "out")) and sinks.publish(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert sinks.fingerprint(rows).first() == sinks.fingerprint(rows.orderBy(F.desc("id"))).first()
    medline = spark.createDataFrame([("PMID- 1\nTI  - A title\n      goes on\nAB  - Text.\nDP  - 2020\n\nPMID- 2\nTI  - No abstract\n",)], "raw string")
    assert [tuple(r) for r in readers.parse_medline(medline).select("pmid", "title", "abstract").collect()] == [("1", "A title goes on", "Text.")]


def test_workbook_and_pages(spark, tmp_path):
    import zipfile

    from loomgraph.sources.workbook import paged, read_workbook

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>label</t></si></sst>")
        rows = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="inlineStr"><is><t>yes</t></is></c></row><row><c r="C3"><v>9</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    assert [tuple(r) for r in read_workbook(spark, str(tmp_path / "b.xlsx"), ["id", "label"]).collect()] == [("7", "yes")]
    pages = paged(spark, lambda page, size: [(page * size + i,) for i in range(size if page < 2 else 1)], "value bigint", pages=3, page_size=2)
    assert sorted(r[0] for r in pages.collect()) == [0, 1, 2, 3, 4]


def test_record_json_round_trip(spark):
    rows = frame(spark, [triple(1, "1", ("A", "Gene"), "nonsense", ("B", "Drug"))])
    rejected = records.rejected(records.normalize(rows)).first()
    assert rejected["line"] == 1 and json.loads(rejected["record"])["entity_1"]["name"] == "A"


def test_ablation_counts_conflicts_without_lists(spark):
    from itertools import combinations

    from pyspark.sql import functions as F

    from loomgraph.functions import vocabulary
    from loomgraph.operators import fusion

    names = [*vocabulary.DEFAULT.polarity, "OTHER", None]
    groups = [c for n in (1, 2) for c in combinations(names, n)]
    df = spark.createDataFrame([(g, r) for g, c in enumerate(groups) for r in c], "g int, relation string")
    lists = df.groupBy("g").agg(F.collect_set("relation").alias("all")).select("g", vocabulary.conflicting(F.col("all")).alias("x"))
    rows = df.groupBy("g").agg(vocabulary.conflicting_rows(F.col("relation")).alias("x"))
    want = sorted(map(tuple, lists.collect()))
    assert sorted(map(tuple, rows.collect())) == want and {x for _, x in want} == {True, False}
    flat = df.select(
        F.col("g").cast("string").alias("name_1"), F.lit("Drug").alias("type_1"), "relation", F.lit("P").alias("name_2"), F.lit("Disease").alias("type_2"),
        F.lit("1").alias("source_pmid"), F.lit("LLM").alias("extracted_by"), F.lit(0.5).alias("computed_confidence"), F.lit(1).alias("seq"),
    )
    out = fusion.ablation({"raw": flat})
    assert "collect_set" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.first().asDict() == {"condition": "raw", "records": df.count(), "edges": df.count(), "nodes": len(groups) + 1, "pairs": len(groups), "self_loops": 0, "conflicts": sum(x for _, x in want)}
