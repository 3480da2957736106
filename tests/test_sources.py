"""Numbers of rows and lines, keyed updates and published versions."""

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import sinks
from loomgraph.sources.records import numbered, read_lines, slice_rows
from loomgraph.sources.scratch import Tables, released


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    keys = {"spark.sql.adaptive.enabled": request.param, "spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_numbers_of_wide_rows_are_gapless_and_in_order(spark, adaptive):
    n = 60_000
    df = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("key"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("payload"))
    out = numbered(df, "key")
    assert out.columns == ["key", "payload", "seq"]
    row = out.agg(F.count(F.lit(1)), F.count_distinct("seq"), F.min("seq"), F.max("seq"), F.count_if(F.col("seq") != F.col("key") + 1)).first()
    assert tuple(row) == (n, n, 1, n, 0)
    narrow = out.select("seq").agg(F.count_distinct("seq")).first()[0]  # whatever columns are read
    assert narrow == n and slice_rows(out, 100, 50).select("key").count() == 50


def test_numbers_with_ties_and_without_rows(spark, adaptive):
    df = spark.range(5000).select((F.col("id") % 3).alias("key"), "id")
    out = numbered(df, "key").groupBy("key").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.count_distinct("seq").alias("n")).orderBy("key").collect()
    assert [tuple(r) for r in out] == [(0, 1, 1667, 1667), (1, 1668, 3334, 1667), (2, 3335, 5000, 1666)]
    assert numbered(df.where("false"), "key").count() == 0
    with pytest.raises(ValueError):
        numbered(df)


def test_lines_of_several_files_in_order(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for name, size in (("a", 50), ("b", 900), ("c", 7)):
            (tmp_path / f"{name}.txt").write_text("".join(f"{name} {i}\n" if i % 5 else "\n" for i in range(size)))
        rows = read_lines(spark, f"{tmp_path}/*.txt").orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = [(k + 1, f"{name} {i}") for k, (name, i) in enumerate((n, i) for n, size in (("a", 50), ("b", 900), ("c", 7)) for i in range(size)) if i % 5]
    assert [tuple(r) for r in rows] == expected


def test_upsert_with_repeated_and_null_keys(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    changes = spark.createDataFrame([(1, "x", 1), (1, "w", 2), (None, "m", 1), (None, "l", 0), (9, None, 5)], "k int, v string, at int")
    rows = sorted(map(tuple, sinks.upsert(current, changes, ["k"], "at").select("k", "v").collect()), key=str)
    assert rows == sorted([(1, "w"), (2, "b"), (None, "m"), (9, None)], key=str)
    assert sinks.upsert(current, changes.where("false"), ["k"]).count() == 3
    assert sinks.upsert(current, changes.drop("at"), ["k"]).groupBy("k").count().where("count > 1").count() == 0


def test_published_versions_and_refusals(spark, tmp_path):
    root = str(tmp_path / "table")
    first = sinks.publish_version(spark.range(3), root)
    assert sinks.publish_version(spark.range(1), root, least=2) is None
    assert sinks.read_published(spark, root).count() == 3
    second = sinks.publish_version(spark.range(5), root)
    assert first != second and sinks.read_published(spark, root).count() == 5
    assert sorted(p.name for p in tmp_path.joinpath("table").iterdir() if p.is_dir()) == sorted([first, second])
    assert sinks.publish(spark.range(2), str(tmp_path / "plain")) and not sinks.publish(spark.range(1), str(tmp_path / "plain"), least=9)
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("plain")] == ["plain"]


def test_tables_of_a_scope_are_freed(spark):
    import os

    with released(spark):
        inside = Tables(spark, "scope")
        inside.write(spark.range(3), "t")
        assert os.path.isdir(inside.path)
    assert not os.path.exists(inside.path)


def test_pages_up_to_a_short_one(spark):
    from loomgraph.sources.workbook import all_pages

    def fetch(page, size):
        return [(page * size + i,) for i in range(max(0, min(size, 23 - page * size)))]

    assert sorted(r[0] for r in all_pages(spark, fetch, "value bigint", page_size=5, at_once=2).collect()) == list(range(23))
    assert all_pages(spark, lambda page, size: [], "value bigint", page_size=5, at_once=2).count() == 0


def test_settings_and_reports(spark, tmp_path):
    import json

    from loomgraph.sources.records import read_settings

    (tmp_path / ".env").write_text("# note\nKEY = 'a=b'\nOTHER=\"x\"\nnothing\nKNOWN=new\n")
    assert read_settings(str(tmp_path / ".env"), {"KNOWN": "old"}) == {"KNOWN": "old", "KEY": "a=b", "OTHER": "x"}
    sinks.write_report(spark.createDataFrame([(1, "é")], "n int, s string"), str(tmp_path / "report.json"))
    assert json.loads((tmp_path / "report.json").read_text()) == [{"n": 1, "s": "é"}]
    with pytest.raises(ValueError):
        sinks.write_report(spark.range(5), str(tmp_path / "big.json"), most=3)


def test_small_readers_and_writers(spark, tmp_path):
    from loomgraph.sources import records

    (tmp_path / "a.csv").write_text("\ufeffid,text\n1,\"x, y\"\n")
    assert [tuple(r) for r in records.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "x, y")]
    (tmp_path / "d.json").write_text('{"a": {"b": [1, 2]}}')
    assert records.read_json_document(spark, str(tmp_path / "d.json")).first()["a"]["b"] == [1, 2]
    rows = spark.createDataFrame([(1, "p", "t", "x"), (2, "p", None, None), (3, " ", "t", "x")], "seq bigint, pmid string, title string, abstract string")
    assert [tuple(r) for r in records.abstracts_by_id(rows).collect()] == [("p", "", "")]
    assert records.with_text(rows).count() == 2
    sinks.write_csv(spark.createDataFrame([(1, ["a"])], "n int, l array<string>"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["l"] == '["a"]'
    sinks.write_version(spark.createDataFrame([("k", 1)], "key string, v int"), str(tmp_path / "v"), "v1", "key")
    sinks.write_version(spark.createDataFrame([("k", 2)], "key string, v int"), str(tmp_path / "v"), "v2", "key")
    assert {(r["graph_version"], r["v"]) for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {("v1", 1), ("v2", 2)}
    with pytest.raises(ValueError):
        sinks.write_version(spark.createDataFrame([("k", 2), ("k", 3)], "key string, v int"), str(tmp_path / "v"), "v3", "key")
    pointer = spark.createDataFrame([("active", "v1", None, "t0")], "name string, graph_version string, previous_version string, activated_at string")
    once = sinks.activate(pointer, "v2", "t1")
    assert tuple(once.first()) == ("active", "v2", "v1", "t1") and tuple(sinks.activate(once, "v2", "t2").first())[:3] == ("active", "v2", "v1")


def test_vocabulary_documents(spark):
    from loomgraph.functions import vocabulary

    v = vocabulary.load('{"entity_types": ["Gene"], "relations": {"TREATS": {"polarity": "positive"}, "X": {}}, "negative_relations": ["X"], "relation_aliases": {"treated-with": "TREATS"}, "entity_type_aliases": {" Genes": "Gene"}, "conflict_relation_pairs": [["TREATS", "X"]]}')
    row = spark.range(1).select(vocabulary.relation(F.lit("Treated with"), v), vocabulary.polarity(F.lit("X"), v), vocabulary.label(F.lit("genes"), v), vocabulary.label(F.lit("Drug"), v), vocabulary.relationship(F.lit("no"), v)).first()
    assert tuple(row) == ("TREATS", "negative", "Gene", "Unknown", "ASSOCIATED_WITH")


def test_files_are_validated(spark, tmp_path):
    from loomgraph.operators import audit

    good = '{"source_pmid": "1", "entity_1": {"name": "A", "type": "Gene"}, "relation": "CAUSES", "entity_2": {"name": "B", "type": "Disease"}}'
    (tmp_path / "r.jsonl").write_text(f"{good}\n\nbroken\n[1]\n{good}\n")
    row = audit.validate_file(spark, str(tmp_path / "r.jsonl")).first()
    assert (row["records"], row["bad_json_lines"], row["invalid_triples"], row["valid"], row["missing"]) == (4, 1, 1, False, False) and row["bytes"] > 100
    gone = audit.validate_file(spark, str(tmp_path / "none")).first()
    assert (gone["records"], gone["valid"], gone["missing"]) == (0, False, True)
