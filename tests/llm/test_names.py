"""Tables that have the names of helper columns as columns of their own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import decontamination, language, simhash, tokens
from loomgraph.llm.common import quoted
from loomgraph.llm.queries import QUERIES
from tests.llm.test_pipeline import tables

HELPERS = """__kept __hit __key __text __rows __id __own_doc_id __own_text __utf8 __size __source __name __target __pick __whole __copy __spread __hash __n __h __bucket
    fp node label least a b id held_out score lang_pred predicted n_tokens n_known n_bytes fingerprint component_id taken size weight rank row group digest claim leaf root subroot proof
    edits item_id slot law grown_shard mix_size mix_copies mix_target mix_source_size words buckets eligible late down seq __part __at __offset g pos n block""".split() + ["a.b", "c `d"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    plain, named = str(tmp_path_factory.mktemp("plain")), str(tmp_path_factory.mktemp("named"))
    tables(spark, plain)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{plain}/{name}.parquet").write.parquet(f"{named}/{name}.parquet")
    docs = spark.read.parquet(f"{plain}/documents.parquet")
    docs.withColumns({c: F.lit(f"own {c}") for c in HELPERS}).write.parquet(f"{named}/documents.parquet")
    for at in (plain, named):
        spark.createDataFrame([(1, "u", "<article><p>x</p></article>", "own")], "page_id int, url string, html string, text string").write.parquet(f"{at}/pages.parquet")
    return plain, named


def test_every_query_is_the_same(spark, folder):
    for name, query in QUERIES.items():
        plain, named = ([tuple(r) for r in query(spark, at).collect()] for at in folder)
        if name == "op2_lm_scores":  # sums of logarithms
            plain, named = ([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows] for rows in (plain, named))
        assert sorted(plain, key=repr) == sorted(named, key=repr), name


def test_pipeline_keeps_its_columns(spark, folder):
    plain, named = (corpus_pipeline.run(spark, at) for at in folder)
    assert named.columns == [*plain.columns[:-1], *HELPERS, "shard"]
    assert sorted(map(tuple, named.select(*plain.columns).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert named.where(" OR ".join(f"{quoted(c)} <> 'own {c}'" for c in HELPERS)).isEmpty()
    docs, items = spark.read.parquet(f"{folder[1]}/documents.parquet"), spark.read.parquet(f"{folder[1]}/benchmark.parquet")
    for rows in (simhash.keep_one_each(docs), simhash.keep_one_each(docs.unionAll(docs)), decontamination.clean(docs, items)):
        assert rows.columns == docs.columns and 0 < rows.count() < docs.count()


def test_ids_named_like_a_result_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "score int, text string")
    with pytest.raises(ValueError, match="score"):
        language.identify(docs, language.Model([], {}, {}), id_col="score")
    with pytest.raises(ValueError, match="n_bytes"):
        tokens.count_tokens(docs.withColumnRenamed("score", "n_bytes"), id_col="n_bytes")
