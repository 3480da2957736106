"""Language identification: as many languages and entries as occur, and the model as a table."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import language
from tests.llm.test_operators import odd


def test_three_thousand_languages(spark):
    words = ("".join(w) for w in itertools.product("bcdfgklmnprstvz", "aeiou", "bcdfgklmnprstvz", "aeiou", "xyq"))
    own = {f"l{k:04d}": list(itertools.islice(words, 3)) for k in range(3000)}
    rows = [(i, " ".join(ws), lang) for i, (lang, ws) in enumerate(own.items())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    model = language.train(df, F.lit(True))
    assert isinstance(model, language.Model) and len(model.languages) == 3000
    assert all(w in model.index[0] for ws in own.values() for w in ws)
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, model).collect()}
    assert all(found[i] == lang for i, _, lang in rows)


def test_model_as_table_gives_the_same(spark):
    texts = ["the house and the garden", "das Haus und der Garten", "la maison et le jardin"] * 6
    rows = [(i, t, ["en", "de", "fr"][i % 3]) for i, t in enumerate(texts)]
    rows += [(90, "gardening houses " * 500 + "y" * 3000, None), (91, "Gartenhaus the", None), (92, "12 34", None), (93, "漢字", None), (94, "é q", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    held = odd(spark).select("doc_id", "text", "size")
    for sample in (df, df.where("lang = 'en'")):
        small, large = language.train(sample, F.lit(True)), language.train(sample, F.lit(True), most_cells=0)
        assert isinstance(large, language.StoredModel) and large.languages == small.languages
        for texts_of in (df, held, held.where("false")):
            a, b = (sorted((tuple(r) for r in language.identify(texts_of, m).collect()), key=str) for m in (small, large))
            assert [r[:2] for r in a] == [r[:2] for r in b]
            assert [r[2] for r in a] == pytest.approx([r[2] for r in b], abs=1e-5)


def test_entries_are_not_capped(spark):
    rows = [(i, " ".join(f"{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676)}{'om' if i else 'ul'}" for j in range(2000)), ["de", "en"][i]) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(df, F.lit(True))
    assert len(model.index[0].hashes) == 4000
    assert [r["lang_pred"] for r in language.identify(df.orderBy("doc_id"), model).collect()] == ["de", "en"]
