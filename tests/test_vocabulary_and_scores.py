import pytest
from pyspark.sql import functions as F

from loomgraph.functions import identity, scoring, text, vocabulary


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, expected", [("TREATS_MENTION", "TREATS"), ("treated_with", "TREATS"), ("treated-with", "TREATS"), ("CO-OCCURS_WITH", "CO_OCCURS_WITH"), ("nonsense", ""), (None, "")])
def test_relation_aliases(spark, raw, expected):
    assert one(spark, vocabulary.relation(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize("raw, expected", [("Gene", "Gene"), (" genes ", "Gene"), ("DRUG", "Drug"), ("Patient", ""), (None, "")])
def test_entity_types(spark, raw, expected):
    assert one(spark, vocabulary.entity_type(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize("relations, expected", [(["IMPROVES", "WORSENS"], True), (["IMPROVES", "TREATS"], False), (["UPREGULATES", "DOWNREGULATES"], True), (["ASSOCIATED_WITH"], False)])
def test_conflicts(spark, relations, expected):
    assert one(spark, vocabulary.conflicting(F.array(*[F.lit(r) for r in relations]))) is expected


@pytest.mark.parametrize("own, engine, expected", [("0.95", "LLM_x", 0.950), ("0.85", "LLM_x", 0.912), (None, "Rule_Candidate", 0.714)])
def test_raw_score(spark, own, engine, expected):
    value = scoring.raw_score(scoring.self_score(F.lit(own).cast("string")), F.lit(engine), F.lit(True), F.lit(0))
    assert one(spark, value) == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("score, expected", [(0.91, 0.784), (0.82, 0.730)])
def test_fused_score(spark, score, expected):
    value = scoring.fused_score(F.lit(score), F.lit(score), F.lit(1), F.lit(1), F.lit(True))
    assert one(spark, value) == pytest.approx(expected, abs=1e-9)


def test_self_score_takes_the_first_number_and_clamps(spark):
    assert one(spark, scoring.self_score(F.lit("x"), F.lit("1.7"))) == 1.0
    assert one(spark, scoring.self_score(F.lit("x"))) is None


def test_wilson(spark):
    low, high = scoring.wilson(F.lit(79), F.lit(300))
    assert one(spark, low) == pytest.approx(0.217, abs=1e-3) and one(spark, high) == pytest.approx(0.316, abs=1e-3)
    assert one(spark, scoring.wilson(F.lit(0), F.lit(0))[0]) is None


@pytest.mark.parametrize(
    "kind, a, b, expected",
    [("Gene", "SMN1", "SMN2", False), ("Gene", "SMN2", "SMN2 (Exon 7)", False), ("Disease", "SMA type 2", "SMA type 3", False), ("Disease", "SMA", "SMA type II", False), ("Gene", "SMN1 deletion", "SMN1", False), ("Drug", "Straße", "STRASSE", True)],
)
def test_compatible_identity(spark, kind, a, b, expected):
    assert one(spark, identity.compatible(F.lit(kind), F.lit(a), F.lit(b))) is expected


def test_identity_conflicts(spark):
    assert one(spark, identity.conflict(F.lit("Gene"), F.lit("SMN1"), F.lit("smn2"))) == "different_authoritative_gene_ids"
    assert one(spark, identity.conflict(F.lit("Disease"), F.lit("SMA type II"), F.lit("sma2"))) is None
    assert one(spark, identity.conflict(F.lit("Disease"), F.lit("SMA"), F.lit("SMA type 1"))) == "subtype_qualifier_changed"


def test_entity_id_is_the_hash_of_compact_json(spark):
    import hashlib

    expected = hashlib.sha256('["literature","Gene","SMN1"]'.encode()).hexdigest()
    assert one(spark, identity.entity_id(F.lit("literature"), F.lit("Gene"), F.lit(" SMN1 "))) == expected


def test_text_expressions(spark):
    assert one(spark, text.sentences(F.lit("One 1.5 mg.  Two!\nThree"))) == ["One 1.5 mg.", "Two!", "Three"]
    assert one(spark, text.repaired_ids(F.lit("12,345,678,123,456,78"))) == ["12", "345", "678", "123", "456", "78"]
    assert one(spark, text.repaired_ids(F.lit("12,345,678,012,345,678"))) == ["12345678", "01234567", "8"]
    assert one(spark, text.repaired_ids(F.lit("123, 456789"))) == ["123", "456789"]
    v = one(spark, text.verdict(F.lit('```json\n{"supported": true, "confidence": 3, "evidence_text": "x"}\n```')))
    assert (v["supported"], v["confidence"], v["evidence_text"]) == (True, 1.0, "x")
    assert one(spark, text.verdict(F.lit("no json")))["supported"] is False
    assert one(spark, text.first_grade(F.lit("grade: 2 of 2"))) == 2 and one(spark, text.first_grade(F.lit("none"))) == 0
    assert one(spark, text.has_term(F.lit("smn1 rises"), "smn")) is False and one(spark, text.has_term(F.lit("(smn) rises"), "SMN")) is True


def test_hash_split_equals_python(spark):
    import hashlib

    for key in ("1", "42", "x"):
        expected = "development" if int(hashlib.sha256(f"20261002:{key}".encode()).hexdigest()[:8], 16) % 10 < 3 else "test"
        assert one(spark, text.hash_split(F.lit(key))) == expected
