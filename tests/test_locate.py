"""The native tiers of location against the plain version, and where quotes stand without their texts in the exchange."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import spans
from loomgraph.operators import evidence

PLAIN = "The patient's Dose—level was RAISED, and “quoted” text... with é À x- 12 (a) [b] \\Q ends. Next Line\n\n and\tmore here! _ $1 a|b (?i) dose the was was".split(" ")
FOLDING = ["ß", "ﬁne", "…", "İx", "ſ", "𝔘", "x\xa0y", "\x1cz"]


def cases(rng, extra, n):
    rows = []
    for k in range(n):
        vocabulary = PLAIN + extra
        title, abstract = " ".join(rng.choices(vocabulary, k=rng.randint(0, 8))), rng.choice([" ", "  ", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 25)))
        words = rng.choice([title, abstract]).split(" ")
        at = rng.randrange(len(words))
        quote = " ".join(words[at : at + rng.randint(0, 9)])
        way = rng.randint(0, 6)
        if way == 1:
            quote = quote.upper()
        elif way == 2:
            quote = quote.replace(" ", "  ") + " "
        elif way == 3:
            words = quote.split(" ")
            cut = rng.randint(0, len(words))
            quote = " ".join(words[:cut]) + rng.choice(["...", "…", " .... "]) + " ".join(words[cut + rng.randint(0, 2) :])
        elif way == 4:
            quote = quote.replace("—", "-").replace("“", '"')
        elif way == 5:
            quote = "\n" + quote + "\t"
        rows.append((k, quote if k % 50 else None, title if k % 7 else None, abstract if k % 11 else None, True))
    return rows


def placed(quote, title, abstract, suggest):
    found = spans.locate(quote, {"title": title or "", "abstract": abstract or ""}, suggest)
    return found["status"], [(s["field"], s["start"], s["end"], s["text"]) for s in found["segments"]], found["suggestion"] and found["suggestion"]["similarity"]


@pytest.mark.parametrize("suggest", [False, True])
def test_location_is_that_of_the_plain_version(spark, suggest):
    rng = random.Random(4)
    rows = cases(rng, [], 900) + [(900 + k, *r[1:]) for k, r in enumerate(cases(rng, FOLDING, 400))]
    long = " ".join(f"word{k}" for k in range(20_000))
    rows += [(1300, long.upper(), "", long, True), (1301, long[:90_000] + " ... " + long[-50_000:], "t", long, True), (1302, "x", None, None, True)]
    df = spark.createDataFrame(rows, "seq int, evidence_text string, title string, abstract string, has_source boolean").repartition(4)
    located = {r["seq"]: r["location"] for r in evidence.locate(df, suggest).collect()}
    seen = set()
    for seq, quote, title, abstract, _ in rows:
        got = located[seq]
        found = got["status"], [tuple(s) for s in got["segments"]], got["suggestion"] and got["suggestion"]["similarity"]
        assert found == placed(quote, title, abstract, suggest), seq
        seen.add(got["status"])
    assert seen == {"exact", "normalized", "ordered_fragments", "not_located", "missing_evidence"}
    quote, title, abstract = evidence._stripped(F.col("evidence_text")), F.col("title"), F.col("abstract")
    plain = df.where(evidence.is_plain(quote, title, abstract) & (quote != ""))
    native = {r["seq"]: r["found"] for r in plain.select("seq", evidence.native_segments(quote, title, abstract).alias("found")).collect()}
    assert len(native) > 700 and {"exact", "normalized", "ordered_fragments"} <= {p["status"] for r in native.values() for p in r or ()}
    for seq, text, *fields, _ in rows:
        if seq in native:
            status, segments, _ = placed(text, *fields, False)
            assert [tuple(p) for p in native[seq] or ()] == [(status, *s) for s in segments]


def test_quotes_of_any_length_are_found_without_a_product(spark):
    rng = random.Random(6)
    words = ["a", "bb", "the", "house", "stands", "ab"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 30))) if k % 13 else None) for k in range(120)]
    texts = [t for _, t in docs if t]
    quotes = [(k, t[i : i + rng.choice([1, 2, 3, 5, 9, 20, 60])]) for k, t in enumerate(rng.choices(texts, k=150)) for i in [rng.randrange(len(t))]]
    quotes += [(900, ""), (901, None), (902, "absent"), (903, "x" * 50)]
    df, items = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(quotes, "item_id int, quote string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = evidence.quote_places(df, items, "doc_id", "item_id")
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted((d, q, t.find(x)) for d, t in docs if t is not None for q, x in quotes if x and x in t)
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert evidence.quote_places(df, items.limit(0), "doc_id", "item_id").collect() == []


def test_pieces_are_measured_as_written_where_wanted(spark):
    """Four letters that fold to five, and five that fold to four: SQL counts what is written."""
    rows = [(1, "first words ... ßäau", None, "First words and then ßäau.", True), (2, "first words ... ab  c", None, "First words and ab  c.", True), (3, "first words ... ßäauß", None, "First words, ßäauß.", True)]
    df = spark.createDataFrame(rows, "seq int, evidence_text string, title string, abstract string, has_source boolean")
    for written, want in ((False, ["ordered_fragments", "not_located", "ordered_fragments"]), (True, ["not_located", "ordered_fragments", "ordered_fragments"])):
        got = {r["seq"]: r["location"]["status"] for r in evidence.locate(df, False, written).collect()}
        assert [got[k] for k in (1, 2, 3)] == want
        assert [spans.locate(q, {"title": "", "abstract": a}, False, written)["status"] for _, q, _, a, _ in rows] == want


def test_fragments_query_is_its_sql_with_a_folding_letter(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    texts = ["Auferieberau erüberlich iesch von ßäau. Eren ßäau.", "Enheitber chtzä chölich, pfkeiter ßöer. Einbebe die.", "One two three four fivesix. More."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(db.execute(entry.oracle_sql()["locate_fragments"]).fetchall())
    assert sorted(map(tuple, entry.queries()["locate_fragments"](spark, str(tmp_path)).collect())) == want


def test_each_tier_folds_a_field_once(spark):
    """Two tiers fold two fields, both need the quote's or its parts' form; runs of white space count where there are any."""
    rows = [(1, "B  C d", None, "a\n\nb c  d", True), (2, "ONE two", "x", "zero one two", True), (3, "absent", "", "x", True)]
    df = spark.createDataFrame(rows, "seq int, evidence_text string, title string, abstract string, has_source boolean")
    found = df.select("seq", evidence.native_segments(F.col("evidence_text"), F.col("title"), F.col("abstract")).alias("found"))
    assert {r["seq"]: [tuple(p) for p in r["found"] or ()] for r in found.collect()} == {1: [("normalized", "abstract", 3, 9, "b c  d")], 2: [("normalized", "abstract", 5, 12, "one two")], 3: []}
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("translate(coalesce(title") == plan.count("translate(coalesce(abstract") == 2
