"""Evidence operators: location, validation, screening and rule extraction as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import spans, text
from loomgraph.functions.identity import identity_form, squeeze

SEGMENT = "struct<field:string,start:int,end:int,text:string>"
SUGGESTION = "struct<field:string,start:int,end:int,text:string,similarity:double>"


def join_sources(records: DataFrame, abstracts: DataFrame) -> DataFrame:
    """Records with title, abstract and has_source; abstracts are unique by pmid."""
    sources = abstracts.select(F.col("pmid").alias("source_pmid"), "title", "abstract", F.lit(True).alias("__has"))
    return records.join(sources, "source_pmid", "left").withColumn("has_source", F.coalesce("__has", F.lit(False))).drop("__has")


def location_simple(span: Column, title: Column, abstract: Column, has_source: Column) -> Column:
    """exact, case_whitespace_match, not_located, missing_evidence or missing_source; native."""
    quote = F.trim(F.coalesce(span, F.lit("")))

    def inside(needle: Column, change) -> Column:
        return F.contains(change(F.coalesce(title, F.lit(""))), needle) | F.contains(change(F.coalesce(abstract, F.lit(""))), needle)

    return (
        F.when(~has_source, "missing_source")
        .when(quote == "", "missing_evidence")
        .when(inside(quote, lambda c: c), "exact")
        .when(inside(F.lower(squeeze(quote)), lambda c: F.lower(squeeze(c))), "case_whitespace_match")
        .otherwise("not_located")
    )


def exact_in_joined(span: Column, title: Column, abstract: Column) -> Column:
    """Whether the lower-cased quote stands in the lower-cased title and abstract, joined by a blank."""
    joined = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))))
    quote = F.lower(F.trim(F.coalesce(span, F.lit(""))))
    return (quote != "") & F.contains(joined, quote)


def _plain(c: Column) -> Column:
    """A plain text's folded form, its white space aside: as long as the text, so places in it are places in the text."""
    return F.lower(F.translate(c, "".join(spans.DASHES_AND_QUOTES), "".join(spans.DASHES_AND_QUOTES.values())))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def _single(folded: Column) -> Column:
    """Folded text with single white space."""
    return F.regexp_replace(folded, r"\s+", " ")


def _origin(text: Column, single: Column, place: Column) -> Column:
    """The place in a plain text of a place in its single form: as much further on as its runs of white space before that are longer than one."""
    before = F.substring(single, F.lit(1), place)
    blanks = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
    more = F.slice(F.regexp_extract_all(text, F.lit(r"\s+"), F.lit(0)), F.lit(1), blanks)
    moved = place + F.aggregate(more, F.lit(0), lambda total, run: total + F.length(run) - 1)
    return F.when(F.length(single) == F.length(text), place).otherwise(moved)


def _piece(text: Column, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.substring(text, start + 1, end - start).alias("text"))


def _pieces(text: Column, needles: Column) -> Column:
    """The places of folded needles in a text, each the first after the one before; null if one isn't there."""
    kind = "struct<at:int,found:array<struct<a:int,b:int>>>"

    def within(single: Column) -> Column:
        def step(state: Column, needle: Column) -> Column:
            place = F.position(needle, single, state["at"])
            end = place + F.length(needle)
            there = F.struct(end.alias("at"), F.concat(state["found"], F.array(F.struct((place - 1).alias("a"), (end - 1).alias("b")))).alias("found")).cast(kind)
            return F.when(state.isNotNull() & (place > 0), there)

        found = F.aggregate(needles, F.struct(F.lit(1).alias("at"), F.array().alias("found")).cast(kind), step)["found"]
        return F.transform(found, lambda p: _piece(text, _origin(text, single, p["a"]), _origin(text, single, p["b"])))

    # An array of one: the folded text is made once and has a name, wherever it is looked at.
    return F.get(F.transform(F.array(_single(_plain(text))), within), F.lit(0))


def native_segments(quote: Column, title: Column, abstract: Column, written: bool = False) -> Column:
    """array<struct(status, field, start, end, text)> of the first tier that finds a plain quote, null if none does; quote is stripped and not empty.

    The tiers are exact, normalized and ordered_fragments, each tried in title and abstract before the next. Folded forms
    with single white space are searched; parts around an ellipsis one after the other, by an aggregate
    that carries the place reached. Places are then carried back past the white space that was left out.
    """
    fields = {"title": F.coalesce(title, F.lit("")), "abstract": F.coalesce(abstract, F.lit(""))}
    raw = F.split(quote, spans.ELLIPSIS)
    parts = F.transform(raw, lambda part: F.trim(_single(_plain(part))))
    good = F.forall(F.transform(raw, _stripped) if written else parts, lambda p: (F.length(p) >= spans.LEAST_PIECE) & p.rlike(r"[\p{L}\p{N}_]"))

    def found(status: str, name: str, pieces: Column) -> Column:
        return F.transform(pieces, lambda p: F.struct(F.lit(status).alias("status"), F.lit(name).alias("field"), p["start"].alias("start"), p["end"].alias("end"), p["text"].alias("text")))

    def tier(status: str, pieces) -> list[Column]:
        return [found(status, name, pieces(text)) for name, text in fields.items()]

    exact = tier("exact", lambda text: F.when(F.contains(text, quote), F.array(_piece(text, F.position(quote, text) - 1, F.position(quote, text) - 1 + F.length(quote)))))
    folded = tier("normalized", lambda text: _pieces(text, F.array(_single(_plain(quote)))))
    fragments = tier("ordered_fragments", lambda text: F.when((F.size(parts) > 1) & good, _pieces(text, parts)))
    # coalesce looks at each only where those before found nothing.
    return F.when(is_plain(quote), F.coalesce(*exact, F.when(is_plain(*fields.values()), F.coalesce(*folded, *fragments))))


def is_plain(*texts: Column) -> Column:
    """Whether native_location may decide: no character whose folding changes more than its case."""
    pattern = rf"\A{spans.plain_characters()}*+\z"
    plain = F.lit(True)
    for text in texts:
        plain &= F.coalesce(text, F.lit("")).rlike(pattern)
    return plain


def locate(records: DataFrame, suggest: bool = True, written: bool = False) -> DataFrame:
    """Records (joined with sources) with `location`: status, segments, suggestion.

    Tiers are native columns wherever the texts are plain, which most Latin text is. Python, in Arrow batches,
    has the similarity tier (only quotes that no other tier found) and texts with characters that fold to others;
    other rows pass it by as nulls. written: parts around an ellipsis must be long enough as they are written, not as folded.
    """
    kind = f"struct<status:string,segments:array<{SEGMENT}>,suggestion:{SUGGESTION}>"

    @F.pandas_udf(kind)
    def tiers(hard: pd.Series, quote: pd.Series, title: pd.Series, abstract: pd.Series) -> pd.DataFrame:
        none = {"status": None, "segments": [], "suggestion": None}
        rows = [spans.locate(q, {"title": t or "", "abstract": a or ""}, suggest, written) if h else none for h, q, t, a in zip(hard, quote, title, abstract)]
        return pd.DataFrame(rows, columns=["status", "segments", "suggestion"])

    quote, title, abstract = _stripped(F.col("evidence_text")), F.col("title"), F.col("abstract")
    tried = records.withColumn("__found", F.when(quote != "", native_segments(quote, title, abstract, written)))
    lost = F.col("__found").isNull() & (quote != "")
    hard = lost if suggest else lost & ~is_plain(quote, title, abstract)
    tried = tried.withColumn("__hard", hard | ((quote == "") & ~is_plain(F.col("evidence_text"))))
    slow = tiers("__hard", *[F.when(F.col("__hard"), F.col(c)) for c in ("evidence_text", "title", "abstract")])
    status = F.coalesce(F.get("__found", F.lit(0))["status"], F.when(quote == "", "missing_evidence").otherwise("not_located"))
    segments = F.transform(F.coalesce("__found", F.array()), lambda p: F.struct(p["field"].alias("field"), p["start"].alias("start"), p["end"].alias("end"), p["text"].alias("text")))
    native = F.struct(status.alias("status"), segments.alias("segments"), F.lit(None).cast(SUGGESTION).alias("suggestion")).cast(kind)
    return tried.withColumn("__slow", slow).withColumn("location", F.when(F.col("__hard"), F.col("__slow")).otherwise(native)).drop("__found", "__hard", "__slow")


def quote_places(docs: DataFrame, quotes: DataFrame, doc: str, quote: str, text: str = "text", quoted: str = "quote", words: int = 5) -> DataFrame:
    """(doc, quote, start) of each document and each quote that stands in it as it is, and where first.

    A quote's words but its first and last are whole words of a text that holds it, so a run of up to `words` of
    them is a run of the text's. Documents and quotes meet by hashes of such runs, of as many words as the
    quote allows, and pairs are then compared: runs carry the document's key and no text. A quote of
    one or two words has no whole word inside; the letters that it and a text must share are its first three, wherever they
    stand. Documents must have unique keys.
    """
    keyed = quotes.select(quote, quoted).where(F.coalesce(F.col(quoted), F.lit("")) != "").withColumn("__w", F.split(quoted, r"\s+"))
    # The length of a run is part of its key; below 0 it is of letters, of which a quote of fewer than three has its first.
    inner, letters = F.least(F.size("__w") - 2, F.lit(words)), F.least(F.length(quoted), F.lit(_LETTERS))
    run = F.when(inner > 0, F.slice("__w", 2, inner)).otherwise(F.slice(F.split(quoted, ""), 1, letters))
    keyed = keyed.select(quote, quoted, F.when(inner > 0, inner).otherwise(-letters).alias("__n"), F.xxhash64(run).alias("__h"))
    body = docs.select(doc, text).where(F.col(text).isNotNull())
    out = body.select(doc, F.lit(None).cast(keyed.schema[quote].dataType).alias(quote), F.lit("").alias(quoted)).where("false")
    for (n,) in sorted(keyed.select("__n").distinct().collect()):  # words + _LETTERS rows at most
        cut = body.withColumn("__w", F.split(text, r"\s+" if n > 0 else "")).where(F.size("__w") >= abs(n))
        runs = cut.select(doc, F.explode(_runs("__w", abs(n))).alias("__h"))
        out = out.unionAll(runs.join(keyed.where(F.col("__n") == n).drop("__n"), "__h").select(doc, quote, quoted).distinct())
    at = F.position(F.col(quoted), F.col(text))
    return out.join(body, doc).where(at > 0).select(doc, quote, (at - 1).alias("start")).distinct()


_LETTERS = 3


def _runs(items: str, n: int) -> Column:
    """Hashes of all runs of n items of an array."""
    places = F.sequence(F.lit(1), F.size(items) - n + 1)
    return F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.slice(items, i, F.lit(n)))))


def _with_aliases(records: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """Records with a1 and a2, the names that the dictionary holds for the same entity, by joins.

    An alias stands for all aliases of its canonical name. Names are compared as identity forms.
    """
    if dictionary is None:
        none = F.array().cast("array<string>")
        return records.withColumns({"a1": none, "a2": none})
    entries = dictionary.select(F.lower("type").alias("t"), "alias", "canonical", identity_form(F.col("canonical")).alias("c"))
    groups = entries.groupBy("t", "c").agg(F.array_union(F.collect_set("canonical"), F.collect_set("alias")).alias("names"))
    known = groups.select("t", "names", F.explode(F.array_union(F.array("c"), "names")).alias("name"))
    known = known.groupBy("t", identity_form(F.col("name")).alias("n")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    out = records
    for k in ("1", "2"):
        side = known.select(F.col("t").alias("__t"), F.col("n").alias("__n"), F.col("names").alias(f"a{k}"))
        form = identity_form(F.coalesce(F.col(f"entity_{k}.name"), F.lit("")))
        out = out.withColumn("__form", form).join(side, (F.lower(F.col(f"entity_{k}.type")) == F.col("__t")) & (F.col("__form") == F.col("__n")), "left").drop("__t", "__n", "__form")
    return out.withColumns({a: F.coalesce(a, F.array().cast("array<string>")) for a in ("a1", "a2")})


def _over_rows(records: DataFrame, dictionary: DataFrame | None, fields: str, make) -> DataFrame:
    """make(row, entities, source) of each record with a source, in Arrow batches; `fields` without seq."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                source = {"title": r["title"] or "", "abstract": r["abstract"] or ""}
                entities = [(r[f"n{k}"] or "", r[f"t{k}"] or "", list(r[f"a{k}"])) for k in ("1", "2")]
                rows.append({"seq": r["seq"], **make(r, entities, source)})
            yield pd.DataFrame(rows, columns=["seq", *names])

    names = [f.split(" ")[0] for f in fields.split(", ")]
    sourced = _with_aliases(records.where("has_source"), dictionary)
    slim = sourced.select("seq", "relation", "evidence_text", "title", "abstract", "a1", "a2", *[F.col(f"entity_{k}.{c}").alias(f"{c[0]}{k}") for k in ("1", "2") for c in ("name", "type")])
    return slim.mapInPandas(run, f"seq bigint, {fields}")


def _without_source(records: DataFrame, fields: str, **values: Column) -> DataFrame:
    """The same columns for records without a source, natively: null but for `values`."""
    kinds = [f.split(" ", 1) for f in fields.split(", ")]
    return records.where(~F.col("has_source")).select("seq", *[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds])


def validate(records: DataFrame, dictionary: DataFrame | None = None, suggest: bool = True) -> DataFrame:
    """(seq, status, segments, suggestion, coverage, flags, traceable, eligible) of records joined with sources.

    Aliases come by joins, and records without a source are decided natively; the others need
    text that keeps its offsets while it is normalised, in Arrow batches.
    """
    fields = f"status string, segments array<{SEGMENT}>, suggestion {SUGGESTION}, coverage array<boolean>, flags array<string>, traceable boolean, eligible boolean"
    found = _over_rows(records, dictionary, fields, lambda r, e, s: spans.validate(r["evidence_text"], [(n, a) for n, _, a in e], s, suggest))
    no, missing = F.lit(False), F.lit("missing_source")
    return found.unionByName(_without_source(records, fields, status=missing, segments=F.array(), coverage=F.array(no, no), flags=F.array(missing), traceable=no, eligible=no))


def screen(records: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(seq, status, segments, flags, contexts, candidate, review_status) of records joined with sources."""
    context = "struct<field:string,start:int,end:int,text:string,scope_cues:array<string>>"
    fields = f"status string, segments array<{SEGMENT}>, flags array<string>, contexts array<{context}>, candidate boolean, review_status string"
    keys = ("status", "segments", "flags", "contexts", "candidate", "review_status")

    def make(r, entities, source):
        found = spans.screen(r["evidence_text"], r["relation"] or "", entities, source)
        return {k: found[k] for k in keys}

    doubts = [F.when(type_doubt(k).isNotNull(), F.concat(F.lit(f"entity_{k}:"), type_doubt(k))) for k in ("1", "2")]
    flags = F.array_sort(F.array_compact(F.array(F.lit("missing_source"), *doubts)))
    alone = _without_source(records, fields, status=F.lit("missing_source"), segments=F.array(), flags=flags, contexts=F.array(), candidate=F.lit(False), review_status=F.lit("needs_review"))
    return _over_rows(records, dictionary, fields, make).unionByName(alone)


@F.pandas_udf(T.StringType())
def _type_flag(name: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([spans.type_flag(n or "", k or "") for n, k in zip(name, kind)], dtype=object)


def type_doubt(n: str) -> Column:
    """The first doubt about the type of entity_n, null without one."""
    return _type_flag(F.col(f"entity_{n}.name"), F.col(f"entity_{n}.type"))


def flag_histogram(screened: DataFrame) -> DataFrame:
    return screened.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


# The rule extractor's lexicon, in order.
DRUGS = (("nusinersen", "Nusinersen"), ("spinraza", "Nusinersen"), ("risdiplam", "Risdiplam"), ("evrysdi", "Risdiplam"), ("zolgensma", "Onasemnogene Abeparvovec"), ("onasemnogene abeparvovec", "Onasemnogene Abeparvovec"))
GENES = (("smn1", "SMN1"), ("smn2", "SMN2"), ("smn", "SMN"))
DISEASES = (("spinal muscular atrophy", "Spinal Muscular Atrophy"), ("sma", "Spinal Muscular Atrophy"))
PHENOTYPES = (
    ("motor function", "motor function"),
    ("motor milestone", "motor milestones"),
    ("motor milestones", "motor milestones"),
    ("muscle weakness", "muscle weakness"),
    ("survival", "survival"),
    ("respiratory", "respiratory function"),
)


def rule_triples(
    abstracts: DataFrame,
    drugs=DRUGS,
    genes=GENES,
    diseases=DISEASES,
    phenotypes=PHENOTYPES,
    treat: str = text.TREAT_CUE,
    improve: str = text.IMPROVE_CUE,
    associate: str = text.ASSOCIATE_CUE,
    negation: str = text.NEGATION_CUE,
) -> DataFrame:
    """Records (source_pmid, entity_1, relation, entity_2, evidence_text, extracted_by) that cue rules find in sentences.

    A sentence with a negation gives none. Two terms of one name give two records, which
    first-seen de-duplication removes. All of it is expressions over sentence arrays.
    """
    each = abstracts.select(F.col("pmid").alias("source_pmid"), F.posexplode(text.sentences(F.col("abstract"))).alias("at", "sentence"))
    lowered = F.lower("sentence")
    # Every rule starts from a drug or a gene: most sentences hold neither and go by one pattern.
    each = each.where(text.has_any_term(lowered, (*drugs, *genes))).where(~F.col("sentence").rlike(negation)).select(
        "source_pmid", "at", "sentence",
        text.terms_present(lowered, drugs).alias("drugs"),
        text.terms_present(lowered, genes).alias("genes"),
        F.get(text.terms_present(lowered, diseases), F.lit(0)).alias("disease"),
        text.terms_present(lowered, phenotypes).alias("phenotypes"),
    )

    def entity(name: Column, kind: str) -> Column:
        return F.struct(name.alias("name"), F.lit(kind).alias("type"))

    def triple(first: Column, relation: str, second: Column) -> Column:
        return F.struct(first.alias("entity_1"), F.lit(relation).alias("relation"), second.alias("entity_2"))

    has_disease = F.col("disease").isNotNull()
    disease = entity(F.col("disease"), "Disease")
    none = F.expr("array()").cast("array<struct<entity_1:struct<name:string,type:string>,relation:string,entity_2:struct<name:string,type:string>>>")
    treats = F.when(has_disease & F.col("sentence").rlike(treat), F.transform("drugs", lambda d: triple(entity(d, "Drug"), "TREATS", disease)))
    improves = F.when(F.col("sentence").rlike(improve), F.flatten(F.transform("drugs", lambda d: F.transform("phenotypes", lambda p: triple(entity(d, "Drug"), "IMPROVES", entity(p, "Phenotype"))))))
    linked = F.when(has_disease & F.col("sentence").rlike(associate), F.transform("genes", lambda g: triple(entity(g, "Gene"), "ASSOCIATED_WITH", disease)))
    found = F.concat(*[F.coalesce(x, none) for x in (treats, improves, linked)])
    rows = each.select("source_pmid", "at", "sentence", F.posexplode(found).alias("k", "t"))
    return rows.select("source_pmid", "t.entity_1", "t.relation", "t.entity_2", F.col("sentence").alias("evidence_text"), F.lit("Rule_Candidate").alias("extracted_by"), "at", "k")
