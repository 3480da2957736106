"""Evaluation statistics: precision and recall, support, gates, reviews, novelty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scoring
from loomgraph.functions.fuzzy import fuzzy_pairs
from loomgraph.functions.spans import SENTENCE_GAP
from loomgraph.functions.vocabulary import lookup

LABELS = ("2", "1", "0", "U")
CHECKS = ("entity_1_correct", "entity_2_correct", "relation_correct", "direction_correct", "evidence_span_correct")


def set_metrics(found: DataFrame, expected: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """(group, extracted, expected, true_positives, false_positives, false_negatives, precision, recall, f1) of distinct tuples."""
    mine = found.select(group, *keys).distinct()
    truth = expected.select(*keys).distinct()
    n_truth = truth.agg(F.count(F.lit(1)).alias("expected"))
    marked = mine.join(truth.withColumn("__hit", F.lit(True)), list(keys), "left")
    counts = marked.groupBy(group).agg(F.count(F.lit(1)).alias("extracted"), F.count("__hit").alias("true_positives")).join(F.broadcast(n_truth))
    p, r, f1 = scoring.precision_recall_f1(F.col("true_positives"), F.col("extracted"), F.col("expected"))
    return counts.select(
        group, "extracted", "expected", "true_positives",
        (F.col("extracted") - F.col("true_positives")).alias("false_positives"),
        (F.col("expected") - F.col("true_positives")).alias("false_negatives"),
        p.alias("precision"), r.alias("recall"), f1.alias("f1"),
    )


def disease_genes(records: DataFrame, synonyms: Sequence[str], kinds: Sequence[str] = ("Gene", "Protein")) -> DataFrame:
    """(extracted_by, gene) of records that link a gene or protein with the disease, in either direction."""
    names = [s.lower() for s in synonyms]
    n1, n2 = F.lower(F.trim("entity_1.name")), F.lower(F.trim("entity_2.name"))
    first = F.when(F.col("entity_1.type").isin(list(kinds)) & n2.isin(names), n1)
    second = F.when(F.col("entity_2.type").isin(list(kinds)) & n1.isin(names), n2)
    return records.select("extracted_by", F.explode(F.array_compact(F.array(first, second))).alias("gene"))


def fuzzy_set_metrics(found: DataFrame, baseline: DataFrame, column: str, baseline_column: str, group: str, least: float = 85.0) -> DataFrame:
    """Precision over found names with a similar baseline name, recall over baseline names with a similar found one."""
    pairs = fuzzy_pairs(found.select(column), baseline.select(baseline_column), column, baseline_column, least)
    mine = found.select(group, column).distinct()
    total = baseline.where(F.col(baseline_column).isNotNull()).select(baseline_column).distinct().agg(F.count(F.lit(1)).alias("expected"))
    joined = mine.join(pairs, column, "left")
    counts = joined.groupBy(group).agg(
        F.count_distinct(column).alias("extracted"),
        F.count_distinct(F.when(F.col(baseline_column).isNotNull(), F.col(column))).alias("hits"),
        F.count_distinct(baseline_column).alias("hits_expected"),
    ).join(F.broadcast(total))
    p, r, f1 = scoring.precision_recall_f1(F.col("hits"), F.col("extracted"), F.col("expected"), F.col("hits_expected"))
    return counts.select(group, "extracted", "expected", "hits", "hits_expected", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def novelty(records: DataFrame, baseline: DataFrame, synonyms: Sequence[str], engine_part: str = "LLM") -> DataFrame:
    """Genes linked with the disease that the baseline (column gene, lower case) lacks, by gene, relation and context.

    The first direction that fits decides: where it fits with a known gene, the second isn't tried.
    """
    names, kinds = [s.lower() for s in synonyms], ["Gene", "Protein"]
    n1, n2 = F.lower(F.trim("entity_1.name")), F.lower(F.trim("entity_2.name"))
    first = F.col("entity_1.type").isin(kinds) & n2.isin(names)
    second = F.col("entity_2.type").isin(kinds) & n1.isin(names)
    pick = F.when(first, F.struct(n1.alias("key"), F.col("entity_1.name").alias("gene"), F.col("entity_2.name").alias("context"))).when(
        second, F.struct(n2.alias("key"), F.col("entity_2.name").alias("gene"), F.col("entity_1.name").alias("context"))
    )
    linked = records.where(F.contains(F.coalesce("extracted_by", F.lit("")), F.lit(engine_part))).withColumn("p", pick).where("p IS NOT NULL")
    new = linked.join(baseline.select(F.col("gene").alias("__g")).distinct(), F.col("p.key") == F.col("__g"), "left_anti")
    grouped = new.groupBy(F.col("p.key").alias("key"), F.col("relation").alias("Relation_Type"), F.col("p.context").alias("Context_Entity")).agg(
        F.min_by("p.gene", "seq").alias("Novel_Gene"),
        F.sort_array(F.collect_set("source_pmid")).alias("pmids"),
        F.avg("computed_confidence").alias("__mean"),
    )
    return grouped.select("Novel_Gene", "Relation_Type", "Context_Entity", F.array_join("pmids", ", ").alias("Evidence_PMIDs"), F.size("pmids").alias("Number_of_Mentions"), F.bround("__mean", 4).alias("Confidence_Score"))


def support_statistics(df: DataFrame, group: str, label: str = "support_label", cluster: str = "source_pmid") -> DataFrame:
    """Label counts, strict and lenient support among resolved rows, bounds over all rows and a Wilson interval, by group."""
    n = {k: F.count_if(F.col(label) == k) for k in LABELS}
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(cluster).alias("unique_pmids"), *[v.alias(f"label_{k}") for k, v in n.items()])
    resolved = F.col("n") - F.col("label_U")
    low, high = scoring.wilson(F.col("label_2"), resolved)
    return counts.select(
        "*",
        scoring.ratio(F.col("label_2"), resolved).alias("strict_support"),
        scoring.ratio(F.col("label_2") + F.col("label_1"), resolved).alias("lenient_support"),
        scoring.ratio(F.col("label_U"), F.col("n")).alias("unknown_fraction"),
        scoring.ratio(F.col("label_2"), F.col("n")).alias("strict_low"),
        scoring.ratio(F.col("label_2") + F.col("label_U"), F.col("n")).alias("strict_high"),
        low.alias("wilson_low"),
        high.alias("wilson_high"),
    )


def error_histogram(df: DataFrame, group: str, error: str = "error_type") -> DataFrame:
    """(group, error_type, n): errors that reviewers recorded."""
    named = F.coalesce(F.nullif(F.trim(F.col(error)), F.lit("")), F.lit("not_recorded"))
    return df.groupBy(F.col(group), named.alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


# How reviewers write the label of a span, in two languages.
SPAN_LABELS = {"yes": "yes", "no": "no", "unclear": "unclear", "合格": "yes", "不合格": "no", "无法判断": "unclear"}


def span_label(raw: Column) -> Column:
    """A reviewer's span label as yes, no or unclear; null for anything else."""
    return lookup(SPAN_LABELS, F.trim(F.coalesce(raw, F.lit(""))))


def decision_accepted(decision: Column, title: Column, abstract: Column) -> Column:
    """Whether a model's decision is accepted, from struct<support, entity_types_correct, direction_correct,
    conditions_preserved: boolean, missing_conditions: array, source_field, evidence_quote>.

    Fails closed: a null, an open condition or a quote that isn't whole sentences of the named
    field is a refusal. A mark takes the place of each gap between sentences, in text and quote
    alike, so a quote of whole sentences is one that stands between marks.
    """
    quote = F.trim(decision["evidence_quote"])
    gap, mark = rf"(?:{SENTENCE_GAP})\s*", "\u0001"

    def marked(text: Column) -> Column:
        return F.concat(F.lit(mark), F.regexp_replace(F.trim(text), gap, f"$1{mark}"), F.lit(mark))

    whole = F.when(decision["source_field"] == "title", quote == F.trim(title)).when(decision["source_field"] == "abstract", F.contains(marked(abstract), marked(quote)))
    says = decision["entity_types_correct"] & decision["direction_correct"] & decision["conditions_preserved"] & (F.size(decision["missing_conditions"]) == 0)
    return F.coalesce((decision["support"] == "direct") & says & (quote != "") & whole, F.lit(False))


def candidate_gates(candidates: DataFrame, screens: DataFrame, decisions: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Candidates with their gates: evidence (eligible), context (candidate) of screens, model (accepted) of decisions, and both.

    A candidate without a screen or a decision doesn't pass the gates that need it.
    """
    joined = candidates.join(screens.select(key, "eligible", "candidate"), key, "left").join(decisions.select(key, "accepted"), key, "left")
    no = {c: F.coalesce(c, F.lit(False)) for c in ("eligible", "candidate", "accepted")}
    return joined.withColumns({"all_predictions": F.lit(True), "previous_evidence_triage": no["eligible"], "context_type_screen": no["candidate"], "model_direct_screen": no["accepted"], "combined_screen": no["accepted"] & no["eligible"]}).drop(*no)


def novelty_in_order(found: DataFrame) -> DataFrame:
    """novelty()'s rows with a rank, most mentions first; ties by gene, relation and context."""
    from loomgraph.sources.records import numbered

    keyed = found.withColumn("__less", F.negate("Number_of_Mentions"))
    return numbered(keyed, "__less", "Novel_Gene", "Relation_Type", "Context_Entity").withColumnRenamed("seq", "rank").drop("__less")


def gate_confusion(df: DataFrame, gates: dict[str, Column], group: str, split: str, span: str = "span_label", label: str = "support_label") -> DataFrame:
    """Confusion counts and rates of each gate by group, over all rows (`all`) and by split, in one aggregation."""
    out = F.array(*[F.struct(F.lit(name).alias("gate"), F.coalesce(passed, F.lit(False)).alias("keep")) for name, passed in gates.items()])
    rows = df.select(F.col(group).alias("sample_group"), F.col(split).alias("split"), F.col(span).alias("__span"), F.col(label).alias("__label"), F.explode(out).alias("g"))
    rows = rows.select("sample_group", "split", "__span", "__label", "g.gate", "g.keep")
    yes, no, strict, known = F.col("__span") == "yes", F.col("__span") == "no", F.col("__label") == "2", F.col("__label") != "U"
    keep = F.col("keep")
    grouped = rows.groupingSets([["gate", "sample_group"], ["gate", "sample_group", "split"]], "gate", "sample_group", "split").agg(
        F.grouping("split").alias("__all"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(yes & keep).alias("tp"),
        F.count_if(no & keep).alias("fp"),
        F.count_if(no & ~keep).alias("tn"),
        F.count_if(yes & ~keep).alias("fn"),
        F.count_if(keep).alias("retained"),
        F.count_if(keep & known).alias("__resolved"),
        F.count_if(keep & strict).alias("strict_retained"),
    )
    c = F.col
    return grouped.select(
        "gate", "sample_group", F.when(c("__all") == 1, "all").otherwise(c("split")).alias("split"),
        "n", "tp", "fp", "tn", "fn",
        scoring.ratio(c("tp"), c("tp") + c("fp")).alias("ppv"),
        scoring.ratio(c("tp"), c("tp") + c("fn")).alias("sensitivity"),
        scoring.ratio(c("tn"), c("tn") + c("fp")).alias("specificity"),
        "retained", scoring.ratio(c("retained"), c("n")).alias("retention"),
        scoring.ratio(c("strict_retained"), c("__resolved")).alias("strict_among_retained"),
    )


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pairs, raw agreement and nominal kappa (null if chance agreement is complete)."""
    table = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = table.agg(F.sum("n").alias("pairs"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    sides = table.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("v")), F.struct(F.lit(1).alias("side"), F.col("b").alias("v")))).alias("x"), "n")
    marginal = sides.groupBy("x.v").agg(F.sum(F.when(F.col("x.side") == 0, F.col("n")).otherwise(0)).alias("l"), F.sum(F.when(F.col("x.side") == 1, F.col("n")).otherwise(0)).alias("r"))
    chance = marginal.agg(F.sum(F.col("l") * F.col("r")).alias("lr"))
    row = total.join(F.broadcast(chance))
    n = F.col("pairs").cast("double")
    observed, expected = F.try_divide(F.col("same"), n), F.try_divide(F.col("lr"), n * n)
    return row.select(F.coalesce("pairs", F.lit(0)).cast("bigint").alias("pairs"), observed.alias("raw_agreement"), F.when(expected < 1, (observed - expected) / (F.lit(1.0) - expected)).alias("cohen_kappa"))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""


def review_issues(df: DataFrame) -> DataFrame:
    """Review rows with `issues` (codes), `final` (counts towards results) and final_label."""
    label, second, settled, status = (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("support_label", "second_support_label", "adjudicated_label", "review_status"))
    valid, required = label.isin(list(LABELS)), F.col("requires_second_review") == "yes"
    second_valid = second.isin(list(LABELS)) & ~_blank("second_reviewer_id") & ~_blank("second_review_date") & (F.col("second_reviewer_id") != F.col("reviewer_id"))
    incomplete, bad_check, contradicts = F.lit(False), F.lit(False), F.lit(False)
    for c in ("reviewer_id", "review_date", "error_type", *CHECKS):
        incomplete = incomplete | _blank(c)
    for c in CHECKS:
        bad_check = bad_check | ~F.coalesce(F.col(c), F.lit("")).isin("yes", "no", "unclear")
    for c in CHECKS[:4]:
        contradicts = contradicts | (F.coalesce(F.col(c), F.lit("")) != "yes")
    needs_notes = ((label != "2") | (F.coalesce(F.col("evidence_span_correct"), F.lit("")) != "yes")) & _blank("review_notes")
    tests = [(F.when((x != "") & ~x.isin(list(LABELS)), f"invalid_{n}")) for n, x in (("support_label", label), ("second_support_label", second), ("adjudicated_label", settled))]
    tests += [
        F.when(~status.isin("pending_review", "completed", "needs_adjudication", "excluded"), "invalid_review_status"),
        F.when(status == "excluded", "excluded_without_decision"),
        F.when(valid & incomplete, "incomplete_primary_review"),
        F.when(valid & bad_check, "invalid_check"),
        F.when(valid & (label == "2") & contradicts, "support_contradicts_checks"),
        F.when(valid & needs_notes, "notes_missing"),
        F.when(~valid & (status == "completed"), "completed_without_label"),
        F.when((second != "") & ~second_valid, "second_review_invalid"),
        F.when((settled != "") & _blank("adjudication_notes"), "adjudication_without_reason"),
    ]
    open_ = (required & ~second_valid) | (second_valid & valid & (label != second) & ~settled.isin(list(LABELS)))
    final = (status == "completed") & valid & ~open_
    return df.withColumns({"issues": F.array_compact(F.array(*tests)), "second_valid": second_valid, "final": final, "final_label": F.when(final, F.when(settled.isin(list(LABELS)), settled).otherwise(label))})


def review_summary(df: DataFrame) -> DataFrame:
    """By sample group: counts of final labels; rates only if every row of the group is final and no row at all has an issue."""
    rows = review_issues(df)
    issues = rows.agg(F.count_if(F.size("issues") > 0).alias("__issues"))
    counts = rows.groupBy("sample_group").agg(F.count(F.lit(1)).alias("sample_count"), F.count_if("final").alias("final_count"), *[F.count_if(F.col("final_label") == k).alias(f"final_{k}") for k in LABELS]).join(F.broadcast(issues))
    resolved = F.col("final_0") + F.col("final_1") + F.col("final_2")
    ready = (F.col("final_count") == F.col("sample_count")) & (F.col("__issues") == 0)
    low, high = scoring.wilson(F.col("final_2"), resolved)
    primary = ready & (F.col("sample_group") == "primary_random")
    return counts.select(
        "sample_group", "sample_count", "final_count", *[f"final_{k}" for k in LABELS], ready.alias("ready"),
        F.when(ready, scoring.ratio(F.col("final_2"), resolved)).alias("strict_rate"),
        F.when(ready, scoring.ratio(F.col("final_1") + F.col("final_2"), resolved)).alias("lenient_rate"),
        F.when(ready, scoring.ratio(F.col("final_2"), F.col("sample_count"))).alias("strict_low"),
        F.when(ready, scoring.ratio(F.col("final_2") + F.col("final_U"), F.col("sample_count"))).alias("strict_high"),
        F.when(primary, low).alias("wilson_low"), F.when(primary, high).alias("wilson_high"),
    )


def review_agreement(df: DataFrame) -> DataFrame:
    """One row: pairs of independent reviews, raw agreement and kappa of the labels as entered, before any adjudication."""
    pairs = review_issues(df).where(F.col("second_valid") & F.trim("support_label").isin(list(LABELS)))
    return cohen_kappa(pairs.select(F.trim("support_label").alias("a"), F.trim("second_support_label").alias("b")), "a", "b")


def graded_accuracy(df: DataFrame, score: str, group: str) -> DataFrame:
    """(group, n, strict, lenient, mean) of grades 0, 1, 2; what isn't a whole number is left out."""
    grade = F.col(score).cast("string").try_cast("int")
    known = df.select(group, grade.alias("g")).where("g IS NOT NULL")
    return known.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("g") == 2).cast("double")).alias("strict"), F.avg((F.col("g") >= 1).cast("double")).alias("lenient"), F.avg("g").alias("mean"))


def mapping_accuracy(queue: DataFrame, submission: DataFrame, judgment: str) -> DataFrame:
    """One row: reviewed, correct, accuracy and Wilson interval of a mapping stage; null rates until every queued id is judged once.

    Ids of the submission that the queue lacks, and repeated ones, count as problems.
    """
    per_id = submission.groupBy("review_id").agg(F.count(F.lit(1)).alias("n"), F.max(judgment).alias("j"))
    both = queue.select("review_id", F.lit(True).alias("queued")).join(per_id, "review_id", "full_outer")
    sums = both.agg(
        F.count("queued").alias("queued"),
        F.count_if(F.col("queued") & F.col("j").isin("correct", "incorrect", "unclear")).alias("reviewed"),
        F.count_if(F.col("queued") & (F.col("j") == "correct")).alias("correct"),
        F.count_if(F.col("queued") & F.col("j").isin("correct", "incorrect")).alias("decided"),
        F.count_if(F.col("queued").isNull() | (F.col("n") > 1)).alias("problems"),
    )
    done = (F.col("queued") == F.col("reviewed")) & (F.col("problems") == 0)
    low, high = scoring.wilson(F.col("correct"), F.col("decided"))
    return sums.select("queued", "reviewed", "correct", "problems", F.when(done, scoring.ratio(F.col("correct"), F.col("decided"))).alias("accuracy"), F.when(done, low).alias("wilson_low"), F.when(done, high).alias("wilson_high"))
