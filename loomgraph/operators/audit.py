"""Validation of record files and the audit of all inputs of an evaluation, as rows of counts."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators import checks, evidence, fusion, records
from loomgraph.sources.records import TRIPLE

#: Columns of a review row that a reviewer must not change.
PROTECTED = ("sample_group", "requires_second_review", "source_pmid", "title", "abstract", "entity_1_name", "entity_1_type", "relation", "entity_2_name", "entity_2_type", "evidence_text")


def validate_lines(lines: DataFrame, schema: T.StructType = TRIPLE, line: str = "line") -> DataFrame:
    """One row (records, bad_json_lines, invalid_triples, valid) of lines of JSON; blank ones don't count.

    An object that is no valid record, evidence aside, is invalid; so is JSON that is no object.
    """
    parsed = lines.where(F.trim(F.coalesce(F.col(line), F.lit(""))) != "").select(F.try_parse_json(line).alias("__value"), F.from_json(line, schema).alias("record"))
    checked = records.normalize(parsed.select("__value", "record.*"), require_evidence=False)
    good = F.col("__value").isNotNull()
    counts = checked.agg(F.count(F.lit(1)).alias("records"), F.count_if(~good).alias("bad_json_lines"), F.count_if(good & (F.size("problems") > 0)).alias("invalid_triples"))
    return counts.withColumn("valid", (F.col("bad_json_lines") == 0) & (F.col("invalid_triples") == 0))


def validate_file(spark: SparkSession, path: str) -> DataFrame:
    """validate_lines() of a file with its path, size and digest; `missing` and not valid where there is none."""
    from loomgraph.sources.sinks import exists, manifest

    if not exists(spark, path):
        none = [F.lit(0).cast("bigint").alias(c) for c in ("records", "bad_json_lines", "invalid_triples")]
        return spark.range(1).select(F.lit(path).alias("path"), *none, F.lit(False).alias("valid"), F.lit(True).alias("missing"), F.lit(None).cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("sha256"))
    files = manifest(spark, path).agg(F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("sha256"))
    rows = validate_lines(spark.read.text(path).withColumnRenamed("value", "line"))
    return rows.crossJoin(F.broadcast(files)).select(F.lit(path).alias("path"), "records", "bad_json_lines", "invalid_triples", "valid", F.lit(False).alias("missing"), "bytes", "sha256")


def _count(df: DataFrame, file: str, check: str, failing: Column | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if failing is None else F.count_if(failing)
    return df.agg(n.cast("bigint").alias("n")).select(F.lit(file).alias("file"), F.lit(check).alias("check"), "n")


def record_checks(name: str, rows: DataFrame, abstracts: DataFrame) -> DataFrame:
    """Records, invalid ones and ones without a source, of one stage."""
    known = abstracts.select(F.col("pmid").alias("source_pmid"), F.lit(True).alias("__known")).distinct()
    checked = records.normalize(rows).join(known, "source_pmid", "left")
    row = checked.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.size("problems") > 0).alias("schema_invalid"), F.count_if(F.col("__known").isNull()).alias("missing_sources"))
    pairs = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("n")) for c in ("records", "schema_invalid", "missing_sources")])
    return row.select(F.lit(name).alias("file"), F.explode(pairs).alias("x")).select("file", "x.check", "x.n")


def location_checks(raw: DataFrame, abstracts: DataFrame) -> DataFrame:
    """How many quotes are located how; a review matter and no failure."""
    joined = evidence.join_sources(raw, abstracts)
    status = evidence.location_simple(F.col("evidence_text"), F.col("title"), F.col("abstract"), F.col("has_source"))
    return joined.groupBy(status.alias("check")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("evidence_location").alias("file"), "check", "n")


def fused_checks(fused: DataFrame, aligned: DataFrame) -> DataFrame:
    """Edges that don't match their records, by problem, and edges that stand twice."""
    wrong = checks.provenance(fused, aligned, fusion.EDGE).groupBy(F.col("problem").alias("check")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("fused").alias("file"), "check", "n")
    twice = fused.groupBy(*fusion.EDGE).agg(F.count(F.lit(1)).alias("n"))
    return wrong.unionAll(_count(twice, "fused", "repeated_edges", F.col("n") > 1))


def alignment_checks(raw: DataFrame, mapped: DataFrame, aligned: DataFrame) -> DataFrame:
    """Names that changed over the stages (raw, mapped, aligned by seq), and fields that must not have."""
    m = mapped.select("seq", F.struct("source_pmid", "relation", "evidence_text", "entity_1", "entity_2").alias("m"))
    a = aligned.select("seq", F.struct("source_pmid", "relation", "evidence_text", "entity_1", "entity_2").alias("a"))
    both = raw.select("seq", "entity_1", "entity_2").join(m, "seq").join(a, "seq")
    fixed = [(~F.col(f"m.{c}").eqNullSafe(F.col(f"a.{c}"))).cast("int") for c in ("source_pmid", "relation", "evidence_text", "entity_1.type", "entity_2.type")]
    wrong = _count(both, "aligned", "unexpected_field_changes", functools.reduce(Column.__add__, fixed) > 0)
    names = F.array(*[F.struct(F.col(f"m.{e}.type").alias("t"), F.col(f"{e}.name").alias("x"), F.col(f"m.{e}.name").alias("y"), F.col(f"a.{e}.name").alias("z")) for e in ("entity_1", "entity_2")])
    changed = both.select(F.explode(names).alias("c")).where("c.x <> c.y OR c.y <> c.z").distinct()
    return wrong.unionAll(_count(changed, "aligned", "changed_name_mappings"))


def conflict_checks(conflicts: DataFrame, aligned: DataFrame) -> DataFrame:
    """Relations of conflicts that no record supports."""
    each = conflicts.select(*fusion.PAIR, F.explode("relations").alias("relation"))
    return _count(each.join(aligned.select(*fusion.EDGE).distinct(), list(fusion.EDGE), "left_anti"), "conflicts", "missing_relation_sources")


def workbook_checks(workbook: DataFrame, candidates: DataFrame, protected: Sequence[str] = PROTECTED) -> DataFrame:
    """Rows of a review workbook that were lost, added, repeated or changed in a protected column, by problem."""
    found = checks.protected_columns(workbook, candidates, "candidate_id", list(protected))
    return found.groupBy(F.col("problem").alias("check")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("workbook").alias("file"), "check", "n")


def audit(abstracts: DataFrame, raw: DataFrame, mapped: DataFrame, aligned: DataFrame, fused: DataFrame, conflicts: DataFrame, candidates: DataFrame | None = None, workbook: DataFrame | None = None) -> DataFrame:
    """(file, check, n) of all inputs: stages of records (nested, with seq), fused edges and conflicts (flat), review rows."""
    flat = aligned.select(F.col("entity_1.name").alias("name_1"), F.col("entity_1.type").alias("type_1"), "relation", F.col("entity_2.name").alias("name_2"), F.col("entity_2.type").alias("type_2"), "source_pmid")
    per_id = abstracts.groupBy("pmid").agg(F.count(F.lit(1)).alias("n"))
    parts = [_count(per_id, "abstracts", "duplicate_pmids", F.col("n") > 1)]
    parts += [record_checks(name, rows, abstracts) for name, rows in (("raw", raw), ("mapped", mapped), ("aligned", aligned))]
    parts += [location_checks(raw, abstracts.dropDuplicates(["pmid"])), fused_checks(fused, flat), alignment_checks(raw, mapped, aligned), conflict_checks(conflicts, flat)]
    if candidates is not None and workbook is not None:
        parts.append(workbook_checks(workbook, candidates))
    return functools.reduce(DataFrame.unionAll, parts)


#: Counts that are a finding of the audit and no failure.
_FINDINGS = ("records", "changed_name_mappings")


def structural_issues(report: DataFrame) -> DataFrame:
    """The rows of an audit that are failures."""
    return report.where((F.col("n") > 0) & (F.col("file") != "evidence_location") & ~F.col("check").isin(list(_FINDINGS)))
