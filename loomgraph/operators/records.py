"""Validation, scoring and first-seen de-duplication of subject-relation-object records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scoring, vocabulary
from loomgraph.functions.identity import squeeze
from loomgraph.functions.vocabulary import DEFAULT, Vocabulary

SIGNATURE = ("entity_1.name", "entity_1.type", "relation", "entity_2.name", "entity_2.type")


def signature() -> Column:
    """The five columns that identify an edge."""
    return F.struct(*[F.col(c).alias(c.replace(".", "_")) for c in SIGNATURE])


def pair_key() -> Column:
    return F.struct(*[F.col(c).alias(c.replace(".", "_")) for c in SIGNATURE if c != "relation"])


def stage_signature() -> Column:
    """The key under which extraction stages merge: types are ignored, parts joined by underscores."""
    return F.concat_ws("_", "source_pmid", F.lower("entity_1.name"), F.upper("relation"), F.lower("entity_2.name"))


def _missing(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def evidence_of(df: DataFrame) -> Column:
    """The first text that isn't empty of evidence_text, evidence_sentence and evidence.text, as far as df has them."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    texts = [F.col(c).cast("string") for c in ("evidence_text", "evidence_sentence") if c in kinds]
    if "evidence" in kinds and "text" in getattr(kinds["evidence"], "names", ()):
        texts.append(F.col("evidence.text").cast("string"))
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def normalize(df: DataFrame, vocab: Vocabulary = DEFAULT, require_evidence: bool = True) -> DataFrame:
    """df with normalised fields and `problems`, an array of codes; nothing is dropped.

    relation_original keeps a relation's key where an alias replaced it. A null id counts as
    missing, as does an id of blanks.
    """
    key = vocabulary.relation_key(F.col("relation"))
    out = df.withColumns(
        {
            "source_pmid": F.trim(F.coalesce(F.col("source_pmid").cast("string"), F.lit(""))),
            "relation_original": F.when(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(vocab.relation_aliases.items()) for x in kv]), key).isNotNull(), key),
            "relation": vocabulary.relation(F.col("relation"), vocab),
            "evidence_text": squeeze(evidence_of(df)),
            "__has_1": F.col("entity_1").isNotNull(),
            "__has_2": F.col("entity_2").isNotNull(),
        }
    )
    for k in ("entity_1", "entity_2"):
        entity = F.struct(squeeze(F.col(f"{k}.name")).alias("name"), vocabulary.entity_type(F.col(f"{k}.type"), vocab).alias("type"))
        out = out.withColumn(k, entity)
    problems = [F.when(F.col("source_pmid") == "", "missing_source_pmid")]
    for n in ("1", "2"):
        has = F.col(f"__has_{n}")
        problems += [
            F.when(~has, f"entity_{n}_not_object"),
            F.when(has & (F.col(f"entity_{n}.name") == ""), f"entity_{n}.name_empty"),
            F.when(has & (F.col(f"entity_{n}.type") == ""), f"entity_{n}.type_invalid"),
        ]
    problems.append(F.when(F.col("relation") == "", "relation_invalid"))
    if require_evidence:
        problems.append(F.when(F.col("evidence_text") == "", "evidence_text_empty"))
    return out.withColumn("problems", F.array_compact(F.array(*problems))).drop("__has_1", "__has_2")


#: Where a record may state its own confidence, by precedence.
OWN_SCORES = ("llm_confidence", "confidence", "self_confidence", "confidence_score")


def score(df: DataFrame, digits: int = 3, own: tuple[str, ...] = OWN_SCORES) -> DataFrame:
    """df with computed_confidence, from normalised records with problems; of `own`, the columns that df has count."""
    stated = [F.col(c) for c in own if c in df.columns] or [F.lit(None).cast("string")]
    value = scoring.raw_score(scoring.self_score(*stated), F.col("extracted_by"), ~_missing(F.col("evidence_text")), F.size("problems"), digits)
    return df.withColumn("computed_confidence", value)


def normalize_and_score(df: DataFrame, vocab: Vocabulary = DEFAULT, require_evidence: bool = True, digits: int = 3) -> DataFrame:
    return score(normalize(df, vocab, require_evidence), digits)


def nested(df: DataFrame) -> DataFrame:
    """Flat review rows as records."""
    ends = {e: F.struct(F.col(f"{e}_name").alias("name"), F.col(f"{e}_type").alias("type")) for e in ("entity_1", "entity_2")}
    return df.select("source_pmid", "evidence_text", "relation", *[x.alias(e) for e, x in ends.items()])


def id_batches(df: DataFrame, key: str, size: int = 200) -> DataFrame:
    """(batch, ids): distinct ids in order, joined by commas, `size` to a request."""
    from loomgraph.sources.records import numbered

    rows = numbered(df.select(key).where(F.col(key).isNotNull()).distinct(), key)
    listed = rows.groupBy(F.floor((F.col("seq") - 1) / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("seq", F.col(key).cast("string").alias("id")))).alias("x"))
    return listed.select("batch", F.array_join("x.id", ",").alias("ids"))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.size("problems") == 0).drop("problems")


def rejected(df: DataFrame) -> DataFrame:
    """(line, problems, record): what a split sink writes for rows with problems."""
    record = F.to_json(F.struct(*[F.col(c) for c in df.columns if c not in ("problems", "seq")]))
    return df.where(F.size("problems") > 0).select(F.col("seq").alias("line"), "problems", record.alias("record"))


def first_seen(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """One row for each key: the first in the given order."""
    ranked = df.withColumn("__key", key).withColumn("__rank", F.row_number().over(Window.partitionBy("__key").orderBy(*order)))
    return ranked.where("__rank = 1").drop("__key", "__rank")


def merge_stages(*stages: DataFrame, excluded: tuple[str, ...] = ("Rule_Candidate",)) -> DataFrame:
    """Stages in order, their rows of excluded engines left out, the first row of each signature kept."""
    united = None
    for k, stage in enumerate(stages):
        part = stage.where(~F.coalesce(F.col("extracted_by"), F.lit("")).isin(list(excluded))).withColumn("stage", F.lit(k))
        united = part if united is None else united.unionByName(part, allowMissingColumns=True)
    return first_seen(united, stage_signature(), "stage", "seq")


def stage_problems(allowed_engines: tuple[str, ...]) -> Column:
    """Problems of an extracted record by itself: fields, numeric confidence, engine prefix."""
    engine = F.coalesce(F.col("extracted_by"), F.lit(""))
    known = F.lit(False)
    for prefix in allowed_engines:
        known = known | engine.startswith(prefix)
    return F.array_compact(
        F.array(
            F.when(_missing(F.col("source_pmid").cast("string")), "missing_source_pmid"),
            F.when(_missing(F.col("relation")), "missing_relation"),
            F.when(_missing(F.col("entity_1.name")), "missing_entity_1"),
            F.when(_missing(F.col("entity_2.name")), "missing_entity_2"),
            F.when(F.col("computed_confidence").cast("string").try_cast("double").isNull(), "confidence_not_numeric"),
            F.when(~known, "engine_not_allowed"),
        )
    )


def stage_validation(df: DataFrame, allowed_engines: tuple[str, ...] = ("LLM", "Rule")) -> DataFrame:
    """One row: records, invalid ones, unique ids, signatures that repeat."""
    checked = df.withColumn("__bad", F.size(stage_problems(allowed_engines)) > 0).withColumn("__sig", F.struct("source_pmid", F.lower("entity_1.name"), F.upper("relation"), F.lower("entity_2.name")))
    per_key = checked.groupBy("__sig", "source_pmid").agg(F.count(F.lit(1)).alias("n"), F.count_if("__bad").alias("bad"))
    per_id = per_key.groupBy("source_pmid").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") - 1).alias("repeats"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("records"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("invalid"),
        F.count("source_pmid").alias("unique_pmids"),
        F.coalesce(F.sum("repeats"), F.lit(0)).cast("bigint").alias("duplicates"),
    )


def chunks(df: DataFrame, size: int) -> DataFrame:
    """df with the 0-based chunk of each row by seq."""
    return df.withColumn("chunk", F.floor((F.col("seq") - 1) / size).cast("bigint"))


def head_split(df: DataFrame, limit: int) -> DataFrame:
    """df with `part`: llm for the first `limit` rows by seq (all if negative), rule for the rest."""
    return df.withColumn("part", F.lit("llm") if limit < 0 else F.when(F.col("seq") <= limit, "llm").otherwise("rule"))


def unseen(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """One row of each key of df that `existing` doesn't hold."""
    return df.join(existing.select(key).distinct(), key, "left_anti").dropDuplicates([key])
