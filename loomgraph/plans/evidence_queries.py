"""Evidence location and review flags over every document's quote, with SQL that knows plain text.

The quotes are a document's first sentence, altered: their source holds them at its start or
not at all, so SQL needs no offsets to say where they stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import spans
from loomgraph.operators import evidence
from loomgraph.plans import views
from loomgraph.plans.queries import _spread
from loomgraph.plans.registry import query, table

_W = r"[\p{L}\p{N}_]"
_FOLD = r"trim(regexp_replace(lower({0}), '[\s\x0B\xA0]+', ' ', 'g'))"
_PLACED_SQL = rf"""
SELECT *, CASE WHEN quote = '' THEN 'missing_evidence' WHEN contains(source, quote) THEN 'exact' WHEN contains({_FOLD.format("source")}, {_FOLD.format("quote")}) THEN 'normalized' ELSE 'not_located' END AS place
FROM (SELECT *, trim(coalesce(evidence_text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS quote, coalesce(abstract, '') AS source FROM ({views.QUOTES_SQL}))
"""


@query(rf"""
SELECT seq, place AS status, CASE WHEN place IN ('exact', 'normalized') THEN 1 ELSE 0 END AS segments,
       CASE place WHEN 'exact' THEN position(quote IN source) - 1 WHEN 'normalized' THEN length(source) - length(regexp_replace(source, '^[\s\x0B\xA0]+', '')) END AS start FROM ({_PLACED_SQL})
""")
def locate_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.locate(_spread(views.quotes(spark, sf_dir)), suggest=False)
    return found.select("seq", "location.status", F.size("location.segments").alias("segments"), F.get("location.segments", F.lit(0))["start"].alias("start"))


_PIECE = "length({0}) >= 5 AND regexp_matches({0}, '[\\p{{L}}\\p{{N}}_]')"


@query(rf"""
WITH d AS (SELECT doc_id AS seq, text, string_split(split_part(text, '.', 1), ' ') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT seq, text, trim(array_to_string(w[1:3], ' ')) AS a, trim(array_to_string(w[5:7], ' ')) AS b FROM d),
f AS (SELECT *, position(lower(a) IN lower(text)) AS x FROM p), g AS (SELECT *, position(lower(b) IN substr(lower(text), x + length(a))) AS y FROM f)
SELECT seq, CASE WHEN held THEN 'ordered_fragments' ELSE 'not_located' END AS status, CASE WHEN held THEN (x - 1) || ',' || (x + length(a) + y - 2) ELSE '' END AS starts
FROM (SELECT *, {_PIECE.format("a")} AND {_PIECE.format("b")} AND x > 0 AND y > 0 AS held FROM g)
""")
def locate_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's first words, in capitals, and some after them, with an ellipsis between."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("w", F.split(F.split_part("text", F.lit("."), F.lit(1)), " "))
    parts = [F.array_join(F.slice("w", at, 3), " ") for at in (1, 5)]
    quote = F.concat(F.translate(parts[0], "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(" ... "), parts[1])
    found = evidence.locate(docs.select(F.col("doc_id").alias("seq"), quote.alias("evidence_text"), F.lit(None).cast("string").alias("title"), F.col("text").alias("abstract"), F.lit(True).alias("has_source")), suggest=False, written=True)
    return found.select("seq", "location.status", F.array_join(F.transform("location.segments", lambda x: x["start"].cast("string")), ",").alias("starts"))


def _cue_sql(pattern: str, *texts: str) -> str:
    """A cue pattern in a dialect without Unicode word bounds."""
    inner = pattern.replace(r"\b", "").replace(r"\w*", f"{_W}*").replace("'", "''")
    return "(" + " OR ".join(f"regexp_matches({t}, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){inner}($|[^\\p{{L}}\\p{{N}}_])')" for t in texts) + ")"


def _holds_sql(name: str) -> str:
    form = _FOLD.format(name)
    return f"({form} <> '' AND regexp_matches({_FOLD.format('coalesce(evidence_text, chr(32))')}, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape({form}) || '($|[^\\p{{L}}\\p{{N}}_])'))"


_AROUND = r"""CASE WHEN place IN ('exact', 'normalized') THEN list_filter(string_split(regexp_replace(source, '([.!?]["'')\]]*)\s+([A-Z])|\n+', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s) <> '')[1] ELSE '' END"""
_CUES_SQL = ", ".join(f"CASE WHEN {_cue_sql(p, 'raw', 'around')} THEN '{name}' END" for name, p in spans.SPAN_CUES.items())


@query(rf"""
WITH p AS (SELECT *, coalesce(evidence_text, '') AS raw, {_AROUND} AS around, string_split(head, ' ') AS words FROM ({_PLACED_SQL}) JOIN (SELECT doc_id AS seq, split_part(text, '.', 1) || '.' AS head FROM documents) USING (seq)),
f AS (SELECT seq, has_source, place, concat_ws(',', CASE WHEN place NOT IN ('exact', 'normalized') THEN place END,
   CASE WHEN NOT ({_holds_sql("coalesce(words[1], '')")} AND {_holds_sql("coalesce(words[2], '')")}) THEN 'missing_endpoint_in_span' END,
   CASE WHEN len(regexp_extract_all(raw, '{_W}+')) < {spans.LEAST_TOKENS} THEN 'short_fragment' END, CASE WHEN NOT {_cue_sql(spans.PREDICATE_CUES, "raw")} THEN 'no_predicate_cue' END, {_CUES_SQL}) AS flags FROM p)
SELECT seq, CASE WHEN has_source THEN place ELSE 'missing_source' END AS status, CASE WHEN has_source THEN flags ELSE 'missing_source' END AS flags,
       has_source AND place IN ('exact', 'normalized') AS traceable, has_source AND place IN ('exact', 'normalized') AND flags = '' AS eligible FROM f
""")
def evidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.validate(_spread(views.quotes(spark, sf_dir)), suggest=False)
    return out.select("seq", "status", F.array_join("flags", ",").alias("flags"), "traceable", "eligible")
