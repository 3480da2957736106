"""The operators applied with production parameters to their whole tables: op1 to op13."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, language, licenses, lm, merkle, mixing, pages, quality, resampling, rules, sharding, simhash, tokens
from loomgraph.llm.common import id_remainder, remainder_is

ACCEPT = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = remainder_is("doc_id", 3, 1)
    model = language.train(docs, ~held_out)
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = remainder_is("doc_id", 7, 2)
    deleted = F.pmod(F.xxhash64(F.lit("deleted"), "doc_id"), F.lit(10)) == 0  # a tenth of what is learned from
    scored = lm.score_texts(docs, F.when(held_out, 0).when(deleted, 2).otherwise(1), order=3)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.with_copies(_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Discriminant:
    return quality.train(docs, _table(spark, sf_dir, "labels"), ~remainder_is("doc_id", 4, 2))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", remainder_is("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_slots(_table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(id_remainder("doc_id", 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = merkle.manifest(_table(spark, sf_dir, "documents"), claims={"n_chars": tampered})
    proof_digest = F.sha2(merkle.siblings_text(F.col("proof")).cast("binary"), 256)
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest.alias("proof_sha256"), merkle.folded(F.col("claimed"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(_table(spark, sf_dir, "pages"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_MIX_HITS = " ".join(f"WHEN {k} THEN CAST(('0x' || substr(md5('mix-2024:{k // 4}:' || doc_id), {k % 4 * 8 + 1}, 8)) AS BIGINT) / 4294967296.0::DOUBLE < fraction" for k in range(8))
_MIX_SUMS = ", ".join(f"{{'off': abs(sum(size * (whole + CASE WHEN CAST(('0x' || substr(md5('mix-2024:{k // 4}:' || doc_id), {k % 4 * 8 + 1}, 8)) AS BIGINT) / 4294967296.0::DOUBLE < fraction THEN 1 ELSE 0 END)) - target), 'k': {k}}}" for k in range(8))

_MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^ 	-
]+')) END AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY 1),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s), x AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * n AS most FROM w),
v AS (SELECT *, (1.5::DOUBLE * (SELECT sum(n) FROM s) - coalesce(sum(most) OVER b, 0)) / ((SELECT sum(weight) FROM x) - coalesce(sum(weight) OVER b, 0)) AS level FROM x WINDOW b AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT level AS free FROM v WHERE most >= level * weight ORDER BY most / weight, rank LIMIT 1),
t AS (SELECT source, n AS source_size, least(most, coalesce((SELECT free FROM l) * weight, most)) AS target FROM v),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t), f AS (SELECT *, floor(rate) AS whole, rate - floor(rate) AS fraction FROM r),
j AS (SELECT d.doc_id, d.size, f.* FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
k AS (SELECT source, list_min([{_MIX_SUMS}]).k AS k FROM j GROUP BY source, target)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * least(2, whole + CASE WHEN CASE k {_MIX_HITS} END THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM j JOIN k ON j.source IS NOT DISTINCT FROM k.source
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def _templates_sql() -> str:
    rows = []
    for number, (label, text) in enumerate(licenses.TEMPLATES):
        found = licenses.template_tokens(text)
        rows.append(f"({number}, '{label}', {found!r}, {len(found)}, {math.ceil(round(0.8 * len(found), 9))})")
    return ", ".join(rows)


def _places_sql() -> str:
    places = []
    for label, phrase in licenses.PHRASES:
        test = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase))
        places.append(f"list_filter(range(1, len(w) + 1), lambda i: {test}) AS \"{label}\"")
    return ", ".join(places)


_NAMES = [label for label, _ in licenses.PHRASES]
_LICENSE_SQL = rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS low FROM documents), w AS (SELECT *, regexp_extract_all(low, '{_TOKEN}') AS w FROM d),
p AS (SELECT doc_id, len(w) AS n_words, {_places_sql()} FROM w),
b AS (SELECT doc_id, n_words, {" || ".join(f'"{n}"' for n in _NAMES)} AS places, list_filter([{", ".join(f"""CASE WHEN len("{n}") > 0 THEN '{n}' END""" for n in sorted(_NAMES))}], lambda x: x IS NOT NULL) AS base FROM p),
l AS (SELECT doc_id, line, list_distinct(regexp_extract_all(line, '{_TOKEN}')) AS t FROM (SELECT DISTINCT doc_id, unnest(string_split(low, chr(10))) AS line FROM d)),
m AS (SELECT doc_id, line, label, len(list_intersect(t, tokens)) AS k, m, need FROM l, (VALUES {_templates_sql()}) v(number, label, tokens, m, need)),
h AS (SELECT *, k / m AS share FROM m WHERE k >= need QUALIFY rank() OVER (PARTITION BY doc_id, line ORDER BY k / m DESC, k DESC) = 1),
f AS (SELECT doc_id, list(DISTINCT label) AS found, max(share) AS best FROM h GROUP BY 1)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels, CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM b LEFT JOIN f USING (doc_id)
"""

#: CRC-32 has no function in SQL: its table of 256 steps by the generating polynomial, then byte by byte.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS steps FROM range(256) t(b))"


def _crc_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; the query has the table `crc` in its FROM."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, o: xor(c // 256, crc.steps[xor(c % 256, o) + 1])), 4294967295)"


def _encoded_sql(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_encoded_sql(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_RUNS = "SELECT g, lvl + 1, p, sha256(string_agg(d, '' ORDER BY pos)) FROM (SELECT *, pos // 2 AS p, count(*) OVER (PARTITION BY g) AS n FROM {0}) WHERE n > 1 GROUP BY g, lvl, p"
_MERKLE_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
docs AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, {_leaf_sql("n_chars")} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND {_crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS tampered FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs),
t(g, lvl, pos, d) AS (SELECT g, 0, pos, leaf FROM leaves UNION ALL {_RUNS.format("t")}),
subs AS (SELECT g, d FROM t QUALIFY lvl = max(lvl) OVER (PARTITION BY g)),
u(g, lvl, pos, d) AS (SELECT 0, 0, g, d FROM subs UNION ALL {_RUNS.format("u")}),
root AS (SELECT d AS root FROM u QUALIFY lvl = max(lvl) OVER ()),
steps AS (SELECT l.g, l.pos, t.lvl, (l.pos // (1 << t.lvl)) % 2 AS odd, s.d FROM leaves l JOIN (SELECT DISTINCT g, lvl FROM t QUALIFY lvl < max(lvl) OVER (PARTITION BY g)) t ON l.g = t.g
    LEFT JOIN t s ON s.g = l.g AND s.lvl = t.lvl AND s.pos = xor(l.pos // (1 << t.lvl), 1)
  UNION ALL SELECT l.g, l.pos, 1000 + u.lvl, (l.g // (1 << u.lvl)) % 2, s.d FROM leaves l, (SELECT DISTINCT lvl FROM u QUALIFY lvl < max(lvl) OVER ()) u
    LEFT JOIN u s ON s.lvl = u.lvl AND s.pos = xor(l.g // (1 << u.lvl), 1)),
proofs AS (SELECT g, pos, string_agg(d, '' ORDER BY lvl) AS joined, list({{'odd': odd, 'd': d}} ORDER BY lvl) AS way FROM steps GROUP BY g, pos),
rows AS (SELECT l.*, subs.d AS subroot, coalesce(joined, '') AS joined, coalesce(way, []) AS way FROM leaves l JOIN subs USING (g) LEFT JOIN proofs USING (g, pos)),
f(g, pos, k, cur) AS (SELECT g, pos, 0, coalesce(tampered, leaf) FROM rows
  UNION ALL SELECT f.g, f.pos, k + 1, sha256(CASE WHEN way[k + 1].odd = 1 THEN coalesce(way[k + 1].d, '') || cur ELSE cur || coalesce(way[k + 1].d, '') END) FROM f JOIN rows ON f.g = rows.g AND f.pos = rows.pos WHERE k < len(way))
SELECT doc_id, leaf, subroot, root, sha256(joined) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM rows JOIN f ON f.g = rows.g AND f.pos = rows.pos AND f.k = len(way), root
"""


def _features_sql(table: str, extra: str) -> str:
    """(extra columns, w, features) of every row: words, and runs of one and two of them."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TOKEN}')"
    return f"(SELECT *, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS features FROM (SELECT {extra}{words} AS w FROM {table}))"


_RESAMPLING_SQL = f"""
WITH {_CRC_TABLE},
d AS MATERIALIZED {_features_sql("documents", "doc_id, row_number() OVER () AS r, ")}, b AS {_features_sql("benchmark", "")},
df AS MATERIALIZED (SELECT r, f, count(*) AS n FROM (SELECT r, unnest(features) AS f FROM d) GROUP BY 1, 2), bf AS (SELECT f, count(*) AS n FROM (SELECT unnest(features) AS f FROM b) GROUP BY 1),
k AS MATERIALIZED (SELECT f, {_crc_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM df UNION SELECT f FROM bf), crc),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM df JOIN k USING (f) GROUP BY 1), t AS (SELECT bucket, sum(n)::BIGINT AS t FROM bf JOIN k USING (f) GROUP BY 1),
c AS (SELECT bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM s FULL JOIN t USING (bucket)), a AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM c),
gains AS (SELECT bucket, floor(1000.0::DOUBLE * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM c, a),
m AS (SELECT r, sum(n * gain)::BIGINT AS total FROM df JOIN k USING (f) JOIN gains USING (bucket) GROUP BY 1),
w AS (SELECT doc_id, len(w) AS words, len(features)::BIGINT AS n_features, CASE WHEN len(features) = 0 THEN 0 ELSE (total - ((total % len(features)) + len(features)) % len(features)) // len(features) END::BIGINT AS weight,
  CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE AS h FROM d LEFT JOIN m USING (r)),
x AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM w),
y AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (words >= 20) OVER () AS n FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM y
"""

ORACLES = {"op5_mixing": _MIX_SQL, "op9_licenses": _LICENSE_SQL, "op11_merkle": _MERKLE_SQL, "op13_resampling": _RESAMPLING_SQL}

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_lm_scores,
        op3_token_counts,
        op4_simhash,
        op5_mixing,
        op6_quality,
        op7_quality_rules,
        op8_sharding,
        op9_licenses,
        op10_decontamination,
        op11_merkle,
        op12_page_text,
        op13_resampling,
    )
}
