"""Text expressions: sentences, term and cue matches, repairs, deterministic splits."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cue patterns of the rule extractor.
TREAT_CUE = r"(?i)\b(treat|therapy|therapeutic|administer|receive|approved|dose|treatment)\w*\b"
IMPROVE_CUE = r"(?i)\b(improv|benefit|increase|gain|restore|rescue|stabili[sz]e|preserve)\w*\b"
ASSOCIATE_CUE = r"(?i)\b(associat|linked|correlat|variant|mutation|deletion|copy number|cause)\w*\b"
NEGATION_CUE = r"(?i)\b(no|not|without|lack|lacks|failed to|did not|does not|no significant)\b"


def quoted(term: str) -> str:
    """A literal as a pattern that Java's and RE2's dialects both read."""
    return re.sub(r"([^\w ])", r"\\\1", term)


def sentences(text: Column) -> Column:
    """Sentences of a text: split after . ! ? and white space, squeezed, empty ones dropped."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")
    squeezed = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(squeezed, lambda s: s != "")


def has_term(lowered: Column, term: str) -> Column:
    """Whether a lower-case text holds a term that no ASCII letter or digit adjoins."""
    return lowered.rlike(f"(?<![A-Za-z0-9]){quoted(term.lower())}(?![A-Za-z0-9])")


def has_any_term(lowered: Column, lexicon: Sequence[tuple[str, str]]) -> Column:
    """Whether a lower-case text holds any of a lexicon's terms: one pattern for all."""
    choice = "|".join(quoted(term.lower()) for term, _ in lexicon)
    return lowered.rlike(f"(?<![A-Za-z0-9])(?:{choice})(?![A-Za-z0-9])") if choice else F.lit(False)


def terms_present(lowered: Column, lexicon: Sequence[tuple[str, str]]) -> Column:
    """Canonical names of the lexicon's terms in a text, in the lexicon's order."""
    return F.array_compact(F.array(*[F.when(has_term(lowered, term), F.lit(name)) for term, name in lexicon]))


def word_tokens(text: Column) -> Column:
    """Number of runs of word characters."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b\w+\b"))


def white_space_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))


def hash_split(key: Column, salt: str = "20261002", development_tenths: int = 3) -> Column:
    """development or test, from the first 8 hex digits of the SHA-256 of salt:key."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), key), 256), 1, 8), 16, 10).cast("bigint")
    return F.when(head % 10 < development_tenths, "development").otherwise("test")


def repaired_ids(raw: Column) -> Column:
    """An id list as array. Where thousands separators broke eight-digit ids apart, digits are joined and cut anew."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda p: F.trim(p))
    broken = (F.size(parts) > 1) & F.forall(F.slice(parts, 2, F.size(parts)), lambda p: F.length(p) == 3)
    digits = F.array_join(parts, "")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(digits) - 1) / 8)).cast("int")), lambda k: F.substr(digits, k * 8 + 1, F.lit(8)))
    return F.when(broken, cut).otherwise(F.filter(parts, lambda p: p != ""))


def first_grade(reply: Column) -> Column:
    """The first of the digits 0, 1, 2 in a free reply; 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(reply, F.lit("")), "[012]", 0), F.lit("")).cast("int"), F.lit(0))


def unfenced(reply: Column) -> Column:
    """A model's reply without the Markdown fence around it."""
    return F.trim(F.regexp_replace(F.coalesce(reply, F.lit("")), r"^\s*```(?:json)?\s*|\s*```\s*$", ""))


def verdict(reply: Column) -> Column:
    """A verifier's reply as struct<supported, confidence clamped to [0, 1], evidence>; false and 0 where it can't be read."""
    parsed = F.from_json(unfenced(reply), "supported boolean, confidence double, evidence_text string")
    return F.struct(
        F.coalesce(parsed["supported"], F.lit(False)).alias("supported"),
        F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), parsed["confidence"])), F.lit(0.0)).alias("confidence"),
        F.coalesce(parsed["evidence_text"], F.lit("")).alias("evidence_text"),
    )


def accepted(v: Column, least: float = 0.75) -> Column:
    return v["supported"] & (v["confidence"] >= least) & (v["evidence_text"] != "")


def redact(text: Column, *secrets: str) -> Column:
    for secret in secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit("***"))
    return text


def truncated(text: Column, characters: int = 3000) -> Column:
    """The first characters of a text, for a prompt."""
    return F.substring(F.coalesce(text, F.lit("")), 1, characters)


def percent(share: Column) -> Column:
    return F.when(share.isNotNull(), F.format_string("%.1f%%", share * 100)).otherwise(F.lit("not available"))


def markdown_row(*cells: Column) -> Column:
    """A row of a Markdown table; nulls are empty cells."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit(" |"))
