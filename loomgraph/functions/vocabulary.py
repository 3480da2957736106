"""The controlled vocabulary as plain data, and as columns that look things up in it."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity types, relations with their polarity, and aliases of the record format.
ENTITY_TYPES = ("Gene", "Protein", "Phenotype", "Drug", "Disease", "Variant")
POLARITY = {
    "TREATS": "positive",
    "IMPROVES": "positive",
    "PREVENTS": "positive",
    "PROTECTS_AGAINST": "positive",
    "CAUSES": "negative",
    "WORSENS": "negative",
    "INCREASES_RISK_OF": "negative",
    "CONTRAINDICATES": "negative",
    "ASSOCIATED_WITH": "neutral",
    "CO_OCCURS_WITH": "neutral",
    "REGULATES": "neutral",
    "UPREGULATES": "neutral",
    "DOWNREGULATES": "neutral",
    "INHIBITS": "neutral",
    "ACTIVATES": "neutral",
    "TARGETS": "neutral",
    "ENCODES": "neutral",
    "EXPRESSES": "neutral",
    "MODIFIES": "neutral",
    "PREDICTS": "neutral",
    "DIAGNOSES": "neutral",
    "HAS_PHENOTYPE": "neutral",
}
RELATION_ALIASES = {"TREATS_MENTION": "TREATS", "TREATED_WITH": "TREATS", "TREATED_BY": "TREATS", "COOCCURS_WITH": "CO_OCCURS_WITH"}
TYPE_ALIASES = {"genes": "Gene", "proteins": "Protein", "symptom": "Phenotype", "medication": "Drug", "disorder": "Disease", "mutation": "Variant"}
CONFLICT_PAIRS = (("IMPROVES", "WORSENS"), ("TREATS", "CAUSES"), ("UPREGULATES", "DOWNREGULATES"), ("ACTIVATES", "INHIBITS"))


@dataclass(frozen=True)
class Vocabulary:
    entity_types: tuple[str, ...] = ENTITY_TYPES
    polarity: Mapping[str, str] = field(default_factory=lambda: dict(POLARITY))
    relation_aliases: Mapping[str, str] = field(default_factory=lambda: dict(RELATION_ALIASES))
    type_aliases: Mapping[str, str] = field(default_factory=lambda: dict(TYPE_ALIASES))
    conflict_pairs: tuple[tuple[str, str], ...] = CONFLICT_PAIRS

    def relations_with(self, polarity: str) -> list[str]:
        return sorted(r for r, p in self.polarity.items() if p == polarity)


DEFAULT = Vocabulary()


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """table[key], null where it isn't there; a literal map, so no join."""
    if not table:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for kv in sorted(table.items()) for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def relation_key(raw: Column) -> Column:
    """Upper case, each run of other characters one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def relation(raw: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    """The vocabulary's name of a relation, '' if it has none."""
    key = relation_key(raw)
    named = F.coalesce(lookup(vocabulary.relation_aliases, key), key)
    return F.when(named.isin(list(vocabulary.polarity)), named).otherwise(F.lit(""))


def entity_type(raw: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    """The vocabulary's name of an entity type: as it stands, else by alias, else ''."""
    text = F.coalesce(raw, F.lit(""))
    alias = lookup({k.lower(): v for k, v in vocabulary.type_aliases.items()} | {t.lower(): t for t in vocabulary.entity_types}, F.lower(F.trim(text)))
    return F.when(text.isin(list(vocabulary.entity_types)), text).otherwise(F.coalesce(alias, F.lit("")))


# What a graph database takes as a label, and what stands for one that it wouldn't.
LABEL_TOKEN, UNKNOWN_LABEL, DEFAULT_RELATIONSHIP = "^[A-Za-z_][A-Za-z0-9_]*$", "Unknown", "ASSOCIATED_WITH"


def label(raw: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    """An entity type as a graph label."""
    named = entity_type(raw, vocabulary)
    return F.when(named.rlike(LABEL_TOKEN), named).otherwise(F.lit(UNKNOWN_LABEL))


def relationship(raw: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    """A relation as a graph relationship's type."""
    named = relation(raw, vocabulary)
    return F.when(named.rlike(LABEL_TOKEN), named).otherwise(F.lit(DEFAULT_RELATIONSHIP))


def load(text: str) -> Vocabulary:
    """A vocabulary from its JSON document: entity_types, relations {name: {polarity}}, aliases, listed and conflicting relations."""
    parts = json.loads(text)
    polarity = {name: (of or {}).get("polarity", "unknown") for name, of in parts.get("relations", {}).items()}
    for sign in ("positive", "negative"):
        polarity |= {name: sign for name in parts.get(f"{sign}_relations", ())}
    return Vocabulary(
        tuple(parts.get("entity_types", ())),
        polarity,
        {re.sub("[^A-Z0-9]+", "_", k.upper()).strip("_"): v for k, v in parts.get("relation_aliases", {}).items()},
        {k.strip().lower(): v for k, v in parts.get("entity_type_aliases", {}).items()},
        tuple((a, b) for a, b in parts.get("conflict_relation_pairs", ())),
    )


def polarity(name: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    return F.coalesce(lookup(vocabulary.polarity, name), F.lit("unknown"))


def conflicting(relations: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    """Whether an array of relations holds a pair that is listed as conflicting, or both polarities."""

    def has_any(names: list[str]) -> Column:
        return F.arrays_overlap(relations, F.array(*[F.lit(n) for n in names])) if names else F.lit(False)

    both = has_any(vocabulary.relations_with("positive")) & has_any(vocabulary.relations_with("negative"))
    for a, b in vocabulary.conflict_pairs:
        both = both | (F.array_contains(relations, a) & F.array_contains(relations, b))
    return both


def conflicting_rows(relation: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    """conflicting() of the relations of a group's rows, as an aggregate that holds no list."""

    def has_any(names: list[str]) -> Column:
        return F.coalesce(F.bool_or(relation.isin(names)), F.lit(False)) if names else F.lit(False)

    both = has_any(vocabulary.relations_with("positive")) & has_any(vocabulary.relations_with("negative"))
    for a, b in vocabulary.conflict_pairs:
        both = both | (has_any([a]) & has_any([b]))
    return both
