"""Confidence and interval formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reliability of engines, weights of the raw and the fused score.
MODEL_RELIABILITY, RULE_RELIABILITY, OTHER_RELIABILITY = 0.78, 0.45, 0.5
RULE_ENGINES = ("Regex_Fallback", "Rule_Fallback", "Rule_Candidate")
RAW_WEIGHTS = {"model": 0.38, "evidence": 0.24, "schema": 0.24, "engine": 0.14}
FUSED_WEIGHTS = {"max": 0.42, "mean": 0.18, "sources": 0.18, "engines": 0.14, "schema": 0.08}
Z95 = 1.959963984540054


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def self_score(*candidates: Column) -> Column:
    """The first candidate that is a number or the text of one, clamped to [0, 1]; null if none is."""
    numbers = [c.cast("string").try_cast("double") for c in candidates]
    return F.when(F.coalesce(*numbers).isNotNull(), clamp(F.coalesce(*numbers)))


def engine_reliability(engine: Column) -> Column:
    name = F.coalesce(engine, F.lit(""))
    model = (name == "LLM") | name.startswith("LLM_")
    return F.when(model, MODEL_RELIABILITY).when(name.isin(list(RULE_ENGINES)), RULE_RELIABILITY).otherwise(OTHER_RELIABILITY)


def raw_score(own: Column, engine: Column, has_evidence: Column, n_problems: Column, digits: int = 3) -> Column:
    """Score of one record from its own score, its engine, its evidence and its problems."""
    reliability = engine_reliability(engine)
    schema = F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(0.25) * n_problems)
    evidence = F.when(has_evidence, 1.0).otherwise(0.55)
    total = (
        F.lit(RAW_WEIGHTS["model"]) * F.coalesce(own, reliability)
        + F.lit(RAW_WEIGHTS["evidence"]) * evidence
        + F.lit(RAW_WEIGHTS["schema"]) * schema
        + F.lit(RAW_WEIGHTS["engine"]) * reliability
    )
    return F.bround(clamp(total), digits)


def fused_score(most: Column, mean: Column, n_sources: Column, n_engines: Column, all_valid: Column, digits: int = 3) -> Column:
    """Score of an edge from aggregates of its records."""
    total = (
        F.lit(FUSED_WEIGHTS["max"]) * most
        + F.lit(FUSED_WEIGHTS["mean"]) * mean
        + F.lit(FUSED_WEIGHTS["sources"]) * F.least(F.lit(1.0), F.lit(0.45) + F.lit(0.12) * (n_sources - 1))
        + F.lit(FUSED_WEIGHTS["engines"]) * F.least(F.lit(1.0), F.lit(0.55) + F.lit(0.25) * (n_engines - 1))
        + F.lit(FUSED_WEIGHTS["schema"]) * F.when(all_valid, 1.0).otherwise(0.65)
    )
    return F.bround(clamp(total), digits)


def wilson(successes: Column, total: Column) -> tuple[Column, Column]:
    """Wilson 95 % interval, both ends null for a total of 0."""
    n = F.when(total > 0, total.cast("double"))
    p = successes / n
    scale = F.lit(1.0) + F.lit(Z95 * Z95) / n
    center = (p + F.lit(Z95 * Z95) / (n * 2)) / scale
    radius = F.lit(Z95) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(Z95 * Z95) / (n * n * 4)) / scale
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), center - radius)), F.when(n.isNotNull(), F.least(F.lit(1.0), center + radius))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def precision_recall_f1(hits: Column, found: Column, expected: Column, hits_expected: Column | None = None) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, each 0 where its denominator is; recall may count its own hits."""
    p = F.coalesce(ratio(hits, found), F.lit(0.0))
    r = F.coalesce(ratio(hits if hits_expected is None else hits_expected, expected), F.lit(0.0))
    return p, r, F.coalesce(F.try_divide(p * r * 2, p + r), F.lit(0.0))


def average_degree(edges: Column, nodes: Column) -> Column:
    return F.coalesce(ratio(edges * 2, nodes), F.lit(0.0))


def viewer_size(rank: Column) -> Column:
    """A node's size in a graph view from its rank, which defaults to 0.005."""
    return F.greatest(F.lit(12.0), F.least(F.lit(65.0), F.coalesce(rank, F.lit(0.005)) * 1000))


# Colours of node types in a graph view.
COLOURS = {"gene": "#e74c3c", "drug": "#2ecc71"}
MENTION_COLOUR, OTHER_COLOUR = "#3498db", "#95a5a6"


def viewer_colour(kind: Column) -> Column:
    """A node's colour in a graph view: by type, one for all phenotypes and diseases, grey for the rest."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    chosen = F.when(low.rlike("phenotype|disease"), MENTION_COLOUR)
    for name, colour in COLOURS.items():
        chosen = chosen.when(low == name, colour)
    return chosen.otherwise(OTHER_COLOUR)
