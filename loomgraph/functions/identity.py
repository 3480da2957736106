"""Identity of entities: orthographic form, authority ids, conflicts and hashes."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.vocabulary import lookup

#: Printable ASCII and the white space on which Java and Python agree.
PLAIN = r"^[\t-\r -~]*$"

# Official identifiers of exact gene symbols.
NCBI = {"SMN1": "6606", "SMN2": "6607"}
ENSEMBL = {"SMN1": "ENSG00000172062", "SMN2": "ENSG00000205571"}
# Types that a qualifier parts, and how names state it.
SUBTYPE, SHORT_SUBTYPE = r"\btype\s*([0-4]|iv|iii|ii|i)\b", r"^sma([0-4])$"
QUALIFIED_TYPES = ("Disease", "Phenotype", "Variant")


def squeeze(text: Column) -> Column:
    """Unicode white space collapsed to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), "^ | $", "")


@F.pandas_udf(T.StringType())
def _beyond_ascii_form(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else re.sub(r"\s+", " ", unicodedata.normalize("NFC", s).strip()).casefold())


def identity_form(name: Column, exact: bool = True) -> Column:
    """NFC, squeezed, case-folded. Plain ASCII names are native; exact=False: all are, so none goes to Python."""
    plain = F.lower(squeeze(name))
    if not exact:
        return plain
    easy = F.coalesce(name, F.lit("")).rlike(PLAIN)
    return F.when(easy, plain).otherwise(F.coalesce(_beyond_ascii_form(F.when(~easy, name)), F.lit("")))


def authority(kind: Column, name: Column, table: dict[str, str] = NCBI) -> Column:
    """The official id of an exact gene symbol, null for all else."""
    return F.when(kind == "Gene", lookup(table, F.upper(F.trim(name))))


def subtype(name: Column) -> Column:
    """The number of a `type` qualifier, Roman or Arabic, or of `sma0` to `sma4`; null without one."""
    found = F.nullif(F.regexp_extract(F.lower(name), SUBTYPE, 1), F.lit(""))
    roman = lookup({"i": "1", "ii": "2", "iii": "3", "iv": "4"}, found)
    short = F.nullif(F.regexp_extract(F.lower(name), SHORT_SUBTYPE, 1), F.lit(""))
    return F.coalesce(roman, found, short)


def conflict(kind: Column, first: Column, second: Column) -> Column:
    """Why two names of one type can't be one entity; null if nothing speaks against it."""
    a, b = authority(kind, first), authority(kind, second)
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.lit("different_authoritative_gene_ids")).when(
        kind.isin(list(QUALIFIED_TYPES)) & ~subtype(first).eqNullSafe(subtype(second)), F.lit("subtype_qualifier_changed")
    )


def compatible(kind: Column, first: Column, second: Column, exact: bool = True) -> Column:
    """Same orthographic form and no difference in authority ids."""
    return authority(kind, first).eqNullSafe(authority(kind, second)) & (identity_form(first, exact) == identity_form(second, exact))


def entity_id(namespace: Column, kind: Column, name: Column) -> Column:
    """SHA-256 of the compact JSON array of namespace, type and trimmed name."""
    return F.sha2(F.to_json(F.array(namespace, kind, F.trim(name))), 256)


def edge_key(version: Column, source: Column, a: Column, name: Column, b: Column) -> Column:
    return F.sha2(F.to_json(F.array(version, source, a, name, b)), 256)
