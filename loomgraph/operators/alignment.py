"""Dictionary mapping and typed alignment of entity names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import identity


def map_dictionary(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Endpoints renamed by dictionary(type, alias, canonical), unless the new name is another identity.

    Adds changed_1 and changed_2. The dictionary joins by lower-case type and trimmed name; its
    aliases are made unique first, so no row is multiplied.
    """
    entries = dictionary.groupBy(F.lower("type").alias("__type"), F.lower(F.trim("alias")).alias("__alias")).agg(F.min("canonical").alias("__canonical"))
    out = df
    for n in ("1", "2"):
        kind, name = F.col(f"entity_{n}.type"), F.col(f"entity_{n}.name")
        out = out.join(entries, (F.lower(kind) == F.col("__type")) & (F.lower(F.trim(name)) == F.col("__alias")), "left")
        safe = F.col("__canonical").isNotNull() & identity.conflict(kind, name, F.col("__canonical")).isNull()
        new = F.when(safe, F.col("__canonical")).otherwise(name)
        out = out.withColumn(f"changed_{n}", F.coalesce(new != name, F.lit(False))).withColumn(f"entity_{n}", F.struct(new.alias("name"), kind.alias("type")))
        out = out.drop("__type", "__alias", "__canonical")
    return out


def endpoints(df: DataFrame) -> DataFrame:
    """(type, name) of both endpoints of every row."""
    return df.select(F.explode(F.array("entity_1", "entity_2")).alias("e")).select("e.type", "e.name")


def mapping_hits(mapped: DataFrame) -> DataFrame:
    """(type, hits): changed endpoints by type."""
    both = F.array(F.struct(F.col("entity_1.type").alias("type"), F.col("changed_1").alias("c")), F.struct(F.col("entity_2.type").alias("type"), F.col("changed_2").alias("c")))
    return mapped.select(F.explode(both).alias("e")).groupBy("e.type").agg(F.count_if("e.c").alias("hits"))


def name_frequency(df: DataFrame) -> DataFrame:
    return endpoints(df).groupBy("type", "name").agg(F.count(F.lit(1)).alias("frequency"))


def alignment_map(df: DataFrame, exact: bool = True) -> DataFrame:
    """(type, name, canonical): of a type's names with one orthographic form and no conflicting
    authority id, the most frequent, then shortest, then first stands for all."""
    names = name_frequency(df).withColumn("form", identity.identity_form(F.col("name"), exact)).withColumn("authority", identity.authority(F.col("type"), F.col("name")))
    group = Window.partitionBy("type", "form", "authority").orderBy(F.desc("frequency"), F.length("name"), F.lower("name"), "name")
    return names.select("type", "name", "frequency", F.first("name").over(group).alias("canonical"))


def apply_alignment(df: DataFrame, mapping: DataFrame) -> DataFrame:
    out = df
    table = mapping.select(F.col("type").alias("__type"), F.col("name").alias("__name"), F.col("canonical").alias("__canonical"))
    for n in ("1", "2"):
        kind, name = F.col(f"entity_{n}.type"), F.col(f"entity_{n}.name")
        out = out.join(table, (kind == F.col("__type")) & (name == F.col("__name")), "left")
        out = out.withColumn(f"entity_{n}", F.struct(F.coalesce("__canonical", name).alias("name"), kind.alias("type"))).drop("__type", "__name", "__canonical")
    return out


def alignment_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(type, name_before, name_after, records, pmids) of endpoints that alignment changed, rows matched by seq."""

    def names(df: DataFrame, column: str) -> DataFrame:
        return df.select("seq", "source_pmid", F.posexplode(F.array("entity_1", "entity_2")).alias("side", "e")).select("seq", "side", "source_pmid", F.col("e.type").alias("type"), F.col("e.name").alias(column))

    both = names(before, "name_before").join(names(after, "name_after").select("seq", "side", "name_after"), ["seq", "side"])
    changed = both.where("name_before <> name_after")
    return changed.groupBy("type", "name_before", "name_after").agg(F.count_distinct("seq").alias("records"), F.count_distinct("source_pmid").alias("pmids"))


def multi_type_names(df: DataFrame) -> DataFrame:
    """(name, types): names that stand for entities of several types."""
    found = endpoints(df).groupBy("name").agg(F.sort_array(F.collect_set("type")).alias("types"))
    return found.where(F.size("types") > 1)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    """df with `unit`, the vector as doubles of length one; of nulls for the zero vector."""
    doubles = df.withColumn("__v", F.transform(vector, lambda x: x.cast("double"))).withColumn("__norm", F.sqrt(_dot(F.col("__v"), F.col("__v"))))
    return doubles.withColumn("unit", F.transform("__v", lambda x: F.try_divide(x, F.col("__norm")))).drop("__v", "__norm")


def best_neighbours(vectors: DataFrame, threshold: float, kind: str = "type", name: str = "name", vector: str = "vector", block: int = 2048) -> DataFrame:
    """(type, name, candidate, similarity): for each name the most similar other name of its type, from the threshold on.

    Proposals for review, never merges; of equals the smallest candidate. The result is exact,
    so all names of a type are compared: in blocks of names, each pair of blocks one product of
    matrices in an Arrow batch that gives one row for each name, so no pair of names is ever a
    row and a large type is many tasks. A zero vector is similar to nothing.
    """
    unit = unit_vectors(vectors.select(F.col(kind).alias("type"), F.col(name).alias("name"), F.col(vector).alias("__vector")), "__vector")
    unit = unit.where(F.get("unit", F.lit(0)).isNotNull()).select("type", "name", "unit")
    sizes = unit.groupBy("type").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    dealt = unit.join(sizes, "type").withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = dealt.select("type", "name", "unit", F.col("own").alias("i"), F.explode(every).alias("j"))
    right = dealt.select(F.col("type").alias("type2"), F.col("name").alias("name2"), F.col("unit").alias("unit2"), F.col("own").alias("j2"), F.explode(every).alias("i2"))
    name_kind, type_kind = dict(unit.dtypes)["name"], dict(unit.dtypes)["type"]

    def closest(x: pa.Table, y: pa.Table) -> pa.Table:
        x, y = x.combine_chunks(), y.select(["name2", "unit2"]).rename_columns(["name", "unit"]).combine_chunks().sort_by("name")  # the first of equals is the smallest
        if not x.num_rows or not y.num_rows:
            return x.select(["type", "name"]).append_column("candidate", x["name"]).append_column("similarity", pa.array([0.0] * x.num_rows)).slice(0, 0)
        a, b = (t["unit"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (x, y))
        place = pc.index_in(x["name"].combine_chunks(), y["name"].combine_chunks()).to_numpy(zero_copy_only=False)
        best, value = np.zeros(len(a), np.int64), np.zeros(len(a))
        for at in range(0, len(a), 512):
            products = np.round(a[at : at + 512] @ b.T, 12)  # rounding noise doesn't part equals
            own = place[at : at + 512]
            rows = np.flatnonzero(~np.isnan(own.astype(float)))
            products[rows, own[rows].astype(np.int64)] = -np.inf
            best[at : at + 512] = products.argmax(axis=1)
            value[at : at + 512] = products.max(axis=1)
        out = pa.table({"type": x["type"], "name": x["name"], "candidate": y["name"].combine_chunks().take(pa.array(best)), "similarity": pa.array(value)})
        return out.filter(pa.array(value >= threshold - 1e-12))

    met = left.groupBy("type", "i", "j").cogroup(right.groupBy("type2", "i2", "j2")).applyInArrow(closest, f"type {type_kind}, name {name_kind}, candidate {name_kind}, similarity double")
    top = met.groupBy("type", "name").agg(F.max("similarity").alias("__top"), F.collect_list(F.struct("similarity", "candidate")).alias("__all"))  # one row from each block
    first = F.array_min(F.transform(F.filter("__all", lambda r: r["similarity"] == F.col("__top")), lambda r: r["candidate"]))
    return top.where(F.col("__top") >= threshold).select("type", "name", first.alias("candidate"), F.col("__top").alias("similarity"))


def unordered_proposals(best: DataFrame) -> DataFrame:
    """best_neighbours' rows with each unordered pair once."""
    pairs = best.select("type", F.least("name", "candidate").alias("first"), F.greatest("name", "candidate").alias("second"), "similarity")
    return pairs.groupBy("type", "first", "second").agg(F.max("similarity").alias("similarity"))
