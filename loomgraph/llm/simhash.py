"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits share a variant within r/2 bits of both.
Every distinct fingerprint therefore emits all variants in its ball of radius r/2, and the
shuffle is on variants. It isn't on whole ones: a row (variant prefix, fingerprint) stands
for all the fingerprint's variants with that prefix, which the receiving task enumerates
with numpy, so 64-bit fingerprints with r = 4 cost a few dozen rows each in place of 2081.
All fingerprints that meet in one variant are within r of each other, so a variant's group
needs only a chain of links, never all its pairs; every link is verified all the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, own_name, own_names, plain_names, row_key, ship, utf8
from loomgraph.operators.components import component_labels

_BITS = 64
#: Variants that a task sorts at once; beyond it, it splits their prefix.
_AT_ONCE = 1 << 22
#: Rows of one prefix beyond which it is made longer.
_GROUP_ROWS = 1 << 20
#: Shingles hashed at once, so that memory doesn't follow a text's length.
_SHINGLES = 1 << 16


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of a UTF-8 text: bit i is set if it is in over half the shingles' XXH64 (seed 42); 0 without words."""
    from xxhash import xxh64_digest

    tokens = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space bytes
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = [e + i for i, e in enumerate(accumulate(map(len, tokens)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[words - 1 :] if len(ends) >= words else ends[-1:]
    count, ones = len(last), np.zeros(_BITS, np.int64)
    for i in range(0, count, _SHINGLES):
        digests = b"".join([xxh64_digest(joined[a:b], 42) for a, b in zip(starts[i : i + _SHINGLES], last[i : i + _SHINGLES])])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text as a signed long. Null texts count as empty."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(cell.as_py(), words) for cell in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fp bigint"
    return df.select(F.col(id_col), utf8(text_col).alias("__text")).mapInArrow(run, schema)


def _masks(bits: int, radius: int) -> np.ndarray:
    """All masks of at most `radius` set bits among the lowest `bits`."""
    masks, layer = [np.zeros(1, np.uint64)], [(0, 0)]
    for _ in range(radius):
        layer = [(m | (1 << b), b + 1) for m, low in layer for b in range(low, bits)]
        masks.append(np.array([m for m, _ in layer], np.uint64))
    return np.concatenate(masks)


def _ball_size(bits: int, radius: int) -> int:
    return sum(math.comb(bits, k) for k in range(radius + 1))


def collisions(by_flips: list[np.ndarray], bits: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between fingerprints that share a variant of a common prefix.

    by_flips[t]: fingerprints whose first 64 - bits bits are t flips away from the prefix, so
    they may flip radius - t of the others. Only these low bits matter for their variants.
    """
    total = sum(len(x) * _ball_size(bits, radius - t) for t, x in enumerate(by_flips))
    if sum(map(len, by_flips)) < 2:
        return
    if total > _AT_ONCE and bits > 1:
        top = np.uint64(1 << (bits - 1))
        for bit in (np.uint64(0), top):
            sides = [[] for _ in by_flips]
            for t, x in enumerate(by_flips):
                same = (x & top) == bit
                sides[t].append(x[same])
                if t < radius:
                    sides[t + 1].append(x[~same])
            yield from collisions([np.concatenate(s) if s else np.zeros(0, np.uint64) for s in sides], bits - 1, radius)
        return
    low = np.uint64((1 << bits) - 1)
    variants = np.concatenate([((x & low)[:, None] ^ _masks(bits, radius - t)[None, :]).ravel() for t, x in enumerate(by_flips)])
    ordered = np.sort(variants)
    met = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(met):
        return
    slot = np.searchsorted(met, variants)
    slot[slot == len(met)] = 0
    hit = np.flatnonzero(met[slot] == variants)
    owners = np.concatenate([np.repeat(x, _ball_size(bits, radius - t)) for t, x in enumerate(by_flips)])[hit]
    group = slot[hit]
    order = np.argsort(group, kind="stable")
    owners, group = owners[order], group[order]
    same = group[1:] == group[:-1]
    pairs = np.unique(np.stack([owners[:-1][same], owners[1:][same]], axis=1), axis=0)
    if len(pairs):
        yield pairs[:, 0], pairs[:, 1]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components, at most one for each fingerprint."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links(distinct: DataFrame, count: int, radius: int = 4) -> DataFrame:
    """(a, b): links whose components are those of all pairs of `distinct` fp values within `radius` bits.

    count, the number of rows, sets the prefix's length: about 2 million variants for each
    prefix. Prefixes that more than _GROUP_ROWS rows share all the same are made longer, so a
    task holds a bounded number of rows, and variants in blocks of a bounded number at once.
    """
    half = radius // 2
    prefix = max(2, min(_BITS - 8, math.ceil(math.log2(max(count, 1) * _ball_size(_BITS, half) / (1 << 21)))))
    bits = _BITS - prefix
    flips = _masks(prefix, half)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 4096):
                part = fp[i : i + 4096]
                top = part.view(np.uint64) >> np.uint64(bits)
                yield pa.RecordBatch.from_arrays([pa.array((top[:, None] ^ flips[None, :]).ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)))], names=["prefix", "fp"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of crowded prefixes go to each longer prefix that the flips left to them reach."""
        for batch in batches:
            head, fp, more = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            away = np.bitwise_count((fp.view(np.uint64) >> np.uint64(bits)) ^ head.view(np.uint64))
            for extra in np.unique(more).tolist():
                for t in range(half + 1):
                    own = np.flatnonzero((more == extra) & (away == t))
                    masks = _masks(extra, half - t)
                    for i in range(0, len(own), 4096):
                        part = own[i : i + 4096]
                        next_bits = (fp[part].view(np.uint64) >> np.uint64(bits - extra)) & np.uint64((1 << extra) - 1)
                        longer = ((head[part].view(np.uint64) << np.uint64(extra))[:, None] | (next_bits[:, None] ^ masks[None, :])).ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(longer.view(np.int64)), pa.array(np.full(len(longer), extra, np.int32)), pa.array(np.repeat(fp[part], len(masks)))], names=["prefix", "more", "fp"])

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix_value, left = np.uint64(key[0].as_py()), bits - key[1].as_py()
        fp = np.unique(np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for b in batches]).view(np.uint64))
        away = np.bitwise_count((fp >> np.uint64(left)) ^ prefix_value)
        found = list(collisions([fp[away == t] for t in range(half + 1)], left, half))
        if not found:
            return
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        near = np.bitwise_count(a ^ b) <= radius
        a, b = _forest(a[near], b[near])
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    emitted = distinct.select("fp").mapInArrow(emit, "prefix bigint, fp bigint")
    most = bits - 8  # bits that a prefix may still take
    crowded = emitted.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _GROUP_ROWS)
    crowded = crowded.select("prefix", F.least(F.lit(most), F.ceil(F.log2(F.col("n") / F.lit(_GROUP_ROWS))).cast("int")).alias("more"))
    placed = emitted.join(crowded, "prefix", "left").select("prefix", "fp", F.coalesce("more", F.lit(0)).alias("more"))
    return placed.mapInArrow(extend, "prefix bigint, more int, fp bigint").groupBy("prefix", "more").applyInArrow(meet, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) for every row of df.

    Rows link when their fingerprints differ in at most `radius` (even) bits; component_id is
    the smallest id that a row reaches over links, its own included. Equal fingerprints are one
    node, found by a pre-aggregated minimum, so a group of copies of any size costs one row.
    Texts without words (null, empty, blank) have fingerprint 0 and link like any other; texts
    of any length are read whole.
    Null ids never become a component's id (null if a component has no other). An empty
    table gives an empty result; repeated rows each give a row.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    prints = scratch.write(fingerprints(df, id_col, text_col, words), "prints")
    # Written, so that the join with all rows has two inputs and a fingerprint that many share can be split.
    components = scratch.write(_labelled(scratch, prints, F.min(id_col), radius).select("fp", F.col("label.least").alias("component_id")), "components")
    return prints.join(components, "fp").select(F.col(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(scratch: Scratch, prints: DataFrame, least: Column, radius: int) -> DataFrame:
    """(fp, node, label) for each distinct fingerprint: an aggregate of its rows, and the least of its group.

    Nodes are ordered by that aggregate (nulls last) and fingerprint, so the label that the
    components' steps find is the group's least node itself, and no row needs the whole group.
    """
    node = F.struct(F.col("least").isNull().alias("none"), "least", "fp")
    nodes = scratch.write(prints.groupBy("fp").agg(least.alias("least")).select("fp", node.alias("node")), "nodes")
    found = scratch.write(links(nodes.select("fp"), nodes.count(), radius), "links", drop_shuffles=True)
    for end in ("a", "b"):
        found = found.join(nodes.select(F.col("fp").alias(end), F.col("node").alias(f"node_{end}")), end)
    linked = component_labels(found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).select(F.col("node.fp").alias("fp"), "label")
    return nodes.join(linked, "fp", "left").select("fp", "node", F.coalesce("label", "node").alias("label"))


def keep_one_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of df that stand for their near-duplicate group, one for each.

    It is the one with the smallest id, null after all others, then with the smallest hash of
    its text. A row is known by id and text, so rows without an id and unlike texts that share
    an id stay in their own groups; of rows that repeat both, one stays. df may have columns of any name.
    """
    scratch = Scratch(df.sparkSession, "kept")
    names, df = df.columns, own_names(df)
    id_col, text_col = own_name(id_col), own_name(text_col)
    keyed = df.select(row_key(id_col, text_col).alias("__key"), F.col(text_col).alias("__text"))
    prints = scratch.write(fingerprints(keyed, "__key", "__text", words), "prints")
    order = F.struct(F.col("__key.id").isNull().alias("last"), F.col("__key").alias("key"))
    chosen = _labelled(scratch, prints, F.min(order), radius).where("label.fp = fp")
    chosen = scratch.write(chosen.select(F.col("node.least.key").alias("__kept")), "chosen")
    rows = prints.join(chosen.hint("merge"), _same_row(F.col("__key"))).groupBy("__kept").agg(F.count(F.lit(1)).alias("__rows"))
    kept = scratch.write(rows, "kept")
    # Kept rows grow with the corpus, so they are never broadcast: texts move once, at every size alike.
    stay = df.join(kept.hint("merge"), _same_row(row_key(id_col, text_col)))
    plain = plain_names(names)
    if kept.where("__rows > 1").isEmpty():
        return stay.select(*plain)
    return stay.where("__rows = 1").select(*plain).unionByName(stay.where("__rows > 1").dropDuplicates(["__kept"]).select(*plain))


def _same_row(key: Column) -> Column:
    kept = F.col("__kept")
    return key["id"].eqNullSafe(kept["id"]) & (key["long"] == kept["long"]) & (key["short"] == kept["short"])
