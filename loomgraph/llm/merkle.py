"""A Merkle manifest of a dataset: a digest for each row, a tree for each group of rows, a tree over the groups.

Rows get their place in their group from one range-partitioned sort. The nodes of a level lie in
aligned blocks of fanout^k, and a block is one small numpy matrix of 64-byte hexadecimal digests:
reshaped by the fanout, its rows are hashed level by level, and every sibling's place is index
arithmetic. Blocks of blocks follow until one node is left, so a group may hold all rows. A second
pass goes down again and gives each node the siblings on its way to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, no_clash, ship
from loomgraph.sources.records import numbered

_HEX = 64
_BROADCAST_BYTES = 8_000_000
PROOF = "array<struct<left:string,right:string>>"
OUTPUTS = ("leaf", "claimed", "subroot", "root", "proof")


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count of the value's text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """Lowercase hexadecimal SHA-256 of the encoded values, concatenated."""
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def siblings_text(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to; null for a null leaf."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]).cast("binary"), 256))


def _matrix(digests: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(digests).encode("ascii"), np.uint8).reshape(-1, _HEX)


def _parents(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """Digests of runs of fanout nodes; the last run may be shorter."""
    whole = len(nodes) // fanout * fanout
    runs = [*np.ascontiguousarray(nodes[:whole]).reshape(-1, _HEX * fanout)]
    if whole < len(nodes):
        runs.append(np.ascontiguousarray(nodes[whole:]).reshape(-1))
    return _matrix([hashlib.sha256(run).hexdigest() for run in runs])


def _steps(size: int, width: int, fanout: int) -> int:
    """Levels that a block is folded by, size being the nodes of its whole group: all of a block's where there are further blocks."""
    if size > width:
        size = width
    steps = 0
    while size > 1:
        size, steps = -(-size // fanout), steps + 1
    return steps


def block_levels(nodes: np.ndarray, fanout: int, steps: int) -> list[np.ndarray]:
    """The nodes of a block and of each level above them, up to the block's one digest."""
    levels = [nodes]
    for _ in range(steps):
        levels.append(_parents(levels[-1], fanout))
    return levels


def _level_siblings(nodes: np.ndarray, fanout: int) -> tuple[list[str], list[str]]:
    """For each node of a level, what stands left and right of it in its run."""
    text, count = nodes.tobytes().decode("ascii"), len(nodes)
    lefts, rights = [], []
    for p in range(count):
        first = p // fanout * fanout
        lefts.append(text[first * _HEX : p * _HEX])
        rights.append(text[(p + 1) * _HEX : min(first + fanout, count) * _HEX])
    return lefts, rights


def block_proofs(levels: list[np.ndarray], fanout: int, above: Sequence[Mapping[str, str]]) -> pa.Array:
    """For each node of a block's lowest level its steps through the block, then the steps above the block's digest."""
    count = len(levels[0])
    lefts, rights, places = [], [], []
    for k, nodes in enumerate(levels[:-1]):
        places.append(len(lefts) + np.arange(count) // fanout**k)
        for pool, more in zip((lefts, rights), _level_siblings(nodes, fanout), strict=True):
            pool += more
    for step in above:
        places.append(np.full(count, len(lefts)))
        lefts.append(step["left"])
        rights.append(step["right"])
    at = pa.array(np.stack(places, axis=1).ravel() if places else np.empty(0, np.int64), pa.int64())
    steps = pa.StructArray.from_arrays([pa.array(pool, pa.string()).take(at) for pool in (lefts, rights)], ["left", "right"])
    return pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * len(places), pa.int32()), steps)


def _in_blocks(nodes: DataFrame, width: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(width)).cast("long"))


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(table["pos"].to_numpy())))


def _folded_blocks(nodes: DataFrame, fanout: int, width: int) -> DataFrame:
    """(g, n, pos, digest) of each block's digest."""

    def fold(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        size = table["n"][0].as_py()
        top = block_levels(_matrix(table["digest"].to_pylist()), fanout, _steps(size, width, fanout))[-1]
        return pa.table({"g": table["g"][:1], "n": [-(-size // width)], "pos": table["block"][:1], "digest": [top.tobytes().decode("ascii")]})

    slim = _in_blocks(nodes.select("g", "n", "pos", "digest"), width)
    return slim.groupBy("g", "block").applyInArrow(fold, "g long, n long, pos long, digest string")


def _proofs(nodes: DataFrame, above: DataFrame, fanout: int, width: int) -> DataFrame:
    """nodes with the proof and subroot of their block's digest in `above` carried down to each of them."""
    kept = nodes.columns

    def prove(table: pa.Table, tops: pa.Table) -> pa.Table:
        table, top = _sorted(table), tops.to_pylist()[0]
        levels = block_levels(_matrix(table["digest"].to_pylist()), fanout, _steps(table["n"][0].as_py(), width, fanout))
        proofs = block_proofs(levels, fanout, top["proof"])
        return table.select(kept).append_column("proof", proofs).append_column("subroot", pa.array([top["subroot"]] * len(table), pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + f", proof {PROOF}, subroot string"
    tops = above.select("g", F.col("pos").alias("block"), "proof", "subroot")
    return _in_blocks(nodes, width).groupBy("g", "block").cogroup(tops.groupBy("g", "block")).applyInArrow(prove, schema)


def _tree(nodes: DataFrame, most: int, fanout: int, width: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """nodes, their blocks' digests, those blocks', until every group of up to `most` nodes has one digest."""
    levels = [nodes]
    while most > 1:
        levels.append(scratch.write(_folded_blocks(levels[-1], fanout, width), f"{name}-{len(levels)}"))
        most = -(-most // width)
    return levels


def manifest(
    df: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    value_cols: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    claims: Mapping[str, Column] | None = None,
    fanout: int = 2,
    block: int = 1024,
) -> DataFrame:
    """(id, leaf, claimed, subroot, root, proof) for every row of df.

    leaf is the digest of the row's values; claimed is the digest with the values that `claims`
    gives in place of some columns', else equal to leaf. In a group, null being one of its own,
    leaves ascend by id, null first, then by digest. While there are several nodes, every `fanout`
    consecutive ones, in the last run fewer, even one, become the digest of their concatenation;
    a lone leaf is its group's subroot. Subroots in the order of their groups give the root the same way.
    proof lists the steps to the root as what stands left and right of the node in its run, so
    `folded(leaf, proof)` is the root. Null values are encoded apart from empty ones, texts of any
    length are hashed whole. Repeated rows are leaves of their own whose proofs are dealt among them as they come.
    Further columns are left out; id_col must not be named like an output. An empty table gives an empty result.

    A block holds up to `block` nodes, so neither a task nor the driver holds a group. Groups are one row each
    and are broadcast up to 8 MB only.
    """
    no_clash(id_col, *OUTPUTS)
    if fanout < 2:
        raise ValueError("a run has two nodes or more")
    spark, width = df.sparkSession, fanout
    while width * fanout <= block:
        width *= fanout
    ship(spark)
    scratch = Scratch(spark, "merkle")
    claims = dict(claims or {})
    same = F.lit(True)
    for name, claimed in claims.items():
        same &= F.col(name).eqNullSafe(claimed)
    leaves = df.select(
        F.col(id_col).alias("id"),
        F.col(group_col).alias("group"),
        leaf_digest([F.col(c) for c in value_cols]).alias("digest"),
        F.when(~same, leaf_digest([claims.get(c, F.col(c)) for c in value_cols])).alias("claim"),
    )
    # The row's number in the written table tells repeated rows apart, so that many of them are no single range.
    leaves = scratch.write(leaves, "leaves").withColumn("row", F.monotonically_increasing_id())
    placed = numbered(leaves, "group", "id", "digest", "row")
    groups = scratch.write(placed.groupBy("group").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")), "groups")
    total, most, size = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum(F.octet_length(F.coalesce(F.col("group").cast("string"), F.lit(""))) + 40), F.lit(0))).first()
    if total > 1:
        groups = numbered(groups, "first").withColumn("g", F.col("seq") - 1)
    else:
        groups = groups.withColumn("g", F.lit(0).cast("long"))
    groups = groups.select(F.col("group").alias("name"), "first", "n", "g")
    rows = placed.join(F.broadcast(groups) if size <= _BROADCAST_BYTES else groups, F.col("group").eqNullSafe(F.col("name")))
    rows = rows.select("g", "n", (F.col("seq") - F.col("first")).alias("pos"), "id", "digest", "claim")

    trees = _tree(rows, most, fanout, width, scratch, "rows")
    subroots = trees[-1].select(F.lit(0).cast("long").alias("g"), F.lit(total).cast("long").alias("n"), F.col("g").alias("pos"), "digest")
    tops = _tree(subroots, total, fanout, width, scratch, "groups")
    root = tops[-1].select("digest").first()
    paths = tops[-1].select("g", "pos", "digest", F.array().cast(PROOF).alias("proof"), F.lit(None).cast("string").alias("subroot"))
    for nodes in reversed(tops[:-1]):
        paths = _proofs(nodes, paths, fanout, width)
    paths = paths.select(F.col("pos").alias("g"), F.lit(0).cast("long").alias("pos"), "digest", "proof", F.col("digest").alias("subroot"))
    for nodes in reversed(trees[1:-1]):
        paths = _proofs(nodes, paths, fanout, width)
    if len(trees) > 1:
        paths = _proofs(rows, paths, fanout, width)
    else:  # every group is one row
        paths = rows.join(paths.select("g", "proof", "subroot"), "g")
    return paths.select(
        F.col("id").alias(id_col),
        F.col("digest").alias("leaf"),
        F.coalesce("claim", "digest").alias("claimed"),
        "subroot",
        F.lit(root["digest"] if root else None).cast("string").alias("root"),
        "proof",
    )
