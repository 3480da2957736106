"""Connected components of an edge table, without collecting it.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond"): each is one pre-aggregated minimum per node and one join, and the
number of edges never grows. Every step is written to the shared folder. Before the first,
each task puts the edges that it reads, in blocks, down to stars, which takes whole chains
out of the steps where neighbours lie together.

A hub is a key of the join with many rows on one side and one row on the other, which
adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.scratch import Tables

_MOST_ROUNDS = 64
_BLOCK_EDGES = 1 << 20


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges as stars around the smallest node of each component that a block of them shows."""

    def settled(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(block)
        ends = pa.chunked_array([*table["a"].chunks, *table["b"].chunks])
        nodes = pc.unique(ends)
        nodes = nodes.take(pc.sort_indices(nodes))  # numbers in the order of the nodes
        place = pc.index_in(ends, nodes).to_numpy()
        x, y = place[: len(table)], place[len(table) :]
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
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(label[moved]))], names=["a", "b"])

    block: list[pa.RecordBatch] = []
    for batch in batches:
        block.append(batch)
        if sum(b.num_rows for b in block) >= _BLOCK_EDGES:
            yield settled(block)
            block = []
    if block:
        yield settled(block)


def star_step(edges: DataFrame) -> DataFrame:
    """One large-star step followed by one small-star step on (a, b) edges."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    # Every edge now points from a larger node a to a smaller one b.
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    hooked = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the (a, b) edges, self-loops aside: the smallest node it is linked with."""
    tables = Tables(edges.sparkSession, "components")
    mark = (F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    first = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    kind = dict(first.dtypes)["a"]
    first = (first.mapInArrow(_stars, f"a {kind}, b {kind}") if kind in ("bigint", "int", "string") else first).distinct()
    current, before = tables.write_measured(first, "edges-0", *mark)
    for k in range(1, _MOST_ROUNDS):
        current, after = tables.write_measured(star_step(current), f"edges-{k}", *mark)
        tables.drop(f"edges-{k - 1}")
        if after == before:
            # Settled edges are stars around each component's smallest node.
            return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = after
    raise RuntimeError(f"components have not settled after {_MOST_ROUNDS} rounds")
