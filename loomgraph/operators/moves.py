"""Rounds over a graph by blocks of nodes whose edges are packed as arrays: moves between communities, and ranks.

Edges stay where they are from round to round, in a table with one row of arrays for each block. What
moves is a value or two (a label and a mass, or a rank) for each pair of a node and a block that has a neighbour of it, in
one array for each pair of blocks. A block has about `_BLOCK_EDGES` edges; a node that has more than that by itself is in
none, and has its rounds by joins and sums over its edges.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.scratch import Tables

#: Edges of a block, each counted from both ends: some 16 bytes each in its table, some 100 while it moves.
_BLOCK_EDGES = 1 << 21
_LEAST_EDGES = 1 << 15

_PACKED = "block int, nodes binary, first binary, k binary, near binary, mine binary, w binary, needs array<struct<owner:int,ids:binary>>"
_SUMS = "id bigint, came double"
_MOVED = "id bigint, label bigint, k double, draw bigint, links double, mass double, wants boolean"


def _array(packed: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(packed[column][0].as_buffer(), kind)


def _pack(loops: bool) -> Callable[[pa.Table], pa.Table]:
    def run(edges: pa.Table) -> pa.Table:
        """All edges (block, a, b, owner, w) of a block's nodes as one row; without `loops` a loop counts for a node's strength only."""
        a, b, owner, w = (edges[c].to_numpy() for c in ("a", "b", "owner", "w"))
        block = edges["block"][0].as_py()
        order = np.argsort(a, kind="stable")
        a, b, owner, w = a[order], b[order], owner[order], w[order]
        every, at = np.unique(a, return_index=True)
        strength = np.add.reduceat(w, at)
        if not loops:
            real = a != b
            a, b, owner, w = a[real], b[real], owner[real], w[real]
        nodes, first = np.unique(a, return_index=True)
        wanted, place = np.unique(np.concatenate([b, nodes]), return_inverse=True)
        owners = np.empty(len(wanted), np.int32)
        owners[place] = np.concatenate([owner, np.full(len(nodes), block, np.int32)])
        order = np.lexsort((wanted, owners))  # as the messages of a round follow each other
        spot = np.empty(len(order), np.int32)
        spot[order] = np.arange(len(order), dtype=np.int32)
        senders, starts = np.unique(owners[order], return_index=True)
        ids = np.split(wanted[order], starts[1:])
        arrays = {
            "nodes": nodes,
            "first": first.astype(np.int64),
            "k": strength[np.searchsorted(every, nodes)],
            "near": spot[place[: len(b)]],
            "mine": spot[place[len(b) :]],
            "w": w,
        }
        needs = [[{"owner": int(j), "ids": x.tobytes()} for j, x in zip(senders, ids)]] if len(nodes) else [[]]
        kind = pa.list_(pa.struct([("owner", pa.int32()), ("ids", pa.binary())]))
        return pa.table({"block": pa.array([block], pa.int32()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in arrays.items()}, "needs": pa.array(needs, kind)})

    return run


def _send(*columns: str, own: tuple[str, ...] = ()) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(placed: pa.Table, needs: pa.Table) -> pa.Table:
        """What a block's nodes (id, columns) tell each block that needs some of them; `own` only their own."""
        ids = placed["id"].to_numpy()
        order = np.argsort(ids)
        ids, told = ids[order], {c: placed[c].to_numpy()[order] for c in (*columns, *own)}
        to, owner = needs["block"].to_pylist(), needs["owner"].to_pylist()
        out: dict[str, list[bytes]] = {c: [] for c in told}
        for t, o, want in zip(to, owner, needs["ids"]):
            at = np.searchsorted(ids, np.frombuffer(want.as_buffer(), np.int64))
            for c, values in told.items():
                out[c].append(values[at].tobytes() if c in columns or t == o else b"")
        return pa.table({"to": pa.array(to, pa.int32()), "owner": pa.array(owner, pa.int32()), **{c: pa.array(x, pa.binary()) for c, x in out.items()}})

    return run


def _sum(came: pa.Table, packed: pa.Table) -> pa.Table:
    """The sum of weight times neighbour's unit for each node of a block."""
    if not packed.num_rows or not came.num_rows:
        return pa.table({"id": pa.array([], pa.int64()), "came": pa.array([], pa.float64())})
    unit = np.frombuffer(b"".join(came.sort_by("owner")["unit"].to_pylist()), np.float64)
    parts = unit[_array(packed, "near", np.int32)] * _array(packed, "w", np.float64)
    sums = np.add.reduceat(parts, _array(packed, "first", np.int64))
    return pa.table({"id": pa.array(_array(packed, "nodes", np.int64)), "came": pa.array(sums)})


def _move(whole: float, half: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(came: pa.Table, packed: pa.Table) -> pa.Table:
        """A round of a block's nodes: sums by (node, neighbouring community), the best of them, the smallest label of equals."""
        if not packed.num_rows or not came.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        came = came.sort_by("owner")
        own = np.array(came["owner"].to_pylist()) == packed["block"][0].as_py()
        label, mass, draw = (np.frombuffer(b"".join(came[c].to_pylist()), t) for c, t in (("label", np.int64), ("mass", np.float64), ("draw", np.int64)))
        before = sum(len(x.as_buffer()) // 8 for x in came["label"].slice(0, int(np.argmax(own))))
        nodes, first, k, w = _array(packed, "nodes", np.int64), _array(packed, "first", np.int64), _array(packed, "k", np.float64), _array(packed, "w", np.float64)
        near, mine = _array(packed, "near", np.int32), _array(packed, "mine", np.int32)
        draw = draw[mine - before]
        labels, code = np.unique(label, return_inverse=True)
        masses = np.empty(len(labels))
        masses[code] = mass
        each, width, now = np.arange(len(nodes)), len(labels), code[mine]
        node = np.repeat(each, np.diff(np.append(first, len(w))))
        keys = np.concatenate([node * width + code[near], each * width + now])  # staying is possible without a link
        order = np.argsort(keys)
        keys, weights = keys[order], np.concatenate([w, np.zeros(len(nodes))])[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        links = np.add.reduceat(weights, starts)
        node, option = np.divmod(keys[starts], width)
        here = option == now[node]
        gain = links - k[node] * (masses[option] - np.where(here, k[node], 0.0)) / whole
        begins = np.searchsorted(node, each)
        best = np.flatnonzero(gain == np.maximum.reduceat(gain, begins)[node])
        best = best[np.searchsorted(node[best], each)]
        stay = np.flatnonzero(here)
        wants = gain[best] > gain[stay]
        to = labels[np.where(wants & ((draw & 1) == half), option[best], now)]
        values = (nodes, to, k, draw, links[stay], masses[now], wants)
        return pa.table({c: pa.array(x, t) for (c, t), x in zip(kinds.items(), values)})

    real, whole_number = pa.float64(), pa.int64()
    kinds = {"id": whole_number, "label": whole_number, "k": real, "draw": whole_number, "links": real, "mass": real, "wants": pa.bool_()}
    return run


def _joined(near: DataFrame, placed: DataFrame, whole: float, half: int) -> DataFrame:
    """The same round for the nodes of near (a, b, w), by joins and sums: a hub is pre-aggregated in each task."""
    toward = near.join(placed.select(F.col("id").alias("b"), "label", "mass"), "b").groupBy("a", "label").agg(F.sum("w").alias("links"), F.first("mass").alias("mass"))
    nothing = F.lit(None)
    toward = toward.select("a", "label", "links", "mass", nothing.cast("double").alias("k"), nothing.cast("bigint").alias("draw"))
    stay = placed.join(near.select(F.col("a").alias("id")).distinct(), "id").select(F.col("id").alias("a"), "label", F.lit(0.0).alias("links"), "mass", "k", "draw")
    options = toward.unionAll(stay).groupBy("a", "label").agg(F.sum("links").alias("links"), *[F.max(c).alias(c) for c in ("mass", "k", "draw")])
    options = options.join(stay.select("a", F.col("k").alias("__k")), "a")
    gain = F.col("links") - F.col("__k") * (F.col("mass") - F.coalesce("k", F.lit(0.0))) / F.lit(whole)
    options = options.withColumn("gain", gain)
    chosen = options.groupBy("a").agg(
        F.min_by("label", F.struct(F.negate("gain"), F.col("label"))).alias("to"),
        F.max("gain").alias("gain"),
        F.max(F.when(F.col("k").isNotNull(), F.struct("label", "gain", "links", "mass", "k", "draw"))).alias("now"),
    )
    wants = F.col("gain") > F.col("now.gain")
    goes = wants & (F.pmod("now.draw", F.lit(2)) == half)
    return chosen.select(F.col("a").alias("id"), F.when(goes, F.col("to")).otherwise(F.col("now.label")).alias("label"), "now.k", "now.draw", "now.links", "now.mass", wants.alias("wants"))


class Blocks:
    """The edges (a, b, w) of a graph packed by blocks of nodes a that their hash deals out.

    For moves each edge is there in both directions. `loops`: edges from a node to itself count as well.
    """

    def __init__(self, tables: Tables, level: DataFrame, name: str, loops: bool = False):
        real = F.lit(loops) | F.expr("a <> b")
        strength = level.groupBy("a").agg(F.sum("w").alias("k"), F.count_if(real).alias("n")).where("n > 0")
        self.strength = tables.write(strength, f"strength-{name}")
        edges, most = self.strength.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
        self.count = max(-(-edges // _BLOCK_EDGES), min(-(-edges // _LEAST_EDGES), 2 * level.sparkSession.sparkContext.defaultParallelism), 1)
        self.hubs = None
        if edges and most > _BLOCK_EDGES:
            hubs = self.strength.where(F.col("n") > _BLOCK_EDGES).select("a")  # each has that many edges, so these are few
            self.hubs = tables.write(level.where(real).join(F.broadcast(hubs), "a"), f"hubs-{name}")
            level = level.join(F.broadcast(hubs), "a", "left_anti")
        dealt = level.select(self._block("a").alias("block"), "a", "b", self._block("b").alias("owner"), "w")
        packed = tables.write(dealt.groupBy("block").applyInArrow(_pack(loops), _PACKED), f"packed-{name}")
        self.packed = packed.drop("needs")
        self.needs = tables.write(packed.select("block", F.explode("needs").alias("x")).select("block", "x.*"), f"needs-{name}")

    def _block(self, node: str) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(self.count)).cast("int")

    def _told(self, placed: DataFrame, *columns: str, own: tuple[str, ...] = ()):
        """What the blocks are told of their neighbours, by block, with what the block holds."""
        dealt = placed.select(self._block("id").alias("owner"), "id", *columns, *own)
        kinds = "to int, owner int, " + ", ".join(f"{c} binary" for c in (*columns, *own))
        sent = dealt.groupBy("owner").cogroup(self.needs.groupBy("owner")).applyInArrow(_send(*columns, own=own), kinds)
        return sent.groupBy("to").cogroup(self.packed.groupBy("block"))

    def sums(self, units: DataFrame) -> DataFrame:
        """(id, came): for each node a the sum of w times the unit of b, of (id, unit) rows for all nodes."""
        came = self._told(units, "unit").applyInArrow(_sum, _SUMS)
        if self.hubs is None:
            return came
        sent = self.hubs.join(units.select(F.col("id").alias("b"), "unit"), "b")
        return came.unionAll(sent.groupBy("a").agg(F.sum(F.col("w") * F.col("unit"))))

    def round(self, state: DataFrame, whole: float, half: int) -> DataFrame:
        """Nodes (id, label, k, draw) after a round in which those move whose draw ends in `half`; links, mass and wants are of before."""
        mass = state.groupBy("label").agg(F.sum("k").alias("mass"))
        placed = state.select("id", "label", "k", "draw").join(mass, "label")
        new = self._told(placed, "label", "mass", own=("draw",)).applyInArrow(_move(whole, half), _MOVED)
        return new if self.hubs is None else new.unionByName(_joined(self.hubs, placed, whole, half))
