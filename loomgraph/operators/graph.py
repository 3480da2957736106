"""Property-graph operators on node and edge tables.

Edges are (src, dst, key, weight) rows, nodes (id, ...) rows. Iterations keep their state in
tables of the shared folder, so lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import identity, scoring
from loomgraph.operators.components import component_labels
from loomgraph.operators.moves import Blocks
from loomgraph.sources.records import numbered
from loomgraph.sources.scratch import Tables


def graph_from_edges(fused: DataFrame, namespace: str = "literature", default_weight: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Typed multigraph of fused edges: nodes (id, type, name, namespace), edges (src, dst, key, weight), last write wins."""
    ns = F.lit(namespace)
    ends = fused.withColumn("src", identity.entity_id(ns, F.col("type_1"), F.col("name_1"))).withColumn("dst", identity.entity_id(ns, F.col("type_2"), F.col("name_2")))
    sides = F.array(F.struct(F.col("src").alias("id"), F.col("type_1").alias("type"), F.col("name_1").alias("name")), F.struct(F.col("dst").alias("id"), F.col("type_2").alias("type"), F.col("name_2").alias("name")))
    nodes = ends.select(F.explode(sides).alias("x")).select("x.*").distinct().withColumn("namespace", ns)
    keyed = ends.withColumn("key", F.concat(ns, F.lit(":"), F.col("relation")))
    edges = keyed.groupBy("src", "dst", "key").agg(F.max_by("computed_confidence", "first_seq").alias("w"))
    return nodes, edges.select("src", "dst", "key", F.coalesce("w", F.lit(default_weight)).alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): in-degree plus out-degree, parallel edges counted."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst")


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    return nodes.join(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_anti")


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, directions ignored."""
    labels = component_labels(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.select("id").distinct().join(labels, F.col("id") == F.col("node"), "left").select("id", F.coalesce("label", "id").alias("component"))


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, average degree, isolated nodes and their share."""
    counts = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    lonely = isolates(nodes, edges).agg(F.count(F.lit(1)).alias("isolated"))
    sizes = edges.agg(F.count(F.lit(1)).alias("edges"))
    row = counts.join(F.broadcast(sizes)).join(F.broadcast(lonely))
    return row.select("nodes", "edges", scoring.average_degree(F.col("edges"), F.col("nodes")).alias("average_degree"), "isolated", F.coalesce(scoring.ratio(F.col("isolated"), F.col("nodes")), F.lit(0.0)).alias("isolated_ratio"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, unique directed pairs, components, largest one, share outside it, self-loops."""
    sizes = weak_components(nodes, edges).groupBy("component").count()
    parts = sizes.agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.max("count"), F.lit(0)).alias("largest"), F.coalesce(F.sum("count"), F.lit(0)).alias("nodes"))
    flat = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.expr("src = dst")).alias("self_loops"))
    pairs = edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("pairs"))
    row = parts.join(F.broadcast(flat)).join(F.broadcast(pairs))
    return row.select("nodes", "edges", "pairs", "components", "largest", F.coalesce(F.lit(1.0) - scoring.ratio(F.col("largest"), F.col("nodes")), F.lit(0.0)).alias("outside_largest"), "self_loops")


#: Rounds between two writes: a lost executor costs that many.
_ROUNDS_AT_ONCE = 2


def condition_metrics(conditions: dict[str, DataFrame], base: str = "raw") -> DataFrame:
    """(condition, records, edges, nodes, pairs, average_degree, components, largest, outside_largest, self_loops,
    compression_vs_raw) of flat records under several treatments; compression is against the edges of `base`."""
    rows = None
    for name, records in conditions.items():
        end = lambda n: F.concat_ws("\u0001", f"type_{n}", f"name_{n}")
        keys = records.groupBy("name_1", "type_1", "relation", "name_2", "type_2").agg(F.count(F.lit(1)).alias("n"))
        keys = Tables(records.sparkSession, "condition").write(keys.select(end("1").alias("src"), end("2").alias("dst"), "n"), name)
        summary = graph_summary(keys.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), keys)
        total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("records"))
        row = summary.join(F.broadcast(total)).select(
            F.lit(name).alias("condition"), "records", "edges", "nodes", "pairs", scoring.average_degree(F.col("pairs"), F.col("nodes")).alias("average_degree"), "components", "largest", "outside_largest", "self_loops"
        )
        rows = row if rows is None else rows.unionByName(row)
    rows = Tables(rows.sparkSession, "condition").write(rows, "metrics")
    against = rows.where(F.col("condition") == base).select(F.col("edges").alias("__base"))
    return rows.join(F.broadcast(against), how="left").withColumn("compression_vs_raw", F.lit(1.0) - scoring.ratio(F.col("edges"), F.col("__base"))).drop("__base")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most_rounds: int = 100) -> DataFrame:
    """(id, rank): weighted PageRank, parallel weights summed, dangling mass spread evenly.

    Stops when the summed change of a round is below nodes * tolerance, looked at after every
    other round. Links stay packed by blocks of their targets, which are told the ranks of their sources.
    """
    tables = Tables(nodes.sparkSession, "pagerank")
    ids = tables.write(numbered(nodes.select("id").distinct(), "id"), "ids")
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    summed = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).where("w > 0")
    ends = [ids.select(F.col("id").alias(e), F.col("seq").alias(k)) for e, k in (("src", "b"), ("dst", "a"))]
    links = tables.write(summed.join(ends[0], "src").join(ends[1], "dst").select("a", "b", "w"), "links")
    total = links.groupBy("b").agg(F.sum("w").alias("out"))
    blocks = Blocks(tables, links, "links", loops=True)
    ranks = tables.write(ids.join(total, ids["seq"] == total["b"], "left").select("seq", "id", F.lit(1.0 / n).alias("rank"), "out"), "ranks-0")

    def round_of(before: DataFrame) -> DataFrame:
        lost = F.broadcast(before.where("out IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")))  # one row
        came = blocks.sums(before.select(F.col("seq").alias("id"), (F.col("rank") / F.coalesce("out", F.lit(1.0))).alias("unit"))).toDF("__to", "came")
        spread = F.lit((1.0 - damping) / n) + F.lit(damping / n) * F.col("lost") + F.lit(damping) * F.coalesce("came", F.lit(0.0))
        return before.join(came, before["seq"] == came["__to"], "left").crossJoin(lost).select("seq", "id", F.col("rank").alias("old"), spread.alias("rank"), "out")

    done = 0
    while done < most_rounds:
        some, new = min(_ROUNDS_AT_ONCE, most_rounds - done), ranks
        for _ in range(some):
            new = round_of(new)
        done += some
        ranks, (change,) = tables.write_measured(new, f"ranks-{done}", F.sum(F.abs(F.col("rank") - F.col("old"))))
        tables.drop(f"ranks-{done - some}")
        if change < n * tolerance:
            break
    return ranks.select("id", "rank")


def _undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w) with a < b, parallel edges and both directions summed, self-loops left out."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("w"))


def communities(nodes: DataFrame, edges: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(id, community): dense numbers from 0 by smallest member, of modularity communities.

    Nodes move to the neighbouring community that raises modularity most, communities become
    nodes, and so on until nothing is gained; last, a community that isn't connected falls into its
    connected parts. Every step is made of joins, or of sums over blocks of nodes with their edges, at any size alike:
    no task holds a component. A level of moves ends when two rounds, in which each node has its turn once, raise
    modularity by less than `tolerance`, and its best round counts, so moves made at the same time never
    lower the result. Weights are rounded to 2^-51 of their sum, which makes all sums exact: the
    partition depends on the graph alone, not on partitions or settings. Edges of weight 0 or less and
    self-loops tie nothing; parallel edges add up; a node without edges is a community of its own.
    """
    tables = Tables(nodes.sparkSession, "communities")
    ids = tables.write(numbered(nodes.select("id").distinct(), "id"), "ids")
    und = tables.write(_undirected(edges).where("w > 0"), "undirected")
    total = und.agg(F.sum("w")).first()[0]
    if not total:
        return ids.select("id", (F.col("seq") - 1).alias("community"))
    grid = 2.0 ** (51 - math.ceil(math.log2(total)))
    ends = [ids.select(F.col("id").alias(e), F.col("seq").alias(f"__{e}")) for e in ("a", "b")]
    pairs = und.join(ends[0], "a").join(ends[1], "b").select(F.col("__a").alias("a"), F.col("__b").alias("b"), F.rint(F.col("w") * grid).alias("w"))
    pairs = tables.write(pairs, "pairs")
    # Each edge in both directions; of a contracted community its own weight is a loop, counted from both ends.
    level = pairs.unionAll(pairs.select("b", "a", "w"))
    whole = pairs.agg(F.sum("w")).first()[0] * 2.0
    member = ids.select(F.col("seq").alias("id"), F.col("seq").alias("now"))
    k = 0
    while True:
        groups = _moves(tables, level, whole, tolerance, k)
        if groups.where("id <> label").isEmpty():  # nothing gains by moving: these are the communities
            break
        k += 1
        member = tables.write(member.join(groups.select(F.col("id").alias("now"), "label"), "now", "left").select("id", F.coalesce("label", "now").alias("now")), f"member-{k}")
        for end in ("a", "b"):
            level = level.join(groups.select(F.col("id").alias(end), F.col("label").alias(f"__{end}")), end).drop(end).withColumnRenamed(f"__{end}", end)
        level = tables.write(level.groupBy("a", "b").agg(F.sum("w").alias("w")), f"level-{k}")
    placed = member.select(F.col("id").alias("a"), F.col("now").alias("__a")), member.select(F.col("id").alias("b"), F.col("now").alias("__b"))
    inside = pairs.join(placed[0], "a").join(placed[1], "b").where("__a = __b")
    linked = component_labels(inside.select("a", "b"))  # the least node of each connected part
    every = ids.join(linked, ids["seq"] == linked["node"], "left").select("id", F.coalesce("label", "seq").alias("group"))
    every = tables.write(every, "every")
    firsts = every.select("group").distinct()
    numbers = numbered(firsts, "group").select("group", (F.col("seq") - 1).alias("community"))
    return every.join(numbers, "group").select("id", "community")


def _moves(tables: Tables, level: DataFrame, whole: float, tolerance: float, k: int) -> DataFrame:
    """(id, label): communities after rounds of moves, nodes at first alone; a label is the least of its members.

    The nodes are in two pseudo-random classes, drawn anew for every two rounds, that move in
    turns, so that neighbours don't swap for ever. What a move gains is known from sums by (node, neighbouring
    community), which blocks of nodes make from the labels of their neighbours.
    """
    blocks = Blocks(tables, level, str(k))
    state = tables.write(blocks.strength.select(F.col("a").alias("id"), F.col("a").alias("label"), "k", F.xxhash64("a", F.lit(k)).alias("draw")), f"state-{k}-0")
    best, reached, idle, r = state, -math.inf, 0, 0
    names = {0}
    while idle < 2:
        new = blocks.round(state, whole, r % 2)
        if r % 2:  # both classes had their turn
            new = new.withColumn("draw", F.xxhash64("draw"))
        new = tables.write(new, f"state-{k}-{r + 1}")
        # Modularity before this round, loops aside: they are the same in every round.
        value, wants = new.agg(F.sum("links") / F.lit(whole) - F.sum(F.col("k") * F.col("mass") / F.lit(whole)) / F.lit(whole), F.count_if("wants")).first()
        if value is None:  # no edge between two nodes
            break
        idle = 0 if value > reached + tolerance else idle + 1
        if value > reached:
            best, reached, keep = state, value, r
        if not wants:  # no node would move, whoever's turn it is
            break
        names.add(r + 1)
        for old in names - {keep, r + 1}:
            tables.drop(f"state-{k}-{old}")
        names &= {keep, r + 1}
        state, r = new, r + 1
    firsts = best.groupBy("label").agg(F.min("id").alias("first"))
    return tables.write(best.select("id", "label").join(firsts, "label").select("id", F.col("first").alias("label")), f"moved-{k}")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: modularity of (id, community) labels on the undirected view."""
    und = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("w"))
    la, lb = labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), labels.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    placed = und.join(la, "a").join(lb, "b")
    ends = placed.select(F.explode(F.array("ca", "cb")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("k"))
    inside = placed.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("m"))
    return ends.agg(F.sum(F.col("k") * F.col("k")).alias("kk")).join(F.broadcast(inside)).select((F.col("inside") / F.col("m") - F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with PageRank and community, highest rank first."""
    return nodes.join(pagerank(nodes, edges), "id").join(communities(nodes, edges), "id").orderBy(F.desc("rank"), "id")


def with_metrics(nodes: DataFrame, scored: DataFrame) -> DataFrame:
    """Nodes with rank, community, viewer size and colour, defaults where a node has no metrics."""
    return nodes.join(scored.select("id", "rank", "community"), "id", "left").withColumns({"rank": F.coalesce("rank", F.lit(0.005)), "community": F.coalesce("community", F.lit(-1)), "size": scoring.viewer_size(F.col("rank")), "colour": scoring.viewer_colour(F.col("type")) if "type" in nodes.columns else F.lit(scoring.OTHER_COLOUR)})


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int = 2, directed: bool = False) -> DataFrame:
    """(id, hop): nodes within some hops of the start ids, with the fewest hops."""
    steps = edges.select(F.col("src").alias("from"), F.col("dst").alias("to"))
    if not directed:
        steps = steps.unionByName(edges.select(F.col("dst").alias("from"), F.col("src").alias("to")))
    steps = steps.distinct()
    reached = start.select("id", F.lit(0).alias("hop")).distinct()
    for hop in range(1, hops + 1):
        frontier = reached.where(F.col("hop") == hop - 1)
        found = steps.join(frontier, steps["from"] == frontier["id"]).select(F.col("to").alias("id"), F.lit(hop).alias("hop")).distinct()
        reached = reached.unionByName(found).groupBy("id").agg(F.min("hop").alias("hop"))
    return reached


def select_by_property(edges: DataFrame, column: str, values: list) -> DataFrame:
    """Endpoints of the edges whose property is among the values."""
    return edges.where(F.col(column).isin(values)).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
