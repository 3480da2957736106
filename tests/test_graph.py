"""Components and communities at several ways of cutting the work."""

from collections import defaultdict

import numpy as np
import pytest

from loomgraph.operators import components, graph, moves


def planted(rng, groups=12, size=15):
    pairs = []
    for g in range(groups):
        at = g * size
        pairs += [(at + i, at + j, 1.0) for i in range(size) for j in range(i) if rng.random() < 0.5]
        pairs.append((at, (at + size) % (groups * size), 0.5))
    return pairs


def louvain(pairs, n):
    """Plain Louvain in one process: local moves, contraction, until nothing moves."""
    weight = defaultdict(float)
    for a, b, w in pairs:
        if a != b:
            weight[a, b] += w
            weight[b, a] += w
    whole, member = sum(weight.values()), list(range(n))
    while True:
        near, strength = defaultdict(dict), defaultdict(float)
        for (a, b), w in weight.items():
            near[a][b] = w
            strength[a] += w
        label, mass, moved_any, moved = {v: v for v in near}, dict(strength), False, True
        while moved:
            moved = False
            for v in sorted(near):
                links = defaultdict(float, {label[v]: 0.0})
                for u, w in near[v].items():
                    if u != v:
                        links[label[u]] += w
                mass[label[v]] -= strength[v]
                gain = {c: x - strength[v] * mass[c] / whole for c, x in links.items()}
                best = max(sorted(gain), key=gain.get)
                if gain[best] > gain[label[v]] + 1e-12:
                    label[v], moved, moved_any = best, True, True
                mass[label[v]] += strength[v]
        if not moved_any:
            return member
        member = [label.get(c, c) for c in member]
        new = defaultdict(float)
        for (a, b), w in weight.items():
            new[label[a], label[b]] += w
        weight = new


def test_communities_are_as_good_as_plain_louvain_and_the_same_in_any_setting(spark):
    pairs = planted(np.random.default_rng(3))
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint, weight double")
    nodes = spark.range(12 * 15 + 2)
    found = []
    for partitions, adaptive in (("4", "true"), ("7", "false")):
        try:
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            labels = graph.communities(nodes.repartition(int(partitions)), edges.repartition(int(partitions) + 1))
            found.append({r["id"]: r["community"] for r in labels.collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
    rows = found[0]
    assert rows == found[1] and len(rows) == 182 and sorted(set(rows.values())) == list(range(len(set(rows.values()))))
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i], i)
    assert [first[c] for c in sorted(first)] == sorted(first.values())  # numbers by smallest member
    plain = spark.createDataFrame(list(enumerate(louvain(pairs, 182))), "id bigint, community bigint")
    ours = spark.createDataFrame(list(rows.items()), "id bigint, community bigint")
    best = graph.modularity(edges, plain).first()[0]
    assert best > 0.75 and graph.modularity(edges, ours).first()[0] > 0.99 * best


def test_communities_of_odd_graphs(spark):
    kind = "src string, dst string, weight double"
    nodes = spark.createDataFrame([("x",), ("a",), ("b",), ("b",)], "id string")
    for edges in ([], [("a", "a", 1.0)], [("a", "b", 0.0)]):
        found = graph.communities(nodes, spark.createDataFrame(edges, kind))
        assert sorted(map(tuple, found.collect())) == [("a", 0), ("b", 1), ("x", 2)]
    found = graph.communities(nodes, spark.createDataFrame([("a", "b", 1e-9), ("b", "a", 1e-9), ("x", "x", 5.0)], kind))
    assert sorted(map(tuple, found.collect())) == [("a", 0), ("b", 0), ("x", 1)]
    assert graph.communities(nodes.limit(0), spark.createDataFrame([], kind)).collect() == []
    hub = [(0, i, 1.0) for i in range(1, 300)] + [(i, i + 1, 5.0) for i in range(1, 300, 2)]
    labels = graph.communities(spark.range(301), spark.createDataFrame(hub, "src bigint, dst bigint, weight double"))
    rows = {r["id"]: r["community"] for r in labels.collect()}
    assert all(rows[i] == rows[i + 1] for i in range(1, 300, 2))


@pytest.mark.parametrize("block", [1 << 20, 5])
def test_components_with_hubs_cycles_and_a_giant(spark, monkeypatch, block):
    monkeypatch.setattr(components, "_BLOCK_EDGES", block)
    rng = np.random.default_rng(8)
    pairs = [(0, i) for i in range(1, 200)] + [(300 + i, 300 + (i + 1) % 50) for i in range(50)] + [(400, 400), (500, 501)]
    pairs += [(int(a), int(b)) for a, b in rng.integers(600, 900, (260, 2))] + [(901, 900), (902, 901), (903, 902)]
    parent = list(range(1000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    nodes, edges = spark.range(1000), spark.createDataFrame(pairs, "src bigint, dst bigint").repartition(3)
    assert {r["id"]: r["component"] for r in graph.weak_components(nodes, edges).collect()} == {i: find(i) for i in range(1000)}
    names = graph.weak_components(nodes.selectExpr("lpad(id, 4, 'é') AS id"), edges.selectExpr("lpad(src, 4, 'é') AS src", "lpad(dst, 4, 'é') AS dst"))
    assert names.select("component").distinct().count() == len({find(i) for i in range(1000)})


def test_communities_by_blocks_are_those_by_joins(spark, monkeypatch):
    """Any number of blocks, and hubs that are too large for one, give one partition; edges are packed, not rows, in a round."""
    rng = np.random.default_rng(5)
    pairs = planted(rng) + [(0, i, 0.25) for i in range(1, 180, 2)] + [(7, 7, 3.0)] + [(int(a), int(b), 1.0) for a, b in rng.integers(0, 180, (300, 2))]
    edges, nodes = spark.createDataFrame(pairs, "src bigint, dst bigint, weight double"), spark.range(182)
    found = []
    for most, least in ((1 << 21, 1 << 15), (40, 8), (1, 1)):  # one block, many and hubs, joins alone
        monkeypatch.setattr(moves, "_BLOCK_EDGES", most)
        monkeypatch.setattr(moves, "_LEAST_EDGES", least)
        found.append(sorted(map(tuple, graph.communities(nodes, edges).collect())))
    assert len(found[0]) == 182 and found[1:] == found[:1] * 2
    monkeypatch.setattr(moves, "_BLOCK_EDGES", 1 << 21)
    both = edges.where("src <> dst").selectExpr("src a", "dst b", "weight w").unionAll(edges.where("src <> dst").selectExpr("dst a", "src b", "weight w")).groupBy("a", "b").sum("w").toDF("a", "b", "w")
    monkeypatch.setattr(moves, "_LEAST_EDGES", 400)
    blocks = moves.Blocks(moves.Tables(spark, "test"), both, "t")
    assert blocks.hubs is None and 1 < blocks.count == blocks.packed.count() <= 8 and blocks.needs.count() <= blocks.count**2


def test_ranks_by_blocks_are_those_of_a_plain_version(spark, monkeypatch):
    """Loops, parallel edges, weights of 0, a hub on either side, nodes without edges; a round's edges are packed."""
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b), float(w)) for a, b, w in rng.integers(0, 60, (200, 3))] + [(3, i, 1.0) for i in range(90)] + [(i, 5, 2.0) for i in range(90)] + [(7, 7, 4.0)]
    matrix = np.zeros((100, 100))
    for a, b, w in pairs:
        matrix[b, a] += w
    out = matrix.sum(0)
    share = np.divide(matrix, out, out=np.zeros_like(matrix), where=out > 0)
    want = np.full(100, 0.01)
    for _ in range(5):
        want = 0.15 / 100 + 0.85 * (share @ want + want[out == 0].sum() / 100)
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint, weight double")
    for most, least in ((1 << 21, 1 << 15), (40, 8)):
        monkeypatch.setattr(moves, "_BLOCK_EDGES", most)
        monkeypatch.setattr(moves, "_LEAST_EDGES", least)
        found = {r["id"]: r["rank"] for r in graph.pagerank(spark.range(100), edges, tolerance=0.0, most_rounds=5).collect()}
        assert len(found) == 100 and np.allclose([found[i] for i in range(100)], want, rtol=1e-12, atol=0)
    both = edges.groupBy("dst", "src").sum("weight").toDF("a", "b", "w").where("w > 0")
    blocks = moves.Blocks(moves.Tables(spark, "test"), both, "t", loops=True)
    assert blocks.hubs is not None and 1 < blocks.count and blocks.packed.count() <= blocks.count
    sums = {r["id"]: r["came"] for r in blocks.sums(spark.range(100).selectExpr("id", "1.0D unit")).collect()}
    assert sums == {i: x for i, x in enumerate(matrix.sum(1)) if x}
