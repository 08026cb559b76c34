"""Paths between pairs against breadth-first search; bridges and cut nodes against Tarjan's algorithm."""

import random
from collections import defaultdict

import pytest

from veritrace.operators import between, cuts


def graph(seed, n, m):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


def around(edges):
    adj = defaultdict(set)
    for u, v in edges:
        if u != v:
            adj[u].add(v)
            adj[v].add(u)
    return adj


def plain(adj, a, b, depth):
    level, seen = {a: [a]}, {a}
    for hops in range(1, depth + 1):
        new = {}
        for u, chain in level.items():
            for v in adj[u]:
                if v not in seen:
                    new[v] = min(new.get(v, chain + [v]), chain + [v])
        if b in new:
            return (a, b, hops, new[b])
        seen |= new.keys()
        level = new
    return None


@pytest.mark.parametrize("n,m", [(40, 50), (40, 120)])
def test_paths(spark, n, m):
    edges = graph(n + m, n, m)
    r = random.Random(2)
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(60)] + [(3, 3), (None, 4), (1, 900)]
    e, p = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(pairs * 2, "a long, b long")
    got = sorted((x["a"], x["b"], x["hops"], x["chain"]) for x in between.paths_between(e, p, 4).collect())
    adj = around(edges)
    want = [x for x in (plain(adj, a, b, 4) for a, b in sorted({p for p in pairs if None not in p and p[0] != p[1]})) if x]
    assert got == sorted(want)


def tarjan(adj):
    """(bridges, cut nodes) by depth-first search."""
    number, low, bridge, cut = {}, {}, set(), set()
    for root in adj:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        stack, kids = [(root, None, iter(adj[root]))], 0
        while stack:
            v, parent, it = stack[-1]
            for w in it:
                if w not in number:
                    number[w] = low[w] = len(number)
                    stack.append((w, v, iter(adj[w])))
                    break
                if w != parent:
                    low[v] = min(low[v], number[w])
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] > number[parent]:
                        bridge.add((min(v, parent), max(v, parent)))
                    if parent == root:
                        kids += 1
                    elif low[v] >= number[parent]:
                        cut.add(parent)
        if kids > 1:
            cut.add(root)
    return bridge, cut


@pytest.mark.parametrize("kind", ["sparse", "chain"])
def test_bridges_and_cut_nodes(spark, monkeypatch, kind):
    monkeypatch.setattr(cuts, "PARTS", 3)
    chain = [(i, i + 1) for i in range(300, 360)] + [(310, 320), (330, 331), (400, 401), (401, 402), (402, 400), (402, 403), (403, 404), (404, 402)]
    edges = graph(7, 120, 120) + [(500, 500 + i) for i in range(1, 30)] + [(501, 502)] if kind == "sparse" else chain
    df = spark.createDataFrame([*edges, (1, 1), (None, 5)], "src long, dst long")
    want = tarjan(around(edges))
    tree, blocks = cuts._blocks(df)
    assert {tuple(r) for r in tree.where(cuts._is_bridge()).selectExpr("least(node, parent)", "greatest(node, parent)").collect()} == want[0]
    monkeypatch.setattr(cuts, "_blocks", lambda edges: (tree, blocks))
    assert {r["node"] for r in cuts.cut_nodes(df).collect()} == want[1]
    assert {tuple(r) for r in cuts.bridges(df).collect()} == want[0]


def test_no_edges(spark):
    assert cuts.cut_nodes(spark.createDataFrame([], "src long, dst long")).collect() == []


def pieces(edges):
    """{node: components that its own falls into without it}, of nodes with two or more."""
    adj, found = around(edges), {}
    for x in adj:
        left, n = set(adj[x]), 0
        while left:
            stack, seen = [left.pop()], {x}
            while stack:
                v = stack.pop()
                if v not in seen:
                    seen.add(v)
                    stack += adj[v]
            left -= seen
            n += 1
        if n > 1:
            found[x] = n
    return found


@pytest.mark.parametrize("levels", [32, 3])
def test_cut_nodes_by_levels(spark, monkeypatch, levels):
    def tour(forest):
        raise AssertionError("a shallow graph went by the Euler tour, some fifty rounds of all its nodes")

    edges = graph(3, 60, 66) + [(500, 500 + i) for i in range(1, 12)] + [(501, 502), (503, 504), (504, 505), (600, 601)]
    edges += [(700 + i, 701 + i) for i in range(8)] if levels == 3 else []
    monkeypatch.setattr(cuts, "LEVELS", levels)
    if levels == 32:
        monkeypatch.setattr(cuts, "rooted", tour)
    df = spark.createDataFrame([*edges, (1, 1), (None, 5)], "src long, dst long")
    assert dict(map(tuple, cuts.cut_nodes(df).collect())) == pieces(edges)


def test_paths_keep_no_nodes_seen_before(spark, monkeypatch):
    """Long chains of pairs that share no path: what is stored has a row a node of a frontier, and nothing of rounds before."""
    stored, kept = between.stored, []
    monkeypatch.setattr(between, "stored", lambda df: kept.append(df.columns) or stored(df))
    edges = [(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n3", "m"), ("m", "n5"), ("k0", "k1")]
    pairs = [("n0", "n4"), ("n3", "n5"), ("n0", "n12"), ("n0", "k1"), ("k1", "k0"), ("x", "n1")]
    e, p = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "a string, b string")
    got = sorted((x["a"], x["b"], x["hops"], ">".join(x["chain"])) for x in between.paths_between(e, p, 4).collect())
    assert got == [("k1", "k0", 1, "k1>k0"), ("n0", "n4", 4, "n0>n1>n2>n3>n4"), ("n3", "n5", 2, "n3>m>n5")]
    assert not [c for c in kept if "side" in c and "chain" in c and "a" in c]  # frontiers go by numbers of pairs
