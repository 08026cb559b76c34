"""Bridges and cut nodes of large graphs, after Tarjan and Vishkin: a spanning forest, its Euler tour, low points, joins throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrace.operators.components import BROADCAST_ROWS, connected_components, new_path, stored
from veritrace.operators.graph import undirected

#: Parts that a node's neighbours are put in order in, so that no hub is one window.
PARTS = 256


def _followed(hook: DataFrame) -> DataFrame:
    """Pointers (c, to) without cycles, each led on to where its chain ends: twice as far a round."""
    while True:
        far = hook.select(F.col("c").alias("to"), F.col("to").alias("_to"))
        hook = stored(hook.join(far, "to", "left").select("c", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")))
        moved = not hook.where("moved").isEmpty()
        hook = hook.select("c", "to")
        if not moved:
            return hook


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(u, v): edges, u < v, that keep every component connected and have no cycle.

    In rounds each group that has a smaller neighbour hooks onto the smallest by one edge; groups that hang together become one.
    """
    left = stored(undirected(edges).select("u", "v", F.col("u").alias("a"), F.col("v").alias("b")))
    kept = [left.select("a", "b").limit(0)]
    while not left.isEmpty():
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v"), "a", "b"))
        hook = stored(both.where("v < u").groupBy("u").agg(F.min(F.struct("v", "a", "b")).alias("m")).select(F.col("u").alias("c"), F.col("m.v").alias("to"), F.col("m.a").alias("a"), F.col("m.b").alias("b")))
        kept.append(hook.select("a", "b"))
        roots = _followed(hook.select("c", "to"))
        for end in ("u", "v"):
            left = left.join(roots.withColumnsRenamed({"c": end, "to": "_to"}), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        pair = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
        left = stored(left.where("u <> v").select(*pair, "a", "b").groupBy("u", "v").agg(F.min(F.struct("a", "b")).alias("m")).select("u", "v", "m.a", "m.b"))
    return stored(reduce(DataFrame.union, kept).toDF("u", "v"))


def _around(sides: DataFrame) -> DataFrame:
    """(src, dst, after): the neighbour of src that follows dst, and after the last one the first; in order of PARTS parts, then of nodes."""
    rows = stored(sides.withColumn("part", F.pmod(F.xxhash64("dst"), F.lit(PARTS)).cast("int")))
    inner = rows.withColumn("after", F.lead("dst").over(Window.partitionBy("src", "part").orderBy("dst")))
    # at most PARTS rows for each node
    heads = rows.groupBy("src", "part").agg(F.min("dst").alias("head"))
    every = Window.partitionBy("src")
    nxt = heads.select("src", "part", F.coalesce(F.lead("head").over(every.orderBy("part")), F.first("head").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    return inner.join(nxt, ["src", "part"]).select("src", "dst", F.coalesce("after", "head").alias("after"))


def rooted(forest: DataFrame) -> DataFrame:
    """(node, root, parent, enter, leave) for every node of a forest (u, v): its tree's smallest node, its parent (null for the root), and the
    places of the Euler tour between which it and all below it are walked.

    The tour goes each edge down and up; each step's distance to the end of the tour comes from pointers that reach twice as far a round.
    """
    sides = forest.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(forest.select("v", "u"))
    parts = connected_components(forest, "u", "v")
    # the step after (src, dst) leaves dst for the neighbour that follows src there
    after = _around(sides).select(F.col("src").alias("at"), F.col("dst").alias("from"), F.col("after").alias("to"))
    tour = after.select(F.col("from").alias("src"), F.col("at").alias("dst"), F.col("at").alias("n_src"), F.col("to").alias("n_dst"))
    first = sides.join(parts.where("node = component").select(F.col("node").alias("src")), "src").groupBy("src").agg(F.min("dst").alias("dst"))
    first = first.select(F.col("src").alias("n_src"), F.col("dst").alias("n_dst"), F.lit(True).alias("ends"))
    tour = tour.join(first, ["n_src", "n_dst"], "left")
    nothing = F.col("ends").isNotNull()
    tour = stored(tour.select("src", "dst", *[F.when(~nothing, F.col(c)).alias(c) for c in ("n_src", "n_dst")], F.when(nothing, 0).otherwise(1).cast("long").alias("far")))
    while not tour.where("n_src IS NOT NULL").isEmpty():
        ahead = tour.select(F.col("src").alias("n_src"), F.col("dst").alias("n_dst"), F.col("n_src").alias("m_src"), F.col("n_dst").alias("m_dst"), F.col("far").alias("m_far"))
        tour = stored(tour.join(ahead, ["n_src", "n_dst"], "left").select("src", "dst", F.col("m_src").alias("n_src"), F.col("m_dst").alias("n_dst"), (F.col("far") + F.coalesce("m_far", F.lit(0))).alias("far")))
    # the way down is earlier in the tour, so farther from its end
    back = tour.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("far").alias("back"))
    down = tour.join(back, ["src", "dst"]).where("far > back").select(F.col("dst").alias("node"), F.col("src").alias("parent"), (-F.col("far")).alias("enter"), (-F.col("back")).alias("leave"))
    low = F.lit(-(2**62)).cast("long")
    rows = parts.join(down, "node", "left").select("node", F.col("component").alias("root"), "parent", F.coalesce("enter", low).alias("enter"), F.coalesce("leave", F.lit(1).cast("long")).alias("leave"))
    return stored(rows)


def _below(tree: DataFrame, own: DataFrame) -> DataFrame:
    """(node, lo, hi): the least and the greatest of own (node, lo, hi) over each node and all below it; twice as deep a round."""
    low = stored(tree.select("node", F.col("parent").alias("up")).join(own, "node"))
    while True:
        sent = low.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
        far = low.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        rows = low.join(sent, "node", "left").join(far, "up", "left")
        low = stored(rows.select("node", F.col("_up").alias("up"), F.least("lo", F.coalesce("_lo", "lo")).alias("lo"), F.greatest("hi", F.coalesce("_hi", "hi")).alias("hi")))
        if low.where("up IS NOT NULL").isEmpty():
            return low.select("node", "lo", "hi")


def _blocks(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rooted forest with each node's low points, and (node, block): for each node with a parent, the two-connected part of the edge to it."""
    graph = stored(undirected(edges))
    forest = spanning_forest(graph.toDF("src", "dst"))
    tree = rooted(forest)
    rest = graph.join(forest, ["u", "v"], "left_anti")
    other = stored(rest.union(rest.select("v", "u")).toDF("node", "far"))
    enter = tree.select(F.col("node").alias("far"), F.col("enter").alias("e"))
    seen = other.join(enter, "far").groupBy("node").agg(F.min("e").alias("lo"), F.max("e").alias("hi"))
    own = tree.select("node", "enter").join(seen, "node", "left").select("node", F.least("enter", F.coalesce("lo", "enter")).alias("lo"), F.greatest("enter", F.coalesce("hi", "enter")).alias("hi"))
    tree = stored(tree.join(_below(tree, own), "node"))
    # edges to the parents of two nodes on one cycle: ends of an edge outside the forest, neither above the other ...
    span = tree.select("node", "enter", "leave")
    ends = rest.join(span.toDF("u", "u_in", "u_out"), "u").join(span.toDF("v", "v_in", "v_out"), "v")
    across = ends.where("u_out < v_in OR v_out < u_in").select("u", "v")
    # ... and a node and its parent, if something below the node leads out of what is below the parent
    up = tree.select(F.col("node").alias("parent"), F.col("enter").alias("p_in"), F.col("leave").alias("p_out"), F.col("parent").alias("above"))
    kin = tree.where("parent IS NOT NULL").join(up, "parent").where("above IS NOT NULL AND (lo < p_in OR hi > p_out)").select("node", "parent")
    parts = connected_components(across.union(kin).toDF("src", "dst"))
    below = tree.where("parent IS NOT NULL").select("node")
    return tree, stored(below.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("block")))


def _is_bridge() -> Column:
    return F.col("parent").isNotNull() & (F.col("lo") >= F.col("enter")) & (F.col("hi") <= F.col("leave"))


def bridges(edges: DataFrame) -> DataFrame:
    """(u, v): edges without which a component falls in two. Edges count both ways, once; loops and nulls are left out."""
    tree, _ = _blocks(edges)
    return tree.where(_is_bridge()).select(F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"))


#: Levels that a component is walked from its smallest node; what is deeper goes by the Euler tour, whose rounds do not follow the depth.
LEVELS = 32


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _walked(graph: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes at each distance from their component's smallest node, and those of the last level beyond LEVELS (none, if all was walked)."""
    both = stored(graph.union(graph.select("v", "u")).toDF("src", "dst"))
    front = stored(connected_components(graph, "u", "v").where("node = component").select("node"))
    levels, before = [front], None
    while True:
        new = both.join(_few(front.toDF("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        for old in (front, before):  # neighbours lie at most one level apart
            new = new.join(old, "node", "left_anti") if old is not None else new
        before, front = front, stored(new)
        if len(levels) > LEVELS or front.isEmpty():
            return levels, front
        levels.append(front)


def cut_nodes(edges: DataFrame) -> DataFrame:
    """(node, blocks): nodes without which their component falls apart, and how many two-connected parts meet in each.

    Components are walked level by level from their smallest nodes, and looked at from the last level up: nodes of a level that hang
    together by what is as deep or deeper are a group. A group whose edges up all lead to one node falls off without it; one with
    several nodes above makes these hang together. Each edge is met once, as a minimum or in components, so hubs are combined before a
    shuffle. A component deeper than LEVELS goes by its forest's Euler tour. An empty graph gives no rows.
    """
    graph = stored(undirected(edges))
    levels, beyond = _walked(graph)
    found = []
    if not beyond.isEmpty():
        parts = connected_components(graph, "u", "v")
        deep = parts.join(beyond, "node", "left_semi").select("component").distinct()
        deep = stored(parts.join(deep, "component", "left_semi").select("node"))
        found.append(_cut_nodes_of_forest(graph.join(deep.toDF("u"), "u", "left_semi").toDF("src", "dst")))
        graph = stored(graph.join(deep.toDF("u"), "u", "left_anti"))
        levels = [stored(level.join(deep, "node", "left_anti")) for level in levels]
    at = stored(reduce(DataFrame.union, [level.select("node", F.lit(n).alias("level")) for n, level in enumerate(levels)]))
    placed = graph.join(at.toDF("u", "lu"), "u").join(at.toDF("v", "lv"), "v")
    low = F.col("lu") > F.col("lv")
    placed = placed.select(F.greatest("lu", "lv").alias("level"), F.when(low, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("y"), (F.col("lu") == F.col("lv")).alias("same"))
    path = new_path(graph.sparkSession, "levels")
    placed.write.partitionBy("level").parquet(path)
    placed = graph.sparkSession.read.schema("x {0}, y {0}, same boolean, level int".format(graph.schema["u"].dataType.simpleString())).parquet(path)
    alone, links = [levels[0].limit(0)], None
    for n in range(len(levels) - 1, 0, -1):
        rows = placed.where(F.col("level") == n)
        across = rows.where("same").select("x", "y")
        groups = connected_components(across if links is None else across.union(links), "x", "y")
        up = rows.where("NOT same").select("x", "y").join(_few(groups.toDF("x", "g")), "x", "left").select(F.coalesce("g", "x").alias("g"), "y")
        up = stored(up)
        each = stored(up.groupBy("g").agg(F.min("y").alias("first"), F.max("y").alias("last")))
        alone.append(each.where("first = last").select(F.col("first").alias("node")))
        links = up.join(_few(each.where("first < last").select("g", "first")), "g").where("y > first").select("first", "y")
    # all but a component's first node are also in the part that leads to it
    blocks = reduce(DataFrame.union, alone).groupBy("node").agg(F.count("*").alias("n")).join(_few(levels[0].select("node", F.lit(0).cast("long").alias("above"))), "node", "left")
    blocks = blocks.select("node", (F.col("n") + F.coalesce("above", F.lit(1).cast("long"))).alias("blocks")).where("blocks > 1")
    return stored(reduce(DataFrame.union, [*found, blocks]))


def _cut_nodes_of_forest(edges: DataFrame) -> DataFrame:
    """The same from the rooted forest's low points: joins, sums and pointers that double, in rounds that grow with the logarithm of the graph's size."""
    tree, blocks = _blocks(edges)
    rows = tree.where("parent IS NOT NULL").join(blocks, "node")
    at = rows.select("node", "block").union(rows.select("parent", "block")).distinct()
    return at.groupBy("node").agg(F.count("*").alias("blocks")).where("blocks > 1")
