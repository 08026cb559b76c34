"""Shortest paths between many pairs of nodes at once, searched from both ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.operators.components import stored
from veritrace.operators.graph import both_ways


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """df, sorted by its columns, with numbers that rise in that order."""
    return stored(df.orderBy(*df.columns).withColumn(name, F.monotonically_increasing_id()))


def paths_between(edges: DataFrame, pairs: DataFrame, depth: int = 4) -> DataFrame:
    """(a, b, hops, chain): for each pair (a, b) a shortest path of at most depth edges, either way; of several, the one whose nodes come first.

    Every pair grows from both ends, each time at the end with the smaller frontier, and is done as soon as a new node lies
    on the other end's frontier; pairs that are done leave the tables. So a pair opens about the square root of what a
    search from one end would. A frontier has the nodes that walks of its length reach, each with its least chain: the first
    walk that joins both ends is a shortest path, so nodes seen before need not be kept. Nodes and pairs go as numbers in
    the order of the nodes, and lists of neighbours are dealt out by pair before they are opened, with the other frontier.
    Pairs without a path that short, with a null, or of a node with itself give no rows; repeated pairs count once.
    """
    hop = both_ways(edges)
    asked = _numbered(pairs.select("a", "b").where("a <> b").distinct(), "pair")
    nodes = _numbered(hop.select(F.col("src").alias("node")).distinct(), "id")
    ends = hop.join(nodes.toDF("src", "u"), "src").join(nodes.toDF("dst", "v"), "dst")
    near = stored(ends.groupBy(F.col("u").alias("node")).agg(F.collect_list("v").alias("next")))
    known = asked.join(nodes.toDF("a", "u"), "a").join(nodes.toDF("b", "v"), "b").select("pair", F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("node")) for i, c in enumerate("uv")])).alias("e"))
    front = stored(known.select("pair", "e.side", "e.node", F.array("e.node").alias("chain")))
    none, found = F.lit(None).cast("array<bigint>"), []
    for hops in range(1, depth + 1):
        # which end of each pair opens next: the one with the smaller frontier
        size = front.groupBy("pair").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
        turn = stored(size.where("n0 > 0 AND n1 > 0").select("pair", F.when(F.col("n0") <= F.col("n1"), 0).otherwise(1).alias("side")))
        opened = front.join(turn, ["pair", "side"]).join(near, "node").select("pair", "side", "chain", none.alias("far"), "next")
        other = front.join(turn.select("pair", (1 - F.col("side")).alias("side")), ["pair", "side"])
        rows = opened.union(other.select("pair", 1 - F.col("side"), none, "chain", F.array("node"))).repartition("pair")
        rows = rows.select("pair", "side", "chain", "far", F.explode("next").alias("node"))
        ahead = F.when(F.col("side") == 0, F.concat("chain", F.array("node"))).otherwise(F.concat(F.array("node"), "chain"))
        rows = rows.groupBy("pair", "side", "node").agg(F.min(ahead).alias("chain"), F.min("far").alias("far"))
        rows = rows if hops == depth else stored(rows)
        both = F.when(F.col("side") == 0, F.concat("chain", F.slice("far", 2, depth + 1))).otherwise(F.concat("far", F.slice("chain", 2, depth + 1)))
        met = stored(rows.where("chain IS NOT NULL AND far IS NOT NULL").groupBy("pair").agg(F.min(both).alias("chain")))
        found.append(met.select("pair", F.lit(hops).alias("hops"), "chain"))
        if hops == depth:
            break
        left = stored(turn.join(met, "pair", "left_anti"))
        if left.isEmpty():
            break
        waits = front.join(left.select("pair", (1 - F.col("side")).alias("side")), ["pair", "side"])
        front = rows.where("chain IS NOT NULL").select("pair", "side", "node", "chain").join(left.select("pair"), "pair", "left_semi").unionByName(waits)
    steps = reduce(DataFrame.union, found).select("pair", "hops", F.posexplode("chain").alias("i", "id")).join(nodes, "id")
    chains = steps.groupBy("pair", "hops").agg(F.array_sort(F.collect_list(F.struct("i", "node"))).alias("c"))
    return chains.join(asked, "pair").select("a", "b", "hops", F.col("c.node").alias("chain"))
