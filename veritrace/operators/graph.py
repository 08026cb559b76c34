"""Graph operators over edge tables (src, dst, ...). Loops cut their lineage in the shared checkpoint folder."""

from __future__ import annotations

import math
import sys
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrace.operators.components import BROADCAST_ROWS, connected_components, cut, stored

__all__ = [
    "betweenness", "bfs", "clustering", "connected_components", "cycles", "degrees", "graph_size", "graph_statistics", "induced",
    "pagerank", "paths", "propagate_confidence", "reachable", "sampled_betweenness", "shortest_paths", "strong_components", "triangles", "undirected",
]


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, u < v, without loops."""
    return edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).where("u < v").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    e = undirected(edges)
    return e.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(e.select("v", "u"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def paths(edges: DataFrame, starts: DataFrame, depth: int, carry: str | None = None, limit: int | None = None) -> DataFrame:
    """(start, node, hops, chain, last): all simple paths of 1 to depth edges from ``starts`` (start).

    Each level is one join of the frontier with the edges; ``carry`` is a column of the last edge. With a limit, the
    first by hops, then chain; longer paths are followed only while there are too few. Without one, the number of paths
    can grow with the degree to the power of depth: filter the edges first.
    """
    last = F.col(carry) if carry else F.lit(None).cast("double")
    hop = edges.select("src", "dst", last.alias("last"))
    level = starts.join(hop, starts["start"] == hop["src"]).where("src <> dst").select("start", F.col("dst").alias("node"), F.lit(1).alias("hops"), F.array("src", "dst").alias("chain"), "last")
    levels, left = [], limit
    for n in range(1, depth + 1):
        if n > 1:
            before = level.drop("last")
            level = before.join(hop, before["node"] == hop["src"]).where(~F.array_contains("chain", F.col("dst")))
            level = level.select("start", F.col("dst").alias("node"), F.lit(n).alias("hops"), F.concat("chain", F.array("dst")).alias("chain"), "last")
        if limit is not None:
            first = cut(level.orderBy("chain", "start").limit(left))
            left -= first.count()
            levels.append(first)
            if left == 0:
                break
            level = first  # it was not cut short, so it is the whole level
        else:
            if n % 3 == 0:
                level = cut(level)
                if level.isEmpty():
                    break
            levels.append(level)
    return reduce(DataFrame.union, levels)


def reachable(edges: DataFrame, depth: int) -> DataFrame:
    """(src, dst): nodes that lead to one another over 1 to depth edges, each pair once; a level keeps only pairs that are new."""
    hop = edges.select("src", "dst").distinct()
    level = found = cut(hop)
    for _ in range(depth - 1):
        nxt = hop.select(F.col("src").alias("dst"), F.col("dst").alias("_to"))
        level = cut(level.join(nxt, "dst").select("src", F.col("_to").alias("dst")).distinct().join(found, ["src", "dst"], "left_anti"))
        if level.isEmpty():
            break
        found = cut(found.union(level))
    return found


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between nodes (node)."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)


def _hops(front: DataFrame, edges: DataFrame) -> DataFrame:
    """front (node, ...) with the other end of each edge that a node has, either way, as ``dst``; edges meet a small frontier where they lie."""
    front = F.broadcast(front) if front.count() <= BROADCAST_ROWS else front
    out = front.join(edges.select(F.col("src").alias("node"), "dst"), "node")
    return out.unionByName(front.join(edges.select(F.col("dst").alias("node"), F.col("src").alias("dst")), "node")).where("node <> dst")


def bfs(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, hops): nodes within depth edges, either way, by their distance; starts have 0."""
    edges = stored(edges.select("src", "dst"))
    seen = front = stored(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct())
    for n in range(1, depth + 1):
        new = _hops(front.select("start", "node"), edges).select("start", F.col("dst").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = stored(new.withColumn("hops", F.lit(n)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def shortest_paths(edges: DataFrame, source: int, target: int, depth: int) -> DataFrame:
    """(hops, chain) of a shortest path, either way; of several, the one whose nodes come first. No rows if there is none within depth."""
    edges = stored(edges.select("src", "dst"))
    spark = edges.sparkSession
    front = spark.createDataFrame([(source, [source])], "node long, chain array<long>")
    seen = front.select("node")
    for n in range(1, depth + 1):
        new = _hops(front, edges).select(F.col("dst").alias("node"), F.concat("chain", F.array("dst")).alias("chain"))
        front = stored(new.join(seen, "node", "left_anti").groupBy("node").agg(F.min("chain").alias("chain")))
        found = front.where(F.col("node") == target)
        if not found.isEmpty():
            return found.select(F.lit(n).alias("hops"), "chain")
        if front.isEmpty():
            break
        seen = seen.union(front.select("node"))
    return spark.createDataFrame([], "hops int, chain array<long>")


def _longer(level: DataFrame, hop: DataFrame) -> DataFrame:
    """Paths (start, node, chain) led on by one edge to a node that is new to them and greater than their start."""
    nxt = level.join(hop, level["node"] == hop["src"]).where((F.col("dst") > F.col("start")) & ~F.array_contains("chain", F.col("dst")))
    return nxt.select("start", F.col("dst").alias("node"), F.concat("chain", F.array("dst")).alias("chain"))


#: Starts whose paths are followed first, and how many times more each time that they closed too few cycles.
FIRST_STARTS, MORE_STARTS = 16, 8


def cycles(edges: DataFrame, least: int = 3, most: int = 6, limit: int | None = None) -> DataFrame:
    """(length, chain): simple directed cycles, each once, from its smallest node.

    With a limit, the first by length, then chain; longer paths are followed only while there are too few. A chain begins with its
    smallest node, so of one length the cycles of smaller starts come first: paths are followed from the smallest starts, and
    from more of them only while there are too few. Without a limit, the number of paths can grow with the degree to the power of most.
    """
    hop = cut(edges.select("src", "dst").where("src <> dst").distinct())
    back = hop.select(F.col("src").alias("node"), F.col("dst").alias("start"))
    first = hop.where("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src", "dst").alias("chain"))
    if limit is not None:
        return _first_cycles(hop, back, first, least, most, limit)
    level, found = first, []
    for n in range(2, most + 1):
        if n >= least:
            found.append(level.join(back, ["node", "start"]).select(F.lit(n).alias("length"), "chain"))
        if n < most:
            level = _longer(level, hop)
            level = cut(level) if n > 2 else level  # paths of three nodes are made anew, not stored
    return reduce(DataFrame.union, found)


def _first_cycles(hop: DataFrame, back: DataFrame, first: DataFrame, least: int, most: int, limit: int) -> DataFrame:
    # a cycle's smallest node has an edge to a greater one and one from a greater one
    starts = stored(hop.where("dst > src").select("src").intersect(hop.where("src > dst").select("dst")))
    found, left = [hop.limit(0).select(F.lit(0).alias("length"), F.array("src", "dst").alias("chain"))], limit
    for n in range(least, most + 1):
        low, size = None, FIRST_STARTS
        while left > 0:
            batch = starts.where(F.lit(True) if low is None else F.col("src") > F.lit(low)).orderBy("src").limit(size)
            end = batch.agg(F.max("src").alias("high"), F.count("*").alias("n")).first()
            if not end["n"]:
                break
            level = first.where(F.col("start") <= F.lit(end["high"])).where(F.lit(True) if low is None else F.col("start") > F.lit(low))
            for _ in range(n - 2):
                level = _longer(level, hop)
            closed = cut(level.join(back, ["node", "start"]).select(F.lit(n).alias("length"), "chain").orderBy("chain").limit(left))
            left -= closed.count()
            found.append(closed)
            if end["n"] < size:
                break
            low, size = end["high"], size * MORE_STARTS
    return reduce(DataFrame.union, found)


#: Edges that a task counts triangles in: some 16 MB of numbers.
TRIANGLE_EDGES = 1_000_000
#: Groups of nodes at least, so that small graphs too are dealt over several tasks.
NODE_GROUPS = 4


def _task_triangles(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node, n): the triangles of a task's edges (u, v) whose nodes' groups (gu, gv) add up to those of the task (sum)."""
    nodes, code = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), return_inverse=True)
    m, n = len(pdf), len(nodes)
    group = np.zeros(n, np.int64)
    group[code] = np.concatenate([pdf["gu"].to_numpy(), pdf["gv"].to_numpy()])
    # numbered by degree, edges go up, so a hub starts few paths
    place = np.empty(n, np.int64)
    place[np.argsort(np.bincount(code, minlength=n), kind="stable")] = np.arange(n)
    ends = place[code]
    x, y = np.minimum(ends[:m], ends[m:]), np.maximum(ends[:m], ends[m:])
    order = np.lexsort((y, x))
    y, first = y[order], np.searchsorted(x[order], np.arange(n + 1))
    of = np.empty(n, np.int64)
    of[place] = group
    total, total_groups = np.zeros(n, np.int64), int(pdf["sum"].iloc[0])
    mark = np.zeros(n, bool)
    for s in range(n):
        mine = y[first[s] : first[s + 1]]
        if len(mine) < 2:
            continue
        mark[mine] = True
        sizes = first[mine + 1] - first[mine]
        begin = np.cumsum(sizes) - sizes
        far = y[np.arange(sizes.sum()) + np.repeat(first[mine] - begin, sizes)]
        mid = np.repeat(mine, sizes)[on := mark[far]]
        far = far[on]
        right = of[s] + of[mid] + of[far] == total_groups
        mid, far = mid[right], far[right]
        total[s] += len(mid)
        if 2 * len(mid) > n:
            total += np.bincount(mid, minlength=n) + np.bincount(far, minlength=n)
        else:
            np.add.at(total, mid, 1)
            np.add.at(total, far, 1)
        mark[mine] = False
    total = total[place]
    some = total > 0
    return pd.DataFrame({"node": nodes[some], "n": total[some]})


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles) for every node with an edge.

    Nodes fall in groups by a hash; a task has the edges among three groups (some of them equal) and counts the triangles with a
    node in each, so an edge is sent once for each group and no path of two edges is ever a row. With m edges there are some
    sqrt(6 m / TRIANGLE_EDGES) groups: what is shuffled grows with the power 1.5 of m, as the number of triangles may.
    """
    e = stored(undirected(edges))
    kind, m = e.schema["u"].dataType.simpleString(), e.count()
    groups = max(NODE_GROUPS, math.ceil(math.sqrt(6 * m / TRIANGLE_EDGES)))
    of = [F.pmod(F.xxhash64(c), F.lit(groups)).cast("int").alias(f"g{c}") for c in ("u", "v")]
    rows = e.select("u", "v", *of).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    three = F.array_sort(F.array("gu", "gv", "k"))
    rows = rows.select("u", "v", "gu", "gv", (F.col("gu") + F.col("gv") + F.col("k")).alias("sum"), ((three[0] * groups + three[1]) * groups + three[2]).alias("task"))
    tasks = groups * (groups + 1) * (groups + 2) // 6
    n = rows.repartition(tasks, "task").groupBy("task").applyInPandas(_task_triangles, f"node {kind}, n long").groupBy("node").agg(F.sum("n").alias("triangles"))
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    return nodes.join(n, "node", "left").select("node", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, clustering): triangles over pairs of neighbours, 0 below two neighbours."""
    rows = degrees(edges).join(triangles(edges), "node")
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return rows.withColumn("clustering", F.when(F.col("degree") > 1, F.col("triangles") / pairs).otherwise(F.lit(0.0)))


#: Edges, counted from both ends, of a block of nodes: some 16 MB of numbers in a task. Blocks at least, so that small graphs too are dealt over several tasks.
BLOCK_EDGES, BLOCKS = 1_000_000, 4
#: A block of nodes as arrays: its nodes and their degrees; edges by the message that they add to, and where each message starts; blocks that it
#: has edges with, how many messages go to each and come from each; and which node a message is for.
_BLOCK = {"nodes": np.int64, "n": np.int32, "src": np.int32, "starts": np.int32, "blocks": np.int32, "sent": np.int32, "got": np.int32, "dst": np.int32}


def _task_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """The arrays of one block from its rows (block, other, src, dst).

    A block sends one number for each node of another block that it has edges to, in order of these nodes. Edges go both
    ways, so the other block knows from its own edges which nodes the numbers are for.
    """
    other, dst = pdf["other"].to_numpy(), pdf["dst"].to_numpy()
    nodes, i = np.unique(pdf["src"].to_numpy(), return_inverse=True)
    by = np.lexsort((dst, other))
    first = np.ones(len(by), bool)
    first[1:] = (np.diff(other[by]) != 0) | (np.diff(dst[by]) != 0)
    starts = np.flatnonzero(first)
    blocks, sent = np.unique(other[by][starts], return_counts=True)
    pairs = np.unique(other.astype(np.int64) * len(nodes) + i)
    got = np.unique(pairs // len(nodes), return_counts=True)[1]
    arrays = (nodes, np.bincount(i), i[by], starts, blocks, sent, got, pairs % len(nodes))
    return pd.DataFrame({"block": pdf["block"].iloc[:1].to_numpy(), **{k: [a.astype(t).tobytes()] for (k, t), a in zip(_BLOCK.items(), arrays, strict=True)}})


def _block_ranks(edges: DataFrame, rounds: int, damping: float) -> DataFrame:
    """Undirected PageRank of whole-number nodes, stored: blocks of nodes lie still, in each round one number goes from a block to each node of another that it has edges to."""
    e = stored(undirected(edges).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))
    count = max(BLOCKS, math.ceil(2 * e.count() / BLOCK_EDGES))
    both = e.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(e.select("v", "u"))
    of = [F.pmod(F.xxhash64(c), F.lit(count)).cast("int").alias(name) for c, name in (("src", "block"), ("dst", "other"))]
    schema = ", ".join(["block int", *(f"{k} binary" for k in _BLOCK)])
    blocks = both.select(*of, "src", "dst").repartition(count, "block").groupBy("block").applyInPandas(_task_block, schema)
    # stored, then dealt out once more and kept that way; messages are dealt out alike, so that no round moves a block
    blocks = stored(blocks).repartition(count, "block").persist(StorageLevel.DISK_ONLY)
    kinds, base = dict(_BLOCK), 1 - damping

    def ranks(b: dict, row: dict):
        n = len(b["nodes"])
        if "all" not in row:
            return np.full(n, base)
        sums = np.bincount(b["dst"], np.frombuffer(b"".join(x["v"] for x in sorted(row["all"], key=lambda x: x["s"])), np.float64), n)
        return base + damping * sums

    def rows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(at)[k] for at, name in enumerate(batch.schema.names)}
                b = {name: np.frombuffer(row[name].as_buffer(), t) for name, t in kinds.items()}
                yield row["block"].as_py(), b, {"all": row["all"].as_py()} if "all" in row else {}

    def send(batches):
        for me, b, row in rows(batches):
            values = np.add.reduceat((ranks(b, row) / b["n"])[b["src"]], b["starts"])
            parts = np.split(values, np.cumsum(b["sent"])[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(b["blocks"]), pa.array([me] * len(parts), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "s", "v"])

    def last(batches):
        for _, b, row in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(b["nodes"]), pa.array(ranks(b, row))], names=["node", "rank"])

    at = blocks
    for _ in range(rounds):
        sent = at.mapInArrow(send, "block int, s int, v binary").repartition(count, "block")
        at = blocks.join(sent.groupBy("block").agg(F.collect_list(F.struct("s", "v")).alias("all")).hint("shuffle_merge"), "block")
    found = stored(at.mapInArrow(last, "node long, rank double"))
    blocks.unpersist()
    return found


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, directed: bool = True) -> DataFrame:
    """(node, rank) in the form (1 - d) + d * sum(rank / out-degree), so ranks average 1; the mass of nodes without out-edges is dropped.

    Undirected graphs whose nodes are whole numbers go by blocks of nodes as arrays; a node's edges are in one block. Others go by joins.
    """
    if not directed and edges.schema["src"].dataType.simpleString() == edges.schema["dst"].dataType.simpleString() == "bigint":
        return _block_ranks(edges, rounds, damping)
    e = edges.select("src", "dst").distinct() if directed else both_ways(edges)
    out = e.groupBy("src").agg(F.count("*").alias("n"))
    e = cut(e.join(out, "src"))
    nodes = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    ranks = nodes.withColumn("rank", F.lit(1.0 - damping))
    for i in range(rounds):
        sent = e.join(ranks, e["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("n")).alias("s"))
        ranks = nodes.join(sent, nodes["node"] == sent["dst"], "left").select("node", (F.lit(1 - damping) + damping * F.coalesce("s", F.lit(0.0))).alias("rank"))
        if i % 4 == 3:
            ranks = cut(ranks)
    return ranks


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components by their smallest node, for every node with an edge.

    Nodes without in- or out-edges are trimmed as components of their own; then in rounds each node takes the
    smallest node that reaches it, and what the root of a colour can be reached from within it is one component.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    done: list[DataFrame] = []
    while not e.isEmpty():
        while True:
            keep = e.select(F.col("src").alias("node")).intersect(e.select(F.col("dst").alias("node")))
            smaller = cut(e.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
            if smaller.count() == e.count():
                break
            e = smaller
        if e.isEmpty():
            break
        colour = e.select(F.col("src").alias("node")).distinct().withColumn("c", F.col("node"))
        while True:
            low = e.join(colour, e["src"] == colour["node"]).groupBy("dst").agg(F.min("c").alias("m"))
            new = cut(colour.join(low, colour["node"] == low["dst"], "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c")))
            moved = not new.join(colour, ["node", "c"], "left_anti").isEmpty()
            colour = new
            if not moved:
                break
        back = e.join(colour.withColumnsRenamed({"node": "src", "c": "cs"}), "src").join(colour.withColumnsRenamed({"node": "dst", "c": "cd"}), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        back = cut(back)
        found = cut(colour.where("node = c"))
        front = found
        while True:
            reach = back.join(front.withColumnRenamed("node", "dst"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct()
            front = cut(reach.join(found, ["node", "c"], "left_anti"))
            if front.isEmpty():
                break
            found = cut(found.union(front))
        done.append(found.select("node", F.col("c").alias("component")))
        gone = found.select(F.col("node").alias("src"))
        e = cut(e.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"))
    if not done:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(reduce(DataFrame.union, done), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


#: A component of at most so many edges goes to tasks (32 MB).
TASK_EDGES = 2_000_000
#: Components of at most so many nodes, with an edge for each DENSE of n x n pairs, are walked as a matrix, which has no more than LEVELS levels.
DENSE_NODES, DENSE, LEVELS = 2_048, 32, 16


def _passed(starts: np.ndarray, around: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Half of what each node passes on of the shortest paths from the sources (Brandes)."""
    n = len(starts) - 1
    total = np.zeros(n)
    for s in sources:
        far, count = np.full(n, -1), np.zeros(n)
        far[s], count[s] = 0, 1.0
        front, steps = np.array([s]), []
        while len(front):
            sizes = starts[front + 1] - starts[front]
            src = np.repeat(front, sizes)
            dst = around[np.repeat(starts[front], sizes) + np.arange(len(src)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
            new = np.unique(dst[far[dst] < 0])
            far[new] = len(steps) + 1
            on = far[dst] == len(steps) + 1
            src, dst = src[on], dst[on]
            np.add.at(count, dst, count[src])
            steps.append((src, dst))
            front = new
        part = np.zeros(n)
        for src, dst in reversed(steps):
            np.add.at(part, src, count[src] / count[dst] * (1 + part[dst]))
        part[s] = 0.0
        total += part / 2
    return total


def _passed_dense(starts: np.ndarray, around: np.ndarray, sources: np.ndarray, batch: int = 256) -> np.ndarray | None:
    """The same as ``_passed`` by products with the matrix of edges, for graphs with many edges; None for one of more than LEVELS levels."""
    n = len(starts) - 1
    edge, total = np.zeros((n, n)), np.zeros(n)
    edge[np.repeat(np.arange(n), np.diff(starts)), around] = 1.0
    for at in range(0, len(sources), batch):
        some = sources[at : at + batch]
        count, far = np.zeros((len(some), n)), np.full((len(some), n), -1, np.int16)
        rows = np.arange(len(some))
        count[rows, some], far[rows, some] = 1.0, 0
        level, front = 0, count.copy()
        while True:
            new = front @ edge
            new[far >= 0] = 0.0
            if not new.any():
                break
            level += 1
            if level > LEVELS:
                return None
            far[new > 0] = level
            count += new
            front = new
        part = np.zeros_like(count)
        for k in range(level, 0, -1):
            sent = np.where(far == k, (1 + part) / np.where(count > 0, count, 1.0), 0.0) @ edge
            part += np.where(far == k - 1, count * sent, 0.0)
        part[rows, some] = 0.0
        total += part.sum(axis=0) / 2
    return total


def betweenness(edges: DataFrame) -> DataFrame:
    """(node, betweenness): undirected, by Brandes' accumulation from every node, whatever the size of the graph."""
    return _by_component(stored(undirected(edges))).drop("bound")


#: Nodes times edges that a task walks, times that a component's edges are sent at most, and edges of small components in a task.
TASK_STEPS, TASK_COPIES, BIN_EDGES = 100_000_000, 64, 20_000


def _task_betweenness(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node, b) of a task's edges (u, v), from every ``parts``-th node as source, beginning with the ``part``-th."""
    nodes, code = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), return_inverse=True)
    m, part, parts = len(pdf), int(pdf["part"].iloc[0]), int(pdf["parts"].iloc[0])
    src, dst = np.concatenate([code[:m], code[m:]]), np.concatenate([code[m:], code[:m]])
    by, n = np.lexsort((dst, src)), len(nodes)
    starts, around, sources = np.searchsorted(src[by], np.arange(n + 1)), dst[by], np.arange(part, n, parts)
    total = _passed_dense(starts, around, sources) if n <= DENSE_NODES and m * DENSE >= n * n else None
    return pd.DataFrame({"node": nodes, "b": _passed(starts, around, sources) if total is None else total})


#: Edges that a task joins at once to find which nodes hang together.
FOREST_EDGES = 1_000_000


def _joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that edges (u, v) join to a smaller one, and the smallest that they join it to."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = code[: len(u)], code[len(u) :], np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    hangs = label != np.arange(len(nodes))
    return nodes[label[hangs]], nodes[hangs]


def _forest(batches):
    """Edges (u, v) that join the same nodes as a partition's, one at most for each node of FOREST_EDGES edges."""
    held, size = [], 0
    for pdf in batches:
        held.append((pdf["u"].to_numpy(), pdf["v"].to_numpy()))
        size += len(pdf)
        if size >= FOREST_EDGES:
            u, v = _joined(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [(u, v)], len(u)
            if 2 * size > FOREST_EDGES:
                yield pd.DataFrame({"u": u, "v": v})
                held, size = [], 0
    if size:
        u, v = _joined(*map(np.concatenate, zip(*held, strict=True)))
        yield pd.DataFrame({"u": u, "v": v})


def _by_component(e: DataFrame) -> DataFrame:
    """(node, betweenness, bound) of edges (u, v), each once: shortest paths stay in their component, so one of at most TASK_EDGES edges
    and TASK_COPIES x TASK_STEPS steps is walked in tasks that have its edges and a part of its nodes as sources; a larger one by joins, SOURCES
    nodes at a time. All are exact, bound is 0. What joins nodes is found from a forest of each partition, so only the walks move edges."""
    kind = e.schema["u"].dataType.simpleString()
    parts = connected_components(e.mapInPandas(_forest, f"u {kind}, v {kind}"), "u", "v")
    small = parts.count() <= BROADCAST_ROWS
    at = e.join((F.broadcast(parts) if small else parts).withColumnRenamed("node", "u"), "u")
    at = at if small else stored(at)
    sizes = at.groupBy("component").agg(F.count("*").alias("m")).join(parts.groupBy("component").agg(F.count("*").alias("n")), "component")
    n, m = F.col("n").cast("double"), F.col("m")
    steps = F.when((n <= DENSE_NODES) & (m * DENSE >= n * n), F.lit(1.0)).otherwise(F.ceil(n * m / TASK_STEPS))
    sizes = stored(sizes.withColumn("parts", steps.cast("long")))
    fits = (F.col("m") <= TASK_EDGES) & (F.col("parts") <= TASK_COPIES)
    few = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    rows = at.join(few, "component")
    # components that fit in one task share tasks; the others' edges go to as many as they have parts
    alone = (F.col("parts") > 1) | (F.col("m") > BIN_EDGES)
    told = sizes.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.sum(F.when(fits & alone, F.col("parts"))), F.lit(0)).alias("k"), F.count_if(~fits).alias("rest")).first()
    bins = max(1, (told["m"] + BIN_EDGES - 1) // BIN_EDGES)
    tasks = rows.where(fits).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tasks = tasks.select("u", "v", "part", "parts", F.when(alone, F.col("component")).alias("c"), F.when(~alone, F.pmod(F.xxhash64("component"), F.lit(bins))).alias("bin"))
    sums = tasks.repartition(min(told["k"] + bins, 20_000), "c", "part", "bin").groupBy("c", "part", "bin").applyInPandas(_task_betweenness, f"node {kind}, b double")
    exact = sums.groupBy("node").agg(F.sum("b").alias("betweenness")).withColumn("bound", F.lit(0.0))
    if not told["rest"]:
        return exact
    rest = rows.where(~fits).select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return exact.union(_by_joins(rest).withColumn("bound", F.lit(0.0)))


def _by_joins(edges: DataFrame) -> DataFrame:
    """(node, betweenness) from every node, SOURCES at a time, so that no more than nodes x SOURCES rows or so are there at once."""
    hop = stored(both_ways(edges))
    nodes = stored(hop.select(F.col("src").alias("node")).distinct())
    rounds = max(1, math.ceil(nodes.count() / SOURCES))
    total = nodes.select("node", F.lit(0.0).alias("b"))
    for k in range(rounds):
        starts = nodes.where(F.pmod(F.xxhash64("node"), F.lit(rounds)) == k)
        total = stored(total.union(_walked(hop, starts).select("node", F.col("part") / 2)).groupBy("node").agg(F.sum("b").alias("b")))
    return total.withColumnRenamed("b", "betweenness")


#: Sources that are walked at once by joins, and of the estimate, and the chance that any node's bound fails.
SOURCES, FAILS = 1024, 0.05


def _walked(hop: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, part): what nodes pass on of the shortest paths over edges (src, dst), both ways, from the starts (node), which are all walked at once."""
    seen = stored(starts.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("count")))
    front, levels = seen, [seen]
    while True:
        new = front.join(hop, front["node"] == hop["src"]).groupBy("source", F.col("dst").alias("node")).agg(F.sum("count").alias("count"))
        front = stored(new.join(seen.select("source", "node"), ["source", "node"], "left_anti").select("source", "node", "count"))
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.union(front)
    part, parts = levels[-1].withColumn("part", F.lit(0.0)), []
    for level in reversed(levels[:-1]):
        parts.append(part)
        below = part.select("source", F.col("node").alias("dst"), F.col("count").alias("_count"), F.col("part").alias("_part"))
        sent = hop.join(below, "dst").groupBy("source", F.col("src").alias("node")).agg(F.sum((1 + F.col("_part")) / F.col("_count")).alias("sent"))
        part = stored(level.join(sent, ["source", "node"], "left").withColumn("part", F.col("count") * F.coalesce("sent", F.lit(0.0))).drop("sent"))
    return reduce(DataFrame.union, parts).where("source <> node").groupBy("node").agg(F.sum("part").alias("part"))


def sampled_betweenness(edges: DataFrame, sources: int = SOURCES, fails: float = FAILS) -> DataFrame:
    """(node, betweenness, bound): shortest paths from the ``sources`` nodes of the least hashes, weighed up to all nodes.

    All sources are walked at once, a join a level: counts of shortest paths on the way out, what each node passes back on the
    way in; at most nodes x sources rows. One source adds n - 2 at most, so by Hoeffding's inequality all estimates
    are within ``bound`` of the exact values but for a chance of ``fails``; with as many sources as nodes they are exact and bound is 0.
    """
    hop = stored(both_ways(edges))
    nodes = stored(hop.select(F.col("src").alias("node")).distinct())
    n = nodes.count()
    k = min(n, sources)
    if not n:
        return nodes.select("node", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("bound"))
    starts = nodes.orderBy(F.xxhash64("node"), "node").limit(k)
    bound = 0.0 if k == n else n * max(0, n - 2) / 2 * math.sqrt(math.log(2 * n / fails) / (2 * k))
    sums = _walked(hop, starts).select("node", (F.col("part") * (n / k / 2)).alias("b"))
    return nodes.join(sums, "node", "left").select("node", F.coalesce("b", F.lit(0.0)).alias("betweenness"), F.lit(bound).alias("bound"))


def propagate_confidence(nodes: DataFrame, edges: DataFrame, passes: int = 3) -> DataFrame:
    """(node, confidence): in each pass a node takes the least of its own and of its sources' confidence times the edge's.

    nodes has (node, confidence) with null as 1, edges (src, dst, confidence). All nodes move at once; passes end
    early when nothing moves.
    """
    now = cut(nodes.select("node", F.coalesce("confidence", F.lit(1.0)).alias("confidence")))
    for _ in range(passes):
        sent = edges.select("src", "dst", F.col("confidence").alias("r")).join(now, F.col("src") == F.col("node")).groupBy("dst").agg(F.min(F.col("confidence") * F.col("r")).alias("m"))
        new = cut(now.join(sent, now["node"] == sent["dst"], "left").select("node", F.least("confidence", F.coalesce("m", "confidence")).alias("confidence")))
        moved = not new.join(now, ["node", "confidence"], "left_anti").isEmpty()
        now = new
        if not moved:
            break
    return now


def graph_size(edges: DataFrame) -> DataFrame:
    """One row: nodes with edges, edges, density, average and largest degree."""
    m = undirected(edges).agg(F.count("*").alias("m"))
    rows = degrees(edges).agg(F.count("*").alias("n"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree")).join(F.broadcast(m))  # one row
    density = F.least(F.lit(1.0), F.try_divide(2 * F.col("m"), F.col("n") * (F.col("n") - 1)))
    return rows.select("n", "m", density.alias("density"), "avg_degree", "max_degree")


def _first_clustering(e: DataFrame, sample: int) -> DataFrame:
    """One row avg_clustering: the mean over the first ``sample`` nodes of edges (u, v), each once; only edges among their neighbours are looked at."""
    both = e.union(e.select("v", "u")).toDF("s", "x")
    first = stored(both.select("s").distinct().orderBy("s").limit(sample))
    adj = stored(both.join(F.broadcast(first), "s"))  # sample rows at most
    at = adj.select("x").distinct()
    inner = e.join(at.toDF("u"), "u", "left_semi").join(at.toDF("v"), "v", "left_semi")
    closed = adj.join(inner, adj["x"] == inner["u"]).select("s", F.col("v").alias("x")).join(adj, ["s", "x"]).groupBy("s").agg(F.count("*").alias("t"))
    pairs = F.col("k") * (F.col("k") - 1) / 2
    local = adj.groupBy("s").agg(F.count("*").alias("k")).join(closed, "s", "left")
    return local.agg(F.avg(F.when(F.col("k") > 1, F.coalesce("t", F.lit(0)) / pairs).otherwise(F.lit(0.0))).alias("avg_clustering"))


def graph_statistics(edges: DataFrame, sample: int | None = None) -> DataFrame:
    """graph_size with the number of components and the mean clustering of all nodes with edges, or of the first ``sample`` where that is given."""
    e = stored(undirected(edges))
    edges = e.toDF("src", "dst")
    rows = graph_size(edges)
    parts = connected_components(edges).agg(F.count_distinct("component").alias("components"))
    local = clustering(edges).agg(F.avg("clustering").alias("avg_clustering")) if sample is None else _first_clustering(e, sample)
    for one in (parts, local):
        rows = rows.join(F.broadcast(one))  # frames of one row
    return rows


def typed_statistics(nodes: DataFrame, edges: DataFrame, sample: int = 50) -> DataFrame:
    """(measure, of, value) of a graph of nodes (node, kind) and edges (src, dst, kind) between them.

    node_count, edge_count and how many there are of each kind; density, 2 E / N (N - 1) and 1 at most; avg_degree and max_degree over nodes
    with edges, a loop twice; connected_components, nodes without edges among them; avg_clustering over the first ``sample`` nodes by id, where
    equal edges count once and loops not. Only edges among neighbours of these are looked at. Without nodes all measures are 0.
    """
    edges = stored(edges.select("src", "dst", "kind"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    counts = nodes.agg(F.count("*").alias("n")).join(F.broadcast(edges.agg(F.count("*").alias("m"))))  # frames of one row
    counts = counts.join(F.broadcast(ends.agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("mean"), F.coalesce(F.max("d"), F.lit(0)).alias("most"))))
    linked = connected_components(edges).agg(F.count("*").alias("in"), F.count_distinct("component").alias("groups"))
    first = stored(nodes.select(F.col("node").alias("s")).orderBy("s").limit(sample))
    e = undirected(edges)
    adj = stored(e.union(e.select("v", "u")).toDF("s", "x").join(F.broadcast(first), "s"))  # sample rows at most
    at = adj.select("x").distinct()
    inner = e.join(at.toDF("u"), "u", "left_semi").join(at.toDF("v"), "v", "left_semi")
    closed = adj.join(inner, adj["x"] == inner["u"]).select("s", F.col("v").alias("x")).join(adj, ["s", "x"]).groupBy("s").agg(F.count("*").alias("t"))
    k = F.col("k") * (F.col("k") - 1) / 2
    local = first.join(adj.groupBy("s").agg(F.count("*").alias("k")), "s", "left").join(closed, "s", "left")
    local = local.agg(F.coalesce(F.avg(F.when(F.col("k") > 1, F.coalesce("t", F.lit(0)) / k).otherwise(F.lit(0.0))), F.lit(0.0)).alias("local"))
    one = counts.join(F.broadcast(linked)).join(F.broadcast(local))
    density = F.when(F.col("n") > 1, F.least(F.lit(1.0), 2 * F.col("m") / (F.col("n") * (F.col("n") - 1)))).otherwise(F.lit(0.0))  # least passes nulls over
    values = {"node_count": F.col("n"), "edge_count": F.col("m"), "density": F.round(density, 4), "avg_degree": F.round("mean", 2), "max_degree": F.col("most"), "connected_components": F.col("n") - F.col("in") + F.col("groups"), "avg_clustering": F.round("local", 4)}
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), F.lit("all").alias("of"), v.cast("double").alias("value")) for name, v in values.items()])).alias("r")).select("r.*")
    for name, df in (("node_types", nodes), ("edge_types", edges)):
        rows = rows.union(df.groupBy("kind").agg(F.count("*").cast("double").alias("value")).select(F.lit(name), "kind", "value"))
    return rows


def top_per_key(df: DataFrame, key: str | list[str], n: int, *order) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


# tasks get this module's functions themselves, so executors need not have the package
register_pickle_by_value(sys.modules[__name__])
