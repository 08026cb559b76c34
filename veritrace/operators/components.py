"""Connected components by repeated contraction; no node's neighbours are ever gathered in one place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder (the session's, else one below the warehouse)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        conf = df.sparkSession.conf
        sc.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared checkpoint folder that nothing has been written to."""
    if spark.sparkContext.getCheckpointDir() is None:
        cut(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table in the same folder. Its size is that of its files, while a checkpoint keeps the
    estimate of its plan, which loops of joins multiply from round to round until planning takes longer than the work."""
    path = new_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Pointers of groups go to all tasks up to this many rows (some 16 MB).
BROADCAST_ROWS = 500_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest reachable node.

    Edges count both ways; nulls and self-loops are dropped, so a node with no other edge is not in the
    result. Every round hooks each group onto its smallest neighbour, follows the new pointers twice and
    keeps only the distinct edges between different groups, so groups with edges at least halve. The rounds'
    pointers are followed one after the other at the end. Joins are on unique right sides, which go to all
    tasks while they are few, so that a giant group's rows stay where they are; sums are minima, so a hub is
    combined before it is shuffled.
    """
    pairs = edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v"))
    left = cut(pairs.where(F.col("u") < F.col("v")).distinct())
    labels = left.select(F.col("u").alias("node"), F.col("u").alias("component")).limit(0)
    hooks = []
    while not left.isEmpty():
        both = left.union(left.select("v", "u"))
        hook = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("to"))
        for _ in range(2):
            far = hook.select(F.col("c").alias("to"), F.col("to").alias("_to"))
            hook = hook.join(far, "to", "left").select("c", F.coalesce("_to", "to").alias("to"))
        hook = cut(hook)
        hooks.append(hook)
        hook = F.broadcast(hook) if hook.count() <= BROADCAST_ROWS else hook
        for end in ("u", "v"):
            other = "v" if end == "u" else "u"
            left = left.join(hook, left[end] == hook["c"]).select(F.col("to").alias(end), other)
        left = left.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        left = cut(left.where(F.col("u") < F.col("v")).distinct())
    for n, hook in enumerate(reversed(hooks)):
        # every node of the first round is a group of its own, so its pointers are all nodes' labels
        later = labels.select(F.col("node").alias("to"), "component")
        labels = hook.join(later, "to", "left").select(F.col("c").alias("node"), F.coalesce("component", "to").alias("component")) if n else hook.select(F.col("c").alias("node"), F.col("to").alias("component"))
        if n % 4 == 3:
            labels = cut(labels)
    return cut(labels) if hooks else labels
