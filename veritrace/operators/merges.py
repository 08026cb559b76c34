"""Merges of many entities at once, with a log that tells what was merged and takes it back.

Below the path of a log lie tables by batch, which are only ever added to: rows, edges and comments as they were before, members
(target, source), merges and undone. ``merges`` is written last: a batch without it never happened and may be run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veritrace.operators.components import stored
from veritrace.operators.graph import top_per_key
from veritrace.operators.resolve import merge_rows, rewrite

#: Tag of a comment that came with a merge, and those of the comment that tells of it.
MOVED, TOLD = "migrated-from-merge", ("merge-rationale", "system", "audit")
#: Sources that the comment on a merge names; the log has all.
NAMED = 20


def _kind(rows: DataFrame, key: str) -> str:
    return rows.schema[key].dataType.simpleString()


def _schema(name: str, kind: str) -> str:
    return {
        "members": f"target {kind}, source {kind}, batch string",
        "merges": f"merge_id string, target {kind}, created_at timestamp, merged_count bigint, relationships_updated bigint, comments_migrated bigint, batch string",
        "undone": f"merge_id string, target {kind}, rolled_back_at timestamp, batch string",
        "moved": f"comment_id string, source {kind}, target {kind}, batch string",
    }[name]


def _read(spark: SparkSession, path: str, name: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def targets(rows: DataFrame, wanted: DataFrame, key: str = "id", codes: tuple[str, ...] = ("cf", "piva")) -> DataFrame:
    """(source, target) of wanted (source, target), whose target is text: a row's key, or else one of its codes; of several rows the least key.

    Pairs whose source or target is not there are left out, as are those of a row with itself.
    """
    names = rows.select(key, F.posexplode(F.array(F.col(key).cast("string"), *[F.col(c).cast("string") for c in codes])).alias("o", "target")).where("target IS NOT NULL AND target <> ''")
    first = names.groupBy("target").agg(F.min(F.struct("o", key)).alias("r"))
    found = wanted.join(first, "target").select("source", F.col(f"r.{key}").alias("target")).where("source <> target")
    return found.join(rows.select(F.col(key).alias("source")), "source", "left_semi").distinct()


def preview(rows: DataFrame, edges: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """(target, sources, relationships_to_update) of what ``merge`` would do; nothing is written."""
    kept = _known(rows, ids, key)
    return kept.groupBy("target").agg(F.count("*").alias("sources")).join(_ends(edges, kept), "target", "left").select("target", "sources", F.coalesce("n", F.lit(0)).alias("relationships_to_update"))


def _known(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    have = rows.select(F.col(key).alias("k"))
    kept = ids.select("source", "target").where("source <> target").distinct()
    return kept.join(have.toDF("source"), "source", "left_semi").join(have.toDF("target"), "target", "left_semi")


def _ends(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(target, n): ends of edges at the sources of a target."""
    return edges.select(F.explode(F.array("src", "dst")).alias("source")).join(kept, "source").groupBy("target").agg(F.count("*").alias("n"))


def _split(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with an end among ids, all others)."""
    mark = ids.select(F.col("id").alias("_id"), F.lit(True).alias("_in"))
    at = edges.join(mark.toDF("src", "_a"), "src", "left").join(mark.toDF("dst", "_b"), "dst", "left")
    near = F.coalesce("_a", "_b", F.lit(False))
    return at.where(near).select(*edges.columns), at.where(~near).select(*edges.columns)


def merge(rows: DataFrame, edges: DataFrame, ids: DataFrame, path: str, batch: str, at: str, comments: DataFrame | None = None, key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows, edges, comments) after each source of ids (source, target) is merged into its target, all groups in one pass.

    A target keeps its own values and takes what it lacks from its sources. Edges (src, dst and others, no map) move to it; equal
    ones become one, loops go. comments (comment_id, entity_id, text, tags, author, at) move with a tag, and one on each target tells
    of its merge. Pairs whose source or target is no row are left out. A source with two targets, a target that is itself a source and a
    batch that the log has are errors. Keys must be unique and not null; untouched edges are not shuffled.
    """
    spark, kind = rows.sparkSession, _kind(rows, key)
    kept = stored(_known(rows, ids, key))
    if not kept.groupBy("source").count().where("count > 1").isEmpty() or not kept.join(kept.select(F.col("target").alias("source")), "source", "left_semi").isEmpty():
        raise ValueError("a source may have one target, and a target may be no source")
    if batch in batches(spark, path, kind):
        raise ValueError(f"batch {batch} is in the log")
    group = stored(kept.select(F.col("source").alias("id"), F.col("target").alias("canonical")).union(kept.select("target", "target").distinct()))

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}/batch={batch}")

    ours = rows.join(group.select(F.col("id").alias(key)), key, "left_semi").select(*rows.columns)
    before = write(ours, "rows")
    near, far = _split(edges, group)
    near = write(near, "edges")
    counts = kept.groupBy("target").agg(F.count("*").alias("merged_count")).join(_ends(near, kept), "target", "left")
    moved = spark.createDataFrame([], f"comment_id string, source {kind}, target {kind}")
    if comments is not None:
        moved = comments.join(kept, F.col("entity_id") == F.col("source").cast("string")).select("comment_id", "source", "target")
    moved = write(moved, "moved")
    write(kept.select("target", "source"), "members")
    write(spark.createDataFrame([], f"merge_id string, target {kind}, rolled_back_at timestamp"), "undone")
    merge_id = F.concat_ws("/", F.lit(batch), F.col("target").cast("string"))
    counts = counts.join(moved.groupBy("target").agg(F.count("*").alias("c")), "target", "left")
    done = write(counts.select(merge_id.alias("merge_id"), "target", F.to_timestamp(F.lit(at)).alias("created_at"), "merged_count", F.coalesce("n", F.lit(0)).alias("relationships_updated"), F.coalesce("c", F.lit(0)).alias("comments_migrated")), "merges")
    after = rows.join(group.select(F.col("id").alias(key)), key, "left_anti").select(*rows.columns).unionByName(merge_rows(before, group, key))
    edges = far.unionByName(rewrite(near, group, "src", "dst").where("src <> dst"))
    if comments is not None:
        comments = _moved(comments, moved).unionByName(_told(done, kept))
    return after, edges, comments


def _moved(comments: DataFrame, moved: DataFrame) -> DataFrame:
    to = moved.select("comment_id", F.col("target").cast("string").alias("_to"))
    tags = F.when(F.col("_to").isNotNull(), F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit(MOVED)))).otherwise(F.col("tags"))
    return comments.join(to, "comment_id", "left").withColumns({"entity_id": F.coalesce("_to", "entity_id"), "tags": tags}).select(*comments.columns)


def _told(done: DataFrame, kept: DataFrame) -> DataFrame:
    """One comment on each target."""
    some = top_per_key(kept, "target", NAMED, "source").groupBy("target").agg(F.array_join(F.transform(F.sort_array(F.collect_list("source")), lambda x: x.cast("string")), ", ").alias("s"))
    text = F.concat(F.lit("Merge of "), F.col("s"), F.when(F.col("merged_count") > NAMED, F.format_string(" and %d more", F.col("merged_count") - NAMED)).otherwise(F.lit("")), F.lit(" by "), F.col("merge_id"))
    tags = F.array(*map(F.lit, TOLD))
    return done.join(some, "target").select(F.concat(F.lit("merge:"), F.col("merge_id")).alias("comment_id"), F.col("target").cast("string").alias("entity_id"), text.alias("text"), tags.alias("tags"), F.lit("system").alias("author"), F.col("created_at").alias("at"))


def batches(spark: SparkSession, path: str, kind: str) -> set[str]:
    """The batches of a log; few, as each is a run. None where nothing has been written."""
    from pyspark.errors import AnalysisException

    try:
        return {r[0] for r in _read(spark, path, "merges", _schema("merges", kind)).select("batch").distinct().collect()}
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return set()
        raise


def log(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """Every merge of the log with its status, COMPLETED or ROLLED_BACK, and when it was rolled back."""
    undone = _read(spark, path, "undone", _schema("undone", kind)).groupBy("merge_id").agg(F.min("rolled_back_at").alias("rolled_back_at"))
    rows = _read(spark, path, "merges", _schema("merges", kind)).join(undone, "merge_id", "left")
    return rows.withColumn("status", F.when(F.col("rolled_back_at").isNull(), "COMPLETED").otherwise("ROLLED_BACK"))


def history(spark: SparkSession, path: str, limit: int = 50, kind: str = "bigint") -> DataFrame:
    """The latest merges, newest first."""
    return log(spark, path, kind).orderBy(F.desc("created_at"), "merge_id").limit(limit)


def members(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """(merge_id, target, source) of all merges."""
    return _read(spark, path, "members", _schema("members", kind)).select(F.concat_ws("/", "batch", F.col("target").cast("string")).alias("merge_id"), "target", "source")


def roll_back(rows: DataFrame, edges: DataFrame, path: str, batch: str, only: DataFrame, at: str, comments: DataFrame | None = None, key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows, edges, comments) with the merges into the targets ``only`` (target) of a batch taken back.

    Rows are as they were before. Edges between these groups and others of the batch that stay merged get back only the ends that are undone;
    edges that came later stay with the target. Each moved comment goes to the entity that it came from, and what tells of the
    merge goes. Targets that the batch does not have, or that are undone, change nothing. If a later batch that stands has merged one of these
    targets or taken it as target, that one has to be taken back first.
    """
    spark, kind = rows.sparkSession, _kind(rows, key)
    known = log(spark, path, kind)
    of = known.where((F.col("batch") == batch) & (F.col("status") == "COMPLETED"))
    gone = stored(of.join(only.select("target").distinct(), "target", "left_semi").select("merge_id", "target", "created_at"))
    group = _read(spark, path, "members", _schema("members", kind))
    later = known.where(F.col("status") == "COMPLETED").select("batch", "target", F.col("created_at").alias("_at")).join(group, ["batch", "target"])
    later = later.where(F.col("batch") != batch).select("_at", F.explode(F.array("source", "target")).alias("target"))
    if not later.join(gone, "target").where("_at >= created_at").isEmpty():
        raise ValueError("a later merge has to be taken back first")
    group = group.where(F.col("batch") == batch).join(of.select("target"), "target", "left_semi").select(F.col("source").alias("id"), F.col("target").alias("canonical"))
    before = stored(group)
    after = before.join(gone.select(F.col("target").alias("canonical")), "canonical", "left_anti").select("id", "canonical")
    undone = before.join(gone.select(F.col("target").alias("canonical")), "canonical", "left_semi")
    back_ids = undone.select("id").union(gone.select("target")).distinct()
    old_rows = _read(spark, path, f"rows/batch={batch}", rows.schema).join(back_ids.toDF(key), key, "left_semi").select(*rows.columns)
    old_edges, _ = _split(_read(spark, path, f"edges/batch={batch}", edges.schema), back_ids)
    made = rewrite(old_edges, before, "src", "dst").where("src <> dst")
    now = rewrite(old_edges, after, "src", "dst").where("src <> dst OR src IS NULL OR dst IS NULL")
    loops = old_edges.where("src = dst").distinct()
    edges = stored(edges.subtract(made).unionByName(now).unionByName(loops).distinct())
    rows = stored(rows.join(back_ids.toDF(key), key, "left_anti").select(*rows.columns).unionByName(old_rows))
    if comments is not None:
        moved = _read(spark, path, "moved", _schema("moved", kind)).where(F.col("batch") == batch).join(gone.select("target"), "target", "left_semi").select("comment_id", F.col("source").cast("string").alias("_from"))
        told = gone.select(F.concat(F.lit("merge:"), F.col("merge_id")).alias("comment_id"))
        left = comments.join(told, "comment_id", "left_anti").join(moved, "comment_id", "left")
        tags = F.when(F.col("_from").isNotNull(), F.array_remove("tags", MOVED)).otherwise(F.col("tags"))
        comments = stored(left.withColumns({"entity_id": F.coalesce("_from", "entity_id"), "tags": tags}).select(*comments.columns))
    gone.select("merge_id", "target", F.to_timestamp(F.lit(at)).alias("rolled_back_at")).write.mode("append").parquet(f"{path}/undone/batch={batch}")
    return rows, edges, comments
