"""Comments on entities: an append-only log of what people wrote, changed and took back, and the threads that it makes.

A log has comment_id, parent_id (null for the first of a thread), entity_id, author, text, action (create, update, delete)
and at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrace.functions.text import mentions

LOG = "comment_id string, parent_id string, entity_id string, author string, text string, action string, at timestamp"
#: The most replies that a thread shows.
REPLIES = 50


def state(log: DataFrame) -> DataFrame:
    """The comments that are there, with created_at, edited_at, edited and the ids that they mention.

    Only the author of a comment changes or deletes it; anything before its creation, and all after its deletion, goes.
    Of rows at one time the first by action counts.
    """
    first = log.where("action = 'create' AND trim(text) <> ''").groupBy("comment_id").agg(F.min(F.struct("at", "author", "parent_id", "entity_id", "text")).alias("c"))
    later = log.where("action <> 'create'").join(first, "comment_id").where((F.col("author") == F.col("c.author")) & (F.col("at") >= F.col("c.at")))
    gone = later.where("action = 'delete'").select("comment_id").distinct()
    last = later.where("action = 'update' AND trim(text) <> ''").groupBy("comment_id").agg(F.max(F.struct("at", "text")).alias("u"))
    rows = first.join(gone, "comment_id", "left_anti").join(last, "comment_id", "left")
    text = F.coalesce("u.text", "c.text")
    return rows.select("comment_id", "c.parent_id", "c.entity_id", "c.author", text.alias("text"), F.col("c.at").alias("created_at"), F.col("u.at").alias("edited_at"), F.col("u").isNotNull().alias("edited"), mentions(text).alias("mentions"))


def page(comments: DataFrame, entity_id: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """The comments on an entity, newest first."""
    return comments.where(F.col("entity_id") == entity_id).orderBy(F.desc("created_at"), "comment_id").offset(offset).limit(limit)


def search(comments: DataFrame, words: str, author: str | None = None) -> DataFrame:
    """Comments that have all the words, case aside, and maybe an author."""
    rows = comments if author is None else comments.where(F.col("author") == author)
    for w in words.lower().split():
        rows = rows.where(F.lower("text").contains(w))
    return rows


def threads(comments: DataFrame, most: int = REPLIES) -> DataFrame:
    """(comment_id, text, replies, shown): the first comments with how many replies they have and the first of these, oldest first.

    Replies to replies count with the comment that they answer directly. The limit holds before replies are gathered.
    """
    n = comments.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("comment_id")).agg(F.count("*").alias("replies"))
    order = Window.partitionBy("parent_id").orderBy("created_at", "comment_id")
    some = comments.where("parent_id IS NOT NULL").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)
    shown = some.groupBy(F.col("parent_id").alias("comment_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "comment_id"))), lambda x: x["comment_id"]).alias("shown"))
    top = comments.where("parent_id IS NULL").select("comment_id", "entity_id", "text", "created_at")
    out = top.join(n, "comment_id", "left").join(shown, "comment_id", "left")
    return out.withColumns({"replies": F.coalesce("replies", F.lit(0)), "shown": F.coalesce("shown", F.array().cast("array<string>"))})
