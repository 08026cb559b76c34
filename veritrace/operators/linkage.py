"""Groups of records by average linkage, and pairs of records by words in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.operators.components import stored


def average_linkage(scores: DataFrame, least: float) -> DataFrame:
    """(id, cluster) for every id of scores (a, b, score): the clusters that are left when no two have a mean score of ``least`` or more.

    The mean is over all pairs of members; pairs without a row score 0, and of several rows the greatest counts. The clusters are those
    of merging the best two again and again (of equal means, those whose smallest ids come first), cluster is the least id. Here all pairs that
    are each other's best merge in one round, which gives the same: a merged cluster is never nearer to a third than
    the nearer of its parts was. Scores of merged clusters are sums, so rounds only join and add up, and hubs are combined before a shuffle.
    Rows with a null or of an id with itself are left out. With columns na and nb an id stands for so many records.
    """
    swap, one = F.col("a") > F.col("b"), F.lit(1).cast("long")
    na, nb = (F.col("na"), F.col("nb")) if "na" in scores.columns else (one, one)
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, nb).otherwise(na).alias("na"), F.when(swap, na).otherwise(nb).alias("nb")]
    rows = scores.where("a <> b AND score IS NOT NULL").select(*ends, "score").groupBy("a", "b", "na", "nb").agg(F.max("score").alias("s"))
    left = stored(rows.select("a", "b", (F.col("s") * F.col("na") * F.col("nb")).alias("s"), "na", "nb"))
    labels = stored(left.select("a").union(left.select("b")).distinct().toDF("id").withColumn("cluster", F.col("id")))
    while True:
        rank = F.struct((-F.round(F.col("s") / (F.col("na") * F.col("nb")), 12)).alias("d"), "a", "b")
        near = left.select("a", "b", "na", "nb", rank.alias("rank")).where(-F.col("rank.d") >= least)
        best = near.select(F.explode(F.array("a", "b")).alias("c"), "rank").groupBy("c").agg(F.min("rank").alias("rank"))
        # a pair that is the best of both its clusters
        merge = stored(best.groupBy("rank").count().where("count = 2").select(F.col("rank.b").alias("from"), F.col("rank.a").alias("to")))
        if merge.isEmpty():
            return labels
        sizes = left.select(F.col("a").alias("c"), F.col("na").alias("n")).union(left.select("b", "nb")).distinct()
        grown = merge.join(sizes.toDF("from", "n1"), "from").join(sizes.toDF("to", "n2"), "to").select("to", "from", (F.col("n1") + F.col("n2")).alias("size"))
        grown = stored(grown.select(F.col("from").alias("c"), "to", "size").union(grown.select("to", "to", "size")))
        for end, n in (("a", "na"), ("b", "nb")):
            left = left.join(grown.toDF(end, "_to", "_n"), end, "left").withColumns({end: F.coalesce("_to", end), n: F.coalesce("_n", n)}).drop("_to", "_n")
        swap = F.col("a") > F.col("b")
        ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb")]
        left = stored(left.where("a <> b").select("s", *ends).groupBy("a", "b", "na", "nb").agg(F.sum("s").alias("s")))
        labels = stored(labels.join(merge.toDF("cluster", "_to"), "cluster", "left").select("id", F.coalesce("_to", "cluster").alias("cluster")))


def common_words(rows: DataFrame, words: Column, least: int = 2) -> DataFrame:
    """(a, b, common): records of rows (id) with at least ``least`` different words in common, and how many.

    Records with the same words are a class: pairs are between the least ids of classes (a < b), and each other
    member comes with its class's least id. Words are put in order from the rarest; two sets with so many words in common have one
    of them among the first n - least + 1 of each, so only these meet, and a pair is looked at where its first such word
    is met. The commonest words are in nobody's first words but where sets have little else.
    """
    every = rows.select("id", F.array_sort(F.array_distinct(F.filter(words, lambda w: w.isNotNull()))).alias("w")).where(F.col("id").isNotNull() & (F.size("w") >= least))
    classes = stored(every.groupBy("w").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    token = classes.select("id", F.explode("w").alias("t"))
    ranked = token.join(token.groupBy("t").agg(F.count("*").alias("df")), "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("r"))
    sets = stored(ranked.select("id", F.transform("r", lambda x: x["t"]).alias("w")).withColumn("head", F.slice("w", F.lit(1), F.size("w") - least + 1)))
    keyed = sets.select("id", "w", "head", F.explode("head").alias("t"))
    other = keyed.select(F.col("id").alias("b"), F.col("w").alias("wb"), F.col("head").alias("hb"), "t")
    met = keyed.join(other, "t").where((F.col("id") < F.col("b")) & (F.array_intersect("head", "hb")[0] == F.col("t")))
    pairs = met.select(F.col("id").alias("a"), "b", F.size(F.array_intersect("w", "wb")).alias("common")).where(F.col("common") >= least)
    again = every.join(classes.where("n > 1").select("w", F.col("id").alias("a")), "w").where("id <> a").select("a", F.col("id").alias("b"), F.size("w").alias("common"))
    return pairs.union(again)
