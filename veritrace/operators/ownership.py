"""Loads of persons, seats and shares with the keys that registers give them, and families of companies below their last owners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.operators.components import stored


def load_persons(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """(cf, nome, cognome, source) after a load: a name that is known stays, one that is null is filled, and sources (an array) add up.

    incoming has source as text. Of several rows with one code the least name counts; rows without a code are left out.
    """
    now = current.select("cf", F.lit(0).alias("o"), "nome", "cognome", "source")
    new = incoming.where("cf IS NOT NULL AND cf <> ''").select("cf", F.lit(1).alias("o"), "nome", "cognome", F.array("source").alias("source"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("o", c)))[c].alias(c)
    rows = now.unionByName(new)
    # sources are few: one for each register that was ever loaded
    return rows.groupBy("cf").agg(first("nome"), first("cognome"), F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_set("source"))))).alias("source"))


def load_edges(current: DataFrame, rows: DataFrame, companies: DataFrame, keys: tuple[str, ...], replaced: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(edges, rows refused): edges are one for each value of keys, nulls among them alike; company_cf has to be one of companies (cf).

    An edge that is there keeps its other columns but those ``replaced``, which take what comes, nulls aside. Of several new rows with one
    key the least counts, and for each replaced column its greatest value.
    """
    known = companies.select(F.col("cf").alias("company_cf")).distinct()
    kept = [c for c in current.columns if c not in (*keys, *replaced)]
    new = rows.join(known, "company_cf", "left_semi").select(*current.columns)
    both = current.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    values = [F.coalesce(F.max(F.when(F.col("_o") == 1, F.col(c))), F.max(c)).alias(c) for c in replaced]
    made = both.groupBy(*keys).agg(F.min(F.struct("_o", *kept)).alias("_k"), *values)
    return made.select(*[F.col(f"_k.{c}").alias(c) if c in kept else F.col(c) for c in current.columns]), rows.join(known, "company_cf", "left_anti").select(*rows.columns)


def load_represents(current: DataFrame, rows: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seats by person, company and role: a seat that is there stays as it is."""
    return load_edges(current, rows, companies, ("person_cf", "company_cf", "ruolo"))


def load_shareholdings(current: DataFrame, rows: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shares by holder, company and day of the survey: a share that comes again gets its new quota."""
    return load_edges(current, rows, companies, ("source_cf", "company_cf", "data_rilevazione"), ("quota",))


def last_owners(shares: DataFrame, depth: int = 10) -> DataFrame:
    """(ubo, company, steps): every company with each owner over 1 to depth steps that nobody owns, and the fewest steps between them.

    shares has owner and company; owners are persons and companies, so their ids must tell them apart. Companies that own one another
    in a ring have no last owner but those outside it. The walk starts from the owners that nobody owns, so pairs of inner owners are never made.
    """
    e = stored(shares.select("owner", "company").where("owner IS NOT NULL AND company IS NOT NULL AND owner <> company").distinct())
    top = e.join(e.select(F.col("company").alias("owner")), "owner", "left_anti")
    level = found = stored(top.select(F.col("owner").alias("ubo"), "company", F.lit(1).alias("steps")))
    for k in range(2, depth + 1):
        nxt = level.select("ubo", F.col("company").alias("owner")).join(e, "owner").select("ubo", "company").distinct()
        level = stored(nxt.join(found, ["ubo", "company"], "left_anti").withColumn("steps", F.lit(k)))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def family(shares: DataFrame, company: str, depth: int = 10) -> DataFrame:
    """(ubo, sibling): the other companies below the last owners of one company. Both walks go from frontiers, up and then down."""
    e = shares.select("owner", "company").where("owner IS NOT NULL AND company IS NOT NULL AND owner <> company").distinct()

    def walk(level: DataFrame, near: str, far: str) -> DataFrame:
        level = found = stored(level)
        for _ in range(depth):
            nxt = level.join(e, level["node"] == e[near]).select("start", F.col(far).alias("node")).distinct()
            level = stored(nxt.join(found, ["start", "node"], "left_anti"))
            if level.isEmpty():
                break
            found = found.unionByName(level)
        return found

    spark = shares.sparkSession
    up = walk(spark.createDataFrame([(company, company)], "start string, node string"), "company", "owner").where(F.col("node") != company)
    ubo = up.join(e.select(F.col("company").alias("node")), "node", "left_anti").select(F.col("node").alias("start"), "node")
    down = walk(ubo, "owner", "company")
    return down.where((F.col("node") != F.col("start")) & (F.col("node") != company)).select(F.col("start").alias("ubo"), F.col("node").alias("sibling"))
