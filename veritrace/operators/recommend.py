"""Companies to look at beside one, and what a risk score is made of in words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.functions.text import jaccard, sector

#: What the same sector, the same region, a risk score within NEAR and flags in common count.
SECTOR, REGION, RISK, FLAGS, NEAR = 0.30, 0.25, 0.20, 0.25, 0.15
#: The similarity of companies of one community.
COMMUNITY = 0.85
#: What single bidders, centrality and the largest buyer weigh in a risk score.
SINGLE, CENTRAL, LOYAL = 0.40, 0.30, 0.30


def _beside(companies: DataFrame, company_id) -> DataFrame:
    """All other companies, each with the one in x."""
    x = companies.where(F.col("company_id") == company_id).limit(1).select(F.struct(*companies.columns).alias("x"))
    return companies.where(F.col("company_id") != company_id).join(F.broadcast(x))  # one row


def _flags(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _told(rows: DataFrame, strategy: str, score: Column, features: Column, limit: int, *order) -> DataFrame:
    out = rows.select("company_id", F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"), score.alias("similarity"), F.lit(strategy).alias("strategy"), features.alias("features"))
    return out.orderBy(*(order or (F.desc("similarity"),)), "company_id").limit(limit)


def content(companies: DataFrame, company_id, limit: int = 50) -> DataFrame:
    """Companies (company_id, ateco, regione, risk_score, anomaly_flags, community_id) that are alike in sector, region, risk and flags."""
    rows = _beside(companies, company_id)
    same_sector = F.coalesce(sector(F.col("ateco")) == sector(F.col("x.ateco")), F.lit(False))
    same_region = F.coalesce(F.col("regione") == F.col("x.regione"), F.lit(False))
    near = F.abs(F.coalesce("risk_score", F.lit(0.0)) - F.coalesce("x.risk_score", F.lit(0.0))) < NEAR
    alike = jaccard(_flags("anomaly_flags"), _flags("x.anomaly_flags"))
    score = F.least(F.lit(1.0), SECTOR * same_sector.cast("int") + REGION * same_region.cast("int") + RISK * near.cast("int") + FLAGS * alike)
    features = F.array_compact(F.array(F.when(same_sector, F.lit("sector")), F.when(same_region, F.lit("region")), F.when(near, F.lit("risk")), F.when(alike > 0, F.lit("flags"))))
    return _told(rows.where(score > 0), "content", score, features, limit)


def community(companies: DataFrame, company_id, limit: int = 30) -> DataFrame:
    """The riskiest companies of its community."""
    rows = _beside(companies, company_id).where("community_id = x.community_id")
    return _told(rows, "community", F.lit(COMMUNITY), F.array(F.lit("community")), limit, F.desc("risk_score"))


def anomaly(companies: DataFrame, company_id, limit: int = 30) -> DataFrame:
    """Companies with a flag in common, by the flags' Jaccard similarity."""
    rows = _beside(companies, company_id).where(F.arrays_overlap(_flags("anomaly_flags"), _flags("x.anomaly_flags")))
    shared = F.array_sort(F.array_intersect("anomaly_flags", "x.anomaly_flags"))
    return _told(rows, "anomaly", jaccard(_flags("anomaly_flags"), _flags("x.anomaly_flags")), F.transform(shared, lambda f: F.concat(F.lit("flag:"), f)), limit)


def sector_risk(companies: DataFrame, company_id, limit: int = 20) -> DataFrame:
    """The riskiest companies of its sector; how alike they are is their risk."""
    rows = _beside(companies, company_id).where((F.col("risk_score") > 0) & (sector(F.col("ateco")) == sector(F.col("x.ateco"))))
    return _told(rows, "sector", F.round("risk_score", 4), F.array(F.lit("sector")), limit, F.desc("risk_score"))


STRATEGIES = {"content": content, "community": community, "anomaly": anomaly, "sector": sector_risk}


def recommend(companies: DataFrame, company_id, strategies: tuple[str, ...] = tuple(STRATEGIES), limit: int = 20) -> DataFrame:
    """(company_id, risk_score, similarity, strategies, features): the strategies' companies as one list: the greatest similarity, all reasons."""
    rows = reduce(DataFrame.union, [STRATEGIES[s](companies, company_id) for s in strategies])
    best = rows.groupBy("company_id").agg(
        F.max("risk_score").alias("risk_score"), F.max("similarity").alias("similarity"), F.array_sort(F.collect_set("strategy")).alias("strategies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("features")))).alias("features"),
    )
    return best.orderBy(F.desc("similarity"), F.desc("risk_score"), "company_id").limit(limit)


def factors(companies: DataFrame, wins: DataFrame) -> DataFrame:
    """(company_id, factor, value, contribution, rank): share of single-bidder wins, centrality, share of the largest buyer.

    Companies without wins have centrality only. Ranks go by contribution, then in that order.
    """
    per = wins.groupBy("company_id", "buyer_id").agg(F.count("*").alias("n"), F.count_if("single_bidder").alias("s"))
    all_ = per.groupBy("company_id").agg(F.sum("n").alias("wins"), F.sum("s").alias("single"), F.max("n").alias("top"))
    rows = companies.select("company_id", F.coalesce("centrality_score", F.lit(0.0)).alias("c")).join(all_, "company_id", "left")
    one = F.array_compact(F.array(
        F.when(F.col("wins") > 0, F.struct(F.lit("single_bidder_ratio").alias("factor"), (F.col("single") / F.col("wins")).alias("value"), F.lit(SINGLE).alias("w"), F.lit(1).alias("o"))),
        F.struct(F.lit("market_dominance").alias("factor"), F.col("c").alias("value"), F.lit(CENTRAL).alias("w"), F.lit(2).alias("o")),
        F.when(F.col("wins") > 0, F.struct(F.lit("buyer_concentration").alias("factor"), (F.col("top") / F.col("wins")).alias("value"), F.lit(LOYAL).alias("w"), F.lit(3).alias("o"))),
    ))
    weighed = F.transform(one, lambda f: F.struct((-F.round(f["value"] * f["w"], 4)).alias("k"), f["o"].alias("o"), f["factor"].alias("factor"), f["value"].alias("value")))
    out = rows.select("company_id", F.posexplode(F.array_sort(weighed)).alias("i", "f"))
    return out.select("company_id", "f.factor", F.round("f.value", 4).alias("value"), (-F.col("f.k")).alias("contribution"), (F.col("i") + 1).alias("rank"))


def trend(snapshots: DataFrame, companies: DataFrame, step: float = 0.05) -> DataFrame:
    """(company_id, trend): the score now against the newest snapshot; STABLE with fewer than two."""
    last = snapshots.groupBy("company_id").agg(F.max_by("risk_score", F.struct("change_date", "snapshot_id")).alias("before"), F.count("*").alias("n"))
    d = F.round(F.coalesce("risk_score", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), 4)
    word = F.when(F.coalesce("n", F.lit(0)) < 2, "STABLE").when(d >= step, "WORSENING").when(d <= -step, "IMPROVING").otherwise("STABLE")
    return companies.select("company_id", "risk_score").join(last, "company_id", "left").select("company_id", word.alias("trend"))


def summary(companies: DataFrame, found: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """(company_id, summary): a sentence of a company's factors and, if there is room, of the patterns (company_id, pattern) that flag it."""
    share = F.round(F.col("value") * 100).cast("int")
    said = {"single_bidder_ratio": F.format_string("%d%% single-bidder wins", share), "market_dominance": F.format_string("centrality %.2f", "value"), "buyer_concentration": F.format_string("%d%% buyer concentration", share)}
    words = F.coalesce(*[F.when(F.col("factor") == k, w) for k, w in said.items()])
    parts = found.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("rank", words.alias("w")))).alias("p"))
    rows = companies.select("company_id", "nome", "risk_score").join(parts.select("company_id", F.transform("p", lambda x: x["w"]).alias("p")), "company_id", "left")
    rows = rows.withColumn("p", F.slice(F.coalesce("p", F.array().cast("array<string>")), 1, 3))
    if patterns is not None:
        names = patterns.select("company_id", "pattern").distinct().groupBy("company_id").agg(F.slice(F.array_sort(F.collect_list("pattern")), 1, 2).alias("names"))
        told = F.concat(F.lit("fraud patterns "), F.array_join("names", " and "))
        rows = rows.join(names, "company_id", "left").withColumn("p", F.when(F.col("names").isNotNull() & (F.size("p") < 3), F.concat("p", F.array(told))).otherwise(F.col("p")))
    score = F.format_string("%.2f", F.coalesce("risk_score", F.lit(0.0)))
    numbered = F.transform("p", lambda w, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), w))
    text = F.when(F.size("p") > 0, F.concat(F.lit("This company scored "), score, F.lit(" because: "), F.array_join(numbered, ", "), F.lit("."))).otherwise(F.concat("nome", F.lit(" has a risk score of "), score, F.lit(". No factor explains it.")))
    return rows.select("company_id", text.alias("summary"))
