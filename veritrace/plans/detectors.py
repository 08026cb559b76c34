"""Fraud detectors: findings with severity and score, what they flag, and what that does to risk.

Defaults are those that investigators work with. The registered queries pass other thresholds where the driver's
tables, whose values are spread evenly, would give no row; their SQL has the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrace.operators import graph, runs, scoring
from veritrace.operators.components import cut, new_path, stored
from veritrace.plans.algorithms import _B, _E, _P, shared_buyers, supply
from veritrace.plans.analytics import _SHELL, shell_features
from veritrace.plans.base import joined, query, spread, top, total
from veritrace.plans.templates import shared_boards
from veritrace.sources.tables import AS_OF, EU_FUNDS, Tables

#: What a finding adds to the risk of each company that it flags.
BUMPS = {"low": 0.05, "medium": 0.15, "high": 0.25, "critical": 0.40}
#: How many times more pairs of companies are looked at when the first share too few buyers.
FEW_PAIRS = 64
#: name -> (detector, arguments of its registered query, SQL of the same, columns of companies that it flags).
DETECTORS: dict[str, tuple[Callable[..., DataFrame], dict, str, tuple[str, ...]]] = {}


def detector(name: str, sql: str, flags: tuple[str, ...], **given):
    def add(f):
        DETECTORS[name] = (f, given, sql, flags)
        return query(name, sql, **given)(f)

    return add


def _marked(df: DataFrame, severity: Column | str, score: Column | float, limit: int | None, *order) -> DataFrame:
    """df with severity and score between 0 and 1, the first rows in order."""
    severity = F.lit(severity) if isinstance(severity, str) else severity
    score = F.lit(score) if isinstance(score, float) else F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)
    return top(df.withColumns({"severity": severity, "score": score}), limit, *order)


def _recent(df: DataFrame, days: int | None, as_of: str) -> DataFrame:
    return df if days is None else df.where(F.col("data_aggiudicazione") >= F.date_sub(F.to_date(F.lit(as_of)), days))


@detector("bid_rotation", """SELECT buyer_id, count(*) AS companies, CAST(sum(n) AS BIGINT) AS total_wins, array_to_string(list_sort(list(company_id)), ',') AS rotation, 'high' AS severity, 0.7::DOUBLE AS score
  FROM (SELECT buyer_id, company_id, count(*) AS n FROM wins GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1 HAVING count(*) >= 2 ORDER BY 3 DESC, 1 LIMIT 50""", (), days=None)
def bid_rotation(t: Tables, least_wins: int = 3, least_companies: int = 2, days: int | None = 365, as_of: str = AS_OF, limit: int | None = 50) -> DataFrame:
    """Buyers whose tenders a few companies win in turn. One row stands for all of a buyer's companies; it flags none."""
    w = spread(t, _recent(t.wins, days, as_of).select("buyer_id", "company_id"), "buyer_id", "company_id")
    n = w.groupBy("buyer_id", "company_id").agg(F.count("*").alias("n")).where(F.col("n") >= least_wins)
    out = n.groupBy("buyer_id").agg(F.count("*").alias("companies"), F.sum("n").alias("total_wins"), joined(F.collect_list("company_id")).alias("rotation"))
    return _marked(out.where(F.col("companies") >= least_companies), "high", 0.7, limit, F.desc("total_wins"), "buyer_id")


_WINNER = "winner AS (SELECT l_orderkey AS tender_id, arg_min(l_suppkey, {'a': -l_extendedprice, 'b': l_suppkey}) AS company_id FROM lineitem GROUP BY 1)"


def single_winner(t: Tables) -> DataFrame:
    """(company_id, tender_id): the supplier of a tender's largest line."""
    best = F.min(F.struct((-F.col("l_extendedprice")).alias("a"), F.col("l_suppkey").alias("b")))
    return t.raw("lineitem").groupBy(F.col("l_orderkey").alias("tender_id")).agg(best.alias("m")).select(F.col("m.b").alias("company_id"), "tender_id")


@detector("ghost_bidding", f"""WITH {_WINNER}, big AS (SELECT w.* FROM winner w JOIN tender t ON w.tender_id = t.tender_id WHERE importo > 450000), c AS (SELECT company_id, community_id FROM company),
  n AS (SELECT community_id, count(DISTINCT tender_id) AS n FROM big JOIN c ON big.company_id = c.company_id GROUP BY 1)
  SELECT c.company_id AS ghost_id, c.community_id AS community, n AS community_tenders, 'medium' AS severity, 0.5::DOUBLE AS score FROM c JOIN n ON c.community_id = n.community_id
  WHERE NOT EXISTS (SELECT 1 FROM big WHERE big.company_id = c.company_id) AND n >= 5 ORDER BY 3 DESC, 1 LIMIT 30""", ("ghost_id",), above=450_000.0)
def ghost_bidding(t: Tables, least: int = 5, above: float | None = None, limit: int | None = 30) -> DataFrame:
    """Companies without a win in a community that wins; with ``above``, counting only the supplier of a tender's largest line, in tenders above that value."""
    w = t.win_keys if above is None else single_winner(t).join(t.tender.where(F.col("importo") > above).select("tender_id"), "tender_id")
    c = t.company.where("community_id IS NOT NULL").select("company_id", "community_id")
    n = w.join(c, "company_id").groupBy("community_id").agg(F.count_distinct("tender_id").alias("community_tenders")).where(F.col("community_tenders") >= least)
    out = c.join(w, "company_id", "left_anti").join(n, "community_id").select(F.col("company_id").alias("ghost_id"), F.col("community_id").alias("community"), "community_tenders")
    return _marked(out, "medium", 0.5, limit, F.desc("community_tenders"), "ghost_id")


@detector("split_tendering", "SELECT buyer_id, company_id, count(*) AS tender_count, round(sum(importo), 2) AS total_value, 'high' AS severity, 0.75::DOUBLE AS score FROM wins WHERE importo < 40000 GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY 3 DESC, 1, 2 LIMIT 50", ("company_id",), least=2, days=None)
def split_tendering(t: Tables, below: float = 40_000.0, least: int = 3, days: int | None = 90, as_of: str = AS_OF, limit: int | None = 50) -> DataFrame:
    w = _recent(t.wins.where(F.col("importo") < below), days, as_of)
    out = w.groupBy("buyer_id", "company_id").agg(F.count("*").alias("tender_count"), total("importo", "total_value")).where(F.col("tender_count") >= least)
    return _marked(out, "high", 0.75, limit, F.desc("tender_count"), "buyer_id", "company_id")


@detector("short_award_window", "SELECT tender_id, company_id, buyer_id, d AS award_days, CASE WHEN d <= 1 THEN 'critical' ELSE 'high' END AS severity, CASE WHEN d <= 1 THEN 0.8 ELSE 0.6 END::DOUBLE AS score FROM (SELECT *, datediff('day', data_apertura, data_aggiudicazione) AS d FROM wins) WHERE d >= 0 AND d < 7 ORDER BY d, tender_id, company_id LIMIT 100", ("company_id",))
def short_award_window(t: Tables, below: int = 7, limit: int | None = 100) -> DataFrame:
    d = F.datediff("data_aggiudicazione", "data_apertura").cast("long")
    rows = t.wins.withColumn("award_days", d).where((F.col("award_days") >= 0) & (F.col("award_days") < below))
    fast = F.col("award_days") <= 1
    return _marked(rows.select("tender_id", "company_id", "buyer_id", "award_days"), F.when(fast, "critical").otherwise("high"), F.when(fast, 0.8).otherwise(0.6), limit, "award_days", "tender_id", "company_id")


@detector("price_manipulation", """WITH s AS (SELECT ateco, w.company_id, tender_id, importo FROM wins w JOIN company c ON w.company_id = c.company_id), m AS (SELECT ateco, avg(importo) AS m, stddev_pop(importo) AS sd, count(*) AS n FROM s GROUP BY 1),
  z AS (SELECT s.ateco AS sector, tender_id, company_id, round((importo - m) / sd, 4) AS z_score FROM s JOIN m ON s.ateco = m.ateco WHERE n >= 5 AND sd > 0 AND (importo - m) / sd > 1.6)
  SELECT *, CASE WHEN z_score > 4 THEN 'critical' ELSE 'high' END AS severity, round(least(1, z_score / 5), 4)::DOUBLE AS score FROM z ORDER BY z_score DESC, tender_id, company_id LIMIT 50""", ("company_id",), z=1.6)
def price_manipulation(t: Tables, z: float = 2.5, least: int = 5, limit: int | None = 50) -> DataFrame:
    """Moments are aggregated by sector and joined back, so a large sector is not one window."""
    s = t.wins.join(t.company.select("company_id", "ateco"), "company_id")
    m = stored(s.groupBy("ateco").agg(F.avg("importo").alias("m"), F.stddev_pop("importo").alias("sd"), F.count("*").alias("n")).where(f"n >= {least} AND sd > 0"))
    score = (F.col("importo") - F.col("m")) / F.col("sd")
    rows = s.join(m, "ateco").where(score > z).select(F.col("ateco").alias("sector"), "tender_id", "company_id", F.round(score, 4).alias("z_score"))
    return _marked(rows, F.when(F.col("z_score") > 4, "critical").otherwise("high"), F.col("z_score") / 5, limit, F.desc("z_score"), "tender_id", "company_id")


@detector("ubo_conflict", """WITH RECURSIVE o AS (SELECT company_id, owner_id, 1 AS d FROM shareholder_of UNION ALL SELECT o.company_id, s.owner_id, d + 1 FROM o JOIN shareholder_of s ON s.company_id = o.owner_id WHERE d < 5)
  SELECT DISTINCT w.company_id, w.buyer_id, w.tender_id, 'critical' AS severity, 1.0::DOUBLE AS score FROM wins w JOIN o ON w.company_id = o.company_id JOIN company c ON c.company_id = o.owner_id JOIN buyer b ON b.buyer_id = w.buyer_id AND b.buyer_cf = c.cf ORDER BY 1, 2, 3 LIMIT 50""", ("company_id",))
def ubo_conflict(t: Tables, depth: int = 5, limit: int | None = 50) -> DataFrame:
    """Tenders whose winner is owned, over at most depth steps, by the buyer: a company whose tax code, or VAT number where companies have one, is the buyer's code."""
    above = graph.reachable(t.shareholder_of.select(F.col("company_id").alias("src"), F.col("owner_id").alias("dst")), depth)
    codes = t.company.select(F.col("company_id").alias("dst"), F.explode(F.array(*[c for c in ("cf", "piva") if c in t.company.columns])).alias("buyer_cf"))
    pairs = stored(above.join(codes, "dst").join(t.buyer.select("buyer_id", "buyer_cf"), "buyer_cf").select(F.col("src").alias("company_id"), "buyer_id"))
    rows = t.wins.join(pairs, ["company_id", "buyer_id"], "left_semi").select("company_id", "buyer_id", "tender_id")
    return _marked(rows, "critical", 1.0, limit, "company_id", "buyer_id", "tender_id")


@detector("winner_loser_ring", """WITH c AS (SELECT company_id, community_id FROM company), n AS (SELECT company_id, buyer_id, count(*) AS n FROM wins GROUP BY 1, 2),
  both_ AS (SELECT a.company_id AS winner, b.company_id AS peer, a.buyer_id, count(*) AS k FROM wins a JOIN win_keys b ON a.tender_id = b.tender_id AND a.company_id <> b.company_id GROUP BY 1, 2, 3)
  SELECT n.company_id AS winner, p.company_id AS peer, n.buyer_id, n.n - coalesce(k, 0) AS wins_without, 'high' AS severity, 0.7::DOUBLE AS score FROM n JOIN c ON n.company_id = c.company_id JOIN c p ON c.community_id = p.community_id AND p.company_id <> c.company_id
  LEFT JOIN both_ ON winner = n.company_id AND peer = p.company_id AND both_.buyer_id = n.buyer_id WHERE n.n - coalesce(k, 0) >= 4 ORDER BY 4 DESC, 1, 2, 3 LIMIT 30""", ("winner", "peer"))
def winner_loser_ring(t: Tables, least: int = 4, limit: int | None = 30) -> DataFrame:
    """Tenders of a buyer that a company won and a peer of its community did not: all its wins there less those that both won.

    Only (company, buyer) pairs with enough wins meet their community's peers; they and their tenders are stored, so that
    Spark knows their size and the other wins stay where they lie if they are few. With a limit, a pair's peers that shared
    no win with it all count alike, so only the first ``limit`` of them can be among the first rows: each pair meets its
    community's first peers by number, ``limit`` more than it shared wins with, and no community is multiplied out.
    """
    c = t.company.where("community_id IS NOT NULL").select("community_id", "company_id")
    w = spread(t, t.wins.select("company_id", "buyer_id"), "company_id", "buyer_id")
    n = stored(w.groupBy("company_id", "buyer_id").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    mine = n.join(c, "company_id").withColumnRenamed("company_id", "winner")
    a = t.wins.select("tender_id", "buyer_id", F.col("company_id").alias("winner")).join(n.select(F.col("company_id").alias("winner"), "buyer_id"), ["winner", "buyer_id"], "left_semi")
    a = stored(a)
    others = t.win_keys.join(a.select("tender_id").distinct(), "tender_id", "left_semi")
    both = a.join(others.withColumnRenamed("company_id", "peer"), "tender_id").where("winner <> peer").groupBy("winner", "peer", "buyer_id").agg(F.count("*").alias("k"))
    peers = c.withColumnRenamed("company_id", "peer")
    if limit is not None:
        peers = peers.withColumn("_k", F.row_number().over(Window.partitionBy("community_id").orderBy("peer")))
        shared = both.groupBy("winner", "buyer_id").agg(F.count("*").alias("_shared"))
        sizes = c.groupBy("community_id").agg(F.count("*").alias("_size"))
        asked = mine.join(shared, ["winner", "buyer_id"], "left").join(sizes, "community_id")
        most = F.least("_size", F.coalesce("_shared", F.lit(0)) + limit + 1)  # the winner itself may be one of them
        mine = asked.withColumn("_k", F.explode(F.sequence(F.lit(1), most.cast("int")))).drop("_shared", "_size")
    pairs = mine.join(peers, [c for c in ("community_id", "_k") if c in peers.columns]).where("winner <> peer")
    left = F.col("n") - F.coalesce("k", F.lit(0))
    rows = pairs.join(both, ["winner", "peer", "buyer_id"], "left").where(left >= least).select("winner", "peer", "buyer_id", left.alias("wins_without"))
    return _marked(rows, "high", 0.7, limit, F.desc("wins_without"), "winner", "peer", "buyer_id")


@detector("pnrr_concentration", """WITH e AS (SELECT DISTINCT w.company_id, tender_id, regione, importo FROM wins w JOIN (SELECT project_id FROM project WHERE fondo = 'STANDARD') p ON w.project_id = p.project_id JOIN (SELECT company_id, regione FROM company) c ON w.company_id = c.company_id),
  r AS (SELECT regione, count(DISTINCT tender_id) AS total FROM e GROUP BY 1), s AS (SELECT company_id, e.regione, count(*) AS pnrr_wins, total AS regional_total, round(count(*) / total, 4) AS ratio, round(sum(importo), 2) AS total_value
  FROM e JOIN r ON e.regione = r.regione GROUP BY 1, 2, 4 HAVING count(*) >= 3 AND count(*) / total >= 0.1) SELECT *, CASE WHEN ratio >= 0.8 THEN 'critical' ELSE 'high' END AS severity, ratio AS score FROM s ORDER BY ratio DESC, company_id LIMIT 30""", ("company_id",), ratio=0.1)
def pnrr_concentration(t: Tables, least: int = 3, ratio: float = 0.6, funds: tuple[str, ...] = EU_FUNDS, limit: int | None = 30) -> DataFrame:
    p = t.project.where(F.col("fondo").isin(*funds)).select("project_id")
    e = t.wins.join(p, "project_id", "left_semi").join(t.company.select("company_id", "regione"), "company_id")
    r = e.groupBy("regione").agg(F.count_distinct("tender_id").alias("regional_total"))
    n = e.groupBy("company_id", "regione").agg(F.count("*").alias("pnrr_wins"), total("importo", "total_value")).where(F.col("pnrr_wins") >= least)
    share = F.col("pnrr_wins") / F.col("regional_total")
    rows = n.join(r, "regione").where(share >= ratio).select("company_id", "regione", "pnrr_wins", "regional_total", F.round(share, 4).alias("ratio"), "total_value")
    return _marked(rows, F.when(F.col("ratio") >= 0.8, "critical").otherwise("high"), F.col("ratio"), limit, F.desc("ratio"), "company_id")


@detector("community_monopoly", """WITH v AS (SELECT c.community_id, w.company_id, sum(importo) AS v, count(*) AS n FROM wins w JOIN company c ON w.company_id = c.company_id GROUP BY 1, 2), g AS (SELECT community_id, sum(v) AS total, count(*) AS members FROM v GROUP BY 1)
  SELECT company_id, v.community_id, round(v / total, 4) AS share, members, 'high' AS severity, round(v / total, 4) AS score FROM v JOIN g ON v.community_id = g.community_id WHERE n >= 5 AND members >= 2 AND total > 0 AND v / total >= 0.05 ORDER BY 3 DESC, 1 LIMIT 20""", ("company_id",), share=0.05)
def community_monopoly(t: Tables, share: float = 0.7, least: int = 5, members: int = 2, limit: int | None = 20) -> DataFrame:
    v = t.wins.groupBy("company_id").agg(F.sum("importo").alias("v"), F.count("*").alias("n")).join(t.company.select("company_id", "community_id"), "company_id").where("community_id IS NOT NULL")
    g = v.groupBy("community_id").agg(F.sum("v").alias("total"), F.count("*").alias("members")).where(f"total > 0 AND members >= {members}")
    part = F.col("v") / F.col("total")
    rows = v.where(F.col("n") >= least).join(g, "community_id").where(part >= share).select("company_id", "community_id", F.round(part, 4).alias("share"), "members")
    return _marked(rows, "high", F.col("share"), limit, F.desc("share"), "company_id")


@detector("network_clique", f"""WITH {_P}, {_B}, x AS (SELECT p.src AS node, CAST(count(*) / 2 AS BIGINT) AS triangles FROM b p JOIN b q ON p.dst = q.src JOIN b r ON q.dst = r.src AND r.dst = p.src GROUP BY 1)
  SELECT node AS company_id, triangles, 'high' AS severity, round(least(1.0, triangles / 20), 4)::DOUBLE AS score FROM x WHERE triangles >= 3 ORDER BY 2 DESC, 1 LIMIT 30""", ("company_id",))
def network_clique(t: Tables, least: int = 3, limit: int | None = 30) -> DataFrame:
    n = graph.triangles(shared_buyers(t)).where(F.col("triangles") >= least).select(F.col("node").alias("company_id"), "triangles")
    return _marked(n, "high", F.col("triangles") / 20, limit, F.desc("triangles"), "company_id")


@detector("carousel_fraud", f"""WITH RECURSIVE {_E}, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src), m AS (SELECT r.a AS node, min(r.b) AS component FROM r JOIN r q ON r.a = q.b AND r.b = q.a GROUP BY 1)
  SELECT component AS scc_id, count(*) AS cycle_size, 'critical' AS severity, 0.95::DOUBLE AS score FROM m GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 20""", ())
def carousel_fraud(t: Tables, least: int = 3, most: int = 6, limit: int | None = 20) -> DataFrame:
    """Groups of companies that subcontract to one another in circles; where there is no such group, single cycles."""
    n = graph.strong_components(supply(t)).groupBy(F.col("component").alias("scc_id")).agg(F.count("*").alias("cycle_size")).where(F.col("cycle_size") >= least)
    n = cut(n)
    if n.isEmpty():
        n = graph.cycles(supply(t), least, most, limit).select(F.col("chain")[0].alias("scc_id"), F.col("length").cast("long").alias("cycle_size"))
    return _marked(n, "critical", 0.95, limit, F.desc("cycle_size"), "scc_id")


@detector("board_overlap_collusion", """WITH s AS (SELECT a.company_id AS a, b.company_id AS b, count(*) AS n FROM represents a JOIN represents b ON a.person_id = b.person_id AND a.company_id < b.company_id GROUP BY 1, 2 HAVING count(*) >= 2), k AS (SELECT DISTINCT company_id, buyer_id FROM wins)
  SELECT a AS company_a, b AS company_b, k1.buyer_id, n AS shared_count, 'high' AS severity, 0.75::DOUBLE AS score FROM s JOIN k k1 ON k1.company_id = a JOIN k k2 ON k2.company_id = b AND k2.buyer_id = k1.buyer_id ORDER BY 4 DESC, 1, 2, 3 LIMIT 50""", ("company_a", "company_b"))
def board_overlap_collusion(t: Tables, least: int = 2, limit: int | None = 50) -> DataFrame:
    """One row per pair and shared buyer.

    Rows go by their pair first, so those of the first pairs precede all others: with a limit, the first ``limit`` pairs
    meet their buyers, then FEW_PAIRS times as many, and all only if these share too few buyers.
    """
    s = stored(shared_boards(t, least))
    order = [F.desc("shared_count"), "company_a", "company_b"]

    def found(pairs: DataFrame, won: DataFrame) -> DataFrame:
        k = won.select("company_id", "buyer_id").distinct()
        a = pairs.join(k.withColumnRenamed("company_id", "company_a"), "company_a")
        rows = a.join(k.withColumnRenamed("company_id", "company_b"), ["company_b", "buyer_id"]).select("company_a", "company_b", "buyer_id", "shared_count")
        return _marked(rows, "high", 0.75, limit, *order, "buyer_id")

    for n in () if limit is None else (limit, FEW_PAIRS * limit):
        some = stored(s.orderBy(*order).limit(n))
        ids = some.select(F.col("company_a").alias("company_id")).union(some.select("company_b"))
        first = cut(found(some, t.wins.join(stored(ids.distinct()), "company_id", "left_semi")))
        if first.count() == limit or some.count() < n:
            return first.orderBy(*order, "buyer_id")
    return found(s, t.wins)


@detector("subcontractor_concentration", """WITH p AS (SELECT src, dst, count(*) AS n FROM subcontracts_to GROUP BY 1, 2), g AS (SELECT src, sum(n) AS total FROM p GROUP BY 1)
  SELECT p.src AS winner, dst AS subcontractor, n AS pair_count, round(n / total, 4) AS ratio, 'high' AS severity, 0.8::DOUBLE AS score FROM p JOIN g ON p.src = g.src WHERE n >= 3 AND n / total >= 0.02 ORDER BY 4 DESC, 1, 2 LIMIT 30""", ("winner", "subcontractor"), ratio=0.02)
def subcontractor_concentration(t: Tables, ratio: float = 0.8, least: int = 3, limit: int | None = 30) -> DataFrame:
    p = t.subcontracts_to.groupBy("src", "dst").agg(F.count("*").alias("pair_count"))
    g = p.groupBy("src").agg(F.sum("pair_count").alias("total"))
    part = F.col("pair_count") / F.col("total")
    rows = p.where(F.col("pair_count") >= least).join(g, "src").where(part >= ratio).select(F.col("src").alias("winner"), F.col("dst").alias("subcontractor"), "pair_count", F.round(part, 4).alias("ratio"))
    return _marked(rows, "high", 0.8, limit, F.desc("ratio"), "winner", "subcontractor")


_SCORED = """, y AS (SELECT company_id, 0.30::DOUBLE * (least(w / 3, 1) + (1 - least(e / 5, 1)) + least(d / 10, 1)) / 3 + 0.15::DOUBLE * CASE WHEN NOT vat_active AND w >= 3 THEN 1 WHEN NOT vat_active AND w > 0 THEN 0.5 ELSE 0 END
  + 0.15::DOUBLE * CASE WHEN 2001 - last_filing_year >= 2 THEN least((2001 - last_filing_year) / 4, 1) ELSE 0 END + 0.15::DOUBLE * CASE WHEN b >= 20 THEN least(b / 40, 1) WHEN b > 10 THEN 0.4 ELSE 0 END + 0.10::DOUBLE * CASE WHEN so THEN 1 ELSE 0 END + 0.10::DOUBLE * least(shared / 3, 1)
  + 0.05::DOUBLE * CASE WHEN d > 5 THEN least(d / 8, 1) ELSE 0 END AS s FROM x)"""


@detector("shell_company_network", _SHELL + _SCORED + """, h AS (SELECT * FROM y WHERE s >= 0.3), k AS (SELECT 'p' || person_id AS k, company_id FROM represents UNION SELECT 'a' || address, company_id FROM company), l AS (SELECT k, k.company_id FROM k JOIN h ON k.company_id = h.company_id),
  lk AS (SELECT DISTINCT a.company_id AS u, b.company_id AS v FROM l a JOIN l b ON a.k = b.k), r AS (SELECT u, v FROM lk UNION SELECT r.u, lk.v FROM r JOIN lk ON r.v = lk.u), g AS (SELECT u, min(v) AS component FROM r GROUP BY 1)
  SELECT component, count(*) AS members, round(max(s), 4) AS max_score, CASE WHEN round(max(s), 4) >= 0.75 THEN 'critical' ELSE 'high' END AS severity, round(max(s), 4) AS score FROM g JOIN h ON g.u = h.company_id GROUP BY 1 HAVING count(*) >= 2""", (), threshold=0.3)
def shell_company_network(t: Tables, threshold: float = 0.5, year: int = int(AS_OF[:4])) -> DataFrame:
    """Groups of companies with a high shell score that share a director or an address."""
    s = scoring.enhanced_shell(shell_features(t), year).where(F.col("shell_score") >= threshold).select("company_id", "shell_score")
    hub = t.represents.select("company_id", F.concat(F.lit("p"), F.col("person_id")).alias("k")).union(t.company.select("company_id", F.concat(F.lit("a"), F.col("address"))))
    k = cut(hub.join(s.select("company_id"), "company_id", "left_semi"))
    first = k.groupBy("k").agg(F.min("company_id").alias("dst"))
    groups = graph.connected_components(k.join(first, "k").select(F.col("company_id").alias("src"), "dst"))
    out = groups.join(s, F.col("node") == F.col("company_id")).groupBy("component").agg(F.count("*").alias("members"), F.round(F.max("shell_score"), 4).alias("max_score"))
    return _marked(out.where("members >= 2"), F.when(F.col("max_score") >= 0.75, "critical").otherwise("high"), F.col("max_score"), None, "component")


# -- all of them


def run_all(t: Tables, given: dict[str, dict] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Every detector's findings, stored, and what went wrong with those that failed; one failure stops no other. Tables that several of them read are made once."""
    found, errors, t = {}, {}, t.keep("company", "wins", "win_keys", "represents", "subcontracts_to")
    for name, (f, _, _, _) in DETECTORS.items():
        try:
            found[name] = cut(f(t, **(given or {}).get(name, {})))
        except Exception as e:  # noqa: BLE001 - told to the caller
            errors[name] = f"{type(e).__name__}: {e}"
    return found, errors


def all_found(t: Tables, given: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """Every detector's findings, stored; raises if any detector failed, since the others alone would pass for the whole."""
    found, errors = run_all(t, given)
    if errors:
        raise RuntimeError(f"detectors failed: {errors}")
    return found


def flagged(found: dict[str, DataFrame]) -> DataFrame:
    """(company_id, pattern, severity, score): the links from companies to the patterns that flag them, one for each finding."""
    parts = [df.select(F.col(c).alias("company_id"), F.lit(name).alias("pattern"), "severity", "score") for name, df in found.items() for c in DETECTORS[name][3]]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def summary(found: dict[str, DataFrame]) -> DataFrame:
    """(pattern, severity, occurrences), most first."""
    parts = [df.select(F.lit(name).alias("pattern"), "severity") for name, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("pattern", "severity").agg(F.count("*").alias("occurrences")).orderBy(F.desc("occurrences"), "pattern", "severity")


def bumped(risk: DataFrame, links: DataFrame) -> DataFrame:
    """risk (company_id, score) raised by BUMPS for each link, 1 at most."""
    add = F.coalesce(*[F.when(F.col("severity") == k, F.lit(v)) for k, v in BUMPS.items()])
    more = links.groupBy("company_id").agg(F.sum(add).alias("more"))
    return risk.join(more, "company_id", "left").withColumn("score", F.least(F.lit(1.0), F.col("score") + F.coalesce("more", F.lit(0.0)))).drop("more")


def _given() -> dict[str, dict]:
    return {name: given for name, (_, given, _, _) in DETECTORS.items()}


_ALL = " UNION ALL ".join(f"SELECT '{name}' AS pattern, severity FROM ({sql})" for name, (_, _, sql, _) in DETECTORS.items())
_LINKS = " UNION ALL ".join(f"SELECT {c} AS company_id, '{name}' AS pattern, severity, score FROM ({sql})" for name, (_, _, sql, flags) in DETECTORS.items() for c in flags)


@query("fraud_summary", f"SELECT pattern, severity, count(*) AS occurrences FROM ({_ALL}) GROUP BY 1, 2")
def fraud_summary(t: Tables) -> DataFrame:
    return summary(all_found(t, _given()))


@query("fraud_flags", f"SELECT company_id, pattern, severity, round(score, 4) AS score, count(*) AS findings FROM ({_LINKS}) GROUP BY ALL")
def fraud_flags(t: Tables) -> DataFrame:
    links = flagged(all_found(t, _given()))
    return links.groupBy("company_id", "pattern", "severity", F.round("score", 4).alias("score")).agg(F.count("*").alias("findings"))


@query("risk_after_findings", f"""WITH base AS (SELECT company_id, risk_score AS score FROM company), k AS (SELECT company_id, sum(CASE severity WHEN 'low' THEN 0.05 WHEN 'medium' THEN 0.15 WHEN 'high' THEN 0.25 ELSE 0.40 END)::DOUBLE AS more FROM ({_LINKS}) GROUP BY 1)
  SELECT base.company_id, round(least(1.0, score + coalesce(more, 0)), 4)::DOUBLE AS score FROM base LEFT JOIN k ON base.company_id = k.company_id""")
def risk_after_findings(t: Tables) -> DataFrame:
    risk = t.company.select("company_id", F.col("risk_score").alias("score"))
    return bumped(risk, flagged(all_found(t, _given()))).select("company_id", F.round("score", 4).alias("score"))


@query("latest_findings", f"""SELECT pattern, severity, count(DISTINCT company_id) AS affected FROM ({_LINKS}) GROUP BY 1, 2 ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, 1 LIMIT 10""")
def latest_findings(t: Tables, limit: int = 10, at: str = "2024-02-01 00:00:00") -> DataFrame:
    """The gravest patterns of the newest run, read from the log in which a run of all detectors keeps its findings."""
    log = new_path(t.spark, "findings")
    runs.keep_findings(flagged(all_found(t, _given())), log, "run", at)
    return runs.latest_findings(runs.findings_log(t.spark, log), limit).drop("at")
