"""Query templates of the investigation front ends, and the notebook's entity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.operators.graph import paths
from veritrace.plans.base import joined, mean, query, quarter_of, top, total, valid_at
from veritrace.sources.tables import AS_OF, EU_FUNDS, Tables

VALID = f"valid_from <= DATE '{AS_OF}' AND (valid_to IS NULL OR valid_to > DATE '{AS_OF}')"
_CF = "CF000000007"


@query("companies_by_region", f"""SELECT c.company_id, nome AS company, count(w.tender_id) AS tenders FROM company c LEFT JOIN win_keys w ON c.company_id = w.company_id
  WHERE regione = 'EUROPE' AND {VALID} GROUP BY 1, 2 ORDER BY tenders DESC, c.company_id LIMIT 20""")
def companies_by_region(t: Tables, region: str = "EUROPE", as_of: str = AS_OF, limit: int = 20) -> DataFrame:
    n = t.win_keys.groupBy("company_id").agg(F.count("*").alias("tenders"))
    rows = valid_at(t.company.where(F.col("regione") == region), as_of).join(n, "company_id", "left")
    return top(rows.select("company_id", F.col("nome").alias("company"), F.coalesce("tenders", F.lit(0)).alias("tenders")), limit, F.desc("tenders"), "company_id")


@query("company_by_cf", f"""SELECT nome, cf, risk_score, array_to_string(list_sort(anomaly_flags), ',') AS flags, regione, count(w.tender_id) AS total_tenders, round(coalesce(sum(importo), 0), 2) AS total_value
  FROM company c LEFT JOIN wins w ON c.company_id = w.company_id WHERE cf = '{_CF}' AND {VALID} GROUP BY ALL""")
def company_by_cf(t: Tables, cf: str = _CF, as_of: str = AS_OF) -> DataFrame:
    c = valid_at(t.company.where(F.col("cf") == cf), as_of)
    w = t.wins.join(c.select("company_id"), "company_id", "left_semi").groupBy("company_id").agg(F.count("*").alias("n"), F.sum("importo").alias("v"))
    return c.join(w, "company_id", "left").select("nome", "cf", "risk_score", joined("anomaly_flags").alias("flags"), "regione", F.coalesce("n", F.lit(0)).alias("total_tenders"), F.round(F.coalesce("v", F.lit(0.0)), 2).alias("total_value"))


@query("companies_with_high_risk", f"SELECT nome, cf, risk_score, array_to_string(list_sort(anomaly_flags), ',') AS flags FROM company WHERE risk_score > 0.7 AND {VALID} ORDER BY risk_score DESC, cf LIMIT 20")
def companies_with_high_risk(t: Tables, min_risk: float = 0.7, as_of: str = AS_OF, limit: int = 20) -> DataFrame:
    rows = valid_at(t.company, as_of).where(F.col("risk_score") > min_risk)
    return top(rows.select("nome", "cf", "risk_score", joined("anomaly_flags").alias("flags")), limit, F.desc("risk_score"), "cf")


@query("top_vendors", f"""SELECT nome AS company, cf AS codice_fiscale, count(*) AS tender_count, round(sum(importo), 2) AS total_value FROM company c JOIN wins w ON c.company_id = w.company_id
  WHERE {VALID} GROUP BY ALL ORDER BY tender_count DESC, cf LIMIT 20""")
def top_vendors(t: Tables, as_of: str = AS_OF, limit: int = 20) -> DataFrame:
    sums = t.wins.groupBy("company_id").agg(F.count("*").alias("tender_count"), total("importo", "total_value"))
    rows = valid_at(t.company, as_of).join(sums, "company_id").select(F.col("nome").alias("company"), F.col("cf").alias("codice_fiscale"), "tender_count", "total_value")
    return top(rows, limit, F.desc("tender_count"), "codice_fiscale")


@query("top_centrality_companies", f"SELECT nome AS company, centrality_score AS influence_score, community_id AS community FROM company WHERE {VALID} ORDER BY 2 DESC, 1 LIMIT 20")
def top_centrality_companies(t: Tables, as_of: str = AS_OF, limit: int = 20) -> DataFrame:
    rows = valid_at(t.company.where("centrality_score IS NOT NULL"), as_of)
    return top(rows.select(F.col("nome").alias("company"), F.col("centrality_score").alias("influence_score"), F.col("community_id").alias("community")), limit, F.desc("influence_score"), "company")


@query("regional_spending", f"SELECT regione, count(*) AS total_tenders, round(sum(importo), 2) AS total_importo FROM company c JOIN wins w ON c.company_id = w.company_id WHERE {VALID} GROUP BY 1")
def regional_spending(t: Tables, as_of: str = AS_OF) -> DataFrame:
    sums = t.wins.groupBy("company_id").agg(F.count("*").alias("n"), F.sum("importo").alias("v"))
    return top(valid_at(t.company, as_of).join(sums, "company_id").groupBy("regione").agg(F.sum("n").alias("total_tenders"), total("v", "total_importo")), None, F.desc("total_importo"), "regione")


@query("municipality_ranking", f"""SELECT provincia AS municipality, regione, count(DISTINCT c.company_id) AS companies, count(*) AS tenders, round(sum(importo), 2) AS total_value
  FROM company c JOIN wins w ON c.company_id = w.company_id WHERE {VALID} GROUP BY 1, 2 ORDER BY total_value DESC, 1 LIMIT 20""")
def municipality_ranking(t: Tables, as_of: str = AS_OF, limit: int = 20) -> DataFrame:
    sums = t.wins.groupBy("company_id").agg(F.count("*").alias("n"), F.sum("importo").alias("v"))
    rows = valid_at(t.company, as_of).join(sums, "company_id").groupBy(F.col("provincia").alias("municipality"), "regione")
    return top(rows.agg(F.count("*").alias("companies"), F.sum("n").alias("tenders"), total("v", "total_value")), limit, F.desc("total_value"), "municipality")


_EU = ", ".join(f"'{x}'" for x in EU_FUNDS)


@query("pnrr_projects", f"SELECT cup, titolo, importo_finanziato, regione FROM project WHERE fondo IN ({_EU}) ORDER BY importo_finanziato DESC, cup LIMIT 20")
def pnrr_projects(t: Tables, limit: int = 20) -> DataFrame:
    return top(t.project.where(F.col("fondo").isin(*EU_FUNDS)).select("cup", "titolo", "importo_finanziato", "regione"), limit, F.desc("importo_finanziato"), "cup")


@query("pnrr_by_region", f"SELECT regione, count(*) AS project_count, round(sum(importo_finanziato), 2) AS total_funding FROM project WHERE fondo IN ({_EU}) GROUP BY 1")
def pnrr_by_region(t: Tables) -> DataFrame:
    return t.project.where(F.col("fondo").isin(*EU_FUNDS)).groupBy("regione").agg(F.count("*").alias("project_count"), total("importo_finanziato", "total_funding"))


@query("project_funding_analysis", "SELECT fondo AS funding_source, count(*) AS project_count, round(sum(importo_finanziato), 2) AS total_funding FROM project GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20")
def project_funding_analysis(t: Tables, limit: int = 20) -> DataFrame:
    rows = t.project.groupBy(F.col("fondo").alias("funding_source")).agg(F.count("*").alias("project_count"), total("importo_finanziato", "total_funding"))
    return top(rows, limit, F.desc("total_funding"), "funding_source")


@query("tender_to_project", f"""SELECT cig, cup, titolo, importo FROM company c JOIN wins w ON c.company_id = w.company_id JOIN project p ON w.project_id = p.project_id
  WHERE cf = '{_CF}' AND {VALID} ORDER BY importo DESC, cig LIMIT 20""")
def tender_to_project(t: Tables, cf: str = _CF, as_of: str = AS_OF, limit: int = 20) -> DataFrame:
    c = valid_at(t.company.where(F.col("cf") == cf), as_of).select("company_id")
    rows = t.wins.join(c, "company_id", "left_semi").join(t.project, "project_id")
    return top(rows.select("cig", "cup", "titolo", "importo"), limit, F.desc("importo"), "cig")


@query("single_bidder_tenders", "SELECT cig, importo, data_aggiudicazione FROM tender WHERE single_bidder ORDER BY importo DESC, cig LIMIT 20")
def single_bidder_tenders(t: Tables, limit: int = 20) -> DataFrame:
    return top(t.tender.where("single_bidder").select("cig", "importo", "data_aggiudicazione"), limit, F.desc("importo"), "cig")


@query("tenders_by_procedure", "SELECT procedura AS procedure_type, count(*) AS n, round(sum(importo), 2) AS total_value, round(avg(importo), 6) AS avg_value FROM tender GROUP BY 1")
def tenders_by_procedure(t: Tables) -> DataFrame:
    return t.tender.groupBy(F.col("procedura").alias("procedure_type")).agg(F.count("*").alias("n"), total("importo", "total_value"), mean("importo", "avg_value", 6))


@query("ownership_chain", f"""WITH RECURSIVE e AS (SELECT s.* FROM shareholder_of s JOIN company a ON s.company_id = a.company_id JOIN company b ON s.owner_id = b.company_id WHERE a.{VALID.replace(' AND (valid_to', ' AND (a.valid_to').replace('OR valid_to', 'OR a.valid_to')} AND b.{VALID.replace(' AND (valid_to', ' AND (b.valid_to').replace('OR valid_to', 'OR b.valid_to')}),
  p AS (SELECT owner_id AS owner, company_id AS start, quota, 1 AS hops, [company_id, owner_id] AS chain FROM e WHERE company_id = 77
  UNION ALL SELECT s.owner_id, p.start, s.quota, hops + 1, list_append(chain, s.owner_id) FROM p JOIN e s ON s.company_id = p.owner WHERE hops < 10 AND NOT list_contains(chain, s.owner_id))
  SELECT owner, hops, quota, array_to_string(chain, '>') AS chain FROM p ORDER BY hops, quota DESC, p.chain LIMIT 500""")
def ownership_chain(t: Tables, company_id: int = 77, depth: int = 10, as_of: str = AS_OF, limit: int = 500) -> DataFrame:
    """Owners above a company over links between companies that are valid at a day: the nearest first, then the largest quota."""
    valid = valid_at(t.company, as_of).select("company_id")
    edges = t.shareholder_of.join(valid, "company_id", "left_semi").join(valid.select(F.col("company_id").alias("owner_id")), "owner_id", "left_semi")
    edges = edges.select(F.col("company_id").alias("src"), F.col("owner_id").alias("dst"), "quota")
    rows = paths(edges, t.spark.range(company_id, company_id + 1).select(F.col("id").alias("start")), depth, carry="quota")
    rows = top(rows, limit, "hops", F.desc("last"), "chain")
    return rows.select(F.col("node").alias("owner"), "hops", F.col("last").alias("quota"), F.array_join("chain", ">").alias("chain"))


@query("supply_chain")
def supply_chain(t: Tables, company_id: int = 3, depth: int = 4, up: bool = False, limit: int = 1000) -> DataFrame:
    """The first chains of subcontractors below a company (``up``: of those that it works for) by depth and chain, with the last link's first tender."""
    ends = ("dst", "src") if up else ("src", "dst")
    edges = t.subcontracts_to.groupBy(F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst")).agg(F.min("cig").alias("cig"))
    rows = paths(edges, t.spark.range(company_id, company_id + 1).select(F.col("id").alias("start")), depth, carry="cig", limit=limit)
    return rows.select(F.col("node").alias("sub"), F.col("hops").alias("depth"), F.array_join("chain", ">").alias("chain"), F.col("last").alias("cig"))


@query("board_overlaps", """SELECT a.company_id AS company_a, b.company_id AS company_b, count(*) AS shared_count, array_to_string(list_sort(list(a.person_id)), ',') AS shared_persons
  FROM represents a JOIN represents b ON a.person_id = b.person_id AND a.company_id < b.company_id GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY 3 DESC, 1, 2 LIMIT 50""")
def board_overlaps(t: Tables, min_shared: int = 2, limit: int = 50) -> DataFrame:
    """The pairs with the most persons on both boards; persons are listed for the pairs that are shown."""
    pairs = top(shared_boards(t, min_shared), limit, F.desc("shared_count"), "company_a", "company_b")
    seat = t.represents
    both = pairs.join(seat.withColumnRenamed("company_id", "company_a"), "company_a").join(seat.withColumnRenamed("company_id", "company_b"), ["company_b", "person_id"])
    return both.groupBy("company_a", "company_b", "shared_count").agg(joined(F.collect_list("person_id")).alias("shared_persons"))


def shared_boards(t: Tables, least: int = 1) -> DataFrame:
    """(company_a, company_b, shared_count): pairs of companies, a before b, that so many persons represent both."""
    a = t.represents
    b = a.select("person_id", F.col("company_id").alias("company_b"))
    pairs = a.withColumnRenamed("company_id", "company_a").join(b, "person_id").where("company_a < company_b")
    return pairs.groupBy("company_a", "company_b").agg(F.count("*").alias("shared_count")).where(F.col("shared_count") >= least)


_MONTHS = f"data_aggiudicazione >= DATE '{AS_OF}' - INTERVAL 36 MONTH"


def recent_wins(t: Tables, months: int | None, as_of: str) -> DataFrame:
    rows = t.wins.where("data_aggiudicazione IS NOT NULL")
    return rows if months is None else rows.where(F.col("data_aggiudicazione") >= F.add_months(F.to_date(F.lit(as_of)), -months))


@query("tender_volume_trend", f"""SELECT company_id, CAST(year(data_aggiudicazione) AS INTEGER) AS year, CAST(quarter(data_aggiudicazione) AS INTEGER) AS quarter, count(*) AS tender_count, round(sum(importo), 2) AS total_value, round(avg(importo), 6) AS avg_value
  FROM wins WHERE {_MONTHS} GROUP BY 1, 2, 3""")
def tender_volume_trend(t: Tables, months: int = 36, as_of: str = AS_OF) -> DataFrame:
    return recent_wins(t, months, as_of).groupBy("company_id", *quarter_of("data_aggiudicazione")).agg(F.count("*").alias("tender_count"), total("importo", "total_value"), mean("importo", "avg_value", 6))


@query("single_bidder_trend", f"""SELECT company_id, CAST(year(data_aggiudicazione) AS INTEGER) AS year, CAST(quarter(data_aggiudicazione) AS INTEGER) AS quarter, count(*) AS total_wins, CAST(sum(CASE WHEN single_bidder THEN 1 ELSE 0 END) AS BIGINT) AS single_wins,
  round(sum(CASE WHEN single_bidder THEN 1 ELSE 0 END) / count(*), 3) AS single_bidder_ratio FROM wins WHERE {_MONTHS} GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def single_bidder_trend(t: Tables, months: int = 36, as_of: str = AS_OF) -> DataFrame:
    n, s = F.count("*"), F.sum(F.col("single_bidder").cast("long"))
    rows = recent_wins(t, months, as_of).groupBy("company_id", *quarter_of("data_aggiudicazione"))
    return rows.agg(n.alias("total_wins"), s.alias("single_wins"), F.round(s / n, 3).alias("single_bidder_ratio")).where("total_wins >= 2")


@query("sector_spending_trend", f"""SELECT year, quarter, count(*) AS company_count, round(sum(v), 2) AS total_value, round(coalesce(stddev_samp(v), 0), 2) AS stddev_value FROM (
  SELECT CAST(year(data_aggiudicazione) AS INTEGER) AS year, CAST(quarter(data_aggiudicazione) AS INTEGER) AS quarter, w.company_id, sum(importo) AS v FROM wins w JOIN company c ON w.company_id = c.company_id
  WHERE starts_with(ateco, '41') AND {_MONTHS} GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def sector_spending_trend(t: Tables, prefix: str = "41", months: int = 36, as_of: str = AS_OF) -> DataFrame:
    c = t.company.where(F.col("ateco").startswith(prefix)).select("company_id")
    each = recent_wins(t, months, as_of).join(c, "company_id", "left_semi").groupBy("company_id", *quarter_of("data_aggiudicazione")).agg(F.sum("importo").alias("v"))
    return each.groupBy("year", "quarter").agg(F.count("*").alias("company_count"), total("v", "total_value"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 2).alias("stddev_value"))


@query("sudden_spikes", f"""SELECT company_id, CAST(year(data_aggiudicazione) AS INTEGER) AS year, CAST(quarter(data_aggiudicazione) AS INTEGER) AS quarter, count(*) AS tender_count, round(sum(importo), 2) AS total_value
  FROM wins WHERE {_MONTHS} GROUP BY 1, 2, 3 HAVING count(*) >= 6""".replace("36 MONTH", "84 MONTH"))
def sudden_spikes(t: Tables, months: int = 84, min_bucket: int = 6, as_of: str = AS_OF) -> DataFrame:
    rows = recent_wins(t, months, as_of).groupBy("company_id", *quarter_of("data_aggiudicazione"))
    return rows.agg(F.count("*").alias("tender_count"), total("importo", "total_value")).where(F.col("tender_count") >= min_bucket)


@query("companies_with_red_flags", "SELECT nome, cf, array_to_string(list_sort(anomaly_flags), ',') AS flags, risk_score FROM company WHERE len(anomaly_flags) > 0 ORDER BY len(anomaly_flags) DESC, risk_score DESC, cf LIMIT 20")
def companies_with_red_flags(t: Tables, limit: int = 20) -> DataFrame:
    rows = t.company.where(F.size("anomaly_flags") > 0)
    return top(rows, limit, F.desc(F.size("anomaly_flags")), F.desc("risk_score"), "cf").select("nome", "cf", joined("anomaly_flags").alias("flags"), "risk_score")


@query("short_award_tenders", """SELECT t.cig, t.importo, datediff('day', data_apertura, data_aggiudicazione) AS award_days, min(w.company_id) AS winner FROM tender t JOIN win_keys w ON t.tender_id = w.tender_id
  WHERE datediff('day', data_apertura, data_aggiudicazione) BETWEEN 0 AND 30 GROUP BY 1, 2, 3 ORDER BY 3, 1 LIMIT 50""")
def short_award_tenders(t: Tables, max_days: int = 30, limit: int = 50) -> DataFrame:
    days = F.datediff("data_aggiudicazione", "data_apertura").cast("long")
    rows = t.wins.withColumn("award_days", days).where(F.col("award_days").between(0, max_days))
    return top(rows.groupBy("cig", "importo", "award_days").agg(F.min("company_id").alias("winner")), limit, "award_days", "cig")


@query("price_anomalies", """WITH z AS (SELECT tender_id, cig, importo, (importo - avg(importo) OVER ()) / stddev_pop(importo) OVER () AS z_score FROM tender)
  SELECT cig, importo, round(z_score, 4) AS z_score, min(w.company_id) AS winner FROM z JOIN win_keys w ON z.tender_id = w.tender_id WHERE abs(z_score) > 1.7 GROUP BY ALL""")
def price_anomalies(t: Tables, threshold: float = 1.7) -> DataFrame:
    """The two moments are aggregated first and joined as one row, so no window gathers all tenders in a task."""
    one = t.tender.agg(F.avg("importo").alias("m"), F.stddev_pop("importo").alias("s"))
    z = (F.col("importo") - F.col("m")) / F.col("s")
    rows = t.tender.join(F.broadcast(one)).withColumn("z", z).where(F.abs("z") > threshold)  # one row of totals
    return rows.join(t.win_keys, "tender_id").groupBy("cig", "importo", F.round("z", 4).alias("z_score")).agg(F.min("company_id").alias("winner"))


@query("community_analysis", """SELECT community_id, count(*) AS members, round(avg(risk_score), 4) AS avg_risk, CAST(sum(n) AS BIGINT) AS total_tenders FROM company c
  LEFT JOIN (SELECT company_id, count(*) AS n FROM win_keys GROUP BY 1) w ON c.company_id = w.company_id GROUP BY 1""")
def community_analysis(t: Tables) -> DataFrame:
    n = t.win_keys.groupBy("company_id").agg(F.count("*").alias("n"))
    return t.company.join(n, "company_id", "left").groupBy("community_id").agg(F.count("*").alias("members"), mean("risk_score", "avg_risk", 4), F.sum("n").alias("total_tenders"))


def links(t: Tables) -> DataFrame:
    """(company_id, kind, other): all edges of companies, in either direction."""
    parts = [
        t.win_keys.select("company_id", F.lit("tender").alias("kind"), F.col("tender_id").alias("other")),
        t.represents.select("company_id", F.lit("person"), "person_id"),
        t.shareholder_of.select("company_id", F.lit("company"), "owner_id"), t.shareholder_of.select("owner_id", F.lit("company"), "company_id"),
        t.subcontracts_to.select("src", F.lit("company"), "dst"), t.subcontracts_to.select("dst", F.lit("company"), "src"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_LINKS = """(SELECT company_id, 'tender' AS kind, tender_id AS other FROM win_keys UNION SELECT company_id, 'person', person_id FROM represents UNION SELECT company_id, 'company', owner_id FROM shareholder_of
  UNION SELECT owner_id, 'company', company_id FROM shareholder_of UNION SELECT src, 'company', dst FROM subcontracts_to UNION SELECT dst, 'company', src FROM subcontracts_to)"""


@query("network_hubs", f"SELECT c.cf, count(*) AS connections, centrality_score FROM company c JOIN {_LINKS} l ON c.company_id = l.company_id GROUP BY 1, 3 ORDER BY 2 DESC, 1 LIMIT 20")
def network_hubs(t: Tables, limit: int = 20) -> DataFrame:
    n = links(t).distinct().groupBy("company_id").agg(F.count("*").alias("connections"))
    return top(t.company.join(n, "company_id").select("cf", "connections", "centrality_score"), limit, F.desc("connections"), "cf")


@query("keyword_search", """SELECT doc_id, CAST(sum(n) AS BIGINT) AS hits FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM documents) GROUP BY 1, 2)
  WHERE word IN ('license', 'token', 'mail1') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def keyword_search(t: Tables, words: tuple[str, ...] = ("license", "token", "mail1"), limit: int = 50) -> DataFrame:
    """Documents by occurrences of any of some words."""
    w = t.raw("documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word")).where(F.col("word").isin(*words))
    return top(w.groupBy("doc_id").agg(F.count("*").alias("hits")), limit, F.desc("hits"), "doc_id")


# -- notebook queries about one entity


@query("entity_details", "SELECT nome, cf, regione, provincia, ateco, risk_score, array_to_string(list_sort(anomaly_flags), ',') AS flags FROM company WHERE company_id = 7")
def entity_details(t: Tables, company_id: int = 7) -> DataFrame:
    return t.company.where(F.col("company_id") == company_id).select("nome", "cf", "regione", "provincia", "ateco", "risk_score", joined("anomaly_flags").alias("flags"))


@query("entity_wins", "SELECT cig, importo, data_aggiudicazione, single_bidder FROM wins WHERE company_id = 7 ORDER BY data_aggiudicazione DESC, cig LIMIT 20")
def entity_wins(t: Tables, company_id: int = 7, limit: int = 20) -> DataFrame:
    rows = t.wins.where(F.col("company_id") == company_id).select("cig", "importo", "data_aggiudicazione", "single_bidder")
    return top(rows, limit, F.desc("data_aggiudicazione"), "cig")


@query("entity_win_summary", """SELECT nome, count(w.tender_id) AS total_wins, round(coalesce(sum(importo), 0), 2) AS total_value, round(coalesce(avg(importo), 0), 6) AS avg_value,
  CAST(coalesce(sum(CASE WHEN single_bidder THEN 1 ELSE 0 END), 0) AS BIGINT) AS single_bidder_count FROM company c LEFT JOIN wins w ON c.company_id = w.company_id WHERE c.company_id = 7 GROUP BY 1""")
def entity_win_summary(t: Tables, company_id: int = 7) -> DataFrame:
    rows = t.company.where(F.col("company_id") == company_id).join(t.wins.where(F.col("company_id") == company_id), "company_id", "left")
    avg = F.round(F.coalesce(F.avg("importo"), F.lit(0.0)), 6).alias("avg_value")
    return rows.groupBy("nome").agg(F.count("tender_id").alias("total_wins"), total("importo", "total_value"), avg, F.coalesce(F.sum(F.col("single_bidder").cast("long")), F.lit(0)).alias("single_bidder_count"))


@query("entity_related", f"SELECT kind, count(*) AS entity_count FROM {_LINKS} l WHERE company_id = 7 GROUP BY 1")
def entity_related(t: Tables, company_id: int = 7) -> DataFrame:
    return links(t).where(F.col("company_id") == company_id).distinct().groupBy("kind").agg(F.count("*").alias("entity_count"))


@query("entity_risk", """SELECT nome, risk_score, CASE WHEN risk_score >= 0.7 THEN 'HIGH' WHEN risk_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier, centrality_score FROM company WHERE company_id = 7""")
def entity_risk(t: Tables, company_id: int = 7) -> DataFrame:
    from veritrace.operators.scoring import tier

    return t.company.where(F.col("company_id") == company_id).select("nome", "risk_score", tier("risk_score").alias("risk_tier"), "centrality_score")


@query("entity_risk_history", "SELECT snapshot_id, round(risk_score, 4) AS risk_score, change_date FROM risk_snapshot WHERE company_id = 7 ORDER BY change_date DESC, snapshot_id LIMIT 20")
def entity_risk_history(t: Tables, company_id: int = 7, limit: int = 20) -> DataFrame:
    rows = t.risk_snapshot.where(F.col("company_id") == company_id).select("snapshot_id", F.round("risk_score", 4).alias("risk_score"), "change_date")
    return top(rows, limit, F.desc("change_date"), "snapshot_id")


@query("entity_flags", "SELECT flag, count(*) AS occurrence_count FROM (SELECT unnest(anomaly_flags) AS flag FROM company WHERE company_id = 8) GROUP BY 1")
def entity_flags(t: Tables, company_id: int = 8) -> DataFrame:
    return t.company.where(F.col("company_id") == company_id).select(F.explode("anomaly_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("occurrence_count"))


@query("entity_buyers", "SELECT buyer_name, count(*) AS tenders_issued, round(sum(importo), 2) AS total_value FROM wins w JOIN buyer b ON w.buyer_id = b.buyer_id WHERE company_id = 7 GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20")
def entity_buyers(t: Tables, company_id: int = 7, limit: int = 20) -> DataFrame:
    sums = t.wins.where(F.col("company_id") == company_id).groupBy("buyer_id").agg(F.count("*").alias("tenders_issued"), total("importo", "total_value"))
    return top(sums.join(t.buyer, "buyer_id").select("buyer_name", "tenders_issued", "total_value"), limit, F.desc("total_value"), "buyer_name")


@query("entity_subcontractors", "SELECT dst AS subcontractor, count(*) AS subcontract_count FROM subcontracts_to WHERE src = 3 GROUP BY 1")
def entity_subcontractors(t: Tables, company_id: int = 3) -> DataFrame:
    return t.subcontracts_to.where(F.col("src") == company_id).groupBy(F.col("dst").alias("subcontractor")).agg(F.count("*").alias("subcontract_count"))


@query("entity_subcontractor_concentration", """SELECT count(*) AS total_subcontractors, max(n) AS max_sub_count, CASE WHEN count(*) > 0 THEN round(max(n) / count(*), 4) ELSE 0 END AS concentration_ratio
  FROM (SELECT dst, count(*) AS n FROM subcontracts_to WHERE src = 3 GROUP BY 1)""")
def entity_subcontractor_concentration(t: Tables, company_id: int = 3) -> DataFrame:
    n, most = F.count("*"), F.max("subcontract_count")
    ratio = F.when(n > 0, F.round(most / n, 4)).otherwise(F.lit(0.0))
    return entity_subcontractors(t, company_id).agg(n.alias("total_subcontractors"), most.alias("max_sub_count"), ratio.alias("concentration_ratio"))
