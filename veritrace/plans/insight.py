"""Recommendations, explanations and parts of the graph as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.operators import loaders, recommend, subgraph
from veritrace.plans.base import joined, query, spread
from veritrace.sources.tables import Tables

_X = "a AS (SELECT * FROM company WHERE company_id = 7), o AS (SELECT c.*, a.ateco AS xa, a.regione AS xr, a.risk_score AS xs, a.anomaly_flags AS xf, a.community_id AS xc FROM company c, a WHERE c.company_id <> a.company_id)"
_JACCARD = "CASE WHEN len(list_distinct(list_concat(anomaly_flags, xf))) = 0 THEN 0 ELSE len(list_intersect(anomaly_flags, xf)) / len(list_distinct(list_concat(anomaly_flags, xf))) END"
_CONTENT = f"content AS (SELECT company_id, risk_score, least(1, 0.30 * (left(ateco, 2) = left(xa, 2))::INT + 0.25 * (regione = xr)::INT + 0.20 * (abs(risk_score - xs) < 0.15)::INT + 0.25 * ({_JACCARD}))::DOUBLE AS similarity FROM o ORDER BY 3 DESC, 1 LIMIT 50)"
_COMMUNITY = "community AS (SELECT company_id, risk_score, 0.85::DOUBLE AS similarity FROM o WHERE community_id = xc ORDER BY risk_score DESC, company_id LIMIT 30)"
_ANOMALY = f"anomaly AS (SELECT company_id, risk_score, ({_JACCARD})::DOUBLE AS similarity FROM o WHERE list_has_any(anomaly_flags, xf) ORDER BY 3 DESC, 1 LIMIT 30)"
_SECTOR = "sector AS (SELECT company_id, risk_score, round(risk_score, 4) AS similarity FROM o WHERE left(ateco, 2) = left(xa, 2) AND risk_score > 0 ORDER BY risk_score DESC, company_id LIMIT 20)"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("company_id", F.round("similarity", 4).alias("similarity"))


@query("recommend_content", f"WITH {_X}, {_CONTENT} SELECT company_id, round(similarity, 4) AS similarity FROM content WHERE similarity > 0")
def recommend_content(t: Tables, company_id: int = 7) -> DataFrame:
    return _shown(recommend.content(t.company, company_id))


@query("recommend_community", f"WITH {_X}, {_COMMUNITY} SELECT company_id, similarity FROM community")
def recommend_community(t: Tables, company_id: int = 7) -> DataFrame:
    return _shown(recommend.community(t.company, company_id))


@query("recommend_anomaly", f"WITH {_X.replace('= 7', '= 8')}, {_ANOMALY} SELECT company_id, round(similarity, 4) AS similarity FROM anomaly", company_id=8)
def recommend_anomaly(t: Tables, company_id: int = 7) -> DataFrame:
    return _shown(recommend.anomaly(t.company, company_id))


@query("recommend_sector", f"WITH {_X}, {_SECTOR} SELECT company_id, similarity FROM sector")
def recommend_sector(t: Tables, company_id: int = 7) -> DataFrame:
    return _shown(recommend.sector_risk(t.company, company_id))


@query("recommend_all", f"""WITH {_X.replace('= 7', '= 8')}, {_CONTENT}, {_COMMUNITY}, {_ANOMALY}, {_SECTOR}, u AS (SELECT 'content' AS s, * FROM content WHERE similarity > 0 UNION ALL SELECT 'community', * FROM community UNION ALL SELECT 'anomaly', * FROM anomaly UNION ALL SELECT 'sector', * FROM sector)
  SELECT company_id, round(max(similarity), 4) AS similarity, array_to_string(list_sort(list(DISTINCT s)), ',') AS strategies FROM u GROUP BY 1 ORDER BY max(similarity) DESC, max(risk_score) DESC, 1 LIMIT 20""", company_id=8)
def recommend_all(t: Tables, company_id: int = 7) -> DataFrame:
    return recommend.recommend(t.company, company_id).select("company_id", F.round("similarity", 4).alias("similarity"), joined("strategies").alias("strategies"))


_FACTORS = """p AS (SELECT company_id, buyer_id, count(*) AS n, count(*) FILTER (single_bidder) AS s FROM wins GROUP BY 1, 2), g AS (SELECT company_id, sum(n) AS wins, sum(s) AS single, max(n) AS top FROM p GROUP BY 1),
  f AS (SELECT company_id, 'single_bidder_ratio' AS factor, single / wins AS value, 0.4 AS w, 1 AS o FROM g UNION ALL SELECT company_id, 'market_dominance', coalesce(centrality_score, 0), 0.3, 2 FROM company UNION ALL SELECT company_id, 'buyer_concentration', top / wins, 0.3, 3 FROM g),
  r AS (SELECT company_id, factor, round(value, 4) AS value, round(value * w, 4)::DOUBLE AS contribution, row_number() OVER (PARTITION BY company_id ORDER BY round(value * w, 4) DESC, o)::INT AS rank FROM f)"""


@query("explain_factors", f"WITH {_FACTORS} SELECT * FROM r")
def explain_factors(t: Tables) -> DataFrame:
    return recommend.factors(t.company, spread(t, t.wins.select("company_id", "buyer_id", "single_bidder"), "company_id", "buyer_id"))


@query("explain_trend", "WITH s AS (SELECT company_id, arg_max(risk_score, {'a': change_date, 'b': snapshot_id}) AS b, count(*) AS n FROM risk_snapshot GROUP BY 1) SELECT c.company_id, CASE WHEN coalesce(n, 0) < 2 THEN 'STABLE' WHEN round(c.risk_score - b, 4) >= 0.05 THEN 'WORSENING' WHEN round(c.risk_score - b, 4) <= -0.05 THEN 'IMPROVING' ELSE 'STABLE' END AS trend FROM company c LEFT JOIN s ON c.company_id = s.company_id")
def explain_trend(t: Tables) -> DataFrame:
    return recommend.trend(t.risk_snapshot, t.company)


@query("explain_summary", f"""WITH {_FACTORS}, w AS (SELECT company_id, rank, CASE factor WHEN 'single_bidder_ratio' THEN printf('%d%% single-bidder wins', round(value * 100)::INT) WHEN 'market_dominance' THEN printf('centrality %.2f', value) ELSE printf('%d%% buyer concentration', round(value * 100)::INT) END AS t FROM r),
  j AS (SELECT company_id, string_agg('(' || rank || ') ' || t, ', ' ORDER BY rank) AS t FROM w GROUP BY 1) SELECT c.company_id, printf('This company scored %.2f because: ', risk_score) || t || '.' AS summary FROM company c JOIN j ON c.company_id = j.company_id""")
def explain_summary(t: Tables) -> DataFrame:
    return recommend.summary(t.company, explain_factors(t))


# -- parts of the graph


def graph_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    """nodes (id, kind, risk, created) and edges (src, dst, kind) of companies, tenders, buyers and directors."""

    def node(kind: str, c: str):
        return F.concat(F.lit(kind), F.col(c).cast("string"))

    none = F.lit(None).cast("double")
    nodes = (
        t.company.select(node("c", "company_id").alias("id"), F.lit("Company").alias("kind"), F.col("risk_score").alias("risk"), F.col("valid_from").alias("created"))
        .union(t.tender.select(node("t", "tender_id"), F.lit("Tender"), none, "data_apertura"))
        .union(t.buyer.select(node("b", "buyer_id"), F.lit("Buyer"), none, F.lit(None).cast("date")))
        .union(t.represents.select("person_id").distinct().select(node("p", "person_id"), F.lit("Person"), none, F.lit(None).cast("date")))
    )
    edges = (
        t.win_keys.select(node("c", "company_id").alias("src"), node("t", "tender_id").alias("dst"), F.lit("WINS").alias("kind"))
        .union(t.tender.select(node("b", "buyer_id"), node("t", "tender_id"), F.lit("ISSUES")))
        .union(t.represents.select(node("p", "person_id"), node("c", "company_id"), F.lit("REPRESENTS")))
    )
    return nodes, edges


_NODES = "nodes AS (SELECT 'c' || company_id AS id, 'Company' AS kind, risk_score AS risk, valid_from AS created FROM company UNION ALL SELECT 't' || tender_id, 'Tender', NULL, data_apertura FROM tender UNION ALL SELECT 'b' || buyer_id, 'Buyer', NULL, NULL FROM buyer UNION ALL SELECT DISTINCT 'p' || person_id, 'Person', NULL, NULL FROM represents)"
_EDGES = "edges AS (SELECT 'c' || company_id AS src, 't' || tender_id AS dst, 'WINS' AS kind FROM win_keys UNION ALL SELECT 'b' || buyer_id, 't' || tender_id, 'ISSUES' FROM tender UNION ALL SELECT 'p' || person_id, 'c' || company_id, 'REPRESENTS' FROM represents)"


@query("company_network", f"""WITH RECURSIVE {_NODES}, {_EDGES}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT 'c3' AS id, 0 AS hops UNION SELECT b.dst, hops + 1 FROM r JOIN b ON r.id = b.src WHERE hops < 2), m AS (SELECT id, min(hops) AS hops FROM r GROUP BY 1),
  s AS (SELECT nodes.id, kind, hops FROM nodes JOIN m ON nodes.id = m.id ORDER BY hops, nodes.id LIMIT 500) SELECT s.id, s.kind, hops, (SELECT count(*) FROM edges e WHERE (e.src = s.id OR e.dst = s.id) AND e.src IN (SELECT id FROM s) AND e.dst IN (SELECT id FROM s)) AS links FROM s""")
def company_network(t: Tables, company_id: int = 3) -> DataFrame:
    """The network view around a company, with how many links of the view each node has."""
    nodes, edges = graph_tables(t)
    shown, links = subgraph.template(nodes, edges, "Company Network", f"c{company_id}")
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    return shown.join(ends, "id", "left").select("id", "kind", "hops", F.coalesce("links", F.lit(0)).alias("links"))


@query("risk_hotspot", f"""WITH {_NODES}, {_EDGES}, s AS (SELECT id, risk FROM nodes WHERE kind IN ('Company', 'Person', 'Buyer') AND risk >= 0.7 ORDER BY risk DESC, id LIMIT 500) SELECT id, risk FROM s""")
def risk_hotspot(t: Tables) -> DataFrame:
    nodes, edges = graph_tables(t)
    return subgraph.template(nodes, edges, "Risk Hotspot")[0].select("id", "risk")


@query("entity_search", "SELECT company_id FROM company WHERE lower(nome) = lower('Supplier#000000042')")
def entity_search(t: Tables, text: str = "Supplier#000000042", least: float = 0.999) -> DataFrame:
    """Companies whose name or tax code is like a text, by the best of five ratios; all rows are compared."""
    from veritrace.operators import resolve

    return resolve.search(t.company, text, ("nome",), "company_id", least).select("company_id")


@query("companies_with_eu_projects", "SELECT w.company_id, count(DISTINCT w.project_id) AS projects, round(sum(importo), 2) AS total_value FROM wins w JOIN project p ON w.project_id = p.project_id WHERE fondo = 'STANDARD' GROUP BY 1")
def companies_with_eu_projects(t: Tables) -> DataFrame:
    from veritrace.sources.tables import EU_FUNDS

    p = t.project.where(F.col("fondo").isin(*EU_FUNDS)).select("project_id")
    return t.wins.join(p, "project_id", "left_semi").groupBy("company_id").agg(F.count_distinct("project_id").alias("projects"), F.round(F.sum("importo"), 2).alias("total_value"))


@query("amount_history", """WITH v AS (SELECT o_orderkey AS tender_id, 1 AS version, o_totalprice AS importo, DATE '2000-01-01' AS valid_from, CASE WHEN o_orderkey % 3 = 0 AND o_totalprice <> 0 THEN DATE '2000-02-01' END AS valid_to FROM orders
  UNION ALL SELECT o_orderkey, 2, o_totalprice * 2, DATE '2000-02-01', CASE WHEN o_orderkey % 6 = 0 THEN DATE '2000-03-01' END FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 3, o_totalprice * 4, DATE '2000-03-01', NULL FROM orders WHERE o_orderkey % 6 = 0)
  SELECT tender_id, version, round(importo, 2) AS importo, valid_from, valid_to FROM v""")
def amount_history(t: Tables, tender_id: int | None = None) -> DataFrame:
    """Every amount that a tender (all, if none is named) has had with its days, from three loads of which the later two change some; what a load replaces is archived."""
    o = t.raw("orders").select(F.col("o_orderkey").alias("tender_id"), F.col("o_totalprice").alias("importo"))
    o = o if tender_id is None else o.where(F.col("tender_id") == tender_id)
    none = o.limit(0).select("tender_id", "importo", *[F.lit(None).cast("date").alias(c) for c in ("valid_from", "valid_to")])
    current, archive = loaders.load_archived(none, None, o, "tender_id", "2000-01-01")
    for k, factor, day in ((3, 2, "2000-02-01"), (6, 4, "2000-03-01")):
        current, archive = loaders.load_archived(current, archive, o.where(F.col("tender_id") % k == 0).withColumn("importo", F.col("importo") * factor), "tender_id", day)
    return loaders.versions(current, archive, "tender_id").select("tender_id", "version", F.round("importo", 2).alias("importo"), "valid_from", "valid_to")


@query("high_risk_list", "SELECT company_id, risk_score FROM company WHERE risk_score > 0.1 ORDER BY 2 DESC, 1 LIMIT 50")
def high_risk_list(t: Tables, least: float = 0.1, limit: int = 50) -> DataFrame:
    return t.company.where(F.col("risk_score") > least).select("company_id", "risk_score").orderBy(F.desc("risk_score"), "company_id").limit(limit)


@query("company_dossier", """WITH p AS (SELECT company_id, buyer_id, count(*) AS n, sum(importo) AS v FROM wins WHERE company_id = 7 GROUP BY 1, 2), o AS (SELECT count(*) AS n FROM shareholder_of WHERE company_id = 7), s AS (SELECT count(*) AS n FROM shareholder_of WHERE owner_id = 7), d AS (SELECT count(*) AS n FROM represents WHERE company_id = 7)
  SELECT 'wins' AS section, CAST(sum(n) AS BIGINT) AS n, round(sum(v), 2) AS value FROM p UNION ALL SELECT 'buyers', count(*), NULL FROM p UNION ALL SELECT 'owners', n, NULL FROM o UNION ALL SELECT 'subsidiaries', n, NULL FROM s UNION ALL SELECT 'directors', n, NULL FROM d""")
def company_dossier(t: Tables, company_id: int = 7) -> DataFrame:
    """The sections of a report on who is behind a company, with their sizes."""
    mine = F.col("company_id") == company_id
    w = t.wins.where(mine)
    none = F.lit(None).cast("double").alias("value")

    def section(name: str, df: DataFrame, n, value=none) -> DataFrame:
        return df.agg(n.alias("n"), value).select(F.lit(name).alias("section"), "n", "value")

    return (
        section("wins", w, F.count("*"), F.round(F.sum("importo"), 2).alias("value")).union(section("buyers", w, F.count_distinct("buyer_id"))).union(section("owners", t.shareholder_of.where(mine), F.count("*")))
        .union(section("subsidiaries", t.shareholder_of.where(F.col("owner_id") == company_id), F.count("*"))).union(section("directors", t.represents.where(mine), F.count("*")))
    )
