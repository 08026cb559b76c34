"""Graph algorithms as queries, and the detectors that need them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.operators import between, community, cuts, graph
from veritrace.operators.components import cut, stored
from veritrace.plans.base import query
from veritrace.sources.tables import Tables

_E = "e AS (SELECT DISTINCT src, dst FROM subcontracts_to WHERE src <> dst)"
_B = "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def supply(t: Tables) -> DataFrame:
    return t.subcontracts_to.select("src", "dst").distinct()


def won_together(t: Tables, least: int = 3) -> DataFrame:
    """(src, dst, n): companies that have won at least so many tenders together."""
    a = t.win_keys
    pairs = a.join(a.select("tender_id", F.col("company_id").alias("dst")), "tender_id").where("company_id < dst")
    return pairs.groupBy(F.col("company_id").alias("src"), "dst").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def shared_buyers(t: Tables, least: int = 3) -> DataFrame:
    """The one-mode projection: companies that have won at least so many tenders together; what buyers they share otherwise is not looked at."""
    return won_together(t, least).select("src", "dst")


_P = "e AS (SELECT a.company_id AS src, b.company_id AS dst FROM win_keys a JOIN win_keys b ON a.tender_id = b.tender_id AND a.company_id < b.company_id GROUP BY 1, 2 HAVING count(*) >= 3)"


@query("weak_components", f"""WITH RECURSIVE {_E}, {_B}, r AS (SELECT src AS node, src AS seen FROM b UNION SELECT r.node, b.dst FROM r JOIN b ON r.seen = b.src) SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def weak_components(t: Tables) -> DataFrame:
    return graph.connected_components(supply(t))


@query("supply_sccs", f"""WITH RECURSIVE {_E}, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
  SELECT n.node, least(n.node, coalesce(min(x.b), n.node)) AS component FROM n LEFT JOIN (SELECT r.a, r.b FROM r JOIN r q ON r.a = q.b AND r.b = q.a) x ON n.node = x.a GROUP BY 1""")
def supply_sccs(t: Tables) -> DataFrame:
    return graph.strong_components(supply(t))


@query("carousel_cycles")
def carousel_cycles(t: Tables, least: int = 3, most: int = 6, limit: int = 20) -> DataFrame:
    """The first subcontracting cycles of 3 to 6 companies by length and chain, each once from its smallest company."""
    rows = graph.cycles(supply(t), least, most, limit)
    return rows.select(F.col("length").cast("long").alias("length"), F.array_join("chain", ">").alias("chain"))


@query("triangle_count", f"""WITH {_P}, {_B}, x AS (SELECT p.src AS node, count(*) / 2 AS triangles FROM b p JOIN b q ON p.dst = q.src JOIN b r ON q.dst = r.src AND r.dst = p.src GROUP BY 1) SELECT DISTINCT b.src AS node, CAST(coalesce(triangles, 0) AS BIGINT) AS triangles FROM b LEFT JOIN x ON b.src = x.node""")
def triangle_count(t: Tables) -> DataFrame:
    return graph.triangles(shared_buyers(t))


@query("degree_centrality", f"WITH {_E}, {_B} SELECT src AS node, count(*) AS degree FROM b GROUP BY 1")
def degree_centrality(t: Tables) -> DataFrame:
    return graph.degrees(supply(t))


@query("neighbourhood", f"""WITH RECURSIVE {_E}, {_B}, r AS (SELECT 3 AS node, 0 AS hops UNION SELECT b.dst, hops + 1 FROM r JOIN b ON r.node = b.src WHERE hops < 3) SELECT CAST(node AS BIGINT) AS node, min(hops) AS hops FROM r GROUP BY 1""")
def neighbourhood(t: Tables, start: int = 3, depth: int = 3) -> DataFrame:
    return graph.bfs(supply(t), t.spark.range(start, start + 1).select(F.col("id").alias("start")), depth).select("node", "hops")


@query("hop_counts", f"""WITH RECURSIVE {_E}, {_B}, r AS (SELECT 3 AS node, 0 AS hops UNION SELECT b.dst, hops + 1 FROM r JOIN b ON r.node = b.src WHERE hops < 3), m AS (SELECT node, min(hops) AS hops FROM r GROUP BY 1) SELECT hops, count(*) AS entities_at_distance FROM m WHERE hops > 0 GROUP BY 1""")
def hop_counts(t: Tables) -> DataFrame:
    return neighbourhood(t).where("hops > 0").groupBy("hops").agg(F.count("*").alias("entities_at_distance"))


@query("shortest_path", f"""WITH RECURSIVE {_E}, {_B}, r AS (SELECT 3::BIGINT AS node, [3::BIGINT] AS chain UNION ALL SELECT b.dst, list_append(chain, b.dst) FROM r JOIN b ON r.node = b.src WHERE len(chain) < 4 AND NOT list_contains(chain, b.dst) AND r.node <> 80) SELECT len(chain) - 1 AS hops, array_to_string(chain, '>') AS chain FROM r WHERE node = 80 ORDER BY len(chain), r.chain LIMIT 1""")
def shortest_path(t: Tables, a: int = 3, b: int = 80, depth: int = 3) -> DataFrame:
    return graph.shortest_paths(supply(t), a, b, depth).select(F.col("hops").cast("long").alias("hops"), F.array_join("chain", ">").alias("chain"))


@query("graph_size", f"WITH {_E}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), d AS (SELECT n, count(*) AS k FROM (SELECT a AS n FROM u UNION ALL SELECT b FROM u) GROUP BY 1) SELECT count(*) AS n, (SELECT count(*) FROM u) AS m, round(least(1.0, 2.0 * (SELECT count(*) FROM u) / (count(*) * (count(*) - 1))), 6)::DOUBLE AS density, round(avg(k), 6) AS avg_degree, max(k) AS max_degree FROM d")
def graph_size(t: Tables) -> DataFrame:
    s = graph.graph_size(supply(t))
    return s.select("n", "m", F.round("density", 6).alias("density"), F.round("avg_degree", 6).alias("avg_degree"), "max_degree")


@query("graph_statistics")
def graph_statistics(t: Tables) -> DataFrame:
    s = graph.graph_statistics(supply(t))
    return s.select(*[F.round(c, 6).alias(c) if c in ("density", "avg_degree", "avg_clustering") else c for c in s.columns])


@query("confidence_propagation", """WITH n0 AS (SELECT company_id AS node, risk_score AS c FROM company), e AS (SELECT owner_id AS src, company_id AS dst, quota / 100 AS r FROM shareholder_of),
  n1 AS (SELECT n.node, least(n.c, coalesce(m, n.c)) AS c FROM n0 n LEFT JOIN (SELECT dst, min(c * r) AS m FROM e JOIN n0 ON src = node GROUP BY 1) x ON x.dst = n.node),
  n2 AS (SELECT n.node, least(n.c, coalesce(m, n.c)) AS c FROM n1 n LEFT JOIN (SELECT dst, min(c * r) AS m FROM e JOIN n1 ON src = node GROUP BY 1) x ON x.dst = n.node),
  n3 AS (SELECT n.node, least(n.c, coalesce(m, n.c)) AS c FROM n2 n LEFT JOIN (SELECT dst, min(c * r) AS m FROM e JOIN n2 ON src = node GROUP BY 1) x ON x.dst = n.node) SELECT node, round(c, 6) AS confidence FROM n3""")
def confidence_propagation(t: Tables) -> DataFrame:
    nodes = t.company.select(F.col("company_id").alias("node"), F.col("risk_score").alias("confidence"))
    edges = t.shareholder_of.select(F.col("owner_id").alias("src"), F.col("company_id").alias("dst"), (F.col("quota") / 100).alias("confidence"))
    return graph.propagate_confidence(nodes, edges).select("node", F.round("confidence", 6).alias("confidence"))


@query("corporate_family", """WITH RECURSIVE o AS (SELECT company_id, owner_id FROM shareholder_of UNION SELECT o.company_id, s.owner_id FROM o JOIN shareholder_of s ON s.company_id = o.owner_id),
  u AS (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM shareholder_of s WHERE s.company_id = o.owner_id)) SELECT owner_id AS ubo, count(DISTINCT company_id) AS members FROM u GROUP BY 1""")
def corporate_family(t: Tables, depth: int = 10) -> DataFrame:
    """Companies under each owner that nobody owns, over at most depth steps; a company counts once however many chains lead to it."""
    edges = t.shareholder_of.select(F.col("company_id").alias("src"), F.col("owner_id").alias("dst"))
    above = graph.reachable(edges, depth)
    ultimate = above.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti")
    return ultimate.groupBy(F.col("dst").alias("ubo")).agg(F.count("*").alias("members"))


@query("shares_ubo", """WITH RECURSIVE o AS (SELECT company_id, owner_id, 1 AS d FROM shareholder_of UNION SELECT o.company_id, s.owner_id, d + 1 FROM o JOIN shareholder_of s ON s.company_id = o.owner_id WHERE d < 2), p AS (SELECT DISTINCT company_id, owner_id FROM o)
  SELECT DISTINCT a.company_id AS c1, b.company_id AS c2 FROM p a JOIN p b ON a.owner_id = b.owner_id AND a.company_id < b.company_id""")
def shares_ubo(t: Tables, depth: int = 2) -> DataFrame:
    """Pairs of companies with an owner in common over one or two steps."""
    edges = t.shareholder_of.select(F.col("company_id").alias("src"), F.col("owner_id").alias("dst"))
    a = graph.reachable(edges, depth).select(F.col("dst").alias("owner_id"), F.col("src").alias("c1"))
    return a.join(a.withColumnRenamed("c1", "c2"), "owner_id").where("c1 < c2").select("c1", "c2").distinct()


def _rank_sql(edges: str, rounds: int = 20) -> str:
    """PageRank rounds written out one after the other."""
    parts = [f"e AS MATERIALIZED ({edges})", "n AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e)", "o AS MATERIALIZED (SELECT src, count(*) AS k FROM e GROUP BY 1)", "r0 AS MATERIALIZED (SELECT node, 0.15::DOUBLE AS r FROM n)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT n.node, 0.15 + 0.85 * coalesce(s, 0) AS r FROM n LEFT JOIN (SELECT e.dst, sum(r / k) AS s FROM e JOIN r{i} ON e.src = r{i}.node JOIN o ON o.src = e.src GROUP BY 1) x ON x.dst = n.node)")
    return f"WITH {', '.join(parts)} SELECT node, round(r, 6)::DOUBLE AS rank FROM r{rounds}"


def _node(kind: str, c: str):
    return F.concat(F.lit(kind), F.col(c).cast("string"))


_KINDS = "cbtp"


def _code(kind: str, c: str):
    """A node as a number: its key and kind in one."""
    return F.col(c).cast("long") * len(_KINDS) + _KINDS.index(kind)


def _decoded(c: str):
    """The name of a node that _code made a number of."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.pmod(c, F.lit(len(_KINDS)).cast("long")) + 1).cast("int"))
    return F.concat(kind, F.expr(f"({c} - pmod({c}, {len(_KINDS)})) div {len(_KINDS)}").cast("string"))


@query("pagerank_ownership", _rank_sql("SELECT DISTINCT 'c' || owner_id AS src, 'c' || company_id AS dst FROM shareholder_of UNION SELECT DISTINCT 'p' || person_id, 'c' || company_id FROM represents"))
def pagerank_ownership(t: Tables) -> DataFrame:
    """Influence over owners and directors: edges go from the owner or the person to the company."""
    edges = t.shareholder_of.select(_node("c", "owner_id").alias("src"), _node("c", "company_id").alias("dst")).union(t.represents.select(_node("p", "person_id"), _node("c", "company_id")))
    return graph.pagerank(edges, 20).select("node", F.round("rank", 6).alias("rank"))


_PROCUREMENT = "SELECT 'c' || company_id AS u, 't' || tender_id AS v FROM win_keys UNION SELECT 'b' || o_custkey, 't' || o_orderkey FROM orders"


def procurement(t: Tables) -> DataFrame:
    """The graph of companies, buyers and tenders: who won and who issued."""
    issued = t.raw("orders").select(_node("b", "o_custkey"), _node("t", "o_orderkey"))
    return t.win_keys.select(_node("c", "company_id").alias("src"), _node("t", "tender_id").alias("dst")).union(issued)


def coded_procurement(t: Tables) -> DataFrame:
    """``procurement`` with numbers for nodes."""
    issued = t.raw("orders").select(_code("b", "o_custkey"), _code("t", "o_orderkey"))
    return t.win_keys.select(_code("c", "company_id").alias("src"), _code("t", "tender_id").alias("dst")).union(issued)


@query("pagerank_procurement", _rank_sql(f"SELECT u AS src, v AS dst FROM ({_PROCUREMENT}) UNION SELECT v, u FROM ({_PROCUREMENT})"))
def pagerank_procurement(t: Tables) -> DataFrame:
    """Centrality over wins and issues, either way."""
    return graph.pagerank(coded_procurement(t), 20, directed=False).select(_decoded("node").alias("node"), F.round("rank", 6).alias("rank"))


_PROJECTS = "SELECT 'c' || company_id AS u, 't' || tender_id AS v FROM win_keys UNION SELECT 't' || tender_id, 'p' || project_id FROM tender"


@query("pagerank_projects", _rank_sql(f"SELECT u AS src, v AS dst FROM ({_PROJECTS}) UNION SELECT v, u FROM ({_PROJECTS})"))
def pagerank_projects(t: Tables) -> DataFrame:
    """Centrality over wins and the projects that tenders are part of, either way."""
    part = t.tender.select(_code("t", "tender_id"), _code("p", "project_id"))
    edges = t.win_keys.select(_code("c", "company_id").alias("src"), _code("t", "tender_id").alias("dst")).union(part)
    return graph.pagerank(edges, 20, directed=False).select(_decoded("node").alias("node"), F.round("rank", 6).alias("rank"))


def run_suite(t: Tables) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The algorithms whose results companies carry, stored, in the order that they build on each other; a failure stops no other."""
    steps = {
        "centrality_score": lambda: pagerank_procurement(t), "community_id": lambda: communities(t), "betweenness_score": lambda: betweenness(t), "triangle_count": lambda: triangle_count(t),
        "wcc_id": lambda: weak_components(t), "supply_scc_id": lambda: supply_sccs(t), "ownership_influence": lambda: pagerank_ownership(t),
    }
    found, errors = {}, {}
    for name, f in steps.items():
        try:
            found[name] = cut(f())
        except Exception as e:  # noqa: BLE001 - told to the caller
            errors[name] = f"{type(e).__name__}: {e}"
    return found, errors


@query("algorithm_suite")
def algorithm_suite(t: Tables) -> DataFrame:
    """How many nodes each algorithm of the suite has a result for."""
    found, errors = run_suite(t)
    if errors:
        raise RuntimeError(f"algorithms failed: {errors}")
    parts = [df.agg(F.count("*").alias("nodes")).select(F.lit(name).alias("property"), "nodes") for name, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out




@query("articulation_points")
def articulation_points(t: Tables) -> DataFrame:
    """The companies, buyers and tenders of the whole procurement graph without which it falls apart."""
    return cuts.cut_nodes(coded_procurement(t)).select(_decoded("node").alias("node"), "blocks")


#: Owners, and pairs with twelve subcontracts or more, either way: a graph with some cycles.
_TIES = """x AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v FROM subcontracts_to GROUP BY 1, 2 HAVING count(*) >= 12), e AS (SELECT u, v FROM x UNION SELECT least(owner_id, company_id), greatest(owner_id, company_id) FROM shareholder_of), b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e)"""


def ties(t: Tables, least: int = 12) -> DataFrame:
    pairs = t.subcontracts_to.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return t.shareholder_of.select(F.col("owner_id").alias("src"), F.col("company_id").alias("dst")).union(pairs.select("src", "dst"))


@query("company_bridges", f"""WITH RECURSIVE {_TIES}, r AS (SELECT u, v, u AS at FROM e UNION SELECT r.u, r.v, b.v FROM r JOIN b ON r.at = b.u AND (least(b.u, b.v) <> r.u OR greatest(b.u, b.v) <> r.v)) SELECT u, v FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.u = e.u AND r.v = e.v AND r.at = e.v)""")
def company_bridges(t: Tables) -> DataFrame:
    """Ties between companies that no other way replaces."""
    return cuts.bridges(ties(t))


@query("company_cut_points", f"""WITH RECURSIVE {_TIES}, f AS (SELECT u AS x, min(v) AS s FROM b GROUP BY 1), r AS (SELECT x, s AS at FROM f UNION SELECT r.x, b.v FROM r JOIN b ON r.at = b.u WHERE b.v <> r.x) SELECT DISTINCT u AS node FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.x = b.u AND r.at = b.v)""")
def company_cut_points(t: Tables) -> DataFrame:
    """Companies that alone hold others together: without one, some of its neighbours no longer reach each other."""
    return cuts.cut_nodes(ties(t)).select("node")


def _paths_sql(depth: int = 4) -> str:
    """Levels written out from one end: each new node of a pair with its least chain."""
    parts = [
        "e AS (SELECT 'c' || owner_id AS u, 'c' || company_id AS v FROM shareholder_of UNION SELECT 'p' || person_id, 'c' || company_id FROM represents), g AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v)",
        "q AS (SELECT 'c' || company_id AS a, 'c' || ((company_id * 7 + 3) % (SELECT count(*) FROM company)) AS b FROM company)", "f0 AS (SELECT a, b, a AS node, [a] AS chain FROM q WHERE a <> b)",
    ]
    for i in range(1, depth + 1):
        seen = " AND ".join(f"NOT EXISTS (SELECT 1 FROM f{k} s WHERE s.a = f.a AND s.b = f.b AND s.node = g.v)" for k in range(i))
        parts.append(f"f{i} AS MATERIALIZED (SELECT f.a, f.b, g.v AS node, min(list_append(f.chain, g.v)) AS chain FROM f{i - 1} f JOIN g ON f.node = g.u WHERE f.node <> f.b AND {seen} GROUP BY 1, 2, 3)")
    every = " UNION ALL ".join(f"SELECT a, b, {i} AS hops, array_to_string(chain, '>') AS chain FROM f{i} WHERE node = b" for i in range(1, depth + 1))
    return f"WITH {', '.join(parts)} {every}"


@query("company_paths", _paths_sql())
def company_paths(t: Tables, depth: int = 4) -> DataFrame:
    """How each company is linked with one other through owners and board members, in at most four steps."""
    edges = t.shareholder_of.select(_node("c", "owner_id").alias("src"), _node("c", "company_id").alias("dst")).union(t.represents.select(_node("p", "person_id"), _node("c", "company_id")))
    n, k = t.raw("supplier").count(), F.col("s_suppkey")
    pairs = t.raw("supplier").select(_node("c", "s_suppkey").alias("a"), F.concat(F.lit("c"), ((k * 7 + 3) % n).cast("string")).alias("b"))
    return between.paths_between(edges, pairs, depth).select("a", "b", "hops", F.array_join("chain", ">").alias("chain"))


@query("communities", tolerance=5e-3)
def communities(t: Tables, least: int = 3, tolerance: float = 1e-4) -> DataFrame:
    """Louvain communities of companies by how many tenders they won together. Over ``procurement(t)`` the operator takes buyers and tenders in."""
    return community.louvain(won_together(t, least), "n", tolerance)


def with_communities(t: Tables, labels: DataFrame | None = None) -> Tables:
    """The same tables with each company's community_id from ``communities``; a company that has won with nobody is one of its own."""
    labels = (communities(t) if labels is None else labels).toDF("company_id", "_community")
    found = Tables(t.spark, t.sf_dir)
    found.__dict__["company"] = t.company.join(stored(labels), "company_id", "left").withColumn("community_id", F.coalesce("_community", "company_id")).drop("_community")
    return found


@query("betweenness")
def betweenness(t: Tables) -> DataFrame:
    return graph.betweenness(t.subcontracts_to).select("node", F.round("betweenness", 6).alias("betweenness"))


@query("clustering", f"""WITH {_E}, {_B}, d AS (SELECT src AS node, count(*) AS degree FROM b GROUP BY 1), x AS (SELECT p.src AS node, CAST(count(*) / 2 AS BIGINT) AS triangles FROM b p JOIN b q ON p.dst = q.src JOIN b r ON q.dst = r.src AND r.dst = p.src GROUP BY 1)
  SELECT d.node, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN coalesce(triangles, 0) / (degree * (degree - 1) / 2) ELSE 0 END, 6)::DOUBLE AS clustering FROM d LEFT JOIN x ON d.node = x.node""")
def clustering(t: Tables) -> DataFrame:
    return graph.clustering(supply(t)).select("node", "degree", "triangles", F.round("clustering", 6).alias("clustering"))
