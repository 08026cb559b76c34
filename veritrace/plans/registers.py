"""What registers bring and what is made of them: loads by their keys, families of companies, places, merges and their log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.operators import graph, merges, ownership, places
from veritrace.operators.components import new_path, stored
from veritrace.plans.base import query
from veritrace.sources.tables import Tables


def seats(t: Tables) -> DataFrame:
    """(person_cf, company_cf, ruolo, data_inizio, data_fine, new): a customer's seats by the priority of its orders; new ones come from a second register."""
    line = t.raw("lineitem").select("l_orderkey", F.format_string("CF%09d", "l_suppkey").alias("company_cf"), (F.col("l_linenumber") > 2).alias("new"))
    orders = t.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.format_string("CF%09d", "o_custkey").alias("person_cf"), F.col("o_orderpriority").alias("ruolo"), F.to_date("o_orderdate").cast("string").alias("data_inizio"))
    return line.join(orders, "l_orderkey").select("person_cf", "company_cf", "ruolo", "data_inizio", F.lit(None).cast("string").alias("data_fine"), "new")


_CF = "'CF' || lpad(CAST({} AS VARCHAR), 9, '0')"
_SEATS = f"s AS (SELECT {_CF.format('o_custkey')} AS person_cf, {_CF.format('l_suppkey')} AS company_cf, o_orderpriority AS ruolo, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS data_inizio, l_linenumber > 2 AS new FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_KNOWN = "k AS (SELECT cf FROM company WHERE regione <> 'ASIA')"


@query("seat_loads", f"WITH {_SEATS}, {_KNOWN} SELECT person_cf, company_cf, ruolo, coalesce(min(data_inizio) FILTER (NOT new), min(data_inizio)) AS data_inizio FROM s JOIN k ON cf = company_cf GROUP BY 1, 2, 3")
def seat_loads(t: Tables) -> DataFrame:
    """Seats of two registers, loaded one after the other; a seat that is there keeps its dates, and companies that are not known get none."""
    rows = stored(seats(t))
    known = t.company.where("regione <> 'ASIA'").select("cf")
    now = rows.drop("new").limit(0)
    for new in (False, True):
        now, _ = ownership.load_represents(now, rows.where(F.col("new") == new).drop("new"), known)
        now = stored(now)
    return now.select("person_cf", "company_cf", "ruolo", "data_inizio")


@query("share_loads", f"""WITH s AS (SELECT {_CF.format('o_custkey')} AS source_cf, {_CF.format('l_suppkey')} AS company_cf, CAST(year(CAST(o_orderdate AS DATE)) AS VARCHAR) AS data_rilevazione, l_quantity::DOUBLE AS quota, l_linenumber > 2 AS new FROM lineitem JOIN orders ON l_orderkey = o_orderkey), {_KNOWN}
  SELECT source_cf, company_cf, data_rilevazione, coalesce(max(quota) FILTER (new), max(quota)) AS quota, CASE WHEN bool_or(NOT new) THEN 'first' ELSE 'second' END AS source FROM s JOIN k ON cf = company_cf GROUP BY 1, 2, 3""")
def share_loads(t: Tables) -> DataFrame:
    """Shares of two registers by holder, company and year; a share that comes again gets its new quota and keeps its first source."""
    line = t.raw("lineitem").select("l_orderkey", F.format_string("CF%09d", "l_suppkey").alias("company_cf"), F.col("l_quantity").cast("double").alias("quota"), F.when(F.col("l_linenumber") > 2, "second").otherwise("first").alias("source"))
    orders = t.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.format_string("CF%09d", "o_custkey").alias("source_cf"), F.year(F.to_date("o_orderdate")).cast("string").alias("data_rilevazione"))
    rows = stored(line.join(orders, "l_orderkey").select("source_cf", "company_cf", "data_rilevazione", "quota", "source"))
    known, now = t.company.where("regione <> 'ASIA'").select("cf"), rows.limit(0)
    for name in ("first", "second"):
        now, _ = ownership.load_shareholdings(now, rows.where(F.col("source") == name), known)
        now = stored(now)
    return now


def shares(t: Tables) -> DataFrame:
    """(owner, company): companies' shares, and what is left of each company with the first person of its board."""
    c, p = (lambda x: F.concat(F.lit("C"), F.col(x))), (lambda x: F.concat(F.lit("P"), F.col(x)))
    people = t.represents.groupBy("company_id").agg(F.min("person_id").alias("person_id"))
    return t.shareholder_of.select(c("owner_id").alias("owner"), c("company_id").alias("company")).union(people.select(p("person_id"), c("company_id")))


_SHARES = "s AS (SELECT 'C' || owner_id AS owner, 'C' || company_id AS company FROM shareholder_of UNION SELECT 'P' || min(person_id), 'C' || company_id FROM represents GROUP BY company_id), top AS (SELECT owner, company FROM s WHERE owner NOT IN (SELECT company FROM s))"


@query("ownership_families", f"""WITH RECURSIVE {_SHARES}, o AS (SELECT owner AS ubo, company, 1 AS steps FROM top UNION SELECT o.ubo, s.company, steps + 1 FROM o JOIN s ON s.owner = o.company WHERE steps < 10)
  SELECT ubo, CASE WHEN ubo LIKE 'P%' THEN 'Person' ELSE 'Company' END AS ubo_type, company, CAST(min(steps) AS INTEGER) AS steps FROM o GROUP BY 1, 2, 3""")
def ownership_families(t: Tables, depth: int = 10) -> DataFrame:
    """Every company with its last owners, people and companies that nobody owns."""
    kind = F.when(F.col("ubo").startswith("P"), "Person").otherwise("Company")
    return ownership.last_owners(shares(t), depth).select("ubo", kind.alias("ubo_type"), "company", "steps")


@query("company_siblings", f"""WITH RECURSIVE {_SHARES}, o AS (SELECT owner AS ubo, company, 1 AS steps FROM top UNION SELECT o.ubo, s.company, steps + 1 FROM o JOIN s ON s.owner = o.company WHERE steps < 10)
  SELECT DISTINCT a.ubo, CASE WHEN a.ubo LIKE 'P%' THEN 'Person' ELSE 'Company' END AS ubo_type, b.company AS sibling, nome, risk_score FROM o a JOIN o b ON a.ubo = b.ubo JOIN company ON 'C' || company_id = b.company WHERE a.company = 'C7' AND b.company <> 'C7'""")
def company_siblings(t: Tables, company_id: int = 7, depth: int = 10) -> DataFrame:
    """The other companies of one company's family, by last owner."""
    found = ownership.family(shares(t), f"C{company_id}", depth)
    named = t.company.select(F.concat(F.lit("C"), F.col("company_id")).alias("sibling"), "nome", "risk_score")
    return found.join(named, "sibling").select("ubo", F.when(F.col("ubo").startswith("P"), "Person").otherwise("Company").alias("ubo_type"), "sibling", "nome", "risk_score")


@query("place_codes", """SELECT company_id, n_nationkey AS code, coalesce(CASE WHEN n_regionkey > 0 THEN substr(n_name, length(n_name) - 1, 2) END, substr(n_name, 1, 2)) AS sigla FROM company JOIN nation ON n_name = provincia""")
def place_codes(t: Tables) -> DataFrame:
    """Codes of the places that companies write in their own way; provinces of one region are not in the table of places."""
    nation = t.raw("nation")
    known = nation.select(F.col("n_name").alias("nome"), F.col("n_nationkey").alias("cod_istat"), F.expr("right(n_name, 2)").alias("sigla"))
    rows = t.company.select("company_id", F.concat(F.lit(" "), F.initcap("provincia"), F.lit("  ")).alias("place"))
    rows = places.with_city_code(rows, "place", known, "code")
    return places.with_province_code(rows, "place", known.join(nation.where("n_regionkey > 0").select(F.col("n_name").alias("nome")), "nome", "left_semi")).select("company_id", "code", "sigla")


def _statistics_sql(rounds: int = 12) -> str:
    """Components by rounds of least labels written out; companies and people are fewer steps apart than there are rounds."""
    parts = ["e AS MATERIALIZED (SELECT 'P' || person_id AS src, 'C' || company_id AS dst, 'REPRESENTS' AS kind FROM represents UNION ALL SELECT 'C' || owner_id, 'C' || company_id, 'SHAREHOLDER_OF' FROM shareholder_of)",
        "n AS MATERIALIZED (SELECT 'C' || company_id AS node, 'Company' AS kind FROM company UNION ALL SELECT 'P' || buyer_id, 'Person' FROM buyer)",
        "b AS MATERIALIZED (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e)", "d AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)", "l0 AS MATERIALIZED (SELECT node, node AS l FROM n)"]
    parts += [f"l{i + 1} AS MATERIALIZED (SELECT a.node, least(a.l, coalesce(min(c.l), a.l)) AS l FROM l{i} a LEFT JOIN b ON b.x = a.node LEFT JOIN l{i} c ON c.node = b.y GROUP BY a.node, a.l)" for i in range(rounds)]
    parts.append("f AS (SELECT node FROM n ORDER BY node LIMIT 50), k AS (SELECT node, count(y) AS k FROM f LEFT JOIN b ON x = node GROUP BY 1), w AS (SELECT f.node, count(*) / 2 AS t FROM f JOIN b p ON p.x = f.node JOIN b q ON q.x = p.y JOIN b r ON r.x = f.node AND r.y = q.y GROUP BY 1)")
    one = {
        "node_count": "(SELECT count(*) FROM n)", "edge_count": "(SELECT count(*) FROM e)", "density": "round(least(1.0, 2.0 * (SELECT count(*) FROM e) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1.0))), 4)",
        "avg_degree": "(SELECT round(avg(d), 2) FROM d)", "max_degree": "(SELECT max(d) FROM d)", "connected_components": f"(SELECT count(DISTINCT l) FROM l{rounds})",
        "avg_clustering": "(SELECT round(avg(CASE WHEN k > 1 THEN coalesce(t, 0) / (k * (k - 1) / 2) ELSE 0 END), 4) FROM k LEFT JOIN w USING (node))",
    }
    rows = [f"SELECT '{name}' AS measure, 'all' AS \"of\", CAST({v} AS DOUBLE) AS value" for name, v in one.items()]
    rows += [f"SELECT '{name}', kind, CAST(count(*) AS DOUBLE) FROM {x} GROUP BY kind" for name, x in (("node_types", "n"), ("edge_types", "e"))]
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(rows)}"


@query("network_statistics", _statistics_sql())
def network_statistics(t: Tables) -> DataFrame:
    """Measures of the network of companies, people, seats and shares."""
    c, p = (lambda x: F.concat(F.lit("C"), F.col(x))), (lambda x: F.concat(F.lit("P"), F.col(x)))
    nodes = t.company.select(c("company_id").alias("node"), F.lit("Company").alias("kind")).union(t.buyer.select(p("buyer_id"), F.lit("Person")))
    edges = t.represents.select(p("person_id").alias("src"), c("company_id").alias("dst"), F.lit("REPRESENTS").alias("kind")).union(t.shareholder_of.select(c("owner_id"), c("company_id"), F.lit("SHAREHOLDER_OF")))
    return graph.typed_statistics(nodes, edges)


# -- merges: companies at one address of a province are one, but in a region whose merges are taken back


def _merged(t: Tables) -> tuple[DataFrame, DataFrame, str]:
    c = lambda x: F.concat(F.lit("C"), F.col(x))
    rows = stored(t.company.select(c("company_id").alias("id"), "cf", "nome", "address", "provincia", "regione"))
    edges = t.shareholder_of.select(c("owner_id").alias("src"), c("company_id").alias("dst"), F.lit("SHAREHOLDER_OF").alias("kind"))
    edges = stored(edges.union(t.win_keys.select(c("company_id"), F.concat(F.lit("T"), F.col("tender_id")), F.lit("WINS"))))
    first = rows.groupBy("address", "provincia").agg(F.min("id").alias("target"))
    ids = rows.join(first, ["address", "provincia"]).select(F.col("id").alias("source"), "target")
    path = new_path(t.spark, "merges")
    after, links, _ = merges.merge(rows, edges, ids, path, "address", "2024-01-01 00:00:00")
    only = rows.where("regione = 'EUROPE'").select(F.col("id").alias("target"))
    after, links, _ = merges.roll_back(stored(after), stored(links), path, "address", only, "2024-02-01 00:00:00")
    return after, links, path


_MERGED = """c AS (SELECT 'C' || company_id AS id, min('C' || company_id) OVER (PARTITION BY address, provincia) AS target, regione = 'EUROPE' AS back FROM company),
  e AS (SELECT 'C' || owner_id AS src, 'C' || company_id AS dst, 'SHAREHOLDER_OF' AS kind FROM shareholder_of UNION ALL SELECT 'C' || company_id, 'T' || tender_id, 'WINS' FROM win_keys)"""


@query("merge_log", f"""WITH {_MERGED}, n AS (SELECT target, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) JOIN c USING (id) WHERE id <> target GROUP BY 1)
  SELECT 'address/' || target AS merge_id, target, count(*) AS merged_count, CAST(coalesce(any_value(n), 0) AS BIGINT) AS relationships_updated, CASE WHEN back THEN 'ROLLED_BACK' ELSE 'COMPLETED' END AS status FROM c LEFT JOIN n USING (target) WHERE id <> target GROUP BY target, back""")
def merge_log(t: Tables) -> DataFrame:
    """What the log tells of the merges."""
    return merges.log(t.spark, _merged(t)[2], "string").select("merge_id", "target", "merged_count", "relationships_updated", "status")


@query("merged_links", f"""WITH {_MERGED}, m AS (SELECT id, CASE WHEN back THEN id ELSE target END AS t FROM c) SELECT src, kind, count(*) AS links FROM (SELECT DISTINCT a.t AS src, coalesce(b.t, dst) AS dst, kind FROM e JOIN m a ON a.id = src LEFT JOIN m b ON b.id = dst) WHERE src <> dst GROUP BY 1, 2""")
def merged_links(t: Tables) -> DataFrame:
    """Links of companies after the merges, by kind."""
    return _merged(t)[1].groupBy("src", "kind").agg(F.count("*").alias("links"))
