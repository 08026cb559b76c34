"""Entity resolution, similarity search, quality and history as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.functions import text
from veritrace.operators import linkage, nearest, resolve, runs, upsert
from veritrace.operators.components import new_path
from veritrace.plans.base import joined, query, top
from veritrace.sources.tables import Tables


@query("similar_supplier_names", """WITH s AS (SELECT s_suppkey AS id, s_name AS n, s_nationkey AS k FROM supplier) SELECT a.id AS a, b.id AS b, round(1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)), 6) AS similarity
  FROM s a JOIN s b ON a.k = b.k AND a.id < b.id WHERE 1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)) >= 0.94""")
def similar_supplier_names(t: Tables, threshold: float = 0.94) -> DataFrame:
    rows = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("nome"), "s_nationkey")
    return resolve.similar_names(rows, "s_nationkey", threshold).withColumn("similarity", F.round("similarity", 6))


@query("duplicate_candidates")
def duplicate_candidates(t: Tables, threshold: float = 0.9) -> DataFrame:
    rows = t.company.select(F.col("company_id").alias("id"), "nome", "cod_istat", "cf")
    return resolve.tiers(resolve.candidate_classes(rows, threshold)).withColumn("score", F.round("score", 6))


@query("shared_name_tokens", """WITH w AS (SELECT p_partkey AS id, unnest(list_distinct(list_filter(string_split_regex(upper(p_name), '\\s+'), lambda x: length(x) > 3))) AS w FROM part)
  SELECT w.w AS word, count(*) AS parts FROM w GROUP BY 1""")
def shared_name_tokens(t: Tables) -> DataFrame:
    return t.raw("part").select(F.explode(text.tokens(F.col("p_name"))).alias("word")).groupBy("word").agg(F.count("*").alias("parts"))


@query("part_jaccard", """WITH p AS (SELECT p_partkey AS id, list_sort(list_distinct(list_filter(string_split_regex(upper(p_name || ' ' || p_type || ' ' || p_brand), '\\s+'), lambda x: length(x) > 3))) AS w FROM part), c AS (SELECT w, min(id) AS id FROM p WHERE len(w) > 0 GROUP BY 1)
  SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS similarity FROM c a JOIN c b ON a.id < b.id WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.75
  UNION ALL SELECT c.id, p.id, 1.0 FROM p JOIN c ON p.w = c.w WHERE p.id <> c.id""")
def part_jaccard(t: Tables, threshold: float = 0.75) -> DataFrame:
    """Parts by words in common: (a, b, similarity) for the first parts of similar word sets, and (first, b, 1) for the others of each set."""
    rows = t.raw("part").select(F.col("p_partkey").alias("id"), text.tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("w"))
    return resolve.similar_sets(rows, threshold).withColumn("similarity", F.round("similarity", 6))


@query("nearest_vectors", """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q)) AS c FROM embeddings, q)
  SELECT vec_id, round(c, 6) AS similarity FROM s ORDER BY c DESC, vec_id LIMIT 20""")
def nearest_vectors(t: Tables, vec_id: int = 7, k: int = 20) -> DataFrame:
    """Top k by cosine with one vector, which is read first; a vector of zeros is near to none."""
    rows = t.raw("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    q = rows.where(F.col("vec_id") == vec_id).limit(1).select(F.col("e").alias("q"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    c = F.try_divide(dot("e", "q"), F.sqrt(dot("e", "e") * dot("q", "q")))
    return top(rows.join(F.broadcast(q)).select("vec_id", c.alias("c")), k, F.desc("c"), "vec_id").select("vec_id", F.round("c", 6).alias("similarity"))


@query("tender_quality", """SELECT 'missing_value' AS kind, 'l_shipdate' AS "column", count(*) AS n, 'critical' AS severity FROM lineitem WHERE l_shipdate IS NULL HAVING count(*) > 0
  UNION ALL SELECT 'out_of_range', 'l_extendedprice', count(*), 'medium' FROM lineitem WHERE l_extendedprice < 40000 OR l_extendedprice > 1e9 HAVING count(*) > 0
  UNION ALL SELECT 'duplicate_l_orderkey', 'l_orderkey', count(*), 'high' FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)""")
def tender_quality(t: Tables) -> DataFrame:
    return upsert.quality_issues(t.raw("lineitem"), ("l_shipdate",), amount="l_extendedprice", unique="l_orderkey")


@query("upsert_orders", """WITH c AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS k, o_totalprice * 2 AS v FROM orders WHERE o_orderkey % 2 = 0) SELECT coalesce(n.k, c.k) AS k, round(coalesce(n.v, c.v), 2) AS v FROM c FULL JOIN n ON c.k = n.k""")
def upsert_orders(t: Tables) -> DataFrame:
    """Two overlapping loads of orders, the second with doubled prices."""
    o = t.raw("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return upsert.upsert(o.where("k % 3 <> 0"), o.where("k % 2 = 0").withColumn("v", F.col("v") * 2), "k").withColumn("v", F.round("v", 2))


@query("state_diff", "SELECT o_orderkey AS k, 'v' AS property, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS old, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) END AS new, CASE WHEN o_orderkey % 3 = 0 THEN 'added' WHEN o_orderkey % 2 <> 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def state_diff(t: Tables) -> DataFrame:
    o = t.raw("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return upsert.diff(o.where("k % 3 <> 0"), o.where("k % 2 = 0").withColumn("v", F.lower("v")), "k")


@query("exact_project_match", "SELECT cig, cup FROM tender t JOIN project p ON t.project_id = p.project_id")
def exact_project_match(t: Tables) -> DataFrame:
    return t.tender.join(t.project, "project_id").select("cig", "cup")


@query("implicit_links", """WITH t AS (SELECT 'common_tender' AS kind, a.company_id AS a, b.company_id AS b, count(*) AS n FROM win_keys a JOIN win_keys b ON a.tender_id = b.tender_id AND a.company_id < b.company_id GROUP BY 2, 3),
  o AS (SELECT 'shared_owner' AS kind, a.company_id AS a, b.company_id AS b, count(*) AS n FROM shareholder_of a JOIN shareholder_of b ON a.owner_id = b.owner_id AND a.company_id < b.company_id GROUP BY 2, 3),
  r AS (SELECT 'same_region' AS kind, min(company_id) OVER (PARTITION BY regione) AS a, company_id AS b, 1 AS n FROM company)
  SELECT kind, a, b, n, round(CASE kind WHEN 'common_tender' THEN least(1.0, 0.4 + 0.2 * n) WHEN 'shared_owner' THEN least(1.0, 0.5 + 0.15 * n) ELSE 0.5 END, 4)::DOUBLE AS strength FROM (FROM t UNION ALL FROM o UNION ALL FROM r) WHERE a <> b""")
def implicit_links(t: Tables) -> DataFrame:
    """Companies that won tenders together, that owners share, or that are in one region; for regions each company and the region's first."""
    return resolve.implicit_links(t.win_keys, t.shareholder_of, t.company)


@query("explain_company", """SELECT c.company_id, wins, round(single / wins, 4) AS single_ratio, top_buyer, round(topn / wins, 4) AS top_share FROM company c JOIN (SELECT company_id, sum(n)::BIGINT AS wins, sum(s) AS single, arg_max(buyer_id, {'a': n, 'b': -buyer_id}) AS top_buyer, max(n) AS topn
  FROM (SELECT company_id, buyer_id, count(*) AS n, sum(CASE WHEN single_bidder THEN 1 ELSE 0 END) AS s FROM wins GROUP BY 1, 2) GROUP BY 1) x ON c.company_id = x.company_id""")
def explain_company(t: Tables) -> DataFrame:
    """What a company's score is made of: its wins, their single-bidder share, its largest buyer and that one's share."""
    per = t.wins.groupBy("company_id", "buyer_id").agg(F.count("*").alias("n"), F.sum(F.col("single_bidder").cast("long")).alias("s"))
    best = F.max(F.struct("n", (-F.col("buyer_id")).alias("b")))
    rows = per.groupBy("company_id").agg(F.sum("n").alias("wins"), F.sum("s").alias("single"), best.alias("m")).join(t.company.select("company_id"), "company_id")
    return rows.select("company_id", "wins", F.round(F.col("single") / F.col("wins"), 4).alias("single_ratio"), (-F.col("m.b")).alias("top_buyer"), F.round(F.col("m.n") / F.col("wins"), 4).alias("top_share"))


@query("document_identifiers", """SELECT doc_id, len(regexp_extract_all(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')) AS addresses, len(regexp_extract_all(text, 'token = "[0-9a-f]+"')) AS tokens FROM documents""")
def document_identifiers(t: Tables) -> DataFrame:
    ips = F.regexp_extract_all("text", F.lit(r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"), F.lit(1))
    keys = F.regexp_extract_all("text", F.lit('(token = "[0-9a-f]+")'), F.lit(1))
    return t.raw("documents").select("doc_id", F.size(ips).cast("long").alias("addresses"), F.size(keys).cast("long").alias("tokens"))


@query("geo_links", "SELECT s_suppkey AS company_id, n_name AS provincia, r_name AS regione FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def geo_links(t: Tables) -> DataFrame:
    return t.company.select("company_id", "provincia", "regione")


@query("region_directory", "SELECT r_name AS regione, array_to_string(list_sort(list(n_name)), ',') AS province FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def region_directory(t: Tables) -> DataFrame:
    rows = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("regione")).agg(joined(F.collect_list("n_name")).alias("province"))


@query("part_word_pairs", """WITH p AS (SELECT p_partkey AS id, list_sort(list_distinct(list_filter(string_split_regex(upper(p_name), '\\s+'), lambda x: length(x) > 3))) AS w FROM part), c AS (SELECT w, min(id) AS id FROM p WHERE len(w) >= 2 GROUP BY 1)
  SELECT a.id AS a, b.id AS b, CAST(len(list_intersect(a.w, b.w)) AS INTEGER) AS common FROM c a JOIN c b ON a.id < b.id WHERE len(list_intersect(a.w, b.w)) >= 2 UNION ALL SELECT c.id, p.id, CAST(len(p.w) AS INTEGER) FROM p JOIN c ON p.w = c.w WHERE p.id <> c.id""")
def part_word_pairs(t: Tables, least: int = 2) -> DataFrame:
    """Token blocking: parts whose names have two words or more in common; classes of equal names by their first part."""
    rows = t.raw("part").select(F.col("p_partkey").alias("id"), text.tokens(F.col("p_name")).alias("w"))
    return linkage.common_words(rows, F.col("w"), least)


@query("supplier_clusters")
def supplier_clusters(t: Tables, threshold: float = 0.94) -> DataFrame:
    """Average-linkage clusters of suppliers of one nation by the likeness of their names; pairs below the threshold count as unlike."""
    rows = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("nome"), "s_nationkey")
    # equal names merge first, as nothing else has a mean of 1, and are one to all others
    pairs, members = resolve.similar_classes(rows, "s_nationkey", threshold)
    found = linkage.average_linkage(pairs.select("a", "b", F.round("similarity", 6).alias("score"), "na", "nb"), threshold).toDF("first", "cluster")
    return members.join(found, "first", "left").where("cluster IS NOT NULL OR n > 1").select("id", F.coalesce("cluster", "first").alias("cluster"))


@query("risk_snapshots", """SELECT company_id, CASE WHEN risk_score > 0 THEN 2 ELSE 1 END AS snapshots, round(risk_score + 0.25, 4) AS risk_score, CASE WHEN risk_score > 0 THEN round(risk_score, 4) END AS before FROM company""")
def risk_snapshots(t: Tables) -> DataFrame:
    """What two runs leave in the log of risk scores, the second with every score raised and written twice, as after a lost driver."""
    log = new_path(t.spark, "risk")
    c = t.company.select("company_id", "risk_score")
    runs.snapshot_risk(c, log, "first", "2024-01-01 00:00:00")
    for _ in range(2):
        runs.snapshot_risk(c.withColumn("risk_score", F.col("risk_score") + 0.25), log, "second", "2024-02-01 00:00:00")
    rows = runs.latest_scores(runs.risk_log(t.spark, log))
    return rows.select("company_id", F.col("snapshots").cast("int").alias("snapshots"), *[F.round(c, 4).alias(c) for c in ("risk_score", "before")])


_NEAR = """x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id AS question, x.vec_id AS id, round(list_dot_product(q.v, x.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(x.v, x.v)), 6) AS score FROM x q JOIN x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id)"""


@query("nearest_many", f"WITH {_NEAR} SELECT question, id, score, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS INTEGER) AS rank FROM p QUALIFY rank <= 10")
def nearest_many(t: Tables, k: int = 10) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 50, against all rows."""
    return _nearest(t, k).drop("first")


def _nearest(t: Tables, k: int) -> DataFrame:
    rows = t.raw("embeddings")
    cells = nearest.build(rows)
    if cells is None:
        return t.spark.createDataFrame([], "question long, id long, score double, rank int, first boolean")
    return nearest.nearest(cells, nearest.usable(rows.where("vec_id % 50 = 0"), "vec_id", "embedding"), k)
