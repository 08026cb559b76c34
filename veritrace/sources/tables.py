"""The domain tables as DataFrames: one per node label, one per edge type."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: "Now" of all registered queries; no operator reads the clock.
AS_OF = "2001-12-31"
ALERT_AS_OF = "2024-01-31 00:00:00"
EU_FUNDS = ("STANDARD",)
#: Lines of orders that a task gets, about.
LINES = 1_000_000


@dataclass
class Tables:
    """Domain tables bound to the star schema of the driver (company = supplier, tender = order, buyer = customer).

    Every table is built lazily, so a query scans only what it uses. Derived columns are fixed functions of the keys.
    """

    spark: SparkSession
    sf_dir: str
    _raw: dict[str, DataFrame] = field(default_factory=dict)

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    def keep(self, *names: str) -> Tables:
        """The same tables, of which those named are made once and read back by all that follows."""
        from veritrace.operators.components import stored

        found = Tables(self.spark, self.sf_dir, self._raw)
        found.__dict__.update({k: v for k, v in self.__dict__.items() if k not in ("spark", "sf_dir", "_raw")})
        found.__dict__.update({name: stored(getattr(self, name)) for name in names})
        return found

    @cached_property
    def company(self) -> DataFrame:
        k = F.col("s_suppkey")
        geo = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.raw("supplier").join(geo, F.col("s_nationkey") == F.col("n_nationkey")).select(
            k.alias("company_id"), F.format_string("CF%09d", k).alias("cf"), F.col("s_name").alias("nome"), F.col("n_name").alias("provincia"),
            F.col("r_name").alias("regione"), F.col("s_nationkey").cast("string").alias("cod_istat"), (41 + k % 5).cast("string").alias("ateco"),
            (F.col("s_nationkey") % 5).cast("long").alias("community_id"), ((k * 37) % 100 / 100.0).alias("risk_score"),
            ((k * 61) % 100 / 100.0).alias("centrality_score"), F.when(k % 4 == 0, F.array(F.lit("single_bidder"), F.lit("hub"))).when(k % 4 == 1, F.array(F.lit("hub"))).otherwise(F.array().cast("array<string>")).alias("anomaly_flags"),
            F.concat(F.lit("VIA "), (k % 7).cast("string")).alias("address"), (k % 3 != 0).alias("vat_active"), (1995 + k % 7).cast("int").alias("last_filing_year"),
            F.to_date(F.lit("1994-01-01")).alias("valid_from"), F.when(k % 10 == 9, F.to_date(F.lit("2000-01-01"))).alias("valid_to"),
        )

    @cached_property
    def parts(self) -> int:
        """Parts of LINES lines that the lines of orders make; 0 if the cores are as many, so that Spark's own parts are as small."""
        parts = -(-self.raw("lineitem").count() // LINES)
        return parts if parts > self.spark.sparkContext.defaultParallelism else 0

    @cached_property
    def _orders(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("tender_id"), F.format_string("CIG%07d", F.col("o_orderkey")).alias("cig"), F.col("o_totalprice").alias("importo"),
            F.to_date("o_orderdate").alias("data_apertura"), F.col("o_orderpriority").alias("procedura"), F.col("o_custkey").alias("buyer_id"),
        )

    _TENDER = ("tender_id", "cig", "importo", "data_apertura", "data_aggiudicazione", "single_bidder", "procedura", "project_id", "buyer_id")

    @cached_property
    def tender(self) -> DataFrame:
        """Tenders that have been awarded; orders without lines are left out."""
        line, supplier = self.raw("lineitem"), F.col("l_suppkey")
        one = F.coalesce(F.min(supplier) == F.max(supplier), F.lit(False))
        award = line.groupBy(F.col("l_orderkey").alias("tender_id")).agg(F.min(F.to_date("l_shipdate")).alias("data_aggiudicazione"), one.alias("single_bidder"), F.min("l_partkey").alias("project_id"))
        return self._orders.join(award, "tender_id").select(*self._TENDER)

    @cached_property
    def win_keys(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_suppkey").alias("company_id"), F.col("l_orderkey").alias("tender_id")).distinct()

    @cached_property
    def wins(self) -> DataFrame:
        """(company_id, tender_id) and the tender's columns. Lines are dealt out by order once and sorted once, by order and supplier:
        repeats lie side by side, and what an order's lines say of it comes from the same rows, so no table of pairs is held.
        """
        of, company = Window.partitionBy("tender_id"), F.col("company_id")  # the lines of one order
        rows = self.raw("lineitem").select(F.col("l_orderkey").alias("tender_id"), F.col("l_suppkey").alias("company_id"), F.to_date("l_shipdate").alias("day"), "l_partkey")
        rows = rows.repartition(self.parts, "tender_id") if self.parts else rows.repartition("tender_id")
        by = of.orderBy("company_id")
        rows = rows.withColumn("first", F.rank().over(by) == F.row_number().over(by))
        one = F.coalesce(F.min(company).over(of) == F.max(company).over(of), F.lit(False))
        rows = rows.select("tender_id", "company_id", "first", F.min("day").over(of).alias("data_aggiudicazione"), one.alias("single_bidder"), F.min("l_partkey").over(of).alias("project_id"))
        return rows.where("first").drop("first").join(self._orders, "tender_id").select("company_id", *self._TENDER)

    @cached_property
    def buyer(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("buyer_id"), F.col("c_name").alias("buyer_name"), F.format_string("CF%09d", F.col("c_custkey")).alias("buyer_cf"))

    @cached_property
    def project(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("project_id"), F.format_string("CUP%07d", F.col("p_partkey")).alias("cup"), F.col("p_name").alias("titolo"), F.col("p_retailprice").alias("importo_finanziato"), F.col("p_brand").alias("regione"), F.col("p_type").alias("fondo"))

    @cached_property
    def represents(self) -> DataFrame:
        """(person_id, company_id): a customer sits on the boards of the suppliers of its orders' first lines."""
        first = self.raw("lineitem").where("l_linenumber = 1").select("l_orderkey", "l_suppkey")
        return first.join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("person_id"), F.col("l_suppkey").alias("company_id")).distinct()

    @cached_property
    def shareholder_of(self) -> DataFrame:
        """(owner_id, company_id, quota): company k is owned by company k div 3."""
        k = F.col("s_suppkey")
        return self.raw("supplier").where(k >= 3).select(F.floor(k / 3).cast("long").alias("owner_id"), k.alias("company_id"), (10 + k % 90).cast("double").alias("quota"))

    @cached_property
    def subcontracts_to(self) -> DataFrame:
        """(src, dst, cig): suppliers of consecutive lines of an order. Orders are dealt out once: lines meet the next ones, and repeats are dropped, where they lie."""
        line = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").where("l_orderkey IS NOT NULL")
        line = line.repartition(self.parts, "l_orderkey") if self.parts else line.repartition("l_orderkey")
        ends = line.select("l_orderkey", F.explode(F.array(
            F.struct(F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("src"), F.lit(None).cast("long").alias("dst")),
            F.struct((F.col("l_linenumber") - 1).alias("n"), F.lit(None).cast("long").alias("src"), F.col("l_suppkey").alias("dst")))).alias("e")).select("l_orderkey", "e.*")
        met = ends.where("n IS NOT NULL").groupBy("l_orderkey", "n").agg(F.collect_set("src").alias("src"), F.collect_set("dst").alias("dst"))
        pairs = met.select("l_orderkey", F.explode("src").alias("src"), "dst").select("l_orderkey", "src", F.explode("dst").alias("dst"))
        return pairs.where("src <> dst").distinct().select("src", "dst", F.format_string("CIG%07d", F.col("l_orderkey")).alias("cig"))

    @cached_property
    def alert(self) -> DataFrame:
        """Alerts and risk snapshots are events; what lifecycle they have follows from their id."""
        k, ts = F.col("event_id"), F.col("ts")
        pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
        status = pick("pending", "acknowledged", "resolved", "dismissed", "pending", "pending")
        return self.raw("events").select(
            k.alias("alert_id"), F.col("event_type").alias("type"), pick("critical", "high", "medium", "low", "info").alias("severity"), status.alias("status"),
            F.col("user_id").alias("entity_id"), (F.col("value") / 500).alias("score"), ts.alias("created_at"), F.get_json_object("props", "$.k").cast("long").alias("rule_id"),
            F.when(status.isin("acknowledged", "resolved"), ts + F.make_dt_interval(hours=(k % 30).cast("int"))).alias("acknowledged_at"),
            F.when(status == "resolved", ts + F.make_dt_interval(hours=(k % 90 + 30).cast("int"))).alias("resolved_at"),
            F.when(status == "dismissed", ts + F.make_dt_interval(hours=(k % 50).cast("int"))).alias("dismissed_at"),
        )

    @cached_property
    def risk_snapshot(self) -> DataFrame:
        return self.raw("events").select(F.col("user_id").alias("company_id"), F.col("event_id").alias("snapshot_id"), F.col("ts").alias("change_date"), F.least(F.lit(1.0), F.col("value") / 500).alias("risk_score"))


#: The same tables for DuckDB, as common table expressions by name.
SQL = {
    "company": """SELECT s_suppkey AS company_id, 'CF' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS cf, s_name AS nome, n_name AS provincia, r_name AS regione,
  CAST(s_nationkey AS VARCHAR) AS cod_istat, CAST(41 + s_suppkey % 5 AS VARCHAR) AS ateco, CAST(s_nationkey % 5 AS BIGINT) AS community_id, ((s_suppkey * 37) % 100) / 100.0::DOUBLE AS risk_score,
  ((s_suppkey * 61) % 100) / 100.0::DOUBLE AS centrality_score, CASE s_suppkey % 4 WHEN 0 THEN ['single_bidder', 'hub'] WHEN 1 THEN ['hub'] ELSE []::VARCHAR[] END AS anomaly_flags,
  'VIA ' || CAST(s_suppkey % 7 AS VARCHAR) AS address, s_suppkey % 3 <> 0 AS vat_active, CAST(1995 + s_suppkey % 7 AS INTEGER) AS last_filing_year,
  DATE '1994-01-01' AS valid_from, CASE WHEN s_suppkey % 10 = 9 THEN DATE '2000-01-01' END AS valid_to
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "tender": """SELECT o_orderkey AS tender_id, 'CIG' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS cig, o_totalprice AS importo, CAST(o_orderdate AS DATE) AS data_apertura, award AS data_aggiudicazione,
  bidders = 1 AS single_bidder, o_orderpriority AS procedura, project_id, o_custkey AS buyer_id
  FROM orders JOIN (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS award, count(DISTINCT l_suppkey) AS bidders, min(l_partkey) AS project_id FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "win_keys": "SELECT DISTINCT l_suppkey AS company_id, l_orderkey AS tender_id FROM lineitem",
    "wins": "SELECT k.company_id, t.* FROM win_keys k JOIN tender t ON k.tender_id = t.tender_id",
    "buyer": "SELECT c_custkey AS buyer_id, c_name AS buyer_name, 'CF' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS buyer_cf FROM customer",
    "project": "SELECT p_partkey AS project_id, 'CUP' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS cup, p_name AS titolo, p_retailprice AS importo_finanziato, p_brand AS regione, p_type AS fondo FROM part",
    "represents": "SELECT DISTINCT o_custkey AS person_id, l_suppkey AS company_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1",
    "shareholder_of": "SELECT s_suppkey // 3 AS owner_id, s_suppkey AS company_id, CAST(10 + s_suppkey % 90 AS DOUBLE) AS quota FROM supplier WHERE s_suppkey >= 3",
    "subcontracts_to": """SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst, 'CIG' || lpad(CAST(a.l_orderkey AS VARCHAR), 7, '0') AS cig FROM lineitem a
  JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey""",
    "alert": """SELECT event_id AS alert_id, event_type AS type, ['critical', 'high', 'medium', 'low', 'info'][event_id % 5 + 1] AS severity, status, user_id AS entity_id, value / 500 AS score, ts AS created_at, rule_id,
  CASE WHEN status IN ('acknowledged', 'resolved') THEN ts + to_hours(event_id % 30) END AS acknowledged_at, CASE WHEN status = 'resolved' THEN ts + to_hours(event_id % 90 + 30) END AS resolved_at,
  CASE WHEN status = 'dismissed' THEN ts + to_hours(event_id % 50) END AS dismissed_at
  FROM (SELECT *, ['pending', 'acknowledged', 'resolved', 'dismissed', 'pending', 'pending'][event_id % 6 + 1] AS status, CAST(regexp_extract(props, '"k":\\s*(-?[0-9]+)', 1) AS BIGINT) AS rule_id FROM events)""",
    "risk_snapshot": "SELECT user_id AS company_id, event_id AS snapshot_id, ts AS change_date, least(1.0, value / 500) AS risk_score FROM events",
}
_NEEDS = {"wins": ("win_keys", "tender")}


def with_tables(sql: str) -> str:
    """sql behind the common table expressions that it names."""
    import re

    names: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            add(n)
        if name not in names:
            names.append(name)

    for name in SQL:
        if re.search(rf"(?i)\b(from|join)\s+{name}\b|,\s*{name}\s+\w", sql):
            add(name)
    rest = sql.strip()
    recursive = re.match(r"(?i)with\s+recursive\s+", rest)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    if m := recursive or re.match(r"(?i)with\s+", rest):
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}{', ' if head else ''}{rest[m.end():]}"
    return f"WITH {head} {rest}" if head else rest
