"""Alert dashboards, alert statistics and alert generators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.operators import alerts, comments
from veritrace.plans.base import joined, mean, query, top
from veritrace.sources.tables import ALERT_AS_OF, AS_OF, Tables

_NOW = f"TIMESTAMP '{ALERT_AS_OF}'"
RANK = {"critical": 1, "high": 2, "medium": 3, "low": 4, "info": 5}


def now():
    return F.to_timestamp(F.lit(ALERT_AS_OF))


def within(hours: int):
    return F.col("created_at") >= now() - F.expr(f"INTERVAL {hours} HOURS")


def n_when(cond, name: str):
    return F.count_if(cond).alias(name)


@query("alerts_pending_by_severity", "SELECT severity, count(*) AS n FROM alert WHERE status = 'pending' GROUP BY 1")
def pending_by_severity(t: Tables) -> DataFrame:
    return t.alert.where("status = 'pending'").groupBy("severity").agg(F.count("*").alias("n"))


@query("alerts_week_by_type", f"SELECT type, count(*) AS n FROM alert WHERE created_at >= {_NOW} - INTERVAL 168 HOUR GROUP BY 1")
def week_by_type(t: Tables) -> DataFrame:
    return t.alert.where(within(168)).groupBy("type").agg(F.count("*").alias("n"))


@query("alerts_by_status", "SELECT status, count(*) AS n FROM alert GROUP BY 1")
def by_status(t: Tables) -> DataFrame:
    return t.alert.groupBy("status").agg(F.count("*").alias("n"))


@query("alerts_top_entities", "SELECT entity_id, count(*) AS alert_count, array_to_string(list_sort(list(DISTINCT type)), ',') AS types, max(severity) AS max_severity FROM alert GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_entities(t: Tables, limit: int = 20) -> DataFrame:
    """max_severity is the alphabetical maximum, as the dashboard shows it."""
    rows = t.alert.groupBy("entity_id").agg(F.count("*").alias("alert_count"), joined(F.collect_set("type")).alias("types"), F.max("severity").alias("max_severity"))
    return top(rows, limit, F.desc("alert_count"), "entity_id")


@query("alerts_entity_timeline", "SELECT alert_id, type, severity, status, created_at FROM alert WHERE entity_id = 7 ORDER BY created_at DESC, alert_id LIMIT 50")
def entity_timeline(t: Tables, entity: int = 7, limit: int = 50) -> DataFrame:
    return top(t.alert.where(F.col("entity_id") == entity).select("alert_id", "type", "severity", "status", "created_at"), limit, F.desc("created_at"), "alert_id")


@query("alerts_critical_pending", "SELECT alert_id, entity_id, created_at FROM alert WHERE status = 'pending' AND severity = 'critical'")
def critical_pending(t: Tables) -> DataFrame:
    return t.alert.where("status = 'pending' AND severity = 'critical'").select("alert_id", "entity_id", "created_at")


@query("alerts_last_day", f"SELECT type, severity, status, count(*) AS n FROM alert WHERE created_at >= {_NOW} - INTERVAL 48 HOUR GROUP BY ALL", hours=48)
def last_day(t: Tables, hours: int = 24) -> DataFrame:
    return t.alert.where(within(hours)).groupBy("type", "severity", "status").agg(F.count("*").alias("n"))


@query("alerts_daily_volume", f"""SELECT CAST(created_at AS DATE) AS alert_date, count(*) AS total_alerts, count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count,
  count(*) FILTER (severity = 'medium') AS medium_count FROM alert WHERE created_at >= {_NOW} - INTERVAL 720 HOUR GROUP BY 1""")
def daily_volume(t: Tables) -> DataFrame:
    counts = [n_when(F.col("severity") == s, f"{s}_count") for s in ("critical", "high", "medium")]
    return t.alert.where(within(720)).groupBy(F.to_date("created_at").alias("alert_date")).agg(F.count("*").alias("total_alerts"), *counts)


def _hours(until: str):
    return F.timestamp_diff("HOUR", F.col("created_at"), F.col(until))


@query("alerts_hours_to_acknowledge", "SELECT type, round(avg(datesub('hour', created_at, acknowledged_at)), 6) AS avg_hours, count(*) AS n FROM alert WHERE acknowledged_at IS NOT NULL GROUP BY 1")
def hours_to_acknowledge(t: Tables) -> DataFrame:
    return t.alert.where("acknowledged_at IS NOT NULL").withColumn("h", _hours("acknowledged_at")).groupBy("type").agg(mean("h", "avg_hours", 6), F.count("*").alias("n"))


@query("alerts_hours_to_resolve", "SELECT type, round(avg(datesub('hour', created_at, resolved_at)), 6) AS avg_hours, count(*) AS n FROM alert WHERE resolved_at IS NOT NULL GROUP BY 1")
def hours_to_resolve(t: Tables) -> DataFrame:
    return t.alert.where("resolved_at IS NOT NULL").withColumn("h", _hours("resolved_at")).groupBy("type").agg(mean("h", "avg_hours", 6), F.count("*").alias("n"))


@query("alerts_fraud_by_pattern", "SELECT type AS pattern, count(*) AS occurrence_count, count(*) FILTER (status = 'pending') AS pending_count, count(*) FILTER (status = 'resolved') AS resolved_count FROM alert GROUP BY 1")
def fraud_by_pattern(t: Tables) -> DataFrame:
    return t.alert.groupBy(F.col("type").alias("pattern")).agg(F.count("*").alias("occurrence_count"), n_when(F.col("status") == "pending", "pending_count"), n_when(F.col("status") == "resolved", "resolved_count"))


@query("alerts_multi_entity_patterns", "SELECT type AS pattern, rule_id, array_to_string(list_sort(list(DISTINCT entity_id)), ',') AS entities, count(DISTINCT entity_id) AS n FROM alert GROUP BY 1, 2 HAVING count(DISTINCT entity_id) > 1 ORDER BY 4 DESC, 1, 2 LIMIT 20")
def multi_entity_patterns(t: Tables, limit: int = 20) -> DataFrame:
    rows = t.alert.groupBy(F.col("type").alias("pattern"), "rule_id").agg(joined(F.collect_set("entity_id")).alias("entities"), F.count_distinct("entity_id").alias("n")).where("n > 1")
    return top(rows, limit, F.desc("n"), "pattern", "rule_id")


@query("alerts_risk_spikes", "SELECT alert_id, entity_id, round(score, 4) AS score, severity, status FROM alert WHERE type = 'error' ORDER BY alert.score DESC, alert_id LIMIT 50")
def risk_spikes(t: Tables, kind: str = "error", limit: int = 50) -> DataFrame:
    return top(t.alert.where(F.col("type") == kind), limit, F.desc("score"), "alert_id").select("alert_id", "entity_id", F.round("score", 4).alias("score"), "severity", "status")


@query("alerts_chronic_spikes", "SELECT entity_id, count(*) AS spike_count, round(max(score), 4) AS max_score, round(avg(score), 4) AS avg_score FROM alert WHERE type = 'error' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def chronic_spikes(t: Tables, kind: str = "error", limit: int = 20) -> DataFrame:
    rows = t.alert.where(F.col("type") == kind).groupBy("entity_id").agg(F.count("*").alias("spike_count"), F.round(F.max("score"), 4).alias("max_score"), mean("score", "avg_score", 4))
    return top(rows, limit, F.desc("spike_count"), "entity_id")


@query("alerts_activity_spikes", f"""SELECT entity_id, count(*) FILTER (created_at >= {_NOW} - INTERVAL 168 HOUR) AS recent, count(*) FILTER (created_at < {_NOW} - INTERVAL 168 HOUR) AS earlier FROM alert GROUP BY 1
  HAVING count(*) FILTER (created_at >= {_NOW} - INTERVAL 168 HOUR) > 5""")
def activity_spikes(t: Tables, least: int = 5) -> DataFrame:
    """One pass over the alerts: both windows are conditional counts."""
    return t.alert.groupBy("entity_id").agg(n_when(within(168), "recent"), n_when(~within(168), "earlier")).where(F.col("recent") > least)


@query("alerts_merge_candidates", """WITH c AS (SELECT company_id, cf, provincia, cod_istat, lower(nome) AS n, string_split(lower(nome), ' ') AS ws FROM company),
  f AS (SELECT a.company_id AS m, min(b.company_id) AS o FROM c a JOIN c b ON a.provincia = b.provincia AND a.ws[1] = b.ws[1] AND a.cf <> b.cf AND a.n <> b.n GROUP BY 1),
  g AS (SELECT a.company_id AS m, min(b.company_id) AS o FROM c a JOIN c b ON a.cod_istat = b.cod_istat AND substr(a.n, 1, 4) = substr(b.n, 1, 4) AND length(a.n) > 3 AND length(b.n) > 3 AND a.cf <> b.cf AND a.n <> b.n GROUP BY 1),
  p AS (SELECT least(m, o) AS a, greatest(m, o) AS b FROM (FROM f UNION ALL FROM g)
  UNION SELECT least(a.company_id, b.company_id), greatest(a.company_id, b.company_id) FROM c a JOIN c b ON a.provincia = b.provincia AND a.ws[1] < b.ws[1] AND list_contains(a.ws, b.ws[1]) AND list_contains(b.ws, a.ws[1]) WHERE a.cf <> b.cf AND a.n <> b.n)
  SELECT a AS first_id, b AS second_id FROM p""")
def merge_candidates(t: Tables) -> DataFrame:
    return alerts.merge_pairs(t.company).select(F.col("a").alias("first_id"), F.col("b").alias("second_id"))


@query("alerts_generated", f"""WITH r AS (SELECT 'risk_spike' AS type, CASE WHEN risk_score >= 0.85 THEN 'critical' ELSE 'high' END AS severity, CAST(company_id AS VARCHAR) AS entity_id FROM (SELECT * FROM company WHERE risk_score >= 0.7 ORDER BY risk_score DESC, company_id LIMIT 100)),
  w AS (SELECT company_id, count(*) FILTER (data_aggiudicazione >= DATE '{AS_OF}' - 900) AS recent, count(*) FILTER (data_aggiudicazione < DATE '{AS_OF}' - 900) AS earlier FROM wins WHERE data_aggiudicazione BETWEEN DATE '{AS_OF}' - 1800 AND DATE '{AS_OF}' GROUP BY 1),
  a AS (SELECT 'activity_spike', 'medium', CAST(company_id AS VARCHAR) FROM (SELECT * FROM w WHERE earlier > 0 AND recent > 5 AND recent / earlier > 1 ORDER BY recent / earlier DESC, company_id LIMIT 50)) SELECT * FROM r UNION ALL SELECT * FROM a""")
def alerts_generated(t: Tables, now: str = AS_OF) -> DataFrame:
    """Alerts that the risk and activity generators make of a table without any; activity over longer times, as wins are spread evenly."""
    none = t.spark.createDataFrame([], alerts.ALERT)
    made, errors = alerts.run_all(none, {"risk": lambda: alerts.from_risk(t.company, none, now), "activity": lambda: alerts.from_activity(t.wins, none, now, 900, 1800, ratio=1.0)}, now)
    if errors:
        raise RuntimeError(f"generators failed: {errors}")
    return made.select("type", "severity", "entity_id")


@query("alert_status_changes", """WITH q AS (SELECT event_id AS k, ['acknowledged', 'resolved', 'pending'][event_id % 3 + 1] AS status, ts + to_hours(event_id % 7) AS at FROM events)
  SELECT alert_id, CASE WHEN q.status = 'acknowledged' AND alert.status = 'pending' THEN 'acknowledged' WHEN q.status = 'resolved' AND alert.status IN ('pending', 'acknowledged') THEN 'resolved' ELSE alert.status END AS status FROM alert JOIN q ON alert_id = q.k""")
def alert_status_changes(t: Tables) -> DataFrame:
    """Every alert's status after one request for each, of which some are refused."""
    k = F.col("event_id")
    asked = t.raw("events").select(k.alias("alert_id"), F.element_at(F.array(F.lit("acknowledged"), F.lit("resolved"), F.lit("pending")), (k % 3 + 1).cast("int")).alias("status"), (F.col("ts") + F.make_dt_interval(hours=(k % 7).cast("int"))).alias("at"))
    return alerts.change(t.alert, asked)[0].select("alert_id", "status")


@query("alerts_rule_effectiveness", "SELECT rule_id, count(*) AS alerts_generated, count(*) FILTER (status = 'pending') AS pending_alerts, count(*) FILTER (status = 'resolved') AS resolved_alerts FROM alert GROUP BY 1")
def rule_effectiveness(t: Tables) -> DataFrame:
    return t.alert.groupBy("rule_id").agg(F.count("*").alias("alerts_generated"), n_when(F.col("status") == "pending", "pending_alerts"), n_when(F.col("status") == "resolved", "resolved_alerts"))


@query("alerts_rules_never_triggered", "SELECT n_nationkey AS rule_id, n_name AS rule_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM alert WHERE rule_id = n_nationkey)")
def rules_never_triggered(t: Tables) -> DataFrame:
    rules = t.raw("nation").select(F.col("n_nationkey").alias("rule_id"), F.col("n_name").alias("rule_name"))
    return rules.join(t.alert.select(F.col("rule_id").alias("r")), F.col("rule_id") == F.col("r"), "left_anti")


@query("alerts_entity_audit", "SELECT alert_id, type, severity, status, created_at, acknowledged_at, resolved_at, dismissed_at FROM alert WHERE entity_id = 7")
def entity_audit(t: Tables, entity: int = 7) -> DataFrame:
    return t.alert.where(F.col("entity_id") == entity).select("alert_id", "type", "severity", "status", "created_at", "acknowledged_at", "resolved_at", "dismissed_at")


@query("alerts_status_audit", "SELECT alert_id, status, created_at, acknowledged_at, resolved_at, dismissed_at FROM alert WHERE coalesce(acknowledged_at, resolved_at, dismissed_at) IS NOT NULL ORDER BY created_at DESC, alert_id LIMIT 100")
def status_audit(t: Tables, limit: int = 100) -> DataFrame:
    rows = t.alert.where(F.coalesce("acknowledged_at", "resolved_at", "dismissed_at").isNotNull())
    return top(rows.select("alert_id", "status", "created_at", "acknowledged_at", "resolved_at", "dismissed_at"), limit, F.desc("created_at"), "alert_id")


@query("alerts_dismissed", "SELECT alert_id, type, severity, dismissed_at FROM alert WHERE status = 'dismissed' ORDER BY dismissed_at DESC, alert_id LIMIT 50")
def dismissed(t: Tables, limit: int = 50) -> DataFrame:
    return top(t.alert.where("status = 'dismissed'").select("alert_id", "type", "severity", "dismissed_at"), limit, F.desc("dismissed_at"), "alert_id")


@query("alert_statistics", f"""SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'acknowledged') AS acknowledged, count(*) FILTER (status = 'resolved') AS resolved,
  count(*) FILTER (status = 'dismissed') AS dismissed, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (created_at >= {_NOW} - INTERVAL 24 HOUR) AS last_day FROM alert""")
def alert_statistics(t: Tables) -> DataFrame:
    by = [n_when(F.col("status") == s, s) for s in ("pending", "acknowledged", "resolved", "dismissed")] + [n_when(F.col("severity") == s, s) for s in RANK]
    return t.alert.agg(F.count("*").alias("total"), *by, n_when(within(24), "last_day"))


@query("alert_page", "SELECT alert_id, type, severity FROM alert WHERE severity IN ('critical', 'high') ORDER BY created_at DESC, alert_id LIMIT 25 OFFSET 50")
def alert_page(t: Tables, severities: tuple[str, ...] = ("critical", "high"), limit: int = 25, offset: int = 50) -> DataFrame:
    return t.alert.where(F.col("severity").isin(*severities)).orderBy(F.desc("created_at"), "alert_id").offset(offset).limit(limit).select("alert_id", "type", "severity")


@query("alert_dedup", """SELECT type, entity_id, count(*) AS kept FROM (SELECT type, entity_id, created_at, lag(created_at) OVER (PARTITION BY type, entity_id ORDER BY created_at, alert_id) AS before FROM alert)
  WHERE before IS NULL OR created_at - before > INTERVAL 24 HOUR GROUP BY 1, 2""")
def alert_dedup(t: Tables, hours: int = 24) -> DataFrame:
    """Alerts of one kind and entity that follow the one before by more than a day."""
    from pyspark.sql import Window

    w = Window.partitionBy("type", "entity_id").orderBy("created_at", "alert_id")
    rows = t.alert.withColumn("before", F.lag("created_at").over(w)).where(F.col("before").isNull() | (F.col("created_at") - F.expr(f"INTERVAL {hours} HOURS") > F.col("before")))
    return rows.groupBy("type", "entity_id").agg(F.count("*").alias("kept"))


@query("alerts_from_risk", "SELECT company_id, risk_score, CASE WHEN risk_score >= 0.85 THEN 'critical' ELSE 'high' END AS severity FROM company WHERE risk_score >= 0.7")
def alerts_from_risk(t: Tables, threshold: float = 0.7, critical: float = 0.85) -> DataFrame:
    sev = F.when(F.col("risk_score") >= critical, "critical").otherwise("high")
    return t.company.where(F.col("risk_score") >= threshold).select("company_id", "risk_score", sev.alias("severity"))


@query("alerts_from_activity", """SELECT company_id, recent, earlier FROM (SELECT company_id, count(*) FILTER (data_aggiudicazione > DATE '1996-06-30' - 90) AS recent, count(*) FILTER (data_aggiudicazione <= DATE '1996-06-30' - 90) AS earlier
  FROM wins WHERE data_aggiudicazione BETWEEN DATE '1996-06-30' - 365 AND DATE '1996-06-30' GROUP BY 1) WHERE recent > 5 AND recent / 90.0 > 1.0 * earlier / 275.0""")
def alerts_from_activity(t: Tables, as_of: str = "1996-06-30", least: int = 5, ratio: float = 1.0) -> DataFrame:
    day, end = F.col("data_aggiudicazione"), F.to_date(F.lit(as_of))
    rows = t.wins.where(day.between(F.date_sub(end, 365), end)).groupBy("company_id").agg(n_when(day > F.date_sub(end, 90), "recent"), n_when(day <= F.date_sub(end, 90), "earlier"))
    return rows.where((F.col("recent") > least) & (F.col("recent") / 90.0 > ratio * F.col("earlier") / 275.0))


@query("comment_threads", """SELECT conv_id, turn, text, n AS reply_count FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) - 1 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k = 1""")
def comment_threads(t: Tables) -> DataFrame:
    """The first comment of each thread and how many replies it has."""
    rows = t.raw("conversations").groupBy("conv_id").agg(F.min_by(F.struct("turn", "text"), "turn").alias("f"), (F.count("*") - 1).alias("reply_count"))
    return rows.select("conv_id", "f.turn", "f.text", "reply_count")


@query("comment_replies", "SELECT conv_id, count(*) - 1 AS replies, coalesce(array_to_string(list_slice(list(turn ORDER BY turn), 2, 51), ','), '') AS shown FROM conversations GROUP BY 1")
def comment_replies(t: Tables) -> DataFrame:
    """Threads with the first replies listed; a conversation's first turn is the comment, all others answer it."""
    rows = t.raw("conversations")
    first = rows.groupBy("conv_id").agg(F.min("turn").alias("_first"))
    own = F.concat_ws(":", F.lpad(F.col("turn").cast("string"), 9, "0"), "conv_id")
    c = rows.join(first, "conv_id").select(own.alias("comment_id"), F.when(F.col("turn") != F.col("_first"), F.concat_ws(":", F.lpad(F.col("_first").cast("string"), 9, "0"), "conv_id")).alias("parent_id"), F.col("conv_id").cast("string").alias("entity_id"), F.col("role").alias("author"), "text", F.timestamp_seconds("turn").alias("created_at"))
    turn = F.transform("shown", lambda x: F.split(x, ":")[0].cast("bigint").cast("string"))
    return comments.threads(c).select(F.col("entity_id").cast("bigint").alias("conv_id"), "replies", F.array_join(turn, ",").alias("shown"))


@query("comment_search", "SELECT conv_id, turn, role FROM conversations WHERE contains(lower(text), 'the') AND role = 'user'")
def comment_search(t: Tables, word: str = "the", role: str = "user") -> DataFrame:
    return t.raw("conversations").where(F.lower("text").contains(word) & (F.col("role") == role)).select("conv_id", "turn", "role")
