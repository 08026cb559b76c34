"""Alerts as an append-only log: creation without repeats, status changes, rules, generators and notices.

An alert table has alert_id, type, severity, status, title, description, entity_type, entity_id, rule_id, triggered_by,
metadata (map of strings), alert_hash, created_at, acknowledged_at, resolved_at, dismissed_at. "Now" is always an argument.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TYPES = ("risk_spike", "fraud_pattern", "sanction_match", "activity_spike", "merge_candidate")
#: Severities, the gravest first.
SEVERITIES = ("critical", "high", "medium", "low", "info")
#: From each status, the next ones; resolved and dismissed are final.
NEXT = {"pending": ("acknowledged", "resolved", "dismissed"), "acknowledged": ("resolved", "dismissed"), "resolved": (), "dismissed": ()}
#: What a bulk action makes of an alert, and the most alerts of one action.
ACTIONS = {"acknowledge": "acknowledged", "resolve": "resolved", "dismiss": "dismissed"}
BULK = 100
#: Hours within which the same alert is not made again.
WINDOW_HOURS = 24
ALERT = (
    "alert_id string, type string, severity string, status string, title string, description string, entity_type string, entity_id string, rule_id string, triggered_by string, "
    "metadata map<string,string>, alert_hash string, created_at timestamp, acknowledged_at timestamp, resolved_at timestamp, dismissed_at timestamp"
)
#: name, type, metric, comparison, threshold, severity of the rules that come with the engine.
RULES = (
    ("Risk Score High", "risk_spike", "risk_score", ">=", 0.7, "critical"), ("Risk Tier Crossing", "risk_spike", "tier_change", "=", 1.0, "high"),
    ("Bid Rotation", "fraud_pattern", "bid_rotation", ">=", 1.0, "critical"), ("Board Overlap Collusion", "fraud_pattern", "board_overlap_collusion", ">=", 1.0, "high"),
    ("Subcontractor Concentration", "fraud_pattern", "subcontractor_share", ">", 0.6, "high"), ("Single Bidder Spike", "activity_spike", "single_bidder_ratio", ">", 0.8, "medium"),
    ("Tender Volume Spike", "activity_spike", "volume_ratio", ">", 3.0, "medium"), ("Duplicate Company Found", "merge_candidate", "similarity", ">", 0.85, "low"),
)
RULE = "rule_id string, name string, type string, metric string, comparison string, threshold double, severity string, enabled boolean"


def at(now: str) -> Column:
    return F.to_timestamp(F.lit(now))


def rank(severity: Column) -> Column:
    """5 for critical down to 1 for info, 0 for anything else."""
    return F.coalesce(*[F.when(severity == s, 5 - i) for i, s in enumerate(SEVERITIES)], F.lit(0))


def alert_hash() -> Column:
    """SHA-256 of what makes an alert the same: type, entity, rule and the names in its metadata; nulls count as values of their own."""
    keys = F.array_join(F.array_sort(F.coalesce(F.map_keys("metadata"), F.array().cast("array<string>"))), ",")
    parts = F.struct("entity_id", keys.alias("metadata_keys"), "rule_id", "type")
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


def create(existing: DataFrame, incoming: DataFrame, now: str, hours: int = WINDOW_HOURS) -> DataFrame:
    """The new alerts among incoming rows (type, severity, title, description, entity_type, entity_id, rule_id, triggered_by, metadata).

    Left out are those with the hash of an alert made in the last hours, and all but the first of equal ones (the gravest,
    then by title and description). An incoming column skip_dedup, where true, lets a row pass. Ids come from hash, time and title.
    """
    rows = incoming if "skip_dedup" in incoming.columns else incoming.withColumn("skip_dedup", F.lit(False))
    rows = rows.where(F.col("type").isin(*TYPES) & F.col("severity").isin(*SEVERITIES)).withColumn("alert_hash", alert_hash())
    recent = existing.where(F.col("created_at") >= at(now) - F.expr(f"INTERVAL {hours} HOURS")).select("alert_hash").distinct()
    fresh = rows.where("NOT coalesce(skip_dedup, false)").join(recent, "alert_hash", "left_anti")
    best = Window.partitionBy("alert_hash").orderBy(F.desc(rank(F.col("severity"))), "title", "description")
    fresh = fresh.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
    out = fresh.unionByName(rows.where("coalesce(skip_dedup, false)"))
    none = F.lit(None).cast("timestamp")
    made = out.withColumns({
        "alert_id": F.substring(F.sha2(F.concat_ws("|", "alert_hash", F.lit(now), "title", "description"), 256), 1, 32), "status": F.lit("pending"), "created_at": at(now),
        "acknowledged_at": none, "resolved_at": none, "dismissed_at": none,
    })
    return made.select(*[c.split()[0] for c in ALERT.split(", ")])


def change(alerts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts after the requests, refused requests with a reason).

    requests has alert_id, status, at (timestamp). Of an alert's requests the earliest that NEXT allows is taken, then the
    earliest after it from there on: pending may become acknowledged, and both resolved or dismissed.
    """
    now = alerts.select("alert_id", F.col("status").alias("_from"))
    asked = requests.select("alert_id", "status", "at").join(now, "alert_id", "left")
    final = F.col("status").isin("resolved", "dismissed")
    order = Window.partitionBy("alert_id").orderBy("at", "status")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # what earlier requests of the same alert have led to
    ended = F.coalesce(F.max(F.when(final, 1)).over(before), F.lit(0)) == 1
    noticed = F.coalesce(F.max(F.when(F.col("status") == "acknowledged", 1)).over(before), F.lit(0)) == 1
    reason = (
        F.when(F.col("_from").isNull(), "no such alert")
        .when(~F.col("status").isin("acknowledged", "resolved", "dismissed"), "no such status")
        .when(F.col("_from").isin("resolved", "dismissed") | ended, "the alert is closed")
        .when((F.col("status") == "acknowledged") & ((F.col("_from") == "acknowledged") | noticed), "already acknowledged")
    )
    asked = asked.withColumn("reason", reason)
    taken = asked.where("reason IS NULL")
    times = taken.groupBy("alert_id").agg(
        F.max_by("status", "at").alias("_status"), *[F.min(F.when(F.col("status") == s, F.col("at"))).alias(f"_{s}") for s in ("acknowledged", "resolved", "dismissed")]
    )
    after = alerts.join(times, "alert_id", "left")
    new = {"status": F.coalesce("_status", "status")} | {f"{s}_at": F.coalesce(f"_{s}", f"{s}_at") for s in ("acknowledged", "resolved", "dismissed")}
    return after.withColumns(new).select(*alerts.columns), asked.where("reason IS NOT NULL").select("alert_id", "status", "at", "reason")


def bulk(alerts: DataFrame, ids: list[str], action: str, now: str) -> tuple[DataFrame, DataFrame]:
    """``change`` for a list of alerts; BULK at most, so that a slip of the hand stays small."""
    if len(ids) > BULK:
        raise ValueError(f"{len(ids)} alerts are more than {BULK}")
    spark = alerts.sparkSession
    requests = spark.createDataFrame([(i, ACTIONS[action]) for i in dict.fromkeys(ids)], "alert_id string, status string").withColumn("at", at(now))
    return change(alerts, requests)


def update(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """alerts with title, description, severity or metadata replaced where changes (alert_id, some of these) has a value."""
    columns = [c for c in ("title", "description", "severity", "metadata") if c in changes.columns]
    new = changes.select("alert_id", *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = alerts.join(new, "alert_id", "left")
    for c in columns:
        value = F.when(F.col(f"_new_{c}").isin(*SEVERITIES), F.col(f"_new_{c}")) if c == "severity" else F.col(f"_new_{c}")
        out = out.withColumn(c, F.coalesce(value, F.col(c)))
    return out.select(*alerts.columns)


def delete(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    return alerts.join(ids.select("alert_id"), "alert_id", "left_anti")


def statistics(alerts: DataFrame, now: str) -> DataFrame:
    """One row: alerts by status, type and severity, and those of the last day and week."""

    def n(cond: Column, name: str) -> Column:
        return F.count_if(cond).alias(f"{name}_count")

    since = {h: F.col("created_at") >= at(now) - F.expr(f"INTERVAL {h} HOURS") for h in (24, 168)}
    by = [n(F.col("status") == s, s) for s in NEXT] + [n(F.col("type") == t, t) for t in TYPES] + [n(F.col("severity") == s, s) for s in SEVERITIES]
    return alerts.agg(*by, n(since[24], "last_24h"), n(since[168], "last_7d"))


# -- rules


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"R{i + 1:02d}", *r, True) for i, r in enumerate(RULES)], RULE)


def put_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """rules with those of new added, or in place of those with the same rule_id."""
    return rules.join(new.select("rule_id"), "rule_id", "left_anti").unionByName(new)


def toggle(rules: DataFrame, rule_id: str, enabled: bool | None = None) -> DataFrame:
    """A rule switched on or off, or over if ``enabled`` is not given."""
    now = ~F.col("enabled") if enabled is None else F.lit(enabled)
    return rules.withColumn("enabled", F.when(F.col("rule_id") == rule_id, now).otherwise(F.col("enabled")))


def evaluate(rules: DataFrame, metrics: DataFrame) -> DataFrame:
    """Alerts to create from metrics (entity_type, entity_id, metric, value): one for each that an enabled rule's comparison holds for."""
    r = F.broadcast(rules.where("enabled"))  # as few as people write
    holds = F.expr(
        "CASE comparison WHEN '>=' THEN value >= threshold WHEN '>' THEN value > threshold WHEN '<=' THEN value <= threshold WHEN '<' THEN value < threshold WHEN '=' THEN value = threshold ELSE false END"
    )
    rows = metrics.join(r, "metric").where(holds)
    said = F.concat(F.col("metric"), F.lit(" is "), F.format_number("value", 4), F.lit(", the rule says "), F.col("comparison"), F.lit(" "), F.format_number("threshold", 4))
    return rows.select(
        "type", "severity", F.col("name").alias("title"), said.alias("description"), "entity_type", "entity_id", "rule_id", F.lit("rule_engine").alias("triggered_by"),
        F.create_map(F.lit("metric"), "metric", F.lit("value"), F.col("value").cast("string")).alias("metadata"),
    )


# -- generators: alerts to create, from domain tables


def _row(kind: str, severity: Column | str, title: Column, description: Column, entity: str, by: str, **metadata: Column) -> list[Column]:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return [
        F.lit(kind).alias("type"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), title.alias("title"), description.alias("description"),
        F.lit("Company").alias("entity_type"), F.col(entity).cast("string").alias("entity_id"), F.lit(None).cast("string").alias("rule_id"), F.lit(by).alias("triggered_by"), F.create_map(*pairs).alias("metadata"),
    ]


def _unheard(rows: DataFrame, entity: str, alerts: DataFrame, kind: str, now: str) -> DataFrame:
    """rows whose entity has no alert of the kind in the last WINDOW_HOURS."""
    recent = alerts.where((F.col("type") == kind) & (F.col("created_at") >= at(now) - F.expr(f"INTERVAL {WINDOW_HOURS} HOURS")))
    return rows.join(recent.select(F.col("entity_id").alias("_e")).distinct(), F.col(entity).cast("string") == F.col("_e"), "left_anti")


def from_risk(companies: DataFrame, alerts: DataFrame, now: str, threshold: float = 0.7, critical: float = 0.85, limit: int = 100) -> DataFrame:
    """The riskiest companies (company_id, nome, risk_score) at the threshold that have no recent alert."""
    rows = _unheard(companies.where(F.col("risk_score") >= threshold), "company_id", alerts, "risk_spike", now).orderBy(F.desc("risk_score"), "company_id").limit(limit)
    said = F.concat(F.lit("Risk score "), F.round("risk_score", 4).cast("string"))
    return rows.select(*_row("risk_spike", F.when(F.col("risk_score") >= critical, "critical").otherwise("high"), F.concat(F.lit("High Risk: "), F.col("nome")), said, "company_id", "risk_monitor", risk_score=F.col("risk_score")))


def from_patterns(patterns: DataFrame, alerts: DataFrame, now: str, limit: int = 50) -> DataFrame:
    """Patterns (pattern_id, pattern, severity, description, detected_at, company_ids) of the last WINDOW_HOURS that no alert names, newest first."""
    known = alerts.where("type = 'fraud_pattern'").select(F.col("metadata").getItem("fraud_pattern_id").alias("pattern_id")).where("pattern_id IS NOT NULL").distinct()
    rows = patterns.where(F.col("detected_at") >= at(now) - F.expr(f"INTERVAL {WINDOW_HOURS} HOURS")).join(known, "pattern_id", "left_anti").orderBy(F.desc("detected_at"), "pattern_id").limit(limit)
    rows = rows.withColumn("_first", F.get("company_ids", F.lit(0)))
    severity = F.when(F.col("severity").isin("critical", "high", "medium", "low"), F.col("severity")).otherwise("medium")
    return rows.select(*_row(
        "fraud_pattern", severity, F.concat(F.lit("Fraud Pattern: "), F.col("pattern")), F.coalesce("description", F.lit("Fraud pattern detected")), "_first", "fraud_detector",
        fraud_pattern_id=F.col("pattern_id"), pattern_name=F.col("pattern"),
    ))


def from_activity(wins: DataFrame, alerts: DataFrame, now: str, recent_days: int = 90, days: int = 365, least: int = 5, ratio: float = 3.0, limit: int = 50) -> DataFrame:
    """Companies with more than ``least`` wins in the last days, ``ratio`` times those of the rest of the year; they must have some there."""
    day, end = F.col("data_aggiudicazione"), F.to_date(F.lit(now))
    late = day >= F.date_sub(end, recent_days)
    rows = wins.where((day >= F.date_sub(end, days)) & (day <= end)).groupBy("company_id").agg(F.count_if(late).alias("recent"), F.count_if(~late).alias("earlier"))
    rows = rows.withColumn("ratio", F.try_divide(F.col("recent"), F.col("earlier"))).where((F.col("recent") > least) & (F.col("ratio") > ratio))
    rows = _unheard(rows, "company_id", alerts, "activity_spike", now).orderBy(F.desc("ratio"), "company_id").limit(limit)
    said = F.concat(F.col("recent").cast("string"), F.lit(f" tenders won in {recent_days} days, "), F.col("earlier").cast("string"), F.lit(" before"))
    return rows.select(*_row("activity_spike", "medium", F.lit("Tender Volume Spike"), said, "company_id", "activity_monitor", recent_wins=F.col("recent"), historical_wins=F.col("earlier"), volume_ratio=F.round("ratio", 2)))


def merge_pairs(companies: DataFrame) -> DataFrame:
    """(a, b), a < b: companies (company_id, cf, nome, provincia, cod_istat) that may be one; their tax codes and names differ.

    Either both are in one province and each name has the other's first word among its words, or both are in one
    municipality and their first four letters are the same, with names of more than three. Companies with the same first
    word in a province, or the same four letters in a municipality, are a class: each is paired with the class's first
    one that it differs from, not with all others; so no company that differs from any of its class is left out.
    """
    name = F.lower("nome")
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    c = companies.where("nome IS NOT NULL").select("company_id", "cf", "provincia", "cod_istat", name.alias("n"), words.alias("ws")).where(F.size("ws") > 0)
    c = c.withColumns({"w": F.col("ws")[0], "four": F.when(F.char_length("n") > 3, F.substring("n", 1, 4))})

    def by_class(*keys: str) -> DataFrame:
        """Each row with the first of its class that differs from it in code and name: one of five, whatever the class's size."""
        rows = c.where(" AND ".join(f"{k} IS NOT NULL" for k in (*keys, "cf"))).select(*keys, "company_id", "cf", "n")
        me = F.struct("company_id", "cf", "n")

        def with_first(rows: DataFrame, **which) -> DataFrame:
            return rows.join(rows.groupBy(*keys).agg(*[F.min(F.when(on, me)).alias(k) for k, on in which.items()]), list(keys))

        def differs(k: str, of: str):
            return F.col(k) != F.col(f"{of}.{k}")

        # the first of all; the first that differs from it in name, in code, in both; and for rows like those again in the other
        name, code = differs("n", "x"), differs("cf", "x")
        rows = with_first(with_first(rows, x=F.lit(True)), s=name, t=code, u=name & code)
        rows = with_first(rows, s2=name & differs("cf", "s"), t2=code & differs("n", "t"))
        same_name = F.when(differs("cf", "s"), F.col("s")).otherwise(F.col("s2"))
        same_code = F.when(differs("n", "t"), F.col("t")).otherwise(F.col("t2"))
        other = F.when(name & code, F.col("x")).when(~name & ~code, F.col("u")).when(code, same_name).otherwise(same_code)
        met = rows.select("company_id", other["company_id"].alias("o")).where("o IS NOT NULL")
        return met.select(F.least("company_id", "o").alias("a"), F.greatest("company_id", "o").alias("b"))

    both = c.select("company_id", "cf", "n", "provincia", "w", F.explode(F.array_distinct("ws")).alias("u")).where("u <> w").withColumns({"lo": F.least("w", "u"), "hi": F.greatest("w", "u")})
    x = both.where("w = lo").select("provincia", "lo", "hi", *[F.col(k).alias(f"{k}_x") for k in ("company_id", "cf", "n")])
    y = both.where("w = hi").select("provincia", "lo", "hi", *[F.col(k).alias(f"{k}_y") for k in ("company_id", "cf", "n")])
    crossed = x.join(y, ["provincia", "lo", "hi"]).where("cf_x <> cf_y AND n_x <> n_y").select(F.least("company_id_x", "company_id_y").alias("a"), F.greatest("company_id_x", "company_id_y").alias("b"))
    return by_class("provincia", "w").union(by_class("cod_istat", "four")).union(crossed).distinct()


def from_merges(companies: DataFrame, alerts: DataFrame, now: str, limit: int = 50) -> DataFrame:
    pairs = _unheard(_unheard(merge_pairs(companies), "a", alerts, "merge_candidate", now), "b", alerts, "merge_candidate", now).orderBy("a", "b").limit(limit)
    names = companies.select(F.col("company_id").alias("_c"), F.col("nome").alias("_n"))
    rows = pairs.join(names.toDF("a", "name_a"), "a").join(names.toDF("b", "name_b"), "b")
    said = F.concat(F.col("name_a"), F.lit(" and "), F.col("name_b"), F.lit(" may be one company"))
    return rows.select(*_row("merge_candidate", "low", F.concat(F.lit("Duplicate Company Found: "), F.col("name_a")), said, "a", "merge_detector", duplicate_entity_id=F.col("b"), match_reason=F.lit("name_similarity")))


def run_all(existing: DataFrame, generators: dict[str, Callable[[], DataFrame]], now: str) -> tuple[DataFrame, dict[str, str]]:
    """(new alerts, errors by generator): a generator that fails stops no other; what an earlier one made counts as existing."""
    from veritrace.operators.components import cut

    made, errors = existing.limit(0).select(*[c.split()[0] for c in ALERT.split(", ")]), {}
    for name, f in generators.items():
        try:
            made = cut(made.unionByName(create(existing.select(*made.columns).unionByName(made), f(), now)))
        except Exception as e:  # noqa: BLE001 - told to the caller
            errors[name] = f"{type(e).__name__}: {e}"
    return made, errors


def notices(alerts: DataFrame, least: str = "high") -> DataFrame:
    """(alert_id, channel, text): every alert goes to the log, those of a severity or graver to people too, gravest first."""
    text = F.format_string("[%s] %s: %s", F.upper("severity"), "title", "description")
    r = rank(F.col("severity"))
    channels = F.when(r >= 5 - SEVERITIES.index(least), F.array(F.lit("log"), F.lit("desktop"))).otherwise(F.array(F.lit("log")))
    return alerts.orderBy(F.desc(r), "created_at", "alert_id").select("alert_id", F.explode(channels).alias("channel"), text.alias("text"))
