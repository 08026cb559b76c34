"""Alerts: repeats within a day, status changes, rules and generators."""

import datetime as dt
import random

import pytest

from veritrace.operators import alerts as al

NOW = "2024-05-02 12:00:00"
IN = "type string, severity string, title string, description string, entity_type string, entity_id string, rule_id string, triggered_by string, metadata map<string,string>"


def wanted(spark, *rows):
    return spark.createDataFrame([(t, s, title, "d", "Company", e, None, "x", m) for t, s, title, e, m in rows], IN)


def empty(spark):
    return spark.createDataFrame([], al.ALERT)


def test_create_without_repeats(spark):
    first = al.create(empty(spark), wanted(spark, ("risk_spike", "low", "A", "1", {"k": "1"}), ("risk_spike", "critical", "B", "1", {"k": "2"}), ("risk_spike", "high", "C", "1", {"q": "2"}), ("nonsense", "high", "D", "1", None), ("merge_candidate", "odd", "E", None, None)), NOW)
    assert sorted((r["title"], r["status"]) for r in first.collect()) == [("B", "pending"), ("C", "pending")]
    again = wanted(spark, ("risk_spike", "low", "A", "1", {"k": "9"}), ("risk_spike", "low", "A", None, {"k": "9"}))
    assert [r["entity_id"] for r in al.create(first, again, "2024-05-03 11:00:00").collect()] == [None]
    assert al.create(first, again, "2024-05-03 13:00:00").count() == 2
    assert al.create(first, again.selectExpr("*", "true AS skip_dedup"), "2024-05-02 13:00:00").count() == 2


def test_status_changes(spark):
    made = al.create(empty(spark), wanted(spark, *[("risk_spike", "low", str(i), str(i), None) for i in range(6)]), NOW)
    ids = {r["title"]: r["alert_id"] for r in made.collect()}
    t = lambda h: dt.datetime(2024, 5, 3, h)
    asked = [(ids["0"], "acknowledged", t(1)), (ids["0"], "resolved", t(2)), (ids["0"], "dismissed", t(3)), (ids["1"], "resolved", t(2)), (ids["1"], "acknowledged", t(4)), (ids["2"], "acknowledged", t(1)), (ids["2"], "acknowledged", t(2)), (ids["3"], "pending", t(1)), ("none", "resolved", t(1)), (ids["5"], "dismissed", t(9))]
    after, refused = al.change(made, spark.createDataFrame(asked, "alert_id string, status string, at timestamp"))
    by = {r["title"]: r for r in after.collect()}
    assert [by[str(i)]["status"] for i in range(6)] == ["resolved", "resolved", "acknowledged", "pending", "pending", "dismissed"]
    assert (by["0"]["acknowledged_at"], by["0"]["resolved_at"], by["0"]["dismissed_at"]) == (t(1), t(2), None)
    assert sorted(r["reason"] for r in refused.collect()) == ["already acknowledged", "no such alert", "no such status", "the alert is closed", "the alert is closed"]
    again, refused = al.bulk(after, [ids["4"], ids["5"], ids["4"]], "dismiss", "2024-05-04 00:00:00")
    assert again.where("status = 'dismissed'").count() == 2 and refused.count() == 1
    with pytest.raises(ValueError):
        al.bulk(after, ["x"] * 101, "dismiss", NOW)
    assert al.delete(after, after.where("title = '1'")).count() == 5
    s = al.statistics(again, "2024-05-02 13:00:00").first()
    assert (s["pending_count"], s["acknowledged_count"], s["resolved_count"], s["dismissed_count"], s["risk_spike_count"], s["low_count"], s["last_24h_count"]) == (1, 1, 2, 2, 6, 6, 6)
    new = al.update(after, spark.createDataFrame([(ids["0"], "high", None), (ids["1"], "odd", "T")], "alert_id string, severity string, title string"))
    assert sorted((r["title"], r["severity"]) for r in new.collect() if r["alert_id"] in (ids["0"], ids["1"])) == [("0", "high"), ("T", "low")]


def test_rules(spark):
    rules = al.default_rules(spark)
    m = spark.createDataFrame([("Company", "1", "risk_score", 0.7), ("Company", "2", "risk_score", 0.69), ("Company", "3", "volume_ratio", 3.0), ("Company", "4", "volume_ratio", 3.1), ("Company", "5", "other", 9.0)], "entity_type string, entity_id string, metric string, value double")
    assert sorted(r["entity_id"] for r in al.evaluate(rules, m).collect()) == ["1", "4"]
    off = al.toggle(rules, "R01")
    assert sorted(r["entity_id"] for r in al.evaluate(off, m).collect()) == ["4"]
    lower = al.put_rules(off, rules.where("rule_id = 'R01'").selectExpr("rule_id", "name", "type", "metric", "comparison", "0.5D AS threshold", "severity", "true AS enabled"))
    assert sorted(r["entity_id"] for r in al.evaluate(lower, m).collect()) == ["1", "2", "4"] and lower.count() == 8


def test_merge_pairs_lose_no_company(spark):
    """Small classes with few codes and names, against each row's first partner by all pairs."""
    r = random.Random(1)
    rows = [(i, r.choice(["A", "B", "C", None]), "rossi " + r.choice(["uno", "due", "tre"]), f"P{r.randrange(12)}", None) for i in range(70)]
    rows += [(100, "A", "rossi uno", "X", None), (101, "A", "rossi due", "X", None), (102, "B", "rossi uno", "X", None)]
    got = {(x["a"], x["b"]) for x in al.merge_pairs(spark.createDataFrame(rows, "company_id long, cf string, nome string, provincia string, cod_istat string")).collect()}
    want = set()
    for a in rows:
        others = [b[0] for b in rows if a[1] and b[1] and a[3] == b[3] and a[1] != b[1] and a[2] != b[2]]
        if others:
            want.add((min(a[0], min(others)), max(a[0], min(others))))
    assert got == want and (101, 102) in want


def test_generators(spark):
    c = spark.createDataFrame([(1, "A1", "Alfa Costruzioni", "RM", "H5", 0.9), (2, "B2", "Nuova Alfa Costruzioni", "RM", "H5", 0.7), (3, "C3", "Beta", "RM", "H5", 0.1), (4, "D4", "Betaville", "MI", "H5", 0.75), (5, "E5", None, "RM", "H5", None), (6, "F6", "Nuova Gamma", "RM", "X", 0.0), (7, "A1", "Alfa", "RM", "K", 0.0), (8, "G8", "Costruzioni Alfa", "RM", "Z", 0.0), (9, "G9", "  ", "RM", "H5", 0.0)], "company_id long, cf string, nome string, provincia string, cod_istat string, risk_score double")
    assert {(r["a"], r["b"]) for r in al.merge_pairs(c).collect()} == {(2, 6), (3, 4), (1, 8)}
    old = al.create(empty(spark), wanted(spark, ("risk_spike", "low", "x", "2", None)), NOW)
    rows = al.from_risk(c, old, "2024-05-03 00:00:00").collect()
    assert [(r["entity_id"], r["severity"]) for r in rows] == [("1", "critical"), ("4", "high")]
    days = [(1, dt.date(2024, 4, 20))] * 7 + [(1, dt.date(2023, 9, 1))] * 2 + [(2, dt.date(2024, 4, 1))] * 9 + [(3, dt.date(2024, 4, 1))] * 6 + [(3, dt.date(2023, 10, 1))] * 2
    w = spark.createDataFrame(days, "company_id long, data_aggiudicazione date")
    assert [r["entity_id"] for r in al.from_activity(w, old, NOW).collect()] == ["1"]
    p = spark.createDataFrame([("p1", "ubo", "critical", "x", dt.datetime(2024, 5, 2, 1), [9]), ("p2", "ring", "weird", None, dt.datetime(2024, 5, 2, 2), []), ("p3", "old", "low", None, dt.datetime(2024, 4, 2), [1])], "pattern_id string, pattern string, severity string, description string, detected_at timestamp, company_ids array<long>")
    assert [(r["title"], r["severity"], r["entity_id"]) for r in al.from_patterns(p, old, NOW).collect()] == [("Fraud Pattern: ring", "medium", None), ("Fraud Pattern: ubo", "critical", "9")]
    made, errors = al.run_all(old, {"risk": lambda: al.from_risk(c, old, NOW), "bad": lambda: 1 / 0, "merge": lambda: al.from_merges(c, old, NOW)}, NOW)
    assert made.count() == 5 and list(errors) == ["bad"]
    assert [r["channel"] for r in al.notices(made).collect()].count("desktop") == 2
