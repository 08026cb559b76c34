"""Logs of runs, batches claimed by content, average linkage and words in common."""

import itertools
import random

import pytest

from veritrace.operators import linkage, runs

T = ["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00"]


def test_snapshots(spark, tmp_path):
    log = str(tmp_path / "risk")
    assert runs.latest_scores(runs.risk_log(spark, log)).collect() == []
    c = spark.createDataFrame([(1, 0.5), (2, 0.0), (3, None)], "company_id long, risk_score double")
    runs.snapshot_risk(c, log, "a", T[0])
    runs.snapshot_risk(c.withColumn("risk_score", c["risk_score"] + 0.25), log, "b", T[1])
    runs.snapshot_risk(c.withColumn("risk_score", c["risk_score"] + 0.25), log, "b", T[1])
    assert sorted(tuple(r) for r in runs.latest_scores(runs.risk_log(spark, log)).collect()) == [(1, 2, 0.75, 0.5), (2, 1, 0.25, None)]
    assert runs.risk_log(spark, log).select("run").distinct().count() == 2


def test_findings(spark, tmp_path):
    log = str(tmp_path / "found")
    rows = [("ring", "high", 1, 0.5), ("ring", "high", 2, 0.5), ("ubo", "critical", 1, 0.9), ("odd", "strange", 9, 0.1)]
    links = spark.createDataFrame(rows, "pattern string, severity string, company_id long, score double")
    for run, at in (("a", T[0]), ("b", T[1]), ("b", T[1])):
        runs.keep_findings(links, log, run, at)
    got = [(r["pattern"], str(r["at"]), r["affected"]) for r in runs.latest_findings(runs.findings_log(spark, log)).collect()]
    assert got == [("ubo", T[1], 1), ("ubo", T[0], 1), ("ring", T[1], 2), ("ring", T[0], 2), ("odd", T[1], 1), ("odd", T[0], 1)]


def test_batches_are_claimed_by_content(spark, tmp_path):
    log, clock, seen = str(tmp_path / "log"), itertools.count(), []
    now = lambda: f"2024-01-01 00:{next(clock):02}:00"

    def rows(*values):
        return spark.createDataFrame([(v, None) for v in values], "v int, w string")

    def load(name, df, bad=()):
        if name in bad:
            raise RuntimeError("broke off")
        seen.append((name, df.count()))

    batches = [("x", rows(1, 2)), ("y", rows(3)), ("z", rows(4))]
    with pytest.raises(RuntimeError):
        runs.run_claimed(spark, log, "s", batches, lambda n, d: load(n, d, ("y",)), now)
    assert {(r["batch"], r["status"]) for r in runs.claims(spark, log).collect()} == {("x", "completed"), ("y", "failed")}
    assert runs.run_claimed(spark, log, "s", batches, load, now) == ["y", "z"]
    assert runs.run_claimed(spark, log, "s", [("x", rows(2, 1).repartition(3)), *batches[1:]], load, now) == []
    assert runs.run_claimed(spark, log, "s", [("x", rows(1, 2, 2)), *batches[1:]], load, now) == ["x"]
    assert runs.run_claimed(spark, log, "other", batches[:1], load, now) == ["x"]
    assert seen == [("x", 2), ("y", 1), ("z", 1), ("x", 3), ("x", 2)]


def test_sync(spark, tmp_path):
    log = str(tmp_path / "sync")
    assert not runs.should_skip(spark, log, "s", T[1])
    runs.record_sync(spark, log, "s", T[0], 5)
    runs.record_sync(spark, log, "s", T[1], 7)
    assert [r["rows_written"] for r in runs.sync_history(spark, log, "s").collect()] == [7, 5]
    assert runs.should_skip(spark, log, "s", "2024-01-02 23:59:00") and not runs.should_skip(spark, log, "s", T[2]) and not runs.should_skip(spark, log, "t", T[1])


def plain_linkage(scores, least):
    ids = sorted({x for a, b, _ in scores for x in (a, b)})
    s = {(min(a, b), max(a, b)): v for a, b, v in scores}
    groups = [[i] for i in ids]
    while True:
        best = None
        for x, y in itertools.combinations(sorted(groups), 2):
            m = sum(s.get((min(i, j), max(i, j)), 0.0) for i in x for j in y) / len(x) / len(y)
            if m >= least and (best is None or m > best[0] + 1e-11):
                best = (m, x, y)
        if best is None:
            return {i: g[0] for g in groups for i in g}
        groups = [g for g in groups if g not in best[1:]] + [sorted(best[1] + best[2])]


def test_average_linkage(spark):
    r = random.Random(3)
    scores = [(i, j, r.choice([0.9, 0.8, r.random()]) if i % 4 == j % 4 else r.random() / 2) for i, j in itertools.combinations(range(22), 2) if r.random() < 0.6]
    df = spark.createDataFrame([(b, a, v) for a, b, v in scores] + [(1, 1, 1.0), (None, 2, 1.0)], "a long, b long, score double")
    got = {x["id"]: x["cluster"] for x in linkage.average_linkage(df, 0.45).collect()}
    assert got == plain_linkage(scores, 0.45) and 2 < len(set(got.values())) < 22
    assert linkage.average_linkage(df.limit(0), 0.5).collect() == []


def test_common_words(spark):
    r = random.Random(4)
    rows = [(i, r.sample("abcdefghijkl", r.randint(0, 6)) + ["a"] * r.randint(0, 2)) for i in range(70)] + [(100, None), (None, ["a", "b"]), (101, ["a", None, "b"]), (102, ["b", "a"])]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    for least in (1, 2, 3):
        got = sorted(tuple(x) for x in linkage.common_words(df, linkage.F.col("words"), least).collect())
        first = {}
        sets = {i: frozenset(w for w in ws or [] if w) for i, ws in rows if i is not None}
        for i in sorted(sets):
            first.setdefault(sets[i], i)
        want = [(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(first.values()), 2) if len(sets[a] & sets[b]) >= least]
        want += [(first[s], i, len(s)) for i, s in sets.items() if first[s] != i and len(s) >= least]
        assert got == sorted(want)
