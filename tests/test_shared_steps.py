"""Steps that many queries share: how often rows are dealt out, and exact first rows of few pairs."""

from types import SimpleNamespace

import numpy as np
import pytest

from veritrace.operators import graph
from veritrace.plans import detectors
from veritrace.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_orders_are_dealt_out_once_for_subcontracts(spark):
    assert plan(Tables(spark, SF).subcontracts_to).count("Exchange ") == 1


@pytest.mark.parametrize("few", [1, 64])
def test_board_overlap_of_first_pairs(spark, monkeypatch, few):
    """Pairs that share most persons share no buyer, so that later ones have to be looked at, too."""
    monkeypatch.setattr(detectors, "FEW_PAIRS", few, raising=False)
    boards = [(p, c) for p in range(6) for c in (1, 2)] + [(p, c) for p in range(10, 14) for c in (3, 4)] + [(p, c) for p in range(20, 22) for c in (5, 6, 7)]
    wins = [(1, 1), (2, 2), (3, 8), (4, 8), (4, 8), *[(c, b) for c in (5, 6, 7) for b in (1, 2, 9)]]
    t = SimpleNamespace(represents=spark.createDataFrame(boards, "person_id long, company_id long"), wins=spark.createDataFrame(wins, "company_id long, buyer_id long"))
    every = [(3, 4, 8, 4), *[(a, b, k, 2) for a, b in ((5, 6), (5, 7), (6, 7)) for k in (1, 2, 9)]]
    for limit in (1, 2, 3, 5, 50, None):
        rows = [tuple(r)[:4] for r in detectors.board_overlap_collusion(t, limit=limit).collect()]
        assert rows == every[:limit]
    looked = []
    monkeypatch.setattr(detectors, "_marked", lambda df, *a, f=detectors._marked: looked.append(plan(df)) or f(df, *a))
    detectors.board_overlap_collusion(t, limit=1)
    assert len(looked) > 1  # the first pair alone is asked first


def test_rank_by_blocks(spark, monkeypatch):
    """Whole-number nodes, some without an edge to many others, loops, nulls and repeated edges: the same ranks as by plain rounds, in blocks."""
    monkeypatch.setattr(graph, "BLOCK_EDGES", 200, raising=False)
    r = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in r.integers(-40, 400, (700, 2))] + [(5, int(b)) for b in range(500, 700)] + [(3, 3), (7, 8), (8, 7)]
    df = spark.createDataFrame([*pairs, (None, 4), (4, None)], "src long, dst long")
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = dict.fromkeys(near, 0.15)
    for _ in range(20):
        want = {v: 0.15 + 0.85 * sum(want[u] / len(near[u]) for u in near[v]) for v in near}
    blocks = []
    monkeypatch.setattr(graph, "_block_ranks", lambda *a, f=getattr(graph, "_block_ranks", None): blocks.append(1) or f(*a), raising=False)
    got = {x["node"]: x["rank"] for x in graph.pagerank(df, 20, directed=False).collect()}
    assert got == pytest.approx(want, abs=1e-9) and blocks
    assert graph.pagerank(df.limit(0), 20, directed=False).count() == 0


ODD_LINES = [(1, 1, 7, 5, "1996-03-02"), (1, 2, 7, 4, "1996-03-01"), (1, 3, 8, 6, "1996-04-01"), (2, 1, 7, 9, "1996-05-01"), (2, 2, None, 8, None), (3, 1, 9, 3, "1996-06-01"), (3, 2, 9, 3, "1996-06-01"), (None, 1, 9, 1, "1996-07-01"), (4, 1, 9, 1, "1996-07-01")]


def small_tables(spark):
    lines = spark.createDataFrame(ODD_LINES, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_shipdate string")
    orders = spark.createDataFrame([(k, float(k), "1996-01-01", "p", k % 2) for k in (1, 2, 3, 5)], "o_orderkey long, o_totalprice double, o_orderdate string, o_orderpriority string, o_custkey long")
    return Tables(spark, SF, {"lineitem": lines, "orders": orders})


@pytest.mark.parametrize("lines", [1, 1_000_000])
def test_wins_in_parts_of_some_lines(spark, monkeypatch, lines):
    """The same wins in many parts as in few; a part has no more lines however many there are, and nothing is held by pair of order and supplier."""
    from veritrace.sources import tables

    monkeypatch.setattr(tables, "LINES", lines, raising=False)
    t = small_tables(spark)
    got = sorted((r["tender_id"], -1 if r["company_id"] is None else r["company_id"], str(r["data_aggiudicazione"]), r["single_bidder"], r["project_id"], r["buyer_id"]) for r in t.wins.collect())
    assert got == [(1, 7, "1996-03-01", False, 4, 1), (1, 8, "1996-03-01", False, 4, 1), (2, -1, "1996-05-01", True, 8, 0), (2, 7, "1996-05-01", True, 8, 0), (3, 9, "1996-06-01", True, 3, 1)]
    assert sorted((r["tender_id"], r["single_bidder"], r["project_id"]) for r in t.tender.collect()) == [(1, False, 4), (2, True, 8), (3, True, 3)]
    assert t.parts == (9 if lines == 1 else 0)
    assert "HashAggregate" not in plan(t.wins)


def test_link_changes_joins_nothing(spark):
    from pyspark.sql import functions as F

    from veritrace.operators import upsert

    e = spark.createDataFrame([(1, "W", 1, True, True), (1, "W", 2, True, False), (1, "W", 3, False, True), (1, "W", 4, False, False), (None, "W", 5, True, True), (2, "W", 6, None, True), (2, "W", None, True, True)], "src long, kind string, dst long, a boolean, b boolean")
    got = upsert.link_changes(e, F.col("a"), F.col("b"))
    want = upsert.link_diff(e.where("a"), e.where("b"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(want) and len(key(got)) == 7
    assert "Exchange" not in plan(got)


@pytest.mark.parametrize("report", ["fraud_summary", "fraud_flags", "risk_after_findings", "latest_findings"])
def test_reports_raise_when_a_detector_fails(spark, monkeypatch, report):
    """What the other detectors found must not pass for the whole report."""

    def works(t):
        return spark.createDataFrame([(1, "high", 0.5)], "company_id long, severity string, score double")

    def fails(t):
        raise ValueError("no such column")

    t = SimpleNamespace(spark=spark, company=spark.createDataFrame([(1, 0.1), (2, 0.2)], "company_id long, risk_score double"))
    t.keep = lambda *_: t
    monkeypatch.setattr(detectors, "DETECTORS", {"works": (works, {}, "", ("company_id",))})
    assert getattr(detectors, report)(t).count() > 0
    monkeypatch.setitem(detectors.DETECTORS, "fails", (fails, {}, "", ("company_id",)))
    with pytest.raises(RuntimeError, match="fails.*no such column"):
        getattr(detectors, report)(t)
