"""Hand fixtures for operators that SQL does not check, and a sample of queries against DuckDB."""

import random

import duckdb
import pytest
import __spark_entry__ as entry
from veritrace.operators import graph, scoring
from veritrace.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_components(spark):
    assert as_dict(graph.connected_components(edges(spark, (1, 2), (3, 4), (4, 5), (9, 5)))) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 9: 3}


def test_strong_components(spark):
    assert as_dict(graph.strong_components(edges(spark, (1, 2), (2, 3), (3, 1), (3, 4)))) == {1: 1, 2: 1, 3: 1, 4: 4}


def test_triangles_and_star(spark):
    assert as_dict(graph.triangles(edges(spark, (1, 2), (2, 3), (1, 3), (3, 4)))) == {1: 1, 2: 1, 3: 1, 4: 0}
    star = edges(spark, (0, 1), (0, 2), (0, 3), (0, 4))
    assert as_dict(graph.betweenness(star))[0] == 6.0
    ranks = as_dict(graph.pagerank(star, directed=False))
    assert ranks[0] > ranks[1]


def test_cycles(spark):
    assert [r["chain"] for r in graph.cycles(edges(spark, (2, 3), (3, 1), (1, 2), (3, 4))).collect()] == [[1, 2, 3]]


def test_shell_scores_by_hand(spark):
    rows = [(2, 3, 4, None, 2022, 12, None, 1), (40, 0, 0, False, 2010, 60, True, 9), (1, 50, 6, False, None, 0, False, 0)]
    df = spark.createDataFrame(rows, "wins int, employees int, depth int, vat_active boolean, last_filing_year int, boards int, sub_only boolean, shared_address int")
    got = [(round(r["shell_score"], 6), r["risk_tier"]) for r in scoring.enhanced_shell(df, 2023).collect()]
    a = 0.30 * (2 / 3 + 0.4 + 0.4) / 3 + 0.15 * 0.4 + 0.10 / 3
    b = 0.30 * 2 / 3 + 0.15 * 3 + 0.20
    c = 0.30 * (1 / 3 + 0.6) / 3 + 0.15 * 0.5 + 0.05 * 0.75
    assert got == [(round(a, 6), "LOW_RISK"), (round(b, 6), "HIGH_RISK"), (round(c, 6), "LOW_RISK")]


def test_betweenness_both_ways(spark, monkeypatch):
    e = edges(spark, (1, 2), (2, 3), (3, 4), (4, 1), (4, 5), (5, 6), (7, 8))
    few = as_dict(graph.betweenness(e))
    monkeypatch.setattr(graph, "TASK_EDGES", 0)
    many = as_dict(graph.betweenness(e))
    assert {k: round(v, 9) for k, v in few.items()} == {k: round(v, 9) for k, v in many.items()} == {1: 1.5, 2: 0.5, 3: 1.5, 4: 6.5, 5: 4.0, 6: 0.0, 7: 0.0, 8: 0.0}


def test_sampled_betweenness(spark):
    r = random.Random(3)
    pairs = [(i, r.randrange(i)) for i in range(1, 60)] + [(r.randrange(60), r.randrange(60)) for _ in range(30)]
    e = edges(spark, *pairs)
    exact = {x["node"]: x["betweenness"] for x in graph.betweenness(e).collect()}
    whole = {x["node"]: (x["betweenness"], x["bound"]) for x in graph.sampled_betweenness(e, 10**6).collect()}
    assert whole.keys() == exact.keys() and all(abs(b - exact[k]) < 1e-6 and d == 0 for k, (b, d) in whole.items())
    some = {x["node"]: (x["betweenness"], x["bound"]) for x in graph.sampled_betweenness(e, 40).collect()}
    assert all(0 < d and abs(b - exact[k]) <= d for k, (b, d) in some.items())
    order = [sorted(exact, key=f) for f in (lambda k: (exact[k], k), lambda k: (some[k][0], k))]
    rank = [{k: i for i, k in enumerate(o)} for o in order]
    n = len(exact)
    assert 1 - 6 * sum((rank[0][k] - rank[1][k]) ** 2 for k in exact) / (n * (n * n - 1)) > 0.9


def test_cycles_and_paths_with_a_limit(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 1), (3, 4), (4, 1), (2, 4), (4, 5), (5, 2), (2, 2))
    every = sorted((r["length"], r["chain"]) for r in graph.cycles(e).collect())
    assert every == [(3, [1, 2, 3]), (3, [1, 2, 4]), (3, [2, 4, 5]), (4, [1, 2, 3, 4]), (4, [2, 3, 4, 5])]
    for n in range(1, 7):
        assert sorted((r["length"], r["chain"]) for r in graph.cycles(e, limit=n).collect()) == every[:n]
    start = spark.createDataFrame([(1,)], "start long")
    walked = sorted((r["hops"], r["chain"]) for r in graph.paths(e, start, 4).collect())
    for n in (1, 3, 5, 50):
        assert sorted((r["hops"], r["chain"]) for r in graph.paths(e, start, 4, limit=n).collect()) == walked[:n]


def test_many_strong_components(spark):
    e = [(3 * k + a, 3 * k + b) for k in range(12) for a, b in ((0, 1), (1, 2), (2, 0))] + [(3 * k, 3 * k + 4) for k in range(11)]
    assert as_dict(graph.strong_components(edges(spark, *e))) == {i: i // 3 * 3 for i in range(36)}


def test_diamond_is_counted_once(spark):
    from types import SimpleNamespace

    from veritrace.plans.algorithms import corporate_family

    owners = spark.createDataFrame([(10, 1), (11, 1), (99, 10), (99, 11)], "owner_id long, company_id long")
    assert [tuple(r) for r in corporate_family(SimpleNamespace(shareholder_of=owners)).collect()] == [(99, 3)]


def test_similar_sets_by_brute_force(spark):
    import random

    from veritrace.operators import resolve

    r = random.Random(2)
    sets = [sorted(r.sample("abcdefghij", r.randint(0, 5))) for _ in range(120)]
    got = {(x["a"], x["b"]): round(x["similarity"], 6) for x in resolve.similar_sets(spark.createDataFrame(list(enumerate(sets)), "id long, w array<string>"), 0.6).collect()}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    want = {(first[tuple(s)], i): 1.0 for i, s in enumerate(sets) if s and first[tuple(s)] != i}
    for s, i in first.items():
        for t, j in first.items():
            if s and t and i < j and len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.6:
                want[i, j] = round(len(set(s) & set(t)) / len(set(s) | set(t)), 6)
    assert got == want


def test_detector_defaults(spark):
    """Thresholds that investigators work with: on both sides of each."""
    import datetime as dt
    from types import SimpleNamespace

    from veritrace.plans import detectors as d

    day = lambda n: dt.date(2001, 12, 31) - dt.timedelta(days=n)
    w = [(1, 10 + i, 7, 1000.0, day(i)) for i in range(3)] + [(2, 20 + i, 7, 39_999.0, day(80 + i)) for i in range(3)] + [(3, 30 + i, 7, 50.0, day(400)) for i in range(5)] + [(4, 40, 7, 50.0, day(0))]
    wins = spark.createDataFrame([(c, t, b, v, x, x - dt.timedelta(days=t % 9)) for c, t, b, v, x in w], "company_id long, tender_id long, buyer_id long, importo double, data_aggiudicazione date, data_apertura date")
    t = SimpleNamespace(wins=wins)
    assert [(r["rotation"], r["total_wins"], r["severity"], r["score"]) for r in d.bid_rotation(t).collect()] == [("1,2", 6, "high", 0.7)]
    assert [(r["company_id"], r["tender_count"]) for r in d.split_tendering(t).collect()] == [(1, 3), (2, 3)]
    short = d.short_award_window(t).collect()
    assert {(r["award_days"], r["severity"], r["score"]) for r in short} == {(x % 9, "critical" if x % 9 <= 1 else "high", 0.8 if x % 9 <= 1 else 0.6) for _, x, *_ in w if x % 9 < 7}
    p = [(1, 2)] * 4 + [(1, 3)] + [(5, 6)] * 3 + [(5, 7)] + [(8, 9)] * 2
    subs = spark.createDataFrame([(a, b, str(i)) for i, (a, b) in enumerate(p)], "src long, dst long, cig string")
    assert [(r["winner"], r["subcontractor"], r["ratio"]) for r in d.subcontractor_concentration(SimpleNamespace(subcontracts_to=subs)).collect()] == [(1, 2, 0.8)]
    links = spark.createDataFrame([(1, "a", "high", 0.5), (1, "b", "critical", 0.5), (2, "a", "low", 0.5)], "company_id long, pattern string, severity string, score double")
    risk = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.5)], "company_id long, score double")
    assert {r["company_id"]: r["score"] for r in d.bumped(risk, links).collect()} == {1: 1.0, 2: 0.55, 3: 0.5}


def test_ring_with_and_without_a_limit(spark):
    import random
    from types import SimpleNamespace

    from veritrace.plans import detectors as d

    r = random.Random(9)
    bids = sorted({(r.randrange(14), t) for t in range(90) for _ in range(2)})
    wins = spark.createDataFrame([(c, t, t % 3) for c, t in bids], "company_id long, tender_id long, buyer_id long")
    company = spark.createDataFrame([(c, c % 2 if c else None) for c in range(14)], "company_id long, community_id long")
    t = SimpleNamespace(wins=wins, win_keys=wins.select("company_id", "tender_id"), company=company)
    every = [tuple(x) for x in d.winner_loser_ring(t, least=3, limit=None).collect()]
    assert len(every) > 60
    for n in (1, 7, 30, 60):
        assert [tuple(x) for x in d.winner_loser_ring(t, least=3, limit=n).collect()] == every[:n]


@pytest.mark.parametrize("name", ["top_vendors", "bid_rotation", "risk_trends", "weak_components", "alerts_daily_volume", "state_diff"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(str([dict(zip(names, r))[c] for c in columns]) for r in found.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def _random_edges(n, p, seed):
    r = random.Random(seed)
    return [(a, b) for a in range(n) for b in range(n) if a != b and r.random() < p]


def test_triangles_over_groups_of_nodes(spark, monkeypatch):
    monkeypatch.setattr(graph, "TRIANGLE_EDGES", 40)
    pairs = _random_edges(30, 0.15, 1)
    near = {a: {b for e in pairs for b in e if a in e and b != a} for a in range(30)}
    expected = {a: sum(b < c and c in near[b] for b in near[a] for c in near[a]) for a in near if near[a]}
    assert max(expected.values()) > 5
    assert as_dict(graph.triangles(edges(spark, *pairs))) == expected
    text = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    got = graph.triangles(text)
    assert as_dict(got) == {f"n{a}": k for a, k in expected.items()}
    # paths of two edges are not rows: the edges are joined with nothing but their own counts
    assert "Inner" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("first,more", [(1, 2), (2, 8)])
def test_first_cycles_from_smallest_starts(spark, monkeypatch, first, more):
    pairs = _random_edges(9, 0.45, 3)
    every = sorted((r["length"], r["chain"]) for r in graph.cycles(edges(spark, *pairs), 3, 4).collect())
    monkeypatch.setattr(graph, "FIRST_STARTS", first)
    monkeypatch.setattr(graph, "MORE_STARTS", more)
    assert len(every) > 8
    for n in (1, len(every) // 2, len(every) + 3):
        assert sorted((r["length"], r["chain"]) for r in graph.cycles(edges(spark, *pairs), 3, 4, n).collect()) == every[:n]


def test_statistics_look_only_at_the_first_nodes(spark, monkeypatch):
    pairs = _random_edges(20, 0.3, 4)
    local = {r["node"]: r["clustering"] for r in graph.clustering(edges(spark, *pairs)).collect()}
    monkeypatch.setattr(graph, "clustering", None)
    got = graph.graph_statistics(edges(spark, *pairs), 5).first()["avg_clustering"]
    assert got == pytest.approx(sum(local[k] for k in sorted(local)[:5]) / 5)


@pytest.mark.parametrize("steps,copies", [(10**8, 64), (50, 64), (50, 1)])
def test_betweenness_by_component(spark, monkeypatch, steps, copies):
    pairs = _random_edges(12, 0.2, 5) + [(a + 20, b + 20) for a, b in _random_edges(8, 0.3, 6)] + [(40, 41), (41, 42)]
    exact = as_dict(graph.betweenness(edges(spark, *pairs)))
    for name, value in (("TASK_STEPS", steps), ("TASK_COPIES", copies), ("BIN_EDGES", 5), ("SOURCES", 1000)):
        monkeypatch.setattr(graph, name, value)
    got = graph._by_component(graph.undirected(edges(spark, *pairs))).collect()
    assert {r["node"]: pytest.approx(r["betweenness"]) for r in got} == exact and {r["bound"] for r in got} == {0.0}


def test_statistics_look_at_all_nodes(spark):
    """Sixty nodes of a star, then a triangle: the first fifty nodes alone have no triangle."""
    star, triangle = [(0, i) for i in range(1, 60)], [(100, 101), (101, 102), (100, 102)]
    got = graph.graph_statistics(edges(spark, *star, *triangle)).first()
    assert got["avg_clustering"] == pytest.approx(3 / 63) and got["components"] == 2


@pytest.mark.parametrize("n,p", [(24, 0.12), (24, 0.5)])
def test_betweenness_is_exact_whatever_the_size(spark, monkeypatch, n, p):
    """Components too large for a task are walked from all nodes, a few at a time, not estimated; those with many edges go as a matrix."""
    pairs = _random_edges(n, p, 7) + [(100 + i, 101 + i) for i in range(4)]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = dict.fromkeys(near, 0.0)
    for s in near:
        far, count, order, part = {s: 0}, {s: 1}, [s], dict.fromkeys(near, 0.0)
        for v in order:
            for w in near[v]:
                if w not in far:
                    far[w], count[w] = far[v] + 1, 0
                    order.append(w)
                if far[w] == far[v] + 1:
                    count[w] += count[v]
        for w in reversed(order[1:]):
            for v in near[w]:
                if far[v] == far[w] - 1:
                    part[v] += count[v] / count[w] * (1 + part[w])
            want[w] += part[w] / 2
    e = edges(spark, *pairs)
    for name, value in {"SOURCES": 15, "FOREST_EDGES": 7, "LEVELS": 3}.items():
        monkeypatch.setattr(graph, name, value, raising=False)
    for most in (2_000_000, 0) if p < 0.5 else (2_000_000,):
        monkeypatch.setattr(graph, "TASK_EDGES", most)
        rows = graph.betweenness(e)
        assert rows.columns == ["node", "betweenness"] and as_dict(rows) == pytest.approx(want)
