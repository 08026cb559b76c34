"""Recommendations, explanations, parts of the graph, policies, and merges that can be undone."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from veritrace.operators import access, recommend, resolve, subgraph


def companies(spark):
    rows = [(1, "Uno", "41.20", "LAZIO", 0.5, ["a", "b"], 3, 0.6), (2, "Due", "41", "LAZIO", 0.6, ["b"], 3, None), (3, "Tre", "42", "LAZIO", 0.9, [], 3, 0.1), (4, "Quattro", "41.1", "PUGLIA", None, None, None, 0.0), (5, "Cinque", None, None, 0.1, ["a", "b"], 9, 0.2)]
    return spark.createDataFrame(rows, "company_id long, nome string, ateco string, regione string, risk_score double, anomaly_flags array<string>, community_id long, centrality_score double")


def test_recommend(spark):
    c = companies(spark)
    got = {r["company_id"]: (round(r["similarity"], 4), r["features"]) for r in recommend.content(c, 1).collect()}
    assert got == {2: (0.875, ["sector", "region", "risk", "flags"]), 3: (0.25, ["region"]), 4: (0.3, ["sector"]), 5: (0.25, ["flags"])}
    assert [r["company_id"] for r in recommend.community(c, 1).collect()] == [3, 2]
    assert [(r["company_id"], r["similarity"]) for r in recommend.anomaly(c, 1).collect()] == [(5, 1.0), (2, 0.5)]
    assert [r["company_id"] for r in recommend.sector_risk(c, 1).collect()] == [2]
    every = [(r["company_id"], round(r["similarity"], 4), r["strategies"]) for r in recommend.recommend(c, 1).collect()]
    assert every == [(5, 1.0, ["anomaly", "content"]), (2, 0.875, ["anomaly", "community", "content", "sector"]), (3, 0.85, ["community", "content"]), (4, 0.3, ["content"])]
    assert recommend.recommend(c, 99).count() == 0


def test_explain(spark):
    c = companies(spark)
    w = spark.createDataFrame([(1, 7, True), (1, 7, False), (1, 8, True), (1, 7, True), (3, 8, False)], "company_id long, buyer_id long, single_bidder boolean")
    f = recommend.factors(c, w)
    assert [(r["factor"], r["value"], r["contribution"]) for r in f.where("company_id = 1").orderBy("rank").collect()] == [("single_bidder_ratio", 0.75, 0.3), ("buyer_concentration", 0.75, 0.225), ("market_dominance", 0.6, 0.18)]
    flags = spark.createDataFrame([(2, "ring"), (2, "ghost"), (2, "ring"), (1, "ring")], "company_id long, pattern string")
    said = {r["company_id"]: r["summary"] for r in recommend.summary(c, f, flags).collect()}
    assert said[1] == "This company scored 0.50 because: (1) 75% single-bidder wins, (2) 75% buyer concentration, (3) centrality 0.60."
    assert said[2] == "This company scored 0.60 because: (1) centrality 0.00, (2) fraud patterns ghost and ring."
    s = spark.createDataFrame([(1, dt.date(2024, 1, 1), 1, 0.9), (1, dt.date(2024, 1, 2), 2, 0.45), (3, dt.date(2024, 1, 1), 3, 0.1), (5, dt.date(2024, 1, 1), 4, 0.3), (5, dt.date(2024, 1, 1), 5, 0.2)], "company_id long, change_date date, snapshot_id long, risk_score double")
    assert {r["company_id"]: r["trend"] for r in recommend.trend(s, c).collect()} == {1: "WORSENING", 2: "STABLE", 3: "STABLE", 4: "STABLE", 5: "IMPROVING"}


def graph(spark):
    n = [("c1", "Company", 0.9, None), ("c2", "Company", 0.2, dt.date(2020, 1, 1)), ("t1", "Tender", None, dt.date(2021, 1, 1)), ("t2", "Tender", None, None), ("b1", "Buyer", None, None), ("c3", "Company", 0.8, None), ("p1", "Person", 0.75, None)]
    e = [("c1", "t1", "WINS"), ("c2", "t1", "WINS"), ("b1", "t1", "ISSUES"), ("c2", "t2", "WINS"), ("c3", "t2", "WINS"), ("c1", "c3", "OWNS"), ("p1", "c3", "REPRESENTS")]
    return spark.createDataFrame(n, "id string, kind string, risk double, created date"), spark.createDataFrame(e, "src string, dst string, kind string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_parts_of_the_graph(spark):
    n, e = graph(spark)
    f = subgraph.Filter
    shown, links = subgraph.neighbourhood(n, e, "c1", 2)
    assert ids(shown) == ["b1", "c1", "c2", "c3", "p1", "t1", "t2"] and links.count() == 7
    assert ids(subgraph.neighbourhood(n, e, "c1", 2, f(edge_kinds=("WINS",)))[0]) == ["c1", "c2", "t1"]
    assert ids(subgraph.neighbourhood(n, e, "c1", 2, f(least_risk=0.5))[0]) == ["b1", "c1", "c3", "p1", "t1", "t2"]
    assert ids(subgraph.neighbourhood(n, e, "c1", 2, f(until="2020-06-01"))[0]) == ["b1", "c1", "c2", "c3", "p1", "t2"]
    assert ids(subgraph.neighbourhood(n, e, "c1", 3, f(), most=3)[0]) == ["c1", "c3", "t1"]
    flags = spark.createDataFrame([("c3", "ring")], "id string, pattern string")
    assert "c3" not in ids(subgraph.neighbourhood(n, e, "c1", 2, f(without_patterns=("ring",)), flags=flags)[0])
    assert ids(subgraph.selection(n, e, f(least_risk=0.5))[0]) == ["c1", "c3", "p1"]
    assert ids(subgraph.selection(n, e, f(("Tender",), since="2020-01-01"))[0]) == ["t1"]
    assert ids(subgraph.template(n, e, "Company Network", "c2")[0]) == ["b1", "c1", "c2", "c3", "t1", "t2"]
    assert ids(subgraph.template(n, e, "Risk Hotspot")[0]) == ["c1", "c3", "p1"]
    with pytest.raises(ValueError):
        subgraph.template(n, e, "Supply Chain")
    assert ids(subgraph.community(n, e, spark.createDataFrame([("c1",), ("c2",), ("x",)], "id string"), 1)[0]) == ["c1"]
    assert sorted((r["id"], r["edge"], r["direction"]) for r in subgraph.neighbours(n, e, "c3").collect()) == [("c1", "OWNS", "in"), ("p1", "REPRESENTS", "in"), ("t2", "WINS", "out")]
    d = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x")], "src string, dst string")
    src = spark.createDataFrame([("q", "file"), ("x", "other")], "id string, source string")
    assert sorted((r["id"], r["hops"]) for r in subgraph.lineage(d, src, "x").collect()) == [("y", 1), ("z", 2)]
    assert [(r["id"], r["via"]) for r in subgraph.lineage(d, src, "q").collect()] == [("file", "source")]


@pytest.mark.parametrize("how", ["circular", "grid", "radial", "hierarchical", "force"])
def test_layouts(spark, how):
    n, e = graph(spark)
    at = subgraph.layout(n, e, how, centre="c1")
    assert len(at) == 7 and len({(round(x, 3), round(y, 3)) for x, y in at.values()}) == 7 and all(-1 <= v <= 1001 for p in at.values() for v in p)
    assert at == subgraph.layout(n, e, how, centre="c1")
    if how == "radial":
        assert at["c1"] == (500, 500)
    if how == "hierarchical":
        assert at["p1"][1] < at["c3"][1] < at["t2"][1]


def test_files(spark):
    n, e = graph(spark)
    assert len(json.loads(subgraph.to_json(n, e))["links"]) == 7
    assert subgraph.to_graphml(n, e).count("<edge") == 7 and subgraph.to_svg(n, e).count("<circle") == 7


def test_policies(spark):
    c = companies(spark)
    p, w = access.Policy, access.Condition
    mine = p("region", "Company", conditions=(w("regione", "==", "${user.region}"),))
    secret = p("secret", "Company", effect="deny", conditions=(w("risk_score", "gte", 0.9), w("community_id", "in", [3, 4])))
    see = lambda user, *ps: sorted(r["company_id"] for r in access.visible(c, list(ps), "Company", user).collect())
    assert see({"region": "LAZIO"}, mine) == [1, 2, 3] and see({"region": "LAZIO"}, mine, secret) == [1, 2]
    assert see({}, mine) == [1, 2, 3, 4, 5] and see({}) == [1, 2, 3, 4, 5]
    assert see({}, p("x", "Company", conditions=(w("anomaly_flags", "contains", "a"),))) == [1, 5]
    assert see({}, p("x", "Company", conditions=(w("nome", "contains", "u"), w("risk_score", "!=", 0.6)))) == [5]
    assert see({}, p("x", "Company", conditions=(w("no_such", "==", 1),))) == [] and see({}, p("x", "Tender", conditions=(w("nome", "==", "q"),))) == [1, 2, 3, 4, 5]
    assert access.permitted(["viewer", "analyst"], "export") and not access.permitted(["viewer"], "lineage") and access.permitted(["admin"], "user:delete")


@pytest.mark.parametrize("sql,ok", [("SELECT a FROM t WHERE b = 'drop table x' LIMIT 3", True), ("with q as (select 1) select * from q limit 1;", True), ("select 1; drop table t", False), ("DELETE FROM t", False), ("select * from parquet.`/etc/x`", False), ("select /* create */ 1 -- insert", True), ("select reflect('a', 'b')", False), ("insert into t select 1", False)])
def test_guard(sql, ok):
    assert (not access.guard(sql)[0]) == ok


def test_costly():
    assert access.guard("select * from a cross join b order by c")[1] == ["a cross join", "all columns without a limit", "a full sort without a limit"]


def test_similar_names_miss_no_pair(spark):
    r = random.Random(12)
    names = []
    for _ in range(40):
        base = "".join(r.choices("abcd ", k=r.randint(1, 16)))
        for _ in range(3):
            x = list(base)
            for _ in range(r.randint(0, 3)):
                i = r.randrange(len(x) + 1)
                x[i : i + r.randint(0, 1)] = r.choices("abcd", k=r.randint(0, 1))
            names.append("".join(x))
    rows = spark.createDataFrame([(i, n, i % 2) for i, n in enumerate(names)], "id long, nome string, k int")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for threshold in (0.7, 0.85, 1.0):
        got = {(x["a"], x["b"]) for x in resolve.similar_names(rows, "k", threshold).collect()}
        want = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if i % 2 == j % 2 and names[i] and names[j] and 1 - distance(names[i], names[j]) / max(len(names[i]), len(names[j])) >= threshold}
        assert got == want and len(want) > 5


def test_one_entity(spark):
    rows = spark.createDataFrame([(1, "Ponti Alfa", "CF1", "P1"), (2, "Alfa Ponti", "CF2", "P1"), (3, "Beta", "CF1", None), (4, "Ponti Alfaa", None, None), (5, None, None, None)], "id long, nome string, cf string, piva string")
    assert [(r["id"], r["score"], r["reason"]) for r in resolve.candidates_for(rows, 1, 0.9).collect()] == [(3, 1.0, "cf"), (2, 0.95, "piva"), (4, 0.9091, "name")]
    assert [r["id"] for r in resolve.search(rows, "ponti alfa", ("nome", "cf"), least=0.9).collect()] == [1, 2, 4]
    nodes = spark.createDataFrame([(1, "01234567890", None, None, None, "Alfa Ponti SRL"), (2, None, "IT99988877766", None, None, "Beta"), (3, None, None, "J51B21004500001", None, "Opera"), (4, None, None, None, "Z9A2B3C4D5", "Gara")], "id long, cf string, piva string, cup string, cig string, nome string")
    m = spark.createDataFrame([(1, "con 01234567890 e 99988877766", "x"), (2, "iva 99988877766", None), (3, "progetto J51B21004500001", None), (4, "gara z9a2b3c4d5", None), (5, "", "Alfa Ponte"), (6, "", "Alfa Ponti Due"), (7, "", "Zeta"), (8, None, None)], "mention_id long, text string, nome string")
    got = {r["mention_id"]: (r["node_id"], r["method"]) for r in resolve.resolve_mentions(m, nodes).collect()}
    assert got == {1: (1, "cf"), 2: (2, "piva"), 3: (3, "cup"), 4: (4, "cig"), 5: (1, "name"), 6: (1, "needs_review"), 7: (None, "new"), 8: (None, "new")}
    e = spark.createDataFrame([("k1", 0.5, "A", None), (" K1", 0.9, None, "x"), ("k1", 0.7, "B", "y"), ("", 1.0, "C", None)], "key string, confidence double, nome string, role string")
    assert [tuple(r) for r in resolve.merge_entities(e).collect()] == [("K1", 0.9, "B", "x")]


def test_merge_and_undo(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A", None), (2, "B", "x"), (3, "C", "y")], "id long, nome string, note string")
    edges = spark.createDataFrame([(2, 3, "W"), (1, 3, "W"), (2, 1, "O"), (3, 2, "S")], "src long, dst long, kind string")
    p = resolve.preview(rows, edges, 2, 1).first()
    assert (p["edges_moved"], p["loops"], p["edges_equal"], p["conflicts"]) == (3, 1, 1, ["nome"])
    r, e = resolve.merge(rows, edges, 2, 1, str(tmp_path / "m"))
    assert sorted(map(tuple, r.collect())) == [(1, "A", "x"), (3, "C", "y")] and sorted(map(tuple, e.collect())) == [(1, 3, "W"), (3, 1, "S")]
    later = e.union(spark.createDataFrame([(1, 9, "N")], e.schema))
    r, e = resolve.undo(r, later, str(tmp_path / "m"))
    assert sorted(map(str, r.collect())) == sorted(map(str, rows.collect())) and sorted(map(tuple, e.collect())) == sorted([*map(tuple, edges.collect()), (1, 9, "N")])
    with pytest.raises(ValueError):
        resolve.merge(rows, edges, 2, 77, str(tmp_path / "n"))


def test_greedy_is_one_pass(spark):
    r = random.Random(31)
    pairs = {(a, b): round(r.uniform(0.7, 1.0), 2) for a, b in (sorted(r.sample(range(40), 2)) for _ in range(70))}
    gone = {}
    for (a, b), s in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        if s >= 0.92 and a not in gone and b not in gone:
            gone[b] = a
    last = lambda x: last(gone[x]) if x in gone else x
    df = resolve.tiers(spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a long, b long, score double"))
    assert {x["id"]: x["canonical"] for x in resolve.greedy_ids(df).collect()} == {k: last(k) for k in gone} and len(gone) > 8


def test_candidates(spark):
    rows = spark.createDataFrame([(1, "Alfa Ponti srl", "H1", "C1"), (2, "Ponti Alfa", "H1", "C2"), (3, "Beta", "H1", "C1"), (4, "Alfa Ponte", "H2", None), (5, "Zeta Molto Lunga Davvero", "H1", None), (6, None, "H1", None)], "id long, nome string, cod_istat string, cf string")
    got = {(r["a"], r["b"]): round(r["score"], 3) for r in resolve.candidates(rows).collect()}
    assert got == {(1, 2): 1.0, (1, 3): 1.0}
    assert resolve.merged_ids(resolve.tiers(resolve.candidates(rows))).count() == 3


def test_person_keys(spark):
    df = spark.createDataFrame([(" Rossini", "bari", "x1"), ("Li", None, None)], "s string, b string, cf string")
    assert [x[0] for x in df.select(resolve.person_keys(F.col("s"), F.col("b"), F.col("cf"))).collect()] == [["PERS_ROSS_BARI", "CF_X1"], []]


def test_weighted_score(spark):
    s = "struct<cf:string,nome:string,cod_istat:string,ateco:string>"
    df = spark.createDataFrame([(("1", "Alfa", "H", "41.2"), ("1", "Alfa srl", "H", "41")), (("1", "Alfa", "H", "41"), ("2", None, None, "42"))], f"a {s}, b {s}")
    assert [round(r[0], 4) for r in df.select(resolve.weighted_score("a", "b")).collect()] == [1.0, 0.0]
