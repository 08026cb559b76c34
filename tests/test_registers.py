"""Loads by registers' keys, families, places, measures of typed graphs, and merges with their log, on small tables and against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veritrace.operators import graph, merges, ownership, places


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_persons_keep_names_and_gather_sources(spark):
    now = spark.createDataFrame([("A", "Ada", None, ["x"]), ("B", None, "Bo", None)], "cf string, nome string, cognome string, source array<string>")
    new = spark.createDataFrame([("A", "Eva", "Verdi", "y"), ("A", "Eva", "Rossi", "y"), ("B", "Bea", "Z", "x"), ("C", None, "", "y"), (None, "N", "N", "y"), ("", "N", "N", "y")], "cf string, nome string, cognome string, source string")
    got = ownership.load_persons(now, new)
    assert rows_of(got) == [("A", "Ada", "Rossi", ["x", "y"]), ("B", "Bea", "Bo", ["x"]), ("C", None, "", ["y"])]
    assert rows_of(ownership.load_persons(got, new)) == rows_of(got)


def test_seats_and_shares_by_their_keys(spark):
    known = spark.createDataFrame([("c1",), ("c2",)], "cf string")
    seat = "person_cf string, company_cf string, ruolo string, data_inizio string, data_fine string"
    now = spark.createDataFrame([("p", "c1", "Socio", "2001", None), ("p", "c1", None, "2002", None)], seat)
    new = spark.createDataFrame([("p", "c1", "Socio", "1999", "2009"), ("p", "c1", None, "1998", None), ("p", "c1", "Sindaco", "2005", None), ("p", "c1", "Sindaco", "2004", None), ("p", "c9", "Socio", "2000", None)], seat)
    got, refused = ownership.load_represents(now, new, known)
    assert rows_of(got) == sorted([("p", "c1", "Socio", "2001", None), ("p", "c1", None, "2002", None), ("p", "c1", "Sindaco", "2004", None)], key=str)
    assert [r["company_cf"] for r in refused.collect()] == ["c9"]
    share = "source_cf string, company_cf string, quota double, data_rilevazione string, source string"
    now = spark.createDataFrame([("p", "c1", 10.0, "2001", "a"), ("p", "c2", 5.0, None, "a")], share)
    new = spark.createDataFrame([("p", "c1", 20.0, "2001", "b"), ("p", "c1", 30.0, "2002", "b"), ("p", "c2", None, None, "b")], share)
    got, refused = ownership.load_shareholdings(now, new, known)
    assert rows_of(got) == sorted([("p", "c1", 20.0, "2001", "a"), ("p", "c1", 30.0, "2002", "b"), ("p", "c2", 5.0, None, "a")], key=str) and refused.isEmpty()


def test_families_by_brute_force(spark):
    r = random.Random(7)
    e = {(f"C{a}", f"C{b}") for a, b in (sorted(r.sample(range(30), 2)) for _ in range(28))} | {(f"P{r.randint(0, 5)}", f"C{r.randint(0, 29)}") for _ in range(12)} | {("C90", "C91"), ("C91", "C90"), ("C5", "C5")}
    below = defaultdict(set)
    for a, b in e:
        if a != b:
            below[a].add(b)
    owned = {b for a, b in e if a != b}
    want, steps = {}, {}
    for top in set(below) - owned:
        level, seen, k = below[top], {}, 1
        while level and k <= 10:
            seen |= {x: k for x in level if x not in seen}
            level, k = {y for x in level for y in below[x]} - seen.keys(), k + 1
        want[top] = set(seen)
        steps |= {(top, x): n for x, n in seen.items()}
    shares = spark.createDataFrame([*e, (None, "C1"), ("C1", None)], "owner string, company string")
    assert {(x["ubo"], x["company"]): x["steps"] for x in ownership.last_owners(shares).collect()} == steps
    for c in ("C20", "C90", "C77"):
        got = {(x["ubo"], x["sibling"]) for x in ownership.family(shares, c).collect()}
        assert got == {(u, s) for u, of in want.items() if c in of for s in of - {c}}
    assert ownership.last_owners(shares.limit(0)).isEmpty() and ownership.family(shares.limit(0), "C1").isEmpty()


def test_places(spark):
    rows = spark.createDataFrame([(1, " milano "), (2, "Como"), (3, ""), (4, None)], "n int, city string")
    assert [r[2] for r in rows_of(places.with_city_code(rows, "city"))] == ["015146", None, None, None]
    assert [r[2] for r in rows_of(places.with_province_code(rows, "city"))] == ["MI", "CO", "", ""]
    known = spark.createDataFrame([("COMO", "013075", "CM"), ("como", "013000", "CM"), (None, "9", "X")], "nome string, cod_istat string, sigla string")
    assert [r[2] for r in rows_of(places.with_city_code(rows, "city", known))] == [None, "013000", None, None]
    assert [r[2] for r in rows_of(places.with_province_code(rows, "city", known))] == ["MI", "CM", "", ""]


def test_typed_statistics(spark):
    nodes = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y"), ("d", "Y"), ("e", "Y"), ("f", "Z")], "node string, kind string")
    edges = spark.createDataFrame([("a", "b", "k"), ("b", "c", "k"), ("c", "a", "l"), ("c", "d", "l"), ("d", "c", "l"), ("e", "e", "k")], "src string, dst string, kind string")
    got = {(r["measure"], r["of"]): r["value"] for r in graph.typed_statistics(nodes, edges).collect()}
    assert got == {
        ("node_count", "all"): 6, ("edge_count", "all"): 6, ("density", "all"): 0.4, ("avg_degree", "all"): 2.4, ("max_degree", "all"): 4, ("connected_components", "all"): 3,
        ("avg_clustering", "all"): round((1 + 1 + 1 / 3) / 6, 4), ("node_types", "X"): 2, ("node_types", "Y"): 3, ("node_types", "Z"): 1, ("edge_types", "k"): 3, ("edge_types", "l"): 3,
    }
    empty = {(r["measure"], r["of"]): r["value"] for r in graph.typed_statistics(nodes.limit(0), edges.limit(0)).collect()}
    assert len(empty) == 7 and set(empty.values()) == {0.0}


def network(spark):
    rows = spark.createDataFrame([(i, f"cf{i}", None if i % 3 else f"v{i}", None) for i in range(1, 13)], "id long, cf string, piva string, note string")
    r = random.Random(3)
    edges = spark.createDataFrame(sorted({(r.randint(1, 12), r.randint(1, 14), r.choice("WS")) for _ in range(60)}), "src long, dst long, kind string")
    comments = spark.createDataFrame([("k1", "2", "t", ["x"], "u"), ("k2", "3", "t", None, "u"), ("k3", "9", "t", [], "u")], "comment_id string, entity_id string, text string, tags array<string>, author string")
    return rows, edges, comments.withColumn("at", F.to_timestamp(F.lit("2023-01-01")))


def mapped(edges, to):
    return sorted({(to.get(a, a), to.get(b, b), k) for a, b, k in edges if to.get(a, a) != to.get(b, b) or (a == b and a not in to)})


def test_merges_in_bulk_and_back(spark, tmp_path):
    rows, edges, comments = network(spark)
    plain, path = [tuple(r) for r in edges.collect() if r[0] != r[1]], str(tmp_path / "log")
    edges = edges.where("src <> dst")
    wanted = spark.createDataFrame([(2, "1"), (3, "cf1"), (5, "v6"), (8, "8"), (77, "1"), (9, "nobody")], "source long, target string")
    ids = merges.targets(rows, wanted)
    assert rows_of(ids) == [(2, 1), (3, 1), (5, 6)]
    want = {1: 2, 6: 1}
    p = {r["target"]: (r["sources"], r["relationships_to_update"]) for r in merges.preview(rows, edges, ids).collect()}
    ends = lambda s: sum((a in s) + (b in s) for a, b, _ in plain)
    assert p == {1: (2, ends({2, 3})), 6: (1, ends({5}))}
    r, e, c = merges.merge(rows, edges, ids, path, "one", "2024-01-01", comments)
    assert sorted(x["id"] for x in r.collect()) == [1, 4, 6, 7, 8, 9, 10, 11, 12]
    assert r.where("id = 1").first()["piva"] == "v3" and r.where("id = 6").first()["cf"] == "cf6"
    assert rows_of(e) == sorted(mapped(plain, {2: 1, 3: 1, 5: 6}), key=str)
    at = {x["comment_id"]: (x["entity_id"], x["tags"]) for x in c.collect()}
    assert at["k1"] == ("1", ["x", merges.MOVED]) and at["k2"] == ("1", [merges.MOVED]) and at["k3"] == ("9", [])
    assert at["merge:one/1"][1] == list(merges.TOLD) and c.where("comment_id = 'merge:one/1'").first()["text"] == "Merge of 2, 3 by one/1"
    h = {x["merge_id"]: (x["merged_count"], x["relationships_updated"], x["comments_migrated"], x["status"]) for x in merges.history(spark, path).collect()}
    assert h == {f"one/{k}": (n, p[k][1], 2 if k == 1 else 0, "COMPLETED") for k, n in want.items()}
    assert rows_of(merges.members(spark, path)) == [("one/1", 1, 2), ("one/1", 1, 3), ("one/6", 6, 5)]
    e = e.union(spark.createDataFrame([(1, 99, "N")], e.schema))
    one = spark.createDataFrame([(1,), (44,)], "target long")
    r2, e2, c2 = merges.roll_back(r, e, path, "one", one, "2024-02-01", c)
    assert rows_of(e2) == sorted([*mapped(plain, {5: 6}), (1, 99, "N")], key=str)
    assert {x["comment_id"]: x["entity_id"] for x in c2.collect()} == {"k1": "2", "k2": "3", "k3": "9", "merge:one/6": "6"}
    assert {x["merge_id"]: x["status"] for x in merges.history(spark, path).collect()} == {"one/1": "ROLLED_BACK", "one/6": "COMPLETED"}
    r3, e3, _ = merges.roll_back(r2, e2, path, "one", spark.createDataFrame([(6,), (1,)], "target long"), "2024-03-01", c2)
    assert rows_of(r3) == rows_of(rows) and rows_of(e3) == sorted([*plain, (1, 99, "N")], key=str)
    assert merges.log(spark, path).where("rolled_back_at = '2024-02-01'").count() == 1


def test_merges_that_are_refused(spark, tmp_path):
    rows, edges, _ = network(spark)
    path = str(tmp_path / "log")
    pairs = lambda *x: spark.createDataFrame(list(x), "source long, target long")
    for bad in (pairs((2, 1), (2, 3)), pairs((2, 1), (1, 3))):
        with pytest.raises(ValueError):
            merges.merge(rows, edges, bad, path, "bad", "2024-01-01")
    r, e, _ = merges.merge(rows, edges, pairs((2, 1)), path, "a", "2024-01-01")
    with pytest.raises(ValueError):
        merges.merge(rows, edges, pairs((4, 3)), path, "a", "2024-01-02")
    merges.merge(r, e, pairs((1, 7)), path, "b", "2024-01-02")
    with pytest.raises(ValueError):
        merges.roll_back(r, e, path, "a", spark.createDataFrame([(1,)], "target long"), "2024-01-03")
    assert merges.history(spark, path, 1).first()["merge_id"] == "b/7"


def test_conflict_by_vat_number(spark):
    from types import SimpleNamespace

    from veritrace.plans.detectors import ubo_conflict

    t = SimpleNamespace(
        shareholder_of=spark.createDataFrame([(10, 1), (11, 10), (12, 2)], "owner_id long, company_id long"), company=spark.createDataFrame([(10, "A", None), (11, "B", "X"), (12, "C", None)], "company_id long, cf string, piva string"),
        buyer=spark.createDataFrame([(5, "X"), (6, "C"), (7, None)], "buyer_id long, buyer_cf string"), wins=spark.createDataFrame([(1, 5, 100), (1, 6, 101), (2, 6, 102), (2, 7, 103)], "company_id long, buyer_id long, tender_id long"),
    )
    assert [r["tender_id"] for r in ubo_conflict(t).collect()] == [100, 102]
