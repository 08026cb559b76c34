"""Edges with both ends, loads with history, marks and batches."""

import datetime as dt

from veritrace.operators import loaders, upsert


def test_edges_need_both_ends(spark):
    c = spark.createDataFrame([(1, "A"), (2, "B")], "id long, cf string")
    t = spark.createDataFrame([(10, "G1")], "id long, cig string")
    rows = spark.createDataFrame([("A", "G1", 5.0), ("A", "G1", 7.0), ("B", "G9", 1.0), ("Z", "G1", 1.0), ("Z", None, 1.0)], "company_cf string, tender_cig string, importo double")
    made, refused = loaders.edges(rows, (c, "cf", "company_cf"), (t, "cig", "tender_cig"), ("importo",))
    assert [tuple(r) for r in made.collect()] == [(1, 10, 7.0)]
    assert sorted((r["company_cf"], r["missing"]) for r in refused.collect()) == [("B", "tender_cig"), ("Z", "both ends"), ("Z", "company_cf")]
    now = spark.createDataFrame([(2, 10, 3.0), (1, 10, 1.0)], "src long, dst long, importo double")
    assert sorted(map(tuple, loaders.edges(rows, (c, "cf", "company_cf"), (t, "cig", "tender_cig"), ("importo",), now)[0].collect())) == [(1, 10, 7.0), (2, 10, 3.0)]


def test_load_keeps_old_values_and_history(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, n string, v int")
    new = spark.createDataFrame([("a", None, 5), ("a", "w", 4), ("c", "z", 3), (None, "q", 1)], "k string, n string, v int")
    state, gone = loaders.load(old, new, "k", "2024-01-01", ("n",))
    assert sorted(map(tuple, state.collect())) == [("a", "w", 4), ("b", "y", 2), ("c", "z", 3)]
    assert [(r["k"], r["n"]) for r in gone.collect()] == [("a", "x")]
    assert sorted(map(tuple, loaders.load(old, new.where("v = 5"), "k", "2024-01-01", ("n",))[0].collect()))[0] == ("a", "x", 5)


def test_links_of_companies(spark):
    subs = spark.createDataFrame([(5, "G1"), (1, "G1"), (6, "G2")], "company long, cig string")
    wins = spark.createDataFrame([(1, "G1"), (1, "G3"), (2, "G1")], "company long, cig string")
    assert sorted(map(tuple, loaders.subcontracts(subs, wins).collect())) == [(1, 5, "G1"), (2, 1, "G1"), (2, 5, "G1")]
    c = spark.createDataFrame([(3, "x", "P"), (1, "y", "P"), (2, "y", "P"), (4, "z", None), (5, "w", "Q")], "id long, cf string, piva string")
    assert [tuple(r) for r in loaders.same_as(c).collect()] == [(1, 3, "same_piva")]
    w = spark.createDataFrame([(3, 2.0), (3, 3.0)], "company_id long, importo double")
    got = loaders.company_statistics(c.selectExpr("id AS company_id"), w).collect()
    assert {r["company_id"]: (r["total_wins"], r["total_value"]) for r in got}[3] == (2, 5.0) and len(got) == 5


def test_marks(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 3)), (3, None)], "id int, at timestamp")
    marks = loaders.watermarks(spark)
    new, marks = loaders.fetch_new(rows, marks, "s", "at", "2024-02-01")
    assert new.count() == 3 and loaders.read_mark(marks, "s")["rows_processed"] == 3
    new, marks = loaders.fetch_new(rows.union(spark.createDataFrame([(4, dt.datetime(2024, 1, 4))], rows.schema)), marks, "s", "at", "2024-02-02")
    assert [r["id"] for r in new.collect()] == [4] and loaders.read_mark(marks, "s")["rows_processed"] == 4
    assert loaders.fetch_new(rows, marks, "s", "at", "2024-02-03")[0].isEmpty() and loaders.read_mark(marks, "t")["last_value"] is None


def test_batches_go_on(spark, tmp_path):
    made = []

    def make(n, fail=False):
        def f():
            made.append(n)
            if fail:
                raise RuntimeError(n)
            return spark.range(n)

        return f

    try:
        loaders.run_batches(spark, str(tmp_path), [("a", make(3)), ("b", make(4, True))])
    except RuntimeError:
        pass
    assert loaders.run_batches(spark, str(tmp_path), [("a", make(3)), ("b", make(4))]) == ["b"] and made == [3, 4, 4]
    assert spark.read.parquet(str(tmp_path)).count() == 7


def test_history(spark):
    v = spark.createDataFrame([("k", "2024-01-01", 1), ("k", "2024-02-01", 2), ("j", "2023-01-01", 3)], "k string, at string, v int")
    assert sorted((r["v"], str(r["valid_from"]), str(r["valid_to"])) for r in loaders.history(v, "k", "at").collect()) == [(1, "2024-01-01", "2024-02-01"), (2, "2024-02-01", "None"), (3, "2023-01-01", "None")]
    assert [str(r["valid_from"]) for r in loaders.with_validity(spark.createDataFrame([("2020-05-06T1",), (None,)], "d string"), "d", "2000-01-01").collect()] == ["2020-05-06", "2000-01-01"]


def test_quality(spark):
    rows = spark.createDataFrame([("A", 50_000.0, "2024-01-02"), ("B", 10.0, "02/01/2024"), ("B", 2e9, None)], "cig string, importo double, data string")
    got = {(r["kind"], r["column"]): (r["n"], r["severity"]) for r in upsert.quality_issues(rows, ("cig", "oggetto"), "importo", dates=("data",), unique="cig").collect()}
    assert got == {("missing_column", "oggetto"): (3, "critical"), ("out_of_range", "importo"): (2, "medium"), ("invalid_date_format", "data"): (1, "medium"), ("duplicate_cig", "cig"): (1, "high")}
    score = upsert.quality_score(upsert.quality_issues(rows, ("cig", "oggetto"), "importo", dates=("data",), unique="cig")).first()
    assert tuple(score) == (0.85, False)
    assert tuple(upsert.quality_score(upsert.quality_issues(rows, ("cig",), "importo", dates=("data",))).first()) == (1.0, True)
    assert upsert.quality_score(upsert.quality_issues(rows.limit(0), ("cig",)), 0).first()["passed"] is False


def test_load_archived(spark):
    schema = "k string, v long, valid_from date, valid_to date"
    load = lambda *rows: spark.createDataFrame(rows, "k string, v long")
    current, archive = loaders.load_archived(spark.createDataFrame([], schema), None, load(("a", 1), ("b", None), (None, 4)), "k", "2024-01-01")
    current, archive = loaders.load_archived(current, archive, load(("a", 1), ("b", 2), ("c", 3), ("c", 1)), "k", "2024-02-01")
    current, archive = loaders.load_archived(current, archive, load(("b", None)), "k", "2024-03-01")
    got = sorted((r["k"], r["version"], r["v"], str(r["valid_from"])[5:7], str(r["valid_to"])[5:7]) for r in loaders.versions(current, archive, "k").collect())
    assert got == [("a", 1, 1, "01", ""), ("b", 1, None, "01", "02"), ("b", 2, 2, "02", "03"), ("b", 3, None, "03", ""), ("c", 1, 3, "02", "")]
