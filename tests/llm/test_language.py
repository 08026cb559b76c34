"""Languages told apart by words, then by parts of words; what is held out is not learned."""

import random
import zlib

from veritrace.llm import language

PARTS = {"aa": "ka mo ti su re no", "bb": "schu ber tzen ach eng ulk", "cc": "ñol güe lla ción que ero"}


def words(r, lang, n):
    return ["".join(r.choices(PARTS[lang].split(), k=r.randint(1, 4))) for _ in range(n)]


def held(doc_id):
    return zlib.crc32((b"" if doc_id is None else str(doc_id).encode())) % 3 == 1


def test_counts_by_brute_force(spark):
    df = spark.createDataFrame([("x", "Ab ab abc"), ("x", "abc 12 _ é"), ("y", "é")], "lang string, text string")
    got = sorted((r["lang"], r["size"], r["n"]) for r in language.count(df).collect())
    want = []
    for lang, found in {"x": {"ab": 2, "abc": 2, "é": 1}, "y": {"é": 1}}.items():
        want += [(lang, 0, n) for n in found.values()]
        for size in range(1, language.LONGEST + 1):
            by: dict[str, int] = {}
            for w in found:
                for g in language.grams(w, size):
                    by[g] = by.get(g, 0) + 1
            want += [(lang, size, n) for n in by.values()]
    assert got == sorted(want)


def test_query(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(language, "ROWS_A_LANGUAGE", 30)
    r = random.Random(4)
    rows = [(i, lang, " ".join(words(r, lang, r.randint(3, 60)))) for i, lang in enumerate(r.choices(sorted(PARTS), k=400))]
    rows += [(1000, None, " ".join(words(r, "bb", 40))), (1001, "aa", None), (1002, "aa", ""), (1003, "bb", "12 -- 34"), (None, "cc", "世界"), (None, "cc", "世界")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "0 AS n", "'q' AS word").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    some, sizes = language.sample(docs)
    assert some.groupBy("lang").count().collect() and all(x["count"] == 30 for x in some.groupBy("lang").count().collect())
    assert sizes["bb"] == sum(lang == "bb" and t is not None and not held(i) for i, lang, t in rows)
    got = language.op7_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {x["doc_id"]: x["held_out"] for x in got} == {i: held(i) for i, _, _ in rows}
    by = {x["doc_id"]: x for x in got}
    right = [by[i]["lang_pred"] == lang for i, lang, _ in rows[:400] if held(i)]
    assert len(right) > 100 and sum(right) / len(right) > 0.97
    assert by[1000]["lang_pred"] == "bb" and [(by[i]["lang_pred"], by[i]["score"]) for i in (1001, 1002, 1003)] == [("und", 0.0)] * 3
    assert by[None]["lang_pred"] in PARTS and all(0 <= x["score"] <= 1 for x in got)


def test_memory_does_not_change_results(spark, monkeypatch):
    r = random.Random(6)
    df = spark.createDataFrame([(i, lang, " ".join(words(r, lang, 30))) for i, lang in enumerate(sorted(PARTS) * 20)], "doc_id long, lang string, text string")
    model = language.fit(df)
    texts = [" ".join(words(r, lang, 25)) for lang in PARTS for _ in range(8)]
    once = language.Scorer(model).predict(texts)
    monkeypatch.setattr(language, "REMEMBERED", 5)
    scorer = language.Scorer(model)
    assert once == tuple(sum(x, []) for x in zip(*[scorer.predict([t]) for t in texts]))


def test_copies_are_learnt_from_once(spark, monkeypatch):
    """One row many times over leaves all different rows to learn from, as long as there are few enough."""
    monkeypatch.setattr(language, "ROWS_A_LANGUAGE", 50)
    rows = [(i, f"text number {i}", "xx") for i in range(200)] + [(7, "copied text", "xx")] * 20_000 + [(i, f"texte {i}", "yy") for i in range(30)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found, sizes = language.sample(docs)
    got = [(r["lang"], r["text"]) for r in found.collect()]
    free = [i for i in range(30) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(t for k, t in got if k == "yy") == sorted(f"texte {i}" for i in free) and sizes["yy"] == 3 * len(free)
    xx = [t for k, t in got if k == "xx"]
    assert len(xx) == len(set(xx)) == 50 and sizes["xx"] > 200
