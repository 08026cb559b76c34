"""Search against a plain BM25; fuzzy terms against Levenshtein over all terms."""

import math
import random
import re
from collections import Counter

from veritrace.operators import search


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(docs, text, edits):
    w = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs.items()}
    df = Counter(x for words in w.values() for x in set(words))
    mean, n, weight = sum(map(len, w.values())) / len(w), len(w), {}
    for asked in set(re.findall(r"[^\W_]+", text.lower())):
        for term in df:
            d = levenshtein(asked, term)
            if d <= edits:
                weight[term] = max(weight.get(term, 0), 1 - d / max(len(asked), len(term)))
    out = []
    for i, words in w.items():
        c = {t: k for t, k in Counter(words).items() if weight.get(t, 0) > 0}
        s = sum(weight[t] * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(words) / mean)) for t, k in c.items())
        if c:
            out.append((i, round(s, 6), len(c)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def test_search(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(1, 6))) for _ in range(80)]
    docs = {i: r.choice([" ", ", ", "\n"]).join(r.choices(vocabulary, k=r.randint(1, 60))).title() for i in range(60)} | {60: None, 61: "", 62: " _-. "}
    df = spark.createDataFrame([*docs.items(), (None, "lost words")], "doc_id long, text string")
    index = search.build(df.repartition(5))
    assert index.n == 63
    asked = {1: f"{vocabulary[3]} {vocabulary[9]} {vocabulary[3]}", 2: "abc", 3: "", 4: "zzzzzzzzz", 5: vocabulary[5].upper()}
    questions = spark.createDataFrame([*asked.items()], "question long, text string")
    once = search.build(df, only=search.fuzzy(search.vocabulary(df), questions.select(search.F.explode(search.words(search.F.col("text"))).alias("asked")), 1).select("term"))
    for edits, limit in ((0, None), (1, 5), (2, 15)):
        rows = search.search(once if edits == 1 else index, questions, edits, limit).collect()
        for q, text in asked.items():
            got = sorted(((x["id"], x["score"], x["terms"]) for x in rows if x["question"] == q), key=lambda x: (-x[1], x[0]))
            want = plain(docs, text, edits)[:limit]
            assert [x[::2] for x in got] == [x[::2] for x in want] and all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(got, want))


def test_fuzzy_terms(spark):
    r = random.Random(5)
    terms = sorted({"".join(r.choices("abcü", k=r.randint(1, 7))) for _ in range(400)} | {"a", "ab"})
    asked = r.sample(terms, 12) + ["abcabc", "x", "zzzz", None]
    t, a = spark.createDataFrame([(x,) for x in terms], "term string"), spark.createDataFrame([(x,) for x in asked + asked], "asked string")
    for edits in (0, 1, 2):
        got = sorted(tuple(x) for x in search.fuzzy(t, a, edits).collect())
        assert got == sorted((x, y, levenshtein(x, y)) for x in asked if x is not None for y in terms if levenshtein(x, y) <= edits)


def test_empty(spark):
    index = search.build(spark.createDataFrame([], "doc_id long, text string"))
    assert search.search(index, spark.createDataFrame([(1, "word")], "question long, text string"), 2).collect() == []
