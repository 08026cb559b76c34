"""Quality rules against a plain model that counts everything anew for each letter that it scores."""

import math
import random
from collections import Counter

import pytest

from veritrace.llm import quality

ORDER = quality.ORDER


def grams(text):
    t = " " * (ORDER - 1) + " ".join(text.split())
    return [t[i : i + ORDER] for i in range(len(t) - ORDER + 1)]


def discounts(table):
    c = Counter(table.values())
    y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5
    return [0.0, *(max(0.01, min(k, k - (k + 1) * y * c[k + 1] / c[k])) if c[k] else y for k in (1, 2, 3))]


def below(table):
    out = Counter()
    for g in table:
        out[g[1:]] += 1
    return out


def plain_chance(counts, gram):
    """p with the discounts of all counts, and the counts without one occurrence of gram."""
    tables, kept = [counts], []
    while len(next(iter(tables[-1]))) > 1:
        tables.append(below(tables[-1]))
    less, g = Counter(counts), gram
    less[g] -= 1
    kept.append(less)
    gone = less[g] == 0
    for t in tables[1:]:
        g, t = g[1:], Counter(t)
        if gone:
            t[g] -= 1
            gone = t[g] == 0
        kept.append(t)
    p = 1 / (len(tables[-1]) + 1)
    for whole, t in reversed(list(zip(tables, kept))):
        d = discounts(whole)
        n = len(next(iter(whole)))
        of = {k: v for k, v in t.items() if k[:-1] == gram[ORDER - n : -1] and v > 0}
        total = sum(of.values())
        if total:
            c = t[gram[ORDER - n :]]
            p = (c - d[min(c, 3)]) / total + sum(d[min(v, 3)] for v in of.values()) / total * p
    return p


def plain_cost(counts, every, gram):
    """-log2 p of a language's own model and that of all texts, weighed by letters."""
    own, shared = sum(counts.values()) - 1, quality.SHARED_LETTERS
    return -math.log2((own * plain_chance(counts, gram) + shared * plain_chance(every, gram)) / (own + shared))


def texts(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeé日", k=r.randint(1, 5))) for _ in range(40)]
    return [" ".join(r.choices(words, k=r.randint(1, 90))) for _ in range(n)]


@pytest.mark.parametrize("rows, block", [(quality.MODEL_ROWS, quality.BLOCK_LETTERS), (0, quality.BLOCK_LETTERS), (0, 50)])
def test_model_by_brute_force(spark, monkeypatch, rows, block):
    monkeypatch.setattr(quality, "MODEL_ROWS", rows)
    monkeypatch.setattr(quality, "BLOCK_LETTERS", block)
    monkeypatch.setattr(quality, "SHARED_LETTERS", 700)
    data = [(i, "xx" if i < 15 else None, t) for i, t in enumerate(texts(1, 15) + texts(2, 6))]
    data += [(99, "xx", " \n\u3000"), (100, "yy", None), (101, "xx", "a\0b"), (102, "zz", "b d c ab"), (103, "zz", "")]
    df = spark.createDataFrame(data, "doc_id long, lang string, text string").repartition(3)
    model = quality.fit(quality.count_grams(df))
    got = {r["doc_id"]: r for r in quality.measure(df, model).collect()}
    assert len(got) == len(data)
    some = [(i, lang or "und", t.replace("\0", "\ufffd")) for i, lang, t in data if t and t.split()]
    every = Counter(g for _, _, t in some for g in grams(t))
    for name in ("xx", "und", "zz"):
        counts = Counter(g for _, lang, t in some if lang == name for g in grams(t))
        costs = {g: plain_cost(counts, every, g) for g in counts}
        for i, lang, t in some:
            if lang == name:
                assert got[i]["model"] == name and abs(got[i]["bits"] - sum(costs[g] for g in grams(t)) / len(t.split())) < 1e-4
    assert [got[i]["bits"] for i in (99, 100, 103)] == [None] * 3
    if not rows:
        carried = {r["id"]: r for r in quality.measure(df, model, {"doc_id": "id", "text": "words"}).collect()}
        assert {i: (r["bits"], r["words"]) for i, r in carried.items()} == {i: (got[i]["bits"], t) for i, _, t in data}


def test_many_letters(monkeypatch):
    wide = "".join(chr(0x4E00 + i) for i in range(8000)) + " ab ab"
    rows, n = quality.distinct([wide, "ab ab"])
    want = Counter(grams(wide)) + Counter(grams("ab ab"))
    assert dict(zip(quality._names(rows).tolist(), n.tolist())) == want
    rows, n = quality.distinct(["ab ab", "b"])
    assert dict(zip(quality._names(rows).tolist(), n.tolist())) == Counter(grams("ab ab")) + Counter(grams("b"))


def test_base_counts_and_bands(spark, tmp_path):
    r = random.Random(5)
    words = ["".join(r.choices("aeioulnrst", k=r.randint(2, 7))) for _ in range(300)]
    good = [" ".join(r.choices(words, k=r.randint(60, 120))) for _ in range(60)]
    noise = " ".join("".join(r.choices("qxzwkjv#%", k=9)) for _ in range(80))
    short, again = "one # two\none # two", "a b c " * 30
    rows = [(i, "en", t) for i, t in enumerate([*good, noise, short, again])] + [(None, None, None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = quality.op2_quality(spark, str(tmp_path)).collect()
    by = {x["doc_id"]: x for x in got}
    assert len(got) == len(rows)
    assert [by[i]["kept"] for i in range(63)] == [True] * 60 + [False] * 3
    assert not by[60]["base_failed"] and by[60]["perplexity"] > by[60]["perplexity_high"]
    assert tuple(by[61][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == (6, 14, 2, 1, 6)
    assert by[62]["base_failed"] and by[62]["n_repeat_words"] == 90 and by[None]["n_words"] == 0


def test_low_band(spark, tmp_path):
    """A text of a few short words, in ever new order so that the base rules let it pass, costs less than its language's texts."""
    r = random.Random(6)
    words = ["".join(r.choices("aeioulnrst", k=r.randint(2, 9))) for _ in range(3000)]
    rows = [(i, "en", " ".join(r.choices(words, k=80))) for i in range(150)]
    small = [a + b for a in "aeio" for b in "lnrst"]
    rows.append((150, "en", " ".join(r.choice(small) if r.random() < 0.9 else r.choice(words) for _ in range(80))))
    rows += [(151, "it", " ".join(r.choices(words, k=80))), (152, "it", " ".join(r.choices(words, k=80)))]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    by = {x["doc_id"]: x for x in quality.op2_quality(spark, str(tmp_path)).collect()}
    assert by[150]["perplexity"] < by[150]["perplexity_low"] and not by[150]["kept"] and not by[150]["base_failed"]
    assert all(x["kept"] for i, x in by.items() if i != 150)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, text string, model string, block int")
    assert quality.judge(df).count() == 0 and quality.keep_good(df).columns == df.columns
