"""Fingerprints, trie nodes and groups against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from veritrace.llm import common, simhash


def plain(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, ids):
    root = list(range(len(prints)))
    for j in range(len(prints)):
        for i in range(j):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return [min((ids[k] for k in range(len(prints)) if root[k] == root[i] and ids[k] is not None), default=None) for i in range(len(prints))]


@pytest.mark.parametrize("hot", [False, True])
def test_query(spark, monkeypatch, tmp_path, hot):
    monkeypatch.setattr(simhash, "LEAF", 4)
    if hot:
        monkeypatch.setattr(simhash, "frequent", lambda counts, key, total: [r[0] for r in counts.where("n > 2").collect()])
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(25):
        base = r.choices(words, k=r.randint(1, 400))
        for _ in range(r.randint(1, 4)):
            copy = list(base)
            copy[r.randrange(len(copy))] = r.choice(words)
            texts.append("\t".join(copy) if r.random() < 0.2 else " ".join(copy).upper())
    texts += [None, "", " \n", "a b", "A  b", "a b c d", "Ä b", "ä b", "x" * 4000] + ["same text again"] * 5
    ids = [None if i == 3 else i for i in range(len(texts))]
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").selectExpr("*", "'x' AS fp", "1 AS component").write.parquet(f"{tmp_path}/documents.parquet")
    prints = [plain(t) for t in texts]
    want = sorted(zip(map(str, ids), [f"{p:016x}" for p in prints], map(str, components(prints, ids))))
    got = simhash.op6_simhash(spark, str(tmp_path)).collect()
    assert sorted((str(x["doc_id"]), x["fingerprint"], str(x["component_id"])) for x in got) == want


def test_partners():
    r = random.Random(3)
    leaves, stack = [], [(0, 0)]
    while stack:
        d, p = stack.pop()
        if d < 3 or (d < 9 and r.random() < 0.6):
            stack += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
        elif r.random() < 0.8:
            leaves.append((d, p))
    leaves.sort(key=lambda x: x[1] << (64 - x[0]))
    starts, depth = np.array([p << (64 - d) for d, p in leaves], np.uint64), np.array([d for d, _ in leaves])
    for budget in (0, 1, 2, 3):
        for i, (d, p) in enumerate(leaves):
            near = [j for j, (e, q) in enumerate(leaves) if ((p >> max(0, d - e)) ^ (q >> max(0, e - d))).bit_count() <= budget]
            assert simhash.partners(i, starts, depth, budget) == near


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 50)
    texts = [" ".join(f"w{i % 17}{i}" for i in range(n)) for n in (10, 30, 49, 52, 53, 170, 3)]
    assert simhash._fingerprints(texts, 3).view(np.uint64).tolist() == [plain(t) for t in texts]


def test_rows_are_told_apart_by_all_columns(spark):
    rows = spark.createDataFrame([(1, "a", "x", None), (1, "a", "y", None), (1, "a", None, "x"), (1, "a", "x", None), (2, None, None, None)], "doc_id long, text string, _row_a string, _row_b string")
    keyed, a, b = common.row_key(rows)
    keys = keyed.select(a, b)
    assert keys.distinct().count() == 4 and keyed.columns[:4] == rows.columns
    gone = keyed.where("_row_a = 'y'").select(a, b)
    assert sorted(map(str, common.drop_rows(rows, gone).collect())) == sorted(map(str, rows.where("_row_a IS NULL OR _row_a = 'x'").collect()))
    assert common.keep_rows(rows, keys, keys).count() == 4
