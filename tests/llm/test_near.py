"""Near-duplicates against brute force: copies with single words changed are far apart in fingerprint bits."""

import random

import pytest

from veritrace.llm import near


def sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar(a, b):
    a, b = sets(a), sets(b)
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


@pytest.mark.parametrize("common", [2, 4])
def test_near_copies_go(spark, monkeypatch, common):
    monkeypatch.setattr(near, "COMMON", common)
    monkeypatch.setattr(near, "PART", common)
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    line = " ".join(r.choices(vocabulary, k=20))  # many texts have it, few are alike
    texts = []
    for _ in range(12):
        base = r.choices(vocabulary, k=r.randint(60, 250))
        for _ in range(6):
            copy = list(base)
            for i in r.sample(range(len(copy)), r.randint(0, 5)):
                copy[i] = r.choice(vocabulary)
            texts.append(" ".join(copy) + (" " + line if r.random() < 0.5 else ""))
    texts += [line + " " + " ".join(r.choices(vocabulary, k=30)) for _ in range(30)] + ["a b", "A  b", "", None]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if similar(texts[i] or "", texts[j] or ""):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    assert len(set(root)) < len(set(texts)) - 20
    texts += ["long " + " ".join(r.choices(vocabulary, k=200_000))] * 2  # more than one group of rows in a task
    root += [len(root), len(root)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert sorted(row["doc_id"] for row in near.keep_one(docs).collect()) == sorted(set(root))


def test_sketches_bound_the_difference():
    import numpy as np

    r = np.random.default_rng(3)
    for n in (0, 1, 5, 40, 300, 3000):
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        for m in (0, n // 5, n, 2 * n):
            b = np.unique(np.concatenate([a[: max(0, n - m)], r.integers(0, 2**64, m // 2, dtype=np.uint64)]))
            d = len(np.setxor1d(a, b))
            assert near.differ(near.sketch(a), near.sketch(b)) <= d
            if n > 200 and d > n:
                assert near.differ(near.sketch(a), near.sketch(b)) > (len(a) + len(b)) / 9


@pytest.mark.parametrize("block", [3, 1000])
def test_sets_that_share_a_shingle_meet_in_tasks(spark, monkeypatch, block):
    """All pairs of different groups that are similar are found; hundreds of others that only share one make no rows."""
    import numpy as np

    monkeypatch.setattr(near, "BLOCK", block, raising=False)
    r = np.random.default_rng(1)
    num, den = near.LEAST
    made = []
    for i in range(60):
        base = r.integers(1, 2**63, int(r.integers(9, 400)), dtype=np.uint64)
        for k in range(3):
            s = base.copy()
            s[: len(s) * k // 20] = r.integers(1, 2**63, len(s) * k // 20, dtype=np.uint64)
            made.append(np.unique(np.append(s[k:], np.uint64(0))))  # 0 is the first shingle of all
    prefix = [s[: len(s) - -(-num * len(s) // den) + 1] for s in made]
    rows = [(int(t.view(np.int64)), i, len(s), at, i) for i, s in enumerate(made) for at, t in enumerate(prefix[i])]
    named = spark.createDataFrame(rows, "token long, sig long, n int, at int, c long")
    sketches = spark.createDataFrame([(i, near.sketch(s)) for i, s in enumerate(made)], "sig long, sketch binary")
    got = [tuple(x) for x in near._met(named, sketches).collect()]
    want = {(i, j) for j, b in enumerate(made) for i, a in enumerate(made[:j]) if (num + den) * len(np.intersect1d(a, b)) >= num * (len(a) + len(b))}
    assert len(want) > 60 and want <= set(got)
    assert len(got) == len(set(got)) < 180 * 3
