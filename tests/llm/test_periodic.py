"""Runs against brute force over all periods; the query against a plain one."""

import random
import zlib
from hashlib import sha256

import pytest

from veritrace.llm import periodic


def brute(w):
    """Every (start, length, period) with the smallest period, of 6 words and 4 periods or more."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            part = w[i : j + q]
            if len(part) >= max(6, 4 * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((i, len(part), q))
            i = max(j, i) + 1
    return sorted(out)


def words(r):
    k = r.choice([1, 2, 2, 3, 4, 30])
    w = [r.randrange(k) for _ in range(r.randint(0, 60))]
    while r.random() < 0.6:
        b = [r.randrange(k) for _ in range(r.randint(1, 7))]
        w += (b * 9)[: r.randint(1, len(b) * 8)]
    return [str(x).encode() for x in (w * r.randint(1, 5) if r.random() < 0.3 else w)]


@pytest.mark.parametrize("piece", [8, 1 << 16])
def test_runs(monkeypatch, piece):
    monkeypatch.setattr(periodic, "PIECE", piece)
    r = random.Random(5)
    for _ in range(150):
        some = [words(r) for _ in range(5)]
        assert list(periodic.scan(some, periodic._Codes())) == [brute(w) for w in some]


def test_squares_have_primitive_roots_only():
    r = random.Random(6)
    for _ in range(200):
        w = [int(x) for x in words(r)]
        for end, q in periodic.squares(w):
            root = w[end - q + 1 : end + 1]
            assert root == w[end - 2 * q + 1 : end - q + 1] and not any(root == root[:d] * (q // d) for d in range(1, q) if q % d == 0)


def plain(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    rest = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (str(doc_id), len(runs), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4), sha256(lines.encode()).hexdigest(), sha256(rest).hexdigest())


def test_query(spark, tmp_path):
    r = random.Random(9)
    texts = [" ".join(f"w{int(x)}" for x in words(r)) for _ in range(150)] + [None, "", " \t\n", "a " * 5, "a\n" * 6, "a b " * 4, "ä b " * 9, "la " * 3000]
    ids = [None if i == 4 else i - 3 for i in range(len(texts))]
    rows = [*zip(ids, texts), (ids[7], texts[7])]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS runs", "1 AS _by").write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op12_periodic(spark, str(tmp_path)).collect()
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(((str(x["doc_id"]), *(x[c] for c in names)) for x in got), key=str) == sorted((plain(*x) for x in rows), key=str)


def test_very_long_text(spark):
    text = "x y " * 150_000 + "z"
    rows = periodic.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(x) for x in rows[0]["runs"]] == [(0, 300_000, 2)] and rows[0]["collapsed"] == "x y z"
    assert periodic.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []
