"""Whitened coordinates against plain numpy; merged moments; odd vectors."""

import math

import numpy as np
import pytest

from veritrace.llm import whitening


def plain(rows, components=4):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of (vec_id, vector) rows."""
    good = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in good}))
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    out = []
    for i, x in good:
        for k in range(min(components, fit.shape[1])):
            out.append((i, k + 1, n, sum((n * a - int(b)) ** 2 for a, b in zip(x, s)), abs(float((np.array(x) - s / n) @ q[:, k] / math.sqrt(e[k]))), e[k] / e.sum()))
    return out


def vectors(seed, n=300, d=6):
    g = np.random.default_rng(seed)
    m = (g.normal(size=(n, d)) * np.arange(1, d + 1) / 4 + g.normal(size=d)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(m)]
    rows += [(n, None), (n + 1, [float("nan")] * d), (n + 2, [1.0] * (d - 1) + [None]), (n + 3, [float("inf")] + [0.0] * (d - 1)), (n + 4, [-0.0] * d), (None, [0.25] * d)]
    return rows + [(n + 5 + k, rows[7][1]) for k in range(40)] + [rows[8]] * 3


@pytest.mark.parametrize("parts", [1, 7])
def test_query(spark, tmp_path, parts):
    rows = vectors(3)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "'c' AS x", "2 AS n").repartition(parts).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op11_whitening(spark, str(tmp_path)).collect()
    want = sorted(plain(rows), key=str)
    found = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got), key=str)
    assert [x[:4] for x in sorted(found, key=lambda x: str(x[:4]))] == [x[:4] for x in sorted(want, key=lambda x: str(x[:4]))]
    by = {x[:2]: x[4:] for x in want}
    assert all(np.allclose(x[4:], by[x[:2]], rtol=1e-9, atol=1e-9) for x in found)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    signs = {r["component"]: set() for r in got}
    for r in got:
        if r["vec_id"] in (7, 305, 306):
            signs[r["component"]].add(r["whitened"])
    assert all(len(s) == 1 for s in signs.values())


def test_moments_merge_in_any_order():
    g = np.random.default_rng(4)
    x = (g.integers(-1000, 1000, size=(200, 5)) + 10**6).astype(np.int64)
    whole = whitening.Moments.of(x)
    parts = [whitening.Moments.of(p) for p in (x[:1], x[1:90], x[90:93], x[93:])]
    for order in ((0, 1, 2, 3), (3, 1, 0, 2)):
        m = parts[order[0]]
        for k in order[1:]:
            m = m + parts[k]
        assert m.n == 200 and m.sums.tolist() == [int(c) for c in x.sum(axis=0)]
        assert np.allclose(m.mean, whole.mean, rtol=1e-14) and np.allclose(m.scatter, whole.scatter, rtol=1e-9)


def test_large_entries_are_exact(spark):
    rows = [(1, [3e10, 1.0]), (2, [-2e10, 0.5]), (3, [1e9, 7.0]), (4, [1e30, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    xs = [[256 * 30_000_000_000, 256], [-256 * 20_000_000_000, 128], [256 * 10**9, 1792], [(1 << 63) - 1, 256]]
    s = [sum(c) for c in zip(*xs)]
    want = {i + 1: sum((4 * a - b) ** 2 for a, b in zip(x, s)) for i, x in enumerate(xs)}
    assert {r["vec_id"]: r["deviation"] for r in got} == {k: v if v < 1 << 63 else None for k, v in want.items()}


def test_flat_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in got] == [(1, 0, None, None)] * 4
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], r["whitened"] is None) for r in got) == [(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, True)]
    assert {r["explained"] for r in got if r["component"] == 1} == {1.0}
