"""Nearest vectors against all cosines, with and without groups among them."""

import numpy as np
import pytest

from veritrace.operators import nearest


@pytest.mark.parametrize("groups", [True, False])
def test_nearest(spark, monkeypatch, groups):
    for name, value in (("PART", 30), ("ASKED", 5), ("SAMPLE", 150)):
        monkeypatch.setattr(nearest, name, value)
    g = np.random.default_rng(8)
    x = g.normal(size=(400, 16))
    if groups:
        x = g.normal(size=(12, 16))[g.integers(0, 12, 400)] + 0.1 * x
    x[7] = x[3]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [1.0] * 4), (504, [None] * 16), (3000, rows_of(x[9] * 3))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cells = nearest.build(df)
    asked = nearest.usable(df.where("vec_id % 20 = 0 OR vec_id IN (3, 7, 503)"), "vec_id", "embedding")
    got = nearest.nearest(cells, asked, 10, 3).collect()
    ids = np.array([*range(400), 3000])
    u = np.vstack([x, x[9] * 3])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    score = np.round(u @ u.T, 6)
    for q in [*range(0, 400, 20), 3, 7, 3000]:
        at = int(np.flatnonzero(ids == q)[0])
        other = np.flatnonzero(ids != q)
        want = other[np.lexsort((ids[other], -score[at][other]))[:10]]
        found = sorted((r["rank"], r["id"], r["score"]) for r in got if r["question"] == q)
        assert [f[1] for f in found] == ids[want].tolist() and np.allclose([f[2] for f in found], score[at][want], atol=1.1e-6)
    assert {r["question"] for r in got} == {*range(0, 400, 20), 3, 7, 3000}
    if groups:
        assert np.mean([r["first"] for r in got]) >= 0.9


def rows_of(v):
    return [float(c) for c in v]


def test_empty(spark):
    assert nearest.build(spark.createDataFrame([], "vec_id long, embedding array<float>")) is None
