"""Vector links and groups against all cosines; error bounds; odd vectors."""

import math

import numpy as np
import pytest

from veritrace.llm import vectors


def plain(rows, least=0.93):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector, label) rows."""
    def good(v, label):
        return label is not None and bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)

    n = len(rows)
    ok = [good(v, label) for _, v, label in rows]
    u = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for (_, v, _), k in zip(rows, ok)]
    linked = [[ok[i] and ok[j] and i != j and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and bool(float(u[i] @ u[j]) >= least) for j in range(n)] for i in range(n)]
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked[i][j] and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    out = []
    for i, (vec, *_) in enumerate(rows):
        low = min((rows[k][0] for k in range(n) if group[k] == group[i] and rows[k][0] is not None), default=None)
        out.append((vec, sum(linked[i]), low, vec is not None and vec == low))
    return sorted(out, key=str)


def made(seed, d=12):
    g = np.random.default_rng(seed)
    rows = []
    for label in (1, 2, 3):
        for _ in range(12):
            base = g.normal(size=d)
            for _ in range(g.integers(1, 12)):
                rows.append((base + g.normal(size=d) * g.choice([0.02, 0.12, 0.28]), label))
    rows = [(i, [float(np.float32(c)) for c in v * g.choice([1e-3, 1.0, 50.0])], label) for i, (v, label) in enumerate(rows)]
    g.shuffle(rows)
    n = len(rows)
    rows = [(int(i), v, int(label)) for i, v, label in rows]
    odd = [None, [], [0.0] * d, [1.0] * (d - 1) + [None], [float("nan")] * d, [1.0] + [float("inf")] * (d - 1)]
    rows += [(n + k, v, 1) for k, v in enumerate(odd)] + [(n + 20, rows[0][1], None), (None, rows[1][1], rows[1][2]), (None, [1.0] + [0.0] * (d - 1), 9), (n + 21, rows[0][1][:4], rows[0][2])]
    return rows + [(n + 30 + k, rows[2][1], rows[2][2]) for k in range(30)]


@pytest.mark.parametrize("many", [False, True])
def test_query(spark, tmp_path, monkeypatch, many):
    if many:  # every part is cut into many tiles, hot keys are salted
        monkeypatch.setattr(vectors, "LOW", 7)
        monkeypatch.setattr(vectors, "TILE", 7)
        monkeypatch.setattr(vectors, "frequent", lambda counts, key, total: [r[0] for r in counts.where("n > 5").select(key).collect()])
    rows = made(5)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS key", "2 AS n").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vectors.op13_near_vectors(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_bounds_hold():
    g = np.random.default_rng(6)
    for d in (1, 2, 64, 2500):
        base = g.normal(size=(1, d))
        x = vectors.unscaled(base + g.normal(size=(60, d)) * g.uniform(0, 0.6, size=(60, 1)))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        cos = u @ u.T
        three = vectors.quantised(x)
        may, sure = np.zeros((60, 60), bool), np.zeros((60, 60), bool)
        for i, j, s in vectors.bounded(three, three, 0.93, True):
            may[i, j] = True
            sure[i[s], j[s]] = True
        upper = np.triu(np.ones((60, 60), bool), 1)
        assert not ((cos >= 0.93) & upper & ~may).any() and not (sure & (cos < 0.93)).any()


def test_extremes_and_empty(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1e300, 1e300], "a"), (2, [1e-310, 1e-310], "a"), (3, [1e300, -1e300], "a"), (4, [-1.0, -1.0], "a")]
    got = vectors.near_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
