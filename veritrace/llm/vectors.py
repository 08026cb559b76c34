"""Near-duplicate embeddings: int8 products of tiles of vectors, and full precision only where their error bounds leave it open."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.common import BROADCAST_ROWS, frequent, join_frequent, read, stored
from veritrace.llm.simhash import _roots
from veritrace.llm.whitening import usable
from veritrace.operators.components import connected_components

#: Links have at least this cosine.
LEAST = 0.93
#: A tile has so many vectors at most, and so many bytes; smaller tables are cut into TILES of LOW vectors or more.
TILE, TILE_BYTES, TILES, LOW = 16_384, 8 << 20, 64, 256
#: Products held at a time in a task.
AT_ONCE = 1 << 20
#: int8 products of so many dimensions are sums of whole numbers that float32 holds without rounding.
EXACT = 1024
#: Covers the rounding of float64 in norms, bounds and cosines.
SLACK = 1e-9


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, error): int8 rows such that row i of x, brought to length 1, is scale * q but for a rest of length error or less."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(u - scale[:, None] * q, axis=1) + SLACK / 8


def unscaled(x: np.ndarray) -> np.ndarray:
    """The rows as float64, each times a power of two that keeps squares in range; cosines stay as they are."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: whole numbers, by float32 in blocks of EXACT dimensions."""
    parts = [a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T for k in range(0, a.shape[1], EXACT)]
    return parts[0] if len(parts) == 1 else np.sum(parts, axis=0, dtype=np.float64)


def bounded(a: tuple, b: tuple, least: float, same: bool):
    """(i, j, sure) of pairs that may have a cosine of ``least``, some at a time; those with sure have it whatever the rests are.

    u.v = (s q + r).(t p + w) departs from s t q.p by at most |s q| |w| + |r|. With ``same`` each unordered pair comes once.
    """
    (qa, sa, ea), (qb, sb, eb) = a, b
    length = sa * np.linalg.norm(qa.astype(np.float32), axis=1).astype(float)
    high = eb.max(initial=0.0)
    step = max(1, AT_ONCE // max(1, len(qb)))
    for lo in range(0, len(qa), step):
        first = lo if same else 0
        p = products(qa[lo : lo + step], qb[first:])
        rows = slice(lo, lo + step)
        p *= sb[first:].astype(p.dtype)
        i, j = np.nonzero(p >= ((least - length[rows] * high - ea[rows] - 1e-5) / sa[rows]).astype(p.dtype)[:, None])
        i, j = i + lo, j + first
        if same:
            i, j = i[i < j], j[i < j]
        value = np.einsum("ij,ij->i", qa[i].astype(np.int32), qb[j].astype(np.int32)) * sa[i] * sb[j]
        bound = length[i] * eb[j] + ea[i] + SLACK
        may = value + bound >= least
        yield i[may], j[may], (value - bound >= least)[may]


class _Links:
    """Of the vectors of two tiles (one, if they are the same): how many links each has there, and the smallest of its group."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.weights, self.place = ids[order], weights[order], np.argsort(order)
        self.root, self.n = np.arange(len(ids)), np.zeros(len(ids), np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = self.place[i], self.place[j]
        for here, there in ((i, j), (j, i)):
            self.n += np.bincount(here, self.weights[there], len(self.n)).astype(np.int64)
        a, b = self.root[i], self.root[j]
        if (a != b).any():
            self.root = _roots(len(self.ids), a[a != b], b[a != b])[self.root]

    def rows(self) -> pd.DataFrame:
        to = pd.Series(self.ids[self.root], dtype="Int64").mask(self.root == np.arange(len(self.ids)))
        return pd.DataFrame({"id": self.ids, "n": self.n, "to": to})


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the rows of both tiles; of one tile twice, the same places."""
    same = pdf["a"].iloc[0] == pdf["b"].iloc[0]
    side = pdf["side"].to_numpy()
    here = np.flatnonzero(side == 0)
    return here, here if same else np.flatnonzero(side == 1), same


def _tile(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links that are sure, and which vectors have pairs that full precision has to decide."""
    q = np.frombuffer(b"".join(pdf["q"]), np.int8).reshape(len(pdf), -1)
    scale, error = pdf["scale"].to_numpy(), pdf["error"].to_numpy()
    left, right, same = _sides(pdf)
    links, open_ = _Links(pdf["id"].to_numpy(), pdf["w"].to_numpy()), np.zeros(len(pdf), bool)
    for i, j, sure in bounded((q[left], scale[left], error[left]), (q[right], scale[right], error[right]), least, same):
        i, j = left[i], right[j]
        links.add(i[sure], j[sure])
        open_[i[~sure]] = open_[j[~sure]] = True
    out = links.rows()
    for c in ("part", "a", "b"):
        out[c] = pdf[c].iloc[0]
    out["side"], out["open"] = pdf["side"].to_numpy()[np.argsort(links.place)], open_[np.argsort(links.place)]
    return out[(out["n"] > 0) | out["to"].notna() | out["open"]]


def _again(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """The links among the pairs that their bounds left open, by cosines of the vectors themselves."""
    x = unscaled(np.stack(pdf["v"].to_numpy()))
    norm = np.linalg.norm(x, axis=1)
    q, scale, error = quantised(x)
    left, right, same = _sides(pdf)
    links = _Links(pdf["id"].to_numpy(), pdf["w"].to_numpy())
    for i, j, sure in bounded((q[left], scale[left], error[left]), (q[right], scale[right], error[right]), least, same):
        i, j = left[i[~sure]], right[j[~sure]]
        for lo in range(0, len(i), AT_ONCE // 16):
            a, b = i[lo : lo + AT_ONCE // 16], j[lo : lo + AT_ONCE // 16]
            linked = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= least
            links.add(a[linked], b[linked])
    out = links.rows()
    return out[(out["n"] > 0) | out["to"].notna()]


def classes(rows: DataFrame) -> DataFrame:
    """(key, id, part, v, w, least_id): the different vectors of each label and length, how many rows have each, and their least id."""
    found = rows.groupBy("key").agg(F.first("part").alias("part"), F.first("v").alias("v"), F.count("*").alias("w"), F.min("id").alias("least_id"))
    return stored(found.withColumn("id", F.monotonically_increasing_id()))  # fixed by what is stored


def links(found: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(id, n) and (src, dst): how many rows each class of ``classes`` is linked with, and links that keep its groups connected.

    The classes of a part are dealt over tiles by a hash; each pair of tiles is one group of rows, of int8 vectors only.
    """
    n = found.count()
    sizes = found.groupBy("part").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"))
    tile = F.greatest(F.lit(LOW), F.least(F.lit(TILE), F.floor(TILE_BYTES / F.col("d")), F.lit(-(-n // TILES))))
    parts = stored(sizes.select("part", F.ceil(F.col("n") / tile).alias("k")).where("k > 1"))
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts

    def small(batches):
        for pdf in batches:
            if len(pdf):
                q, scale, error = np.empty(len(pdf), object), np.empty(len(pdf)), np.empty(len(pdf))
                for d, at in pdf.groupby(pdf["v"].map(len)).indices.items():
                    m, scale[at], error[at] = quantised(unscaled(np.stack(pdf["v"].to_numpy()[at])))
                    q[at] = [row.tobytes() for row in m]
                yield pdf[["id", "part", "w"]].assign(q=q, scale=scale, error=error)

    rows = found.select("id", "part", "w", "v").mapInPandas(small, "id bigint, part string, w bigint, q binary, scale double, error double")
    rows = rows.join(parts, "part", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("id"), F.col("k"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    ends = [F.least("at", "with").alias("a"), F.greatest("at", "with").alias("b"), (F.col("at") > F.col("with")).cast("int").alias("side")]
    rows = rows.select("id", "part", "w", "q", "scale", "error", *ends)
    whole = "id bigint, n bigint, to bigint"
    made = stored(rows.groupBy("part", "a", "b").applyInPandas(lambda pdf: _tile(pdf, least), whole + ", part string, a bigint, b bigint, side int, open boolean"))
    left = made.where("open").select("id", "part", "a", "b", "side").join(found.select("id", "v", "w"), "id")
    sure = made.select("id", "n", "to")
    every = sure if left.isEmpty() else stored(sure.union(left.groupBy("part", "a", "b").applyInPandas(lambda pdf: _again(pdf, least), whole)))
    return every.groupBy("id").agg(F.sum("n").alias("n")), every.where("to IS NOT NULL").select(F.col("id").alias("src"), F.col("to").alias("dst"))


def near_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of df: how many other rows of its label it is linked with, and the least id in reach.

    Rows are linked at a cosine of ``least`` or more. Rows without label, and vectors that are null, empty or zero or hold null or
    non-finite entries, are linked with nothing, nor are vectors of different lengths; equal vectors of one label are linked and
    compared once. Repeated rows are rows of their own. A row without id takes part; where no row in reach has an id,
    component_id is null and kept false. Other columns are not read; an empty table gives no rows.
    """
    v = F.col(f"`{vector}`")
    rows = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), v.alias("v"))
    ok = F.col("label").isNotNull() & usable(F.col("v")) & F.coalesce(F.exists("v", lambda c: c != 0), F.lit(False))
    part = F.concat(F.size("v").cast("string"), F.lit(":"), F.col("label"))
    key = F.concat_ws(":", F.xxhash64(F.lit(1), part, "v"), F.xxhash64(F.lit(2), F.reverse("v"), part))  # 128 bits
    good = rows.where(ok).select("id", part.alias("part"), "v", key.alias("key"))
    found = classes(good)
    counts, edges = links(found, least)
    groups = connected_components(edges)
    named = found.select("key", "id", "w", "least_id").join(groups.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left")
    named = stored(named.withColumns({"component": F.coalesce("component", "id"), "n_links": F.col("w") - 1 + F.coalesce("n", F.lit(0))}))
    ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    ids = stored(ids)
    named = join_frequent(named.select("key", "w", "n_links", "component", "id"), ids.drop("n"), "component", frequent(ids, "component", found.count()), F.col("id"))
    often = frequent(named.select("key", F.col("w").alias("n")), "key", df.count())
    linked = join_frequent(good.select("id", "key"), named.select("key", "n_links", "component_id"), "key", often, F.col("id"))
    alone = rows.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.select("id", "n_links", "component_id").union(alone)
    return out.select(F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings of one label at a cosine of 0.93 or more; see ``near_vectors`` for odd rows."""
    return near_vectors(read(spark, sf_dir, "embeddings"))


QUERIES = {"op13_near_vectors": op13_near_vectors}
ORACLE_SQL = {
    "op13_near_vectors": """WITH RECURSIVE x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
  p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
  r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT e.vec_id, coalesce((SELECT count(*) FROM p WHERE p.a = e.vec_id), 0) AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id, least(e.vec_id, coalesce(m, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY 1) g ON g.a = e.vec_id""",
}
