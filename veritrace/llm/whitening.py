"""Whitening of embeddings: mean and covariance by merging the moments of partitions, eigenvectors, a pass that checks them."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from veritrace.llm.common import free, read, stored

#: Levels of the tree in which partitions' moments are merged.
DEPTH = 3
#: Entries are counted in steps of 1 / SCALE.
SCALE = 256


@dataclass
class Moments:
    """Count, mean, scatter about the mean, and exact sums of rows."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        """Those of the rows of x, centred before they are multiplied."""
        sums = np.zeros(x.shape[1], object)
        if x.dtype == np.int64:  # halves of 32 bits, so that no sum runs over
            sums = (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        mean = x.mean(axis=0)
        c = x - mean
        return Moments(len(x), mean, c.T @ c, sums)

    def __add__(self, other: Moments) -> Moments:
        """Chan's formula for the moments of both together."""
        n, away = self.n + other.n, other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(away, away) * (self.n * other.n / n)
        return Moments(n, self.mean + away * (other.n / n), scatter, self.sums + other.sums)


@dataclass
class Whitening:
    """What ``fit`` has found: of n vectors the exact sums, and the first components with their variances."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def away(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums without rounding: longs where they hold it, else Python's integers."""
        most = self.n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, self.sums.tolist()), default=0)
        if most < 1 << 62:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def project(self, away: np.ndarray) -> np.ndarray:
        """Whitened coordinates; not a number along components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (away.astype(float) / self.n) @ self.vectors / np.where(self.values > 0, np.sqrt(self.values), np.nan)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def steps(vector: Column) -> Column:
    """The entries as whole numbers of 1 / SCALE, rounded down; beyond longs, the last of them."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for b in batches:
        if b.num_rows:
            yield b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)


def _merged(fit: DataFrame, d: int, made=lambda x: x) -> Moments:
    """The moments of made(rows): one for each partition, merged in a tree."""

    def work(batches):
        total = None
        for x in _matrices(batches, d):
            part = Moments.of(made(x))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["m"])

    return fit.mapInArrow(work, "m binary").rdd.map(lambda r: pickle.loads(r["m"])).treeReduce(lambda a, b: a + b, DEPTH)


def fit(rows: DataFrame, components: int = 4) -> tuple[Whitening, int] | None:
    """The whitening of the distinct arrays of longs ``x``, and their length; None if there are none.

    Of arrays of different lengths, those of the commonest count (of several, the longest). Variances that are rounding
    errors of the largest count as none. The second pass whitens all distinct arrays and holds their covariance against
    the identity.
    """
    every = stored(rows.select("x").distinct())
    lengths = every.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return None
    d = lengths["d"]
    every = every.where(F.size("x") == d)
    m = _merged(every, d)
    values, vectors = np.linalg.eigh(m.scatter / m.n)
    order = np.argsort(-values, kind="stable")
    k = min(components, d)
    floor = d * np.finfo(float).eps * max(values.max(), 0.0)
    found = Whitening(m.n, m.sums, np.where(values > floor, values, 0.0)[order[:k]], vectors[:, order[:k]], float(np.trace(m.scatter) / m.n))
    some = int((found.values > 0).sum())
    if some:
        narrow = replace(found, values=found.values[:some], vectors=found.vectors[:, :some])
        again = _merged(every, d, lambda x: narrow.project(narrow.away(x)))
        found.identity_error = float(np.abs(again.scatter / again.n - np.eye(some)).max())
    return found, d


def whiten(df: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = 4) -> DataFrame:
    """(keep..., component, n, deviation, whitened, explained, identity_error) for every usable row of df and each of the first components.

    Rows whose vector is null, empty, of another length than most, or holds null or non-finite entries are left out;
    equal vectors count once in the fit; repeated rows stay; other columns are not read; an empty table gives no rows. Components
    without variance have no ``whitened``. A deviation beyond longs is null.
    """
    v = F.col(f"`{vector}`")
    x = free(df.select(*[f"`{c}`" for c in keep]), "x")
    rows = df.where(usable(v)).select(steps(v).alias(x), *[F.col(f"`{c}`") for c in keep])
    own = StructType.fromDDL("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    schema = StructType([df.schema[c] for c in keep] + [StructField(f.name, f.dataType) for f in own])
    made = fit(rows.select(F.col(x).alias("x")), components)
    if made is None:
        return df.sparkSession.createDataFrame([], schema)
    model, d = made
    shared = df.sparkSession.sparkContext.broadcast(model)  # d x components numbers

    def work(batches):
        model = shared.value
        k = len(model.values)
        explained = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)
        for b in batches:
            for m in _matrices([b], d):
                away = model.away(m)
                most = max(abs(int(away.min())), abs(int(away.max())))
                squares = away if most**2 * d < 1 << 63 else away.astype(object)
                deviation = [s if s < 1 << 63 else None for s in (squares * squares).sum(axis=1).tolist()]
                rows = np.repeat(np.arange(len(m)), k)
                n = len(rows)
                made = {
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))), "n": pa.array(np.full(n, model.n)), "deviation": pa.array(deviation, pa.int64()).take(pa.array(rows)),
                    "whitened": pa.array(model.project(away).ravel(), from_pandas=True), "explained": pa.array(np.tile(explained, len(m)), from_pandas=True), "identity_error": pa.array([model.identity_error] * n, pa.float64()),
                }
                yield pa.RecordBatch.from_arrays([c.take(pa.array(rows)) for c in b.columns[1:]] + list(made.values()), names=[*keep, *made])

    return rows.where(F.size(x) == d).mapInArrow(work, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened coordinates of every usable vector of embeddings, in steps of 1 / 256.

    Null and repeated vec_ids stay; see ``whiten`` for odd vectors, repeats, extra columns and empty tables. Equal
    variances are ordered as the decomposition gives them.
    """
    return whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
ORACLE_SQL: dict[str, str] = {}
