"""Nearest vectors by cosine for many questions: cells around means, a few probed first, the others as far as their bounds ask for it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrace.operators.components import BROADCAST_ROWS, stored
from veritrace.operators.graph import top_per_key

#: The cells' means are fitted on the vectors of so many least hashes, in so many rounds; there are at most CELLS.
SAMPLE, ROUNDS, CELLS = 20_000, 10, 1024
#: Vectors and questions that meet in one task.
PART, ASKED = 8192, 1024
#: Rounding that bounds allow for; scores are told to this.
SLACK, PLACES = 1e-6, 6


@dataclass
class Cells:
    """Means of length 1, the vectors with their cell (cell, id, v), and for each cell (cell, n, least) its size and least cosine with its mean."""

    means: np.ndarray
    rows: DataFrame
    sizes: DataFrame


def _unit(vectors) -> np.ndarray:
    x = np.array(vectors.to_list(), float)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v) of the rows whose vector is there, not zero and all finite."""
    v = F.col(f"`{vector}`")
    ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return df.where(F.coalesce(ok, F.lit(False))).select(F.col(f"`{id}`").alias("id"), v.cast("array<double>").alias("v"))


def _means(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the first k vectors; a cell that loses all keeps its mean."""
    means = sample[:k].copy()
    for _ in range(ROUNDS):
        cell = np.argmax(sample @ means.T, axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, cell, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        means = np.where(norm > 0, sums / np.where(norm > 0, norm, 1.0), means)
    return means


def build(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> Cells | None:
    """Every usable vector of df in the cell of its nearest mean; None if there is none. Of several lengths, only the commonest (of equals, the longest) is taken."""
    rows = usable(df, id, vector)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return None
    d, n = size["d"], size["count"]
    rows = rows.where(F.size("v") == d)
    some = rows.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h").limit(SAMPLE).select("v").toPandas()  # a bounded sample
    sample = _unit(some["v"])
    shared = df.sparkSession.sparkContext.broadcast(_means(sample, min(CELLS, len(sample), max(1, round(n**0.5)))))

    def place(batches):
        for pdf in batches:
            if len(pdf):
                near = _unit(pdf["v"]) @ shared.value.T
                cell = near.argmax(axis=1)
                yield pdf.assign(cell=cell, near=near[np.arange(len(pdf)), cell])

    kind = rows.schema["id"].dataType.simpleString()
    placed = stored(rows.mapInPandas(place, f"id {kind}, v array<double>, cell long, near double"))
    return Cells(shared.value, placed.select("cell", "id", "v"), stored(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least"))))


def _met(cells: Cells, asked: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(question, id, score): the k nearest of each question (question, q) within each part of the cells that it probes (question, cell)."""
    parts = cells.sizes.select("cell", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    chunks = probes.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("chunks"))
    size = stored(parts.join(chunks, "cell"))  # a row a cell, CELLS at most
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = cells.rows.join(F.broadcast(size), "cell").select("cell", deal("v", "parts").alias("part"), every("chunks").alias("chunk"), "id", "v")
    asks = probes.join(asked, "question").join(F.broadcast(size), "cell").select("cell", every("parts").alias("part"), deal("question", "chunks").alias("chunk"), "question", "q")
    kind = cells.rows.schema["id"].dataType.simpleString()

    def nearest(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame({"question": [], "id": [], "score": []})
        score = np.round(_unit(asks["q"]) @ _unit(rows["v"]).T, PLACES)
        id, out = rows["id"].to_numpy(), []
        for question, s in zip(asks["question"], score, strict=True):
            at = np.flatnonzero(id != question)
            if len(at) > k:
                at = at[s[at] >= np.partition(s[at], -k)[-k]]
                at = at[np.lexsort((id[at], -s[at]))[:k]]
            out.append(pd.DataFrame({"question": question, "id": id[at], "score": s[at]}))
        return pd.concat(out)

    keys = ("cell", "part", "chunk")
    return rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(nearest, f"question {kind}, id {kind}, score double")


def nearest(cells: Cells, questions: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
    """(question, id, score, rank, first): the k vectors with the largest cosine for each question (id, v), without itself, and whether they are in its first cells.

    A question first probes the ``probes`` cells with the nearest means. What it finds there bounds the rest: a cell whose
    mean is farther than its widest member allows can hold nothing nearer, and all other cells are probed too; so the
    result is exact, and ``first`` tells what stopping early would have found. Scores have six places; equal ones go by id.
    Where vectors have no groups, no cell can be left out, and each question meets every row, block by block. Questions must have different ids.
    """
    kind = questions.schema["id"].dataType.simpleString()
    width = cells.means.shape[1]
    asked = stored(questions.where(F.size("v") == width).select(F.col("id").alias("question"), F.col("v").alias("q")))
    least = {r["cell"]: r["least"] for r in cells.sizes.collect()}  # CELLS rows at most
    shared = asked.sparkSession.sparkContext.broadcast((cells.means[sorted(least)], np.array(sorted(least)), np.arccos(np.clip([least[c] for c in sorted(least)], -1, 1))))

    def probe(batches):
        means, names, wide = shared.value
        for pdf in batches:
            if len(pdf):
                near = _unit(pdf["q"]) @ means.T
                best = np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - wide - SLACK)) + SLACK
                order = np.argsort(-near, axis=1, kind="stable")
                rank = np.argsort(order, axis=1)
                rows = np.repeat(np.arange(len(pdf)), len(names))
                yield pd.DataFrame({"question": pdf["question"].to_numpy()[rows], "cell": np.tile(names, len(pdf)), "turn": rank.ravel(), "best": best.ravel()})

    plan = stored(asked.mapInPandas(probe, f"question {kind}, cell long, turn long, best double"))
    early = stored(_met(cells, asked, plan.where(F.col("turn") < probes).select("question", "cell"), k))
    order = (F.desc("score"), "id")
    early = stored(top_per_key(early, "question", k, *order))
    worst = early.groupBy("question").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    worst = F.broadcast(worst) if asked.count() <= BROADCAST_ROWS else worst
    rest = plan.where(F.col("turn") >= probes).join(worst, "question", "left").where(F.coalesce(F.col("n") < k, F.lit(True)) | (F.col("best") >= F.col("worst") - SLACK)).select("question", "cell")
    late = _met(cells, asked, rest, k).withColumn("first", F.lit(False))
    rows = early.withColumn("first", F.lit(True)).unionByName(late)
    ranked = top_per_key(rows, "question", k, *order)
    return ranked.select("question", "id", "score", F.row_number().over(Window.partitionBy("question").orderBy(*order)).alias("rank"), "first")
