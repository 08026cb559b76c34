"""SimHash near-duplicates: 64-bit fingerprints, linked by a self-join of their binary trie."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.common import cut, frequent, join_frequent, map_rows, read
from veritrace.operators.components import connected_components

#: A trie node with at most so many fingerprints is one side of a task, whatever their number in all.
LEAF = 65_536
#: Shingle hashes whose bits are counted at once.
AT_ONCE = 1_000_000
#: Node pairs with at most so many combinations are compared directly.
DIRECT = 32
#: Node pairs that descend together; more wait for their turn, so that memory does not grow with the nodes.
TOGETHER = 1 << 16


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes: the bits that over half of them have. counts has no zeros."""
    bits = np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_in = np.add.reduceat(bits, np.cumsum(counts) - counts, axis=0, dtype=np.int32)
    return np.packbits((2 * set_in > counts[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()


def _fingerprints(texts: list[str | None], width: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    out, held, owner = np.zeros(len(texts), np.uint64), [], []
    size = 0

    def told():
        """Of the texts held whole, their fingerprints."""
        out[owner] = majority(np.array([x for h in held for x in h], np.uint64), np.array([len(h) for h in held]))
        held.clear()
        owner.clear()

    for i, text in enumerate(texts):
        w = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(w) - width + 1 > AT_ONCE:  # a very long text, some of it at a time
            n, set_in = len(w) - width + 1, np.zeros(64, np.int64)
            for lo in range(0, n, AT_ONCE):
                part = np.array([digest(b" ".join(w[k : k + width]), 42) for k in range(lo, min(n, lo + AT_ONCE))], "<u8")
                set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits((2 * set_in > n).astype(np.uint8), bitorder="little").view("<u8")[0]
        elif w:
            held.append([digest(b" ".join(t), 42) for t in zip(*(w[k:] for k in range(width)), strict=False)] if len(w) > width else [digest(b" ".join(w), 42)])
            owner.append(i)
            size += len(held[-1])
            if size >= AT_ONCE:
                told()
                size = 0
    if held:
        told()
    return out.view(np.int64)


def fingerprints(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), width: int = 3) -> DataFrame:
    """(fp, keep...): the SimHash of every whole text as a signed long; a text without words has 0.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased; shingles are ``width`` words
    joined by spaces, repeats included (fewer words: all of them), hashed by XXH64 with seed 42.
    """

    def work(groups):
        for (texts,) in groups:
            yield {"fp": _fingerprints(texts, width)}

    return map_rows(df, ["text"], "fp bigint", work, {c: c for c in keep})


def trie_pairs(a: np.ndarray, b: np.ndarray, budget: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of sorted distinct uint64 arrays with a[i] and b[j] at most ``budget`` bits apart.

    The sorted arrays are the trie: a node is a range that shares its leading bits. Pairs of nodes descend
    together, one bit a level; crossing children cost one bit, and a pair over the budget is dropped. With
    ``same``, a is b and each unordered pair comes once.
    """
    one = np.uint64(1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = [(63, [np.array([x], np.int64) for x in (0, len(a), 0, len(b), 0)])] if len(a) and len(b) else []
    while waiting:
        bit, front = waiting.pop()
        if len(front[0]) > TOGETHER:
            waiting += [(bit, [c[k : k + TOGETHER] for c in front]) for k in range(0, len(front[0]), TOGETHER)]
            continue
        alo, ahi, blo, bhi, err = front
        size = (ahi - alo) * (bhi - blo)
        small = (size <= DIRECT) | (bit < 0)
        if small.any():
            x, n = [v[small] for v in front], size[small]
            at = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            wide = (x[3] - x[2])[at]
            i, j = x[0][at] + k // wide, x[2][at] + k % wide
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            found.append((i[near], j[near]))
            alo, ahi, blo, bhi, err = (v[~small] for v in front)
        if not len(alo):
            continue
        shift = np.uint64(bit)

        def middle(x, lo, hi, shift=shift):
            return np.clip(np.searchsorted(x, ((x[lo] >> shift) | one) << shift), lo, hi)

        am, bm = middle(a, alo, ahi), middle(b, blo, bhi)
        twin = (alo == blo) & (ahi == bhi) if same else np.zeros(len(alo), bool)
        cross = err < budget
        parts = [(alo, am, blo, bm, err, None), (am, ahi, bm, bhi, err, None), (alo, am, bm, bhi, err + 1, cross), (am, ahi, blo, bm, err + 1, cross & ~twin)]
        kids = []
        for *cols, ok in parts:
            live = (cols[1] > cols[0]) & (cols[3] > cols[2])
            live = live if ok is None else live & ok
            kids.append([c[live] for c in cols])
        waiting.append((bit - 1, [np.concatenate(c) for c in zip(*kids, strict=True)]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index in each index's group."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def trie_leaves(fps: DataFrame, n: int) -> list[tuple[int, int]]:
    """The trie's nodes (depth, prefix) that tasks get, in order: none with more than LEAF fingerprints, and none without any.

    Counts come to the driver by node, at most 64 for every LEAF fingerprints; nodes that are too full are counted some
    bits deeper, in rounds.
    """
    leaves: list[tuple[int, int]] = []
    full, depth = [0], 0
    while full:
        step = min(64 - depth, max(4, (n // LEAF).bit_length() + 2) if depth == 0 else 5)
        node = F.shiftrightunsigned("fp", 64 - depth - step)
        rows = fps.select("fp", node.alias("node"))
        if depth:
            above = fps.sparkSession.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in full], "_up long")
            rows = rows.join(F.broadcast(above), F.shiftrightunsigned("fp", 64 - depth) == F.col("_up"))  # too full, so at most n / LEAF
        counts = {r["node"] & (2 ** (depth + step) - 1): r["n"] for r in rows.groupBy("node").agg(F.count("*").alias("n")).collect()}
        levels = [counts]
        for _ in range(step):
            up: dict[int, int] = {}
            for k, v in levels[-1].items():
                up[k >> 1] = up.get(k >> 1, 0) + v
            levels.append(up)
        again = []
        stack = [(depth, p) for p in full]
        while stack:
            d, p = stack.pop()
            c = levels[depth + step - d].get(p, 0)
            if 0 < c <= LEAF or (c and d == 64):
                leaves.append((d, p))
            elif c and d == depth + step:
                again.append(p)
            elif c:
                stack += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
        full, depth = again, depth + step
    return sorted(leaves, key=lambda x: x[1] << (64 - x[0]))


def partners(i: int, starts: np.ndarray, depth: np.ndarray, budget: int) -> list[int]:
    """The leaves whose prefixes differ from leaf i's in at most ``budget`` of the bits that both have, i among them.

    Leaves are looked up by every prefix that is so near, so the work goes with the depth and not with their number.
    """
    d, low = int(depth[i]), int(starts[i])
    found: set[int] = set()
    for flips in (c for k in range(min(budget, d) + 1) for c in combinations(range(64 - d, 64), k)):
        at = low
        for bit in flips:
            at ^= 1 << bit
        # the leaf that holds this prefix, and those below it
        lo = int(np.searchsorted(starts, np.uint64(at), side="right")) - 1
        hi = int(np.searchsorted(starts, np.uint64(at | ((1 << (64 - d)) - 1)), side="right"))
        found.update(range(max(lo, 0), hi))
    mask = (1 << 64) - 1
    near = []
    for j in found:
        shared = mask ^ ((1 << (64 - min(d, int(depth[j])))) - 1)
        if ((low ^ int(starts[j])) & shared).bit_count() <= budget:
            near.append(j)
    return sorted(near)


def link(fps: DataFrame, budget: int = 2) -> DataFrame:
    """Links (src, dst) between distinct fingerprints ``fp`` that keep all groups of the full link graph connected.

    Each task joins the subtrees below two trie nodes, of at most LEAF fingerprints each, and returns a link from each
    fingerprint to the smallest of its group there, at most one per fingerprint, instead of all pairs.
    """
    n = fps.count()
    leaves = trie_leaves(fps, n) if n else []
    shared = fps.sparkSession.sparkContext.broadcast((np.array([p << (64 - d) for d, p in leaves], np.uint64), np.array([d for d, _ in leaves], np.int64)))

    def deal(batches):
        starts, depth = shared.value
        known: dict[int, list[int]] = {}
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64)
            leaf = np.searchsorted(starts, fp.view(np.uint64), side="right") - 1
            order = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[order])) + 1
            for part in np.split(order, cuts):
                if len(part):
                    i = int(leaf[part[0]])
                    if i not in known:
                        known[i] = partners(i, starts, depth, budget)
                    to = np.array(known[i])
                    yield pd.DataFrame({
                        "a": np.repeat(np.minimum(to, i), len(part)), "b": np.repeat(np.maximum(to, i), len(part)), "side": np.repeat((to < i).astype(np.int32), len(part)), "fp": np.tile(fp[part], len(to)),
                    })

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, side = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["side"].to_numpy()
        a, b = np.sort(fp[side == 0]), np.sort(fp[side == 1])
        same = pdf["a"].iloc[0] == pdf["b"].iloc[0]
        i, j = trie_pairs(a, a if same else b, budget, same)
        every = a if same else np.concatenate([a, b])
        root = _roots(len(every), i, j if same else j + len(a))
        moved = np.flatnonzero(root != np.arange(len(every)))
        return pd.DataFrame({"src": every[moved].view(np.int64), "dst": every[root[moved]].view(np.int64)})

    return fps.select("fp").mapInPandas(deal, "a int, b int, side int, fp bigint").groupBy("a", "b").applyInPandas(join, "src bigint, dst bigint")


def components(docs: DataFrame, budget: int = 2, width: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., fp, component, component_id) for every row of docs.

    component names the group by one of its fingerprints; component_id is the smallest doc_id reachable. Rows
    without doc_id take part in links; a group that has only such rows has a null component_id.
    """
    marked = cut(fingerprints(docs, keep, width))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    groups = connected_components(link(classes.select("fp"), budget))
    linked = classes.drop("n").join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = linked.join(ids, "component").select("fp", "component", "component_id")
    often = frequent(classes, "fp", marked.count())
    return join_frequent(marked, named, "fp", often, F.col("doc_id")).select(*keep, "fp", "component", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints are linked at 2 or fewer differing bits.

    Null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows stay;
    extra columns are not read; an empty table gives no rows.
    """
    found = components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
ORACLE_SQL: dict[str, str] = {}
