"""Periodic runs of words: stretches that repeat a period four times or more, found with suffix automata.

A run of period q has the same q words end at e and at e + q, and nowhere between, as the smallest period is primitive.
So both ends are neighbours in the end-position set of the state where they first meet, and that state's length is q or
more: every neighbour distance up to a state's length that a merge brings about is a square, and every run begins as one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.common import map_rows, read

#: A run has so many words and so many periods at least.
WORDS, TIMES = 6, 4
#: Words of the strings that the sieve looks for again nearby; a run has two or more such strings beyond its first period.
GRAM = 4
#: Stretches of more words go to automata in overlapping pieces.
PIECE = 1 << 16
#: Different words that a task remembers.
_KNOWN = 500_000


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def stretches(codes: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, q) of stretches outside which no run lies; q is the largest period in one. ``text`` numbers the texts of the words.

    Beyond its first q words, every string of GRAM words in a run has occurred q words or less before. M such strings in a
    row hold runs of period (M + GRAM - 1) / (TIMES - 1) at most, so strings last seen longer ago are struck out and
    the stretches measured again.
    """
    n = len(codes) - GRAM + 1
    if n < 2:
        return []
    h = codes[:n].astype(np.uint64)
    for k in range(1, GRAM):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[k : n + k].astype(np.uint64)
    h = h * np.uint64(0xBF58476D1CE4E5B9) + text[:n].astype(np.uint64)
    order = np.argsort(h, kind="stable")
    ago = np.full(n, n, np.int64)
    same = h[order[1:]] == h[order[:-1]]
    ago[order[1:][same]] = (order[1:] - order[:-1])[same]
    at = np.flatnonzero((ago < n) & (text[:n] == text[GRAM - 1 :]))
    while len(at):
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])]))
        m = np.diff(np.append(begins, len(at)))
        near = (ago[at] <= np.repeat((m + GRAM - 1) // (TIMES - 1), m)) & np.repeat(m > 1, m)
        if near.all():
            q = np.maximum.reduceat(ago[at], begins)
            first = np.maximum(at[begins] - q, np.searchsorted(text, text[at[begins]]))
            return list(zip(first.tolist(), (at[begins + m - 1] + GRAM).tolist(), q.tolist(), strict=True))
        at = at[near]
    return []


def squares(codes: list[int]) -> Iterator[tuple[int, int]]:
    """(end, q) of squares: the last q words up to ``end``, itself included, equal the q before. Every run has one or more of its period.

    States of the suffix automaton are taken from the longest to the shortest, each giving its end positions to the state
    that its suffix link leads to, the smaller set to the larger. Sets are sorted from the last position to the first, so
    that a state's own position, the first of all, goes to the end.
    """
    after, link, length, ends = [{}], [-1], [0], [None]
    last = 0
    for i, c in enumerate(codes):
        now = len(after)
        after.append({})
        length.append(i + 1)
        ends.append([-i])
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = now
            p = link[p]
        if p < 0:
            link.append(0)
        elif length[q := after[p][c]] == length[p] + 1:
            link.append(q)
        else:
            split = now + 1
            link += [split, link[q]]
            after.append(dict(after[q]))
            length.append(length[p] + 1)
            ends.append(None)
            link[q] = split
            while p >= 0 and after[p].get(c) == q:
                after[p][c] = split
                p = link[p]
        last = now
    del after
    for v in np.argsort(-np.array(length), kind="stable")[:-1].tolist():
        up, small = link[v], ends[v]
        ends[v] = None
        if not up:
            continue
        large, most = ends[up], length[up]
        if large is None:
            ends[up] = small
            continue
        if len(small) > len(large):
            small, large = large, small
        for x in small:
            large.insert(bisect_left(large, x), x)
        for x in small:  # neighbours in the whole of both sets
            k = bisect_left(large, x)
            if k and x - large[k - 1] <= most:
                yield -large[k - 1], x - large[k - 1]
            if k + 1 < len(large) and large[k + 1] - x <= most:
                yield -x, large[k + 1] - x
        ends[up] = large


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many first words a and b share."""
    lo, step, n = 0, 16, min(len(a), len(b))
    a, b = a[:n], b[:n]
    while lo < n:
        differ = a[lo : lo + step] != b[lo : lo + step]
        k = int(differ.argmax())
        if differ[k]:
            return lo + k
        lo, step = lo + step, 2 * step
    return n


def _pieces(lo: int, hi: int, most: int) -> Iterator[tuple[int, int]]:
    """Parts of a stretch: a run that starts in one before the next begins has two periods in it."""
    size = max(PIECE, 4 * most)
    while lo + size < hi:
        yield lo, lo + size
        lo += size - 2 * most
    yield lo, hi


def runs(codes: np.ndarray, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of one text's words by start, then period; ``found`` are the stretches that hold them."""
    known: dict[int, tuple[list[int], list[int]]] = {}
    for stretch in found:
        for lo, hi in _pieces(*stretch):
            for end, q in squares(codes[lo:hi].tolist()):
                end += lo
                begin = end - 2 * q + 1
                starts, stops = known.setdefault(q, ([], []))
                k = bisect_right(starts, begin)
                if k and end < stops[k - 1]:
                    continue
                # on both sides, words that equal those a period away belong to the run
                starts.insert(k, begin - _same(codes[:begin][::-1], codes[q : begin + q][::-1]))
                stops.insert(k, end + 1 + _same(codes[end + 1 :], codes[end + 1 - q :]))
    every = [(s, t - s, q) for q, (starts, stops) in known.items() for s, t in zip(starts, stops, strict=True)]
    return sorted((s, n, q) for s, n, q in every if n >= max(WORDS, TIMES * q))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those in no run, and of a run its first period, unless another run drops them."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def scan(texts: list[list[bytes]], known: _Codes) -> Iterator[list[tuple[int, int, int]]]:
    """The runs of each text's words."""
    if len(known) > _KNOWN:
        known.clear()
    sizes = np.array([len(w) for w in texts], np.int64)
    codes = np.fromiter((known[w] for words in texts for w in words), np.int64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    found: dict[int, list] = {}
    for lo, hi, q in stretches(codes, np.repeat(np.arange(len(texts)), sizes)):
        k = int(np.searchsorted(first, lo, side="right")) - 1
        found.setdefault(k, []).append((lo - int(first[k]), hi - int(first[k]), q))
    for k, start in enumerate(first.tolist()):
        yield runs(codes[start : start + len(texts[k])], found[k]) if k in found else []


def find(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", prepare: Callable[[object, list[bytes]], list[bytes]] | None = None, by: str | None = None
) -> DataFrame:
    """(keep..., runs, collapsed): the runs (start, length, period) of every whole text, and its words without the repeats.

    Words are runs of bytes other than ASCII white space; positions count words from 0. collapsed joins by one space the
    words that no run holds beyond its first period. ``prepare`` makes each text's words from those found and from its
    value of column ``by``. A null text has no words, no runs and an empty rest; repeated rows stay; other columns are
    not read; an empty table gives no rows. Of very long texts, only stretches that may hold runs go to automata.
    """

    def work(groups):
        known = _Codes()
        for given, texts in groups:
            words = [(t or b"").split() for t in texts]
            if prepare:
                words = [prepare(x, w) for x, w in zip(given, words, strict=True)]
            out, rest = [], []
            for w, found in zip(words, scan(words, known), strict=True):
                out.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                rest.append(b" ".join([w[i] for i in np.flatnonzero(kept(len(w), found)).tolist()] if found else w))
            yield {"runs": out, "collapsed": pa.array(rest, pa.binary()).cast(pa.string())}

    value = F.col(f"`{by}`") if by else F.lit(None)
    rows = docs.select(value.cast("string").alias("_by"), F.col(f"`{text}`").cast("binary").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    return map_rows(rows, ["_by", "_text"], "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string", work, {c: c for c in keep})


def replayed(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """The words of the query: in a tenth of the documents, by the checksum of the id, a part of the rest is repeated to the end."""
    h, n = zlib.crc32(doc_id.encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, the longest of them, and what is left when each is cut to one period.

    Null, empty and blank texts have no run: four nulls and the digest of nothing; a document without doc_id is taken as it
    is; of several longest runs the one that starts first, then with the smallest period; repeated rows stay; extra
    columns are not read; an empty table gives no rows.
    """
    found = find(read(spark, sf_dir, "documents"), prepare=replayed, by="doc_id")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("first"), (-r["period"]).alias("least"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    length, period = F.col("best.length"), -F.col("best.least")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.first")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic": op12_periodic}
ORACLE_SQL: dict[str, str] = {}
