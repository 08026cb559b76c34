"""Near-duplicates by SimHash and, beyond its reach, by exact Jaccard similarity of 5-word shingle sets.

The trie self-join of fingerprints links the closest texts. What no budget of bits can promise comes from a prefix
filter: two sets with similarity of LEAST or more share one of the first n - ceil(LEAST * n) + 1 members of each, in any
order that is the same for all sets. Candidates of both kinds are held against sketches that bound how much two sets
differ, and those left against the sets themselves, so no pair is missed and none is linked by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrace.llm import simhash
from veritrace.llm.common import BROADCAST_ROWS, cut, keep_rows, map_rows, row_key, stored
from veritrace.operators.components import connected_components

#: Words of a shingle, and the least similarity of a link as a fraction.
WIDTH, LEAST = 5, (4, 5)
#: Bits that the fingerprints of a first candidate pair may differ in.
BITS = 2
#: Shingles counted at once in a task; those found COMMON times among them are ordered by their counts, after all
#: others. At most MOST of them: the order decides how many candidates there are, never which links are found.
AT_ONCE, COMMON, MOST = 1_000_000, 2, 1_000_000
#: Sets that one lead is compared with in one task, and the ranges of hashes that a set is sent in.
PART, SLICES = 2000, 8
#: Sets that share a shingle in one block.
BLOCK = 1000
#: Words whose hashes a task remembers.
_WORDS = 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 42)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, known: _Hashes) -> np.ndarray:
    """The sorted distinct hashes of WIDTH-word shingles of the whole text (fewer words: one of all of them).

    Words are those of simhash.fingerprints.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    width = min(WIDTH, len(w))
    n = len(w) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def _name(found: np.ndarray) -> int:
    """A signed 64-bit name of a set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 42)).view(np.int64)) if len(found) else 0


def sketch(s: np.ndarray) -> bytes:
    """A bit for each of at least twice as many places as the set has members, on where an odd number of them falls.

    Two sketches of one length differ in at most as many bits as the sets have members that the other lacks; a longer
    one is brought to half its length by laying its halves over each other.
    """
    size = 64 << max(0, (2 * len(s) - 1) // 64).bit_length()
    return np.packbits((np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def differ(a: bytes, b: bytes) -> int:
    """The least that the sets of two sketches differ by."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many texts have, with their counts."""

    def work(groups):
        known = _Hashes()
        held, size = [], 0

        def counted():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= COMMON
            return {"h": h[often].view(np.int64), "n": n[often]}

        for (texts,) in groups:
            some = [shingles(t, known) for t in texts]
            held += some
            size += sum(map(len, some))
            if size >= AT_ONCE:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    found = map_rows(docs, ["text"], "h bigint, n bigint", work).groupBy("h").agg(F.sum("n").alias("n"))
    table = found.orderBy(F.desc("n"), "h").limit(MOST).toArrow()
    h, n = (table[c].to_numpy() for c in ("h", "n"))
    h = h.view(np.uint64)
    by = np.argsort(h)
    return h[by], n[by]


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b, sig, n, fp, sketch, prefix) of every row; a and b are its row_key, fp is the SimHash of its set."""
    shared = docs.sparkSession.sparkContext.broadcast(common(docs))
    num, den = LEAST

    def work(groups):
        names, counts = shared.value
        known = _Hashes()
        for (texts,) in groups:
            sets = [shingles(t, known) for t in texts]
            prefix = []
            for s in sets:
                p = len(s) - -(-num * len(s) // den) + 1
                if len(names) and len(s):
                    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                    s = s[np.lexsort((s, np.where(names[at] == s, counts[at], 0)))]
                prefix.append(s[:p].view(np.int64))
            sizes = np.array([len(s) for s in sets], np.int64)
            fp = np.zeros(len(sets), np.uint64)
            if sizes.any():
                fp[sizes > 0] = simhash.majority(np.concatenate(sets), sizes[sizes > 0])
            yield {"sig": [_name(s) for s in sets], "n": sizes, "fp": fp.view(np.int64), "sketch": [sketch(s) for s in sets], "prefix": prefix}

    rows, a, b = row_key(docs)
    return stored(map_rows(rows, ["text"], "sig bigint, n int, fp bigint, sketch binary, prefix array<bigint>", work, {"doc_id": "doc_id", a: "a", b: "b"}))


def _sliced(s: np.ndarray) -> list[bytes]:
    """A sorted set in SLICES ranges of its hashes, so that rows stay short."""
    cuts = np.searchsorted(s, np.arange(1, SLICES, dtype=np.uint64) * np.uint64((1 << 64) // SLICES))
    return [x.tobytes() for x in np.split(s, cuts)]


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (lead, part, slice, member, sig, grams) in order, a lead's own slice before its members': (src, dst, ns, nd, both) of each member's slice."""
    own, of = np.zeros(0, np.uint64), None
    for b in batches:
        out: list[tuple] = []
        grams = b.column(5)  # not copied
        for i, (lead, part, k, member, sig) in enumerate(zip(*[c.to_pylist() for c in b.columns[:5]], strict=True)):
            s = np.frombuffer(grams[i].as_buffer(), np.uint64)
            if not member:
                own, of = s.copy(), (lead, part, k)
            elif of == (lead, part, k):
                at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                out.append((lead, sig, len(own), len(s), int((own[at] == s).sum()) if len(own) else 0))
        columns = zip(*out, strict=True) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["src", "dst", "ns", "nd", "both"])


def _close(own: list[np.ndarray], sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places (i < j) of one group of sets that may be similar.

    Besides sizes and sketches, it counts what is left: of the first shingle that two sets share, in their common order,
    neither has more than itself and what follows to share. A pair that is similar passes at that shingle.
    """
    part, home, n, at, c = own
    num, den = LEAST
    width = min(map(len, sketches))
    bits = np.empty((len(sketches), width), np.uint8)
    for i, b in enumerate(sketches):
        x = np.frombuffer(b, np.uint8)
        while len(x) > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        bits[i] = x
    bits = bits.view(np.uint64)
    found: list[tuple[int, np.ndarray]] = []
    for i in range(len(n) - 1):
        m, k = n[i + 1 :], slice(i + 1, None)
        both = n[i] + m
        ok = (c[k] != c[i]) & (den * np.minimum(n[i], m) >= num * np.maximum(n[i], m)) & ((num + den) * np.minimum(n[i] - at[i], m - at[k]) >= num * both)
        ok &= home[k] | home[i]  # two that only visit have met at home
        if part[0] != part[1]:
            ok &= part[2][k] != part[2][i]  # those of one block meet by themselves
        j = np.flatnonzero(ok)
        if len(j):
            j = j[(num + den) * np.bitwise_count(bits[i + 1 + j] ^ bits[i]).sum(1, dtype=np.int64) <= (den - num) * both[j]]
            found.append((i, i + 1 + j))
    left = np.concatenate([np.full(len(j), i) for i, j in found]) if found else np.zeros(0, np.int64)
    return left, np.concatenate([j for _, j in found]) if found else np.zeros(0, np.int64)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, step, lo, hi, block, home, sig, n, at, c, sketch), each group of the first four in one stretch: the pairs (src, dst) that may be similar."""
    held = None

    def pairs(table):
        lo, hi = (table.column(i)[0].as_py() for i in (2, 3))
        block, sig, n, at, c = (table.column(i).to_numpy() for i in (4, 6, 7, 8, 9))
        home = table.column(5).to_numpy(zero_copy_only=False)
        i, j = _close([(lo, hi, block), home, n.astype(np.int64), at.astype(np.int64), c], table.column(10).to_pylist())
        return np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j])

    def made(found):
        src, dst = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    for b in batches:
        table = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
        if not table.num_rows:
            continue
        keys = [table.column(i).to_numpy() for i in range(4)]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        edges = [0, *cuts.tolist()]
        held = table.slice(edges[-1])
        yield made([pairs(table.slice(x, y - x).combine_chunks()) for x, y in zip(edges, edges[1:], strict=False) if y - x > 1])
    if held is not None and held.num_rows > 1:
        yield made([pairs(held.combine_chunks())])


def _met(named: DataFrame, sketches: DataFrame) -> DataFrame:
    """Distinct pairs (src, dst) of sets that share a token, are in different groups c and may be similar, from rows (token, sig, n, at, c).

    Sets of a token meet in tasks by steps of size, each at home and as a visitor one step up, so that sizes that can be
    similar meet. BLOCK or more of them are dealt over blocks that meet two by two. Only pairs that pass become rows.
    """
    keys = ["token", "step"]
    # a little wider than the ratio of similar sizes, so that rounded logarithms put these at most one step apart
    rows = named.withColumn("step", F.floor(F.log("n") / (np.log(LEAST[1] / LEAST[0]) + 1e-9)).cast("int"))
    rows = rows.select("token", "sig", "n", "at", "c", F.explode(F.array(*[F.struct((F.col("step") + k).alias("step"), F.lit(k == 0).alias("home")) for k in range(2)])).alias("s")).select("token", "s.*", "sig", "n", "at", "c")
    many = rows.groupBy(*keys).agg(F.count("*").alias("size"), F.count_if("home").alias("homes"), F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("homes > 0 AND _lo < _hi")
    rows = rows.join(many.select(*keys, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), keys)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sig"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(*keys, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "home", "sig", "n", "at", "c").join(sketches, "sig")
    order = [*keys, "lo", "hi"]
    rows = rows.select(*order, "block", "home", "sig", "n", "at", "c", "sketch").repartition(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(_meetings, "src bigint, dst bigint").distinct()


def _possible(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (src, dst) of texts (sig, n, sketch) whose sketches leave it open that they are similar enough."""
    num, den = LEAST

    def work(batches):
        for b in batches:
            ok = [(num + den) * differ(x, y) <= (den - num) * (n + m) for x, y, n, m in zip(*[c.to_pylist() for c in b.columns[2:]], strict=True)]
            yield b.filter(pa.array(ok, pa.bool_())).select(["src", "dst"])

    of = texts.select("sig", F.struct("n", "sketch").alias("t"))
    both = pairs.select("src", "dst").distinct().join(of.toDF("src", "x"), "src").join(of.toDF("dst", "y"), "dst")
    return both.select("src", "dst", "x.sketch", F.col("y.sketch").alias("other"), "x.n", F.col("y.n").alias("m")).mapInArrow(work, "src bigint, dst bigint")


def _verified(docs: DataFrame, marked: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (src, dst) that may be similar, with ns, nd, the sizes of the two sets, and ``both``, that of their intersection.

    Each set is made once, from one row that has it, and sent to the leads (src) that it is compared with; a lead with
    many members gets them in parts of PART, its own set in each. Only rows in pairs send anything.
    """
    pairs = cut(_possible(texts, pairs))
    if pairs.isEmpty():
        return pairs.select("src", "dst", *[F.lit(0).cast("bigint").alias(c) for c in ("ns", "nd", "both")])
    parts = pairs.groupBy("src").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    member = pairs.join(parts, "src").select(F.col("dst").alias("sig"), F.struct(F.col("src").alias("lead"), F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("member")).alias("to"))
    lead = parts.select(F.col("src").alias("sig"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("sig", F.struct(F.col("sig").alias("lead"), "part", F.lit(0).alias("member")).alias("to"))
    sends = member.union(lead).groupBy("sig").agg(F.collect_list("to").alias("to"))
    one = marked.groupBy("sig").agg(F.min(F.struct("a", "b")).alias("r"))
    rows, a, b = row_key(docs)
    sends = cut(sends.join(one, "sig").select(F.col("r.a").alias(a), F.col("r.b").alias(b), "sig", "to"))
    sends = F.broadcast(sends) if sends.count() <= BROADCAST_ROWS // 4 else sends
    rows = rows.select(a, b, "text").join(sends, [a, b])

    def work(groups):
        known = _Hashes()
        for (texts,) in groups:
            yield {"slices": [_sliced(shingles(t, known)) for t in texts]}

    made = map_rows(rows, ["text"], "slices array<binary>", work, {"sig": "sig", "to": "to"}).dropDuplicates(["sig"])
    sent = made.select("to", "sig", F.posexplode("slices").alias("slice", "grams")).select(F.inline("to"), "slice", "sig", "grams")
    order = ["lead", "part", "slice", "member"]
    sent = sent.select(*order, "sig", "grams").repartition("lead", "part").sortWithinPartitions(*order)
    found = sent.mapInArrow(_overlaps, "src bigint, dst bigint, ns bigint, nd bigint, both bigint")
    return cut(found.groupBy("src", "dst").agg(*[F.sum(c).alias(c) for c in ("ns", "nd", "both")]))


def _similar(a: str, b: str):
    """Whether sets of these sizes can be similar enough."""
    return LEAST[1] * F.least(a, b) >= LEAST[0] * F.greatest(a, b)


def _linked():
    num, den = LEAST
    return (num + den) * F.col("both") >= num * (F.col("ns") + F.col("nd"))


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, a, b, sig) for every row of docs, a and b its row_key, and (sig, component) of the sets that have links of LEAST or more.

    Sets without a link are not in the second table: each is a group of its own.

    Links are looked for in three rounds: between sets whose fingerprints the trie finds near; between each set and one
    leader for every shingle that its prefix shares; and between the others that share such a shingle and are in
    different groups by then, which are compared by sketches where they meet.
    """
    marked = _marked(docs)
    texts = stored(marked.groupBy("sig").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")))
    prints = texts.groupBy("fp").agg(F.min("sig").alias("src"))
    near = simhash.link(prints.select("fp"), BITS)
    near = near.join(prints.toDF("src", "s"), "src").join(prints.toDF("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    first = near.union(texts.join(prints, "fp").where("sig <> src").select("src", "sig"))
    links = _verified(docs, marked, texts, first).where(_linked()).select("src", "dst")
    firsts = marked.select("sig", "n", "prefix").dropDuplicates(["sig"])
    tokens = firsts.select("sig", "n", F.posexplode("prefix").alias("at", "token"))
    alike = Window.partitionBy("token")
    heads = tokens.withColumns({"size": F.count("*").over(alike), "head": F.min(F.struct("sig", "n")).over(alike)}).where("size > 1")
    shared = stored(heads.select("token", "sig", "n", "at", "size", F.col("head.sig").alias("lead"), F.col("head.n").alias("nl")))
    star = shared.where((F.col("sig") != F.col("lead")) & _similar("n", "nl")).select(F.col("lead").alias("src"), F.col("sig").alias("dst"))
    links = links.union(_verified(docs, marked, texts, star.join(links, ["src", "dst"], "left_anti")).where(_linked()).select("src", "dst"))
    group = connected_components(links).toDF("sig", "c")
    named = shared.where((F.col("size") > 2) & (F.col("sig") != F.col("lead"))).join(group, "sig", "left").select("token", "sig", "n", "at", F.coalesce("c", "sig").alias("c"))
    rest = _met(named, texts.select("sig", "sketch"))
    more = _verified(docs, marked, texts, rest).where(_linked()).select("src", "dst")
    group = group if more.isEmpty() else connected_components(links.union(more)).toDF("sig", "c")
    return marked.select("doc_id", "a", "b", "sig"), group.withColumnRenamed("c", "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id (none at all last), of such the least hash of the row.

    Rows that are repeated whole count as one. The best row of a text is found before groups are, so no group
    meets in one task.
    """
    rows, named = groups(docs)
    best = rows.groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")).alias("o"))
    best = best.join(named, "sig", "left").groupBy(F.coalesce("component", "sig").alias("component")).agg(F.min("o").alias("o"))
    return keep_rows(docs, rows.select("a", "b"), best.select("o.a", "o.b"))
