"""Removal of long repeated strings, exact to the byte: suffix arrays of small shards over a lossless sieve.

Every 200-byte string is named by the least hash of the short grams in it, which its own bytes decide; so
equal strings have equal names, and a text falls into runs of neighbouring string starts with one name.
Runs whose name is seen once hold no repeat, unless its gram recurs in them. Runs with one name and equal
bytes repeat as a whole. What is left, runs that share a name and differ or that may repeat in themselves,
goes by name into shards of bounded size: a suffix array of each (Larsson and Sadakane's refinement) and
common prefixes (Kasai's method). A name with more bytes than a shard is dealt over several, and strings that
two of its shards have are found by binary search in their merged, sorted digests.

Two runs count as equal if their names (64 bits) and the hashes of their bytes (64 bits) are; two strings of
different shards if 128 bits of digest are. Within a shard bytes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm import bloom
from veritrace.llm.common import map_rows, read, stored

#: Bytes of a string that must not repeat, and of the grams whose least hash names it.
LENGTH, GRAM = 200, 64
#: Bytes of a shard; a name with more is dealt over several. Longer texts are read in slices of SLICE starts.
SHARD, SLICE = 1 << 21, 1 << 20
#: Parts in which a name of many shards meets its runs.
SALTS = 16
_SEPARATOR = 0xFF  # never in UTF-8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(data: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each place on, by doubling."""
    one = _mix(data.astype(np.uint64) + np.uint64(1))
    out, power, have, mod = one, base, 1, 1 << 64
    for bit in bin(size)[3:]:
        out = out[: len(out) - have] * np.uint64(power) + out[have:]
        have, power = 2 * have, power * power % mod
        if bit == "1":
            out = out[: len(out) - 1] * np.uint64(base) + one[have:]
            have, power = have + 1, power * base % mod
    return _mix(out)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :])


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, number of starts, name, inner) of each run of neighbouring starts with one name.

    inner: the gram with the least hash occurs more than once, so that strings may repeat inside the run.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    grams, width = _hashes(data, GRAM), LENGTH - GRAM + 1
    names = _least(grams, width)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(names)]
    valid = np.arange(len(names)) + LENGTH <= ends[owner]
    change = np.ones(len(names), bool)
    change[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    at = np.flatnonzero(change)
    count = np.diff(np.append(at, len(names)))
    live = valid[at]
    at, count = at[live], count[live]
    # a run's first string holds the first place of its gram, its last string the last one
    windows, inner = np.lib.stride_tricks.sliding_window_view(grams, width), np.zeros(len(at), bool)
    for k in range(0, len(at), 4096):
        a, z = at[k : k + 4096], (at + count - 1)[k : k + 4096]
        inner[k : k + 4096] = a + windows[a].argmin(axis=1) != z + width - 1 - windows[z][:, ::-1].argmin(axis=1)
    return owner[at], at - (ends - sizes)[owner[at]], count, names[at], inner


def _run_key(name: np.ndarray, body: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One 64-bit key of a run's occurrence."""
    x = _mix(name.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    for part in (body, text, start.astype(np.int64)):
        x = _mix(x + part.view(np.uint64))
    return x.view(np.int64)


def _encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _pieces(raw: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) of slices in which every start of every text lies once, about SLICE bytes at a time."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, r in enumerate(raw):
        for at in range(0, max(1, len(r) - LENGTH + 1), SLICE):
            held.append((i, at, r[at : at + SLICE + LENGTH - 1] if len(r) > SLICE else r))
            size += len(held[-1][2])
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _described(ids: list, raw: list[bytes]) -> Iterator[tuple]:
    """Some runs at a time: the owner, start, count, name, inner, body hash and row key of each, and its bytes on demand."""
    digest = xxhash.xxh3_64_intdigest
    seeds = [42 if i is None else xxhash.xxh64_intdigest(str(i), 42) for i in ids]
    keys = np.array([xxhash.xxh64_intdigest(r, k) for r, k in zip(raw, seeds, strict=True)], np.uint64).view(np.int64)
    for part in _pieces(raw):
        owners, offsets = (np.array([p[k] for p in part], np.int64) for k in (0, 1))
        piece, start, count, name, inner = runs([p[2] for p in part])

        def cut(k: int, part=part, piece=piece, start=start, count=count) -> bytes:
            return part[piece[k]][2][start[k] : start[k] + count[k] + LENGTH - 1]

        body = np.array([digest(part[o][2][a:b]) for o, a, b in zip(piece.tolist(), start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)], np.uint64)
        yield owners[piece], start + offsets[piece], count, name.view(np.int64), inner, body.view(np.int64), keys[owners[piece]], cut


def text_key(doc_id: Column, text: Column) -> Column:
    """The row key of runs, as a Spark expression: a hash of doc_id and text."""
    return F.xxhash64(doc_id.cast("string"), F.coalesce(text, F.lit("")))


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text, start, count, name, inner, body): every run of every text; text is the row's text_key, body a hash of the run's bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(groups):
        for ids, texts in groups:
            for owner, start, count, name, inner, body, text, _ in _described(ids, _encoded(texts)):
                yield {"doc_id": [ids[i] for i in owner.tolist()], "text": text, "start": start, "count": count, "name": name, "inner": inner, "body": body}

    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, text bigint, start int, count int, name bigint, inner boolean, body bigint", work)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by Larsson and Sadakane: groups that are equal so far are refined by
    the ranks twice as far on; suffixes that are alone in their group are left alone."""
    n = len(data)
    key = _eight(data)
    order = np.argsort(key)
    first = np.ones(n, bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    alone = first & np.append(first[1:], True)
    todo = np.flatnonzero(~alone)  # places in order whose group is not single
    h = 8
    while len(todo):
        at = order[todo]
        far = at + h
        # a suffix that has ended comes before those that go on, and the shorter of two such first
        then = np.where(far < n, rank[np.minimum(far, n - 1)], n - 1 - far)
        own = rank[at]
        by = np.argsort((own.astype(np.uint64) << np.uint64(32)) + (then + h).astype(np.uint64))
        at, then, own = at[by], then[by], own[by]
        order[todo] = at
        new = np.ones(len(todo), bool)
        new[1:] = (own[1:] != own[:-1]) | (then[1:] != then[:-1])
        rank[at] = np.maximum.accumulate(np.where(new, todo, 0))
        single = new & np.append(new[1:], True)
        todo = todo[~single]
        h *= 2
    return order


def _eight(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one big-endian number; zero bytes stand after the end."""
    wide = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | wide[k : k + len(data)]
    return out


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, lanes: int = 4096) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, counted up to ``most``.

    Kasai's method: in text order, a suffix shares at least one byte less than the suffix one place earlier
    did. Stretches of the text go side by side, each in its own order, eight bytes at a time.
    """
    n = len(data)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    eight = np.concatenate((_eight(data), np.zeros(most + 16, np.uint64)))
    out = np.zeros(n, np.int64)
    lanes = max(1, min(lanes, n // 64))
    step = -(-n // lanes)
    at = np.arange(lanes) * step
    h = np.zeros(lanes, np.int64)
    for _ in range(step):
        live = at < n
        i = at[live]
        r = rank[i]
        j = order[np.maximum(r - 1, 0)]
        got = h[live]
        got[r == 0] = 0
        # a match may not run over the end of the later suffix
        room = np.minimum(n - np.maximum(i, j), most)
        open_ = np.flatnonzero((r > 0) & (got < room))
        while len(open_):
            a, b, g = i[open_], j[open_], got[open_]
            x = eight[a + g] ^ eight[b + g]
            same = np.full(len(x), 8, np.int64)
            odd = x != 0
            top = np.minimum(np.frexp(x[odd].astype(np.float64))[1], 64)  # bits in use, or one more where rounding went up
            top -= (np.uint64(1) << (top - 1).astype(np.uint64)) > x[odd]
            same[odd] = (64 - top) // 8
            g = np.minimum(g + same, room[open_])
            got[open_] = g
            open_ = open_[(same == 8) & (g < room[open_])]
        out[r] = got
        h[live] = np.maximum(got - 1, 0)
        at = at + 1
    return out


def repeated_starts(bodies: list[bytes], told_of: list[bool] | None = None) -> tuple[list[np.ndarray], list[tuple[np.ndarray, list[bytes]]]]:
    """For each of some byte strings without 0xFF: the starts of its LENGTH-byte strings that also start elsewhere in them.

    And for those in ``told_of``, (starts, digests): one start of every different string, and its 16-byte digest.
    """
    sizes = np.array([len(b) for b in bodies], np.int64)
    sep = bytes([_SEPARATOR])
    data = np.frombuffer(sep.join(bodies) + sep, np.uint8)
    order = suffix_array(data)
    shared = common_prefixes(data, order, LENGTH)
    near = np.maximum(shared, np.append(shared[1:], 0)) >= LENGTH
    hit = np.zeros(len(data), bool)
    hit[order[near]] = True
    begins = (np.cumsum(sizes + 1) - sizes - 1).tolist()
    ends = [a + max(0, n - LENGTH + 1) for a, n in zip(begins, sizes.tolist(), strict=True)]
    starts = [np.flatnonzero(hit[a:z]) for a, z in zip(begins, ends, strict=True)]
    if not told_of or not any(told_of):
        return starts, [(np.zeros(0, np.int64), [])] * len(bodies)
    one = np.zeros(len(data), bool)
    one[order[shared < LENGTH]] = True
    digest = np.stack([_hashes(data, LENGTH, base).astype(">u8") for base in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)], axis=1)
    names = []
    for a, z, wanted in zip(begins, ends, told_of, strict=True):
        at = np.flatnonzero(one[a:z]) if wanted else np.zeros(0, np.int64)
        names.append((at, [d.tobytes() for d in digest[a + at]]))
    return starts, names


def shard_repeats(rows: Iterator[tuple[object, bool, bytes]]) -> Iterator[tuple[int, int, int, bytes | None]]:
    """(row, first start, last start, None) of repeated strings among rows (key, spread, bytes) sorted by key.

    Rows go into shards of about SHARD bytes; a key is never cut. Where ``spread`` says that other shards have
    runs of the same name, (row, start, start, digest) tells them one start of each different string.
    """

    def flush(shard: list[tuple[int, bool, bytes]]) -> Iterator[tuple]:
        starts, names = repeated_starts([b for _, _, b in shard], [w for _, w, _ in shard])
        for (row, _, _), at, (one, digests) in zip(shard, starts, names, strict=True):
            if len(at):
                cuts = np.flatnonzero(np.diff(at) > 1)
                for a, z in zip(np.append(at[0], at[cuts + 1]).tolist(), np.append(at[cuts], at[-1]).tolist(), strict=True):
                    yield row, a, z, None
            for a, d in zip(one.tolist(), digests, strict=True):
                yield row, a, a, d

    shard: list[tuple[int, bool, bytes]] = []
    size, last = 0, None
    for row, (key, spread, body) in enumerate(rows):
        if size + len(body) > SHARD and key != last and shard:
            yield from flush(shard)
            shard, size = [], 0
        shard.append((row, spread, body))
        size += len(body)
        last = key
    if shard:
        yield from flush(shard)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches sorted by their last column, a digest: the rows whose digest another row has too, without it.

    A digest's place in the sorted list is found by binary search; the last one of a batch waits for the next.
    """

    def often(b: pa.RecordBatch, d: np.ndarray) -> pa.RecordBatch:
        n = np.searchsorted(d, d, side="right") - np.searchsorted(d, d, side="left")
        return b.filter(pa.array(n > 1)).select(b.schema.names[:-1])

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if held is None else pa.concat_batches([held, b])
        d = np.array(b.column(b.num_columns - 1).to_pylist(), "S16")
        end = int(np.searchsorted(d, d[-1], side="left"))
        yield often(b.slice(0, end), d[:end])
        held, rest = b.slice(end), d[end:]
    if held is not None:
        yield often(held, rest)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def find_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans): for each row of docs (text is its text_key) byte ranges [lo, hi) that repeat, sorted.

    Rows without repeats may be missing. Nothing here needs all occurrences of a string in one task: counts
    are combined before they are shuffled, and joins have unique right sides.
    """
    spark = docs.sparkSession
    every = stored(find_runs(docs))
    by_name = every.groupBy("name").agg(F.count("*").alias("n"), F.min("body").alias("a"), F.max("body").alias("b"), F.bool_or("inner").alias("inner"))
    names = stored(by_name.where("n > 1 OR inner").select("name", (F.expr("a <> b OR inner")).alias("mixed")))
    maybe = spark.sparkContext.broadcast(bloom.build(names.select("name")))

    @F.pandas_udf("boolean")
    def known(name):
        return pd.Series(bloom.passes(maybe.value, name.to_numpy(np.int64)))

    again = stored(every.drop("inner").where(known("name")).join(names, "name"))
    mixed = again.where("mixed")
    first = F.min(F.struct("text", "start", "count")).alias("r")
    bodies = stored(mixed.groupBy("name", "body").agg(F.count("*").alias("n"), first).select("name", "body", "n", "r.text", "r.start", "r.count"))
    large = bodies.groupBy("name").agg(F.sum(F.col("count") + (LENGTH - 1)).alias("size")).where(F.col("size") > SHARD)
    spread = large.select("name", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.ceil(F.col("size") / (SHARD // 2)).cast("int").alias("parts"))

    @F.pandas_udf("bigint")
    def key(name, body, text, start):
        return pd.Series(_run_key(*[c.to_numpy(np.int64) for c in (name, body, text, start)]))

    chosen = spark.sparkContext.broadcast(bloom.build(bodies.select(key("name", "body", "text", "start"))))

    def work(groups):
        for ids, texts in groups:
            for _, start, _, name, _, body, text, cut in _described(ids, _encoded(texts)):
                keep = np.flatnonzero(bloom.passes(chosen.value, _run_key(name, body, text, start)))
                yield {"name": name[keep], "body": body[keep], "text": text[keep], "start": start[keep], "bytes": [cut(k) for k in keep.tolist()]}

    found = map_rows(docs, ["doc_id", "text"], "name bigint, body bigint, text bigint, start int, bytes binary", work)
    own = found.join(bodies.select("name", "body", "text", "start"), ["name", "body", "text", "start"], "left_semi").dropDuplicates(["name", "body"])
    own = own.withColumn("_salt", F.pmod("body", F.lit(SALTS)).cast("int")).join(spread, ["name", "_salt"], "left")
    rows = own.select("name", F.coalesce(F.pmod(F.shiftrightunsigned("body", 8), F.col("parts")).cast("int"), F.lit(-1)).alias("part"), "body", "bytes")

    def shards(batches):
        ids: list[tuple] = []

        def feed():
            for b in batches:
                for name, part, body, raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    ids.append((name, body))
                    yield (name, part), part >= 0, raw

        out: list[tuple] = []
        for row, a, z, digest in shard_repeats(feed()):
            out.append((*ids[row], a, z, digest))
            if len(out) >= 100_000:
                yield _batch(out, kinds)
                out = []
        yield _batch(out, kinds)

    kinds = {"name": pa.int64(), "body": pa.int64(), "from": pa.int32(), "to": pa.int32(), "digest": pa.binary()}
    ranges = "name bigint, body bigint, `from` int, `to` int"
    parts = stored(rows.repartition("name", "part").sortWithinPartitions("name", "part").mapInArrow(shards, ranges + ", digest binary"))
    told, across = parts.where("digest IS NULL").drop("digest"), parts.where("digest IS NOT NULL")
    if not across.isEmpty():
        told = told.union(across.repartitionByRange("digest").sortWithinPartitions("digest").mapInArrow(merged, ranges))
    told = told.union(bodies.where("n > 1").select("name", "body", F.lit(0), F.col("count") - 1))
    spans = (
        again.where("NOT mixed").select("doc_id", "text", F.col("start").alias("lo"), (F.col("start") + F.col("count") + (LENGTH - 1)).alias("hi"))
        .union(mixed.join(told, ["name", "body"]).select("doc_id", "text", F.col("start") + F.col("from"), F.col("start") + F.col("to") + LENGTH))
    )
    return spans.groupBy("doc_id", "text").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept): each row's maximal removed byte ranges and the bytes that stay.

    A null text has no bytes. Rows repeated in docs are documents of their own, so their long texts go.
    """
    found = find_repeats(docs).select(F.col("doc_id").alias("_id"), F.col("text").alias("_key"), F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"))
    rows = docs.select("doc_id", "text").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("doc_id"), F.col("text")) == F.col("_key")), "left")

    def work(groups):
        for ids, lows, highs, texts in groups:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "starts", "ends", "kept")}
            for doc_id, lo, hi, raw in zip(ids, lows, highs, _encoded(texts), strict=True):
                starts, ends, kept, at = [], [], [], 0
                for a, b in zip(lo or (), hi or (), strict=True):
                    if ends and a <= ends[-1]:
                        ends[-1] = max(ends[-1], b)
                    else:
                        starts.append(a)
                        ends.append(b)
                for a, b in zip(starts, ends, strict=True):
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                for k, v in zip(out, (doc_id, len(raw), starts, ends, b"".join(kept)), strict=True):
                    out[k].append(v)
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, ["doc_id", "lo", "hi", "text"], f"doc_id {kind}, n_bytes bigint, starts array<int>, ends array<int>, kept binary", work)


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every whole text once each byte of a repeated 200-byte string is removed.

    Null and short texts stay as they are; repeated rows are documents of their own; extra columns are not read;
    an empty table gives no rows.
    """
    found = remove_repeats(read(spark, sf_dir, "documents"))
    gone = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op9_suffix_array": op9_suffix_array}
ORACLE_SQL: dict[str, str] = {}
