"""Benchmark decontamination: a hash set of normalised benchmark n-grams meets every window of every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.common import ascii_lower, drop_rows, read, row_key

#: What separates words: all of ASCII but digits and lower-case letters.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Slots of the hash set that goes to all tasks: so many for each window, within these bounds (bytes).
SLOTS_A_WINDOW, MIN_SLOTS, MAX_SLOTS = 32, 1 << 14, 1 << 24
#: The exact windows are broadcast up to this many; beyond it, candidates and windows meet in a shuffle.
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    """The words of a lower-cased text; of null: none."""
    return F.filter(F.split(F.coalesce(ascii_lower(text), F.lit("")), _GAPS), lambda w: w != "")


def _starts(n: Column, length: int) -> Column:
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, length: int = 10) -> DataFrame:
    """One row per distinct window: its ``win`` (words joined by spaces), ``len`` and sorted ``items``.

    Items with fewer words than ``length`` are one window; items without words (or null) have none.
    """
    w = F.col("_w")
    n = F.size(w)
    whole = F.when((n > 0) & (n < length), F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
    parts = F.transform(_starts(n, length), lambda i: F.array_join(F.slice(w, i + 1, length), " "))
    return (
        benchmark.select("item_id", words(F.col("text")).alias("_w"))
        .select("item_id", F.explode(F.concat(whole, parts)).alias("win"), F.least(n, F.lit(length)).alias("len"))
        .groupBy("win", "len")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )


def find_hits(docs: DataFrame, benchmark: DataFrame, length: int = 10, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of docs: the ``keep`` columns, n_words, spans (sorted word ranges [from, to)), n_hit and item_ids.

    A fixed-size table of window hashes, made from the benchmark alone, goes to all tasks as a literal; only
    windows that it lets pass leave their row, as text, and are compared with the true windows. So a hash
    that is equal by chance costs a lookup and never a hit, and no document text is shuffled.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, length)
    sizes = {r["len"]: r["n"] for r in windows.groupBy("len").agg(F.count("*").alias("n")).collect()}  # a row a length
    n_windows = sum(sizes.values())
    slots = MIN_SLOTS
    while slots < min(MAX_SLOTS, SLOTS_A_WINDOW * n_windows):
        slots *= 2
    table = bytearray(slots)
    slot = F.pmod(F.xxhash64(F.split("win", " ")), F.lit(slots)).cast("int")
    for r in windows.select(slot.alias("s")).distinct().toLocalIterator():  # as many as slots at most
        table[r["s"]] = 1
    passes = F.lit(table)

    def candidates(w: Column, size: int) -> Column:
        def hit(i: Column) -> Column:
            h = F.pmod(F.xxhash64(F.slice(w, i + 1, size)), F.lit(slots)).cast("int")
            return F.substring(passes, h + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))

        return F.transform(
            F.filter(_starts(F.size(w), size), hit),
            lambda i: F.struct(i.alias("at"), F.lit(size).alias("len"), F.array_join(F.slice(w, i + 1, size), " ").alias("win")),
        )

    found = [candidates(F.col("_w"), s) for s in sorted(sizes)]
    none = F.array().cast("array<struct<at:int,len:int,win:string>>")
    rows = (
        docs.select(*keep, F.monotonically_increasing_id().alias("_row"), words(F.col("text")).alias("_w"))
        .select(*keep, "_row", F.size("_w").cast("long").alias("n_words"), (F.concat(*found) if found else none).alias("_c"))
        .select(*keep, "_row", "n_words", F.explode_outer("_c").alias("_c"))
        .select(*keep, "_row", "n_words", "_c.at", "_c.win", "_c.len")
    )
    windows = windows.withColumnsRenamed({"len": "_len"})
    hits = rows.join(
        F.broadcast(windows) if n_windows <= BROADCAST_WINDOWS else windows,
        (rows["win"] == windows["win"]) & (rows["len"] == windows["_len"]),
        "left",
    )
    is_hit = F.col("_len").isNotNull()
    spans = F.sort_array(F.collect_list(F.when(is_hit, F.struct(F.col("at").alias("lo"), (F.col("at") + F.col("_len")).alias("hi")))))
    firsts = [F.first(c).alias(c) for c in (*keep, "n_words")]
    grouped = hits.groupBy("_row").agg(*firsts, spans.alias("_s"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("item_ids"))
    merged = F.aggregate(
        F.col("_s"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["hi"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(acc["end"], x["lo"]))).cast("long").alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return grouped.select(*keep, "n_words", F.col("_s").alias("spans"), merged.alias("n_hit"), "item_ids")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """docs without the rows in which a benchmark window occurs; all columns stay."""
    rows, a, b = row_key(docs)
    return drop_rows(docs, find_hits(rows, benchmark, length, (a, b)).where("n_hit > 0").select(a, b))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 words over whole texts of documents and benchmark.

    A null or empty text has no words, so it is clean; a null item counts for no window; rows repeated in
    documents are judged each, items repeated in the benchmark once; extra columns are not read; an empty
    benchmark leaves all documents clean.
    """
    hits = find_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.sort_array(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op5_decontaminate": op5_decontaminate}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex(coalesce(" + _LOW + ", ''), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
ORACLE_SQL = {
    "op5_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
win AS (
  SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS g FROM b WHERE len(w) BETWEEN 1 AND 9
  UNION ALL
  SELECT item_id, 10, array_to_string(w[i:i + 9], ' ') FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)"""
}
