"""Sharding: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrace.llm.common import read

#: Hex digits of a key's MD5 that name its bucket; slots are numbered bucket by bucket.
BUCKET_DIGITS = 3
_UNIT = float(16**13)


def _score(key: Column, shard: int, weight: float) -> Column:
    """Weight over -ln of a uniform number that key and shard decide; the largest wins, ties go to the lower shard."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(_UNIT)
    return F.struct((F.lit(weight) / -F.log(uniform)).alias("score"), F.lit(-shard).alias("minus_shard"))


def _best(key: Column, weights: Sequence[float]) -> Column:
    scores = [_score(key, i, float(w)) for i, w in enumerate(weights) if w > 0]
    return scores[0] if len(scores) == 1 else F.greatest(*scores)


def assign(df: DataFrame, key: str, weights: Sequence[float], grown_weight: float | None = None) -> DataFrame:
    """Add ``shard`` and, with a ``grown_weight``, ``grown_shard``: where a row goes once one more shard exists.

    Key and weights alone decide. A shard's share of keys is its weight over the sum of weights; one more
    shard takes rows only into itself, a removed one gives away only its own. Weights must not be negative
    and not all zero. A null key is the key of its own, equal for all rows without one.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be zero or more, and one must be above zero")
    name = F.coalesce(F.col(key).cast("string"), F.lit("\x00null"))
    best = _best(name, weights)
    out = df.withColumn("_best", best)
    if grown_weight is not None:
        grown = F.greatest(F.col("_best"), _score(name, len(weights), float(grown_weight)))
        out = out.withColumn("grown_shard", (-grown["minus_shard"]).cast("int"))
    return out.withColumn("shard", (-F.col("_best.minus_shard")).cast("int")).drop("_best")


def number(df: DataFrame, key: str, order: Sequence[str], counted: DataFrame | None = None) -> DataFrame:
    """Add ``slot``, gapless from 0 in every shard, without sorting a whole shard in one task.

    Rows are numbered within (shard, bucket of the key's hash); each bucket starts where the counts of the
    shard's earlier buckets end. ``counted``: the same rows with at least key and shard, if cheaper to read.
    The broadcast table has shards * 16 ** BUCKET_DIGITS rows at most, whatever the input.
    """
    bucket = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("\x00null")).cast("binary")), 1, BUCKET_DIGITS)
    counts = (counted if counted is not None else df).withColumn("_bucket", bucket).groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_bucket").orderBy(*order)
    rows = df.withColumn("_bucket", bucket).withColumn("_rank", F.row_number().over(within) - 1)
    return (
        rows.join(F.broadcast(starts), ["shard", "_bucket"])
        .withColumn("slot", F.col("_start") + F.col("_rank"))
        .drop("_bucket", "_start", "_rank")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 8 shards of equal weight, under the law ``key``.

    A null text counts no bytes, so its size is 1 and its CRC 0; rows without doc_id share one key; repeated
    rows go to one shard and get slots of their own. Extra columns are not read. An empty table gives no rows.
    """
    docs = read(spark, sf_dir, "documents")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"), F.lit("key").alias("law")
    )
    weights = [1.0] * 8
    out = number(
        assign(rows, "doc_id", weights, grown_weight=1.0),
        "doc_id",
        ["doc_id", "text_crc32", "size"],
        counted=assign(docs.select("doc_id"), "doc_id", weights),
    )
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {"op1_sharding": op1_sharding}


def _oracle(shards: int = 8) -> str:
    """The same in DuckDB: scores from MD5, the CRC byte by byte over a table made from its polynomial."""
    key = "coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')"
    scores = ", ".join(f"{{'s': 1.0 / -ln((CAST('0x' || substr(md5(key || ':{i}'), 1, 13) AS BIGINT) + 0.5) / {_UNIT!r}::DOUBLE), 'm': {-i}}}" for i in range(shards + 1))
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    table = "i::BIGINT"
    for _ in range(8):
        table = f"(SELECT {step} FROM (SELECT {table} AS c))"
    return f"""
WITH t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, {table} AS v FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, {key} AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT r, doc_id, key, length(h) // 2 AS n, list_transform(regexp_extract_all(h, '..'), lambda v: CAST('0x' || v AS BIGINT)) AS bytes FROM d),
c AS (SELECT r, doc_id, key, n + 1 AS size, CASE WHEN n = 0 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, v: xor(a >> 8, t.t[(xor(a, v) & 255) + 1])), 4294967295::BIGINT) END AS crc FROM x, t),
s AS (SELECT *, [{scores}] AS s FROM c),
w AS (SELECT *, CAST(-list_max(s[1:{shards}]).m AS INTEGER) AS shard, CAST(-list_max(s).m AS INTEGER) AS grown_shard FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(key), 1, {BUCKET_DIGITS}), doc_id NULLS FIRST, crc, size) - 1 AS slot, grown_shard
FROM w"""


ORACLE_SQL = {"op1_sharding": _oracle()}
