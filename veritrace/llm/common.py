"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from veritrace.operators.components import cut


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table in the same folder: smaller, and read back by column."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        cut(df.sparkSession.range(1))
    path = f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Characters of text that one Python step holds at a time; batches of long texts are cut to it.
CHARS_AT_ONCE = 1_000_000


def map_rows(
    df: DataFrame,
    columns: list[str],
    schema: str,
    work: Callable[[Iterator[list]], Iterator[dict[str, list]]],
    carry: dict[str, str] | None = None,
) -> DataFrame:
    """Run ``work`` over groups of rows (lists in the order of ``columns``) in Arrow batches.

    ``work`` gets an iterator of column lists and yields dicts of column lists or Arrow arrays; groups are cut
    so that the last of ``columns``, the text, stays under CHARS_AT_ONCE bytes a group, or is one row.
    ``carry`` names columns of any type that pass by unchanged, and their names in the result; it asks for one
    yield of as many rows for each group.
    """
    carry = carry or {}
    made = StructType.fromDDL(schema)
    fields = [(f.name, _arrow(f.dataType.simpleString())) for f in made.fields]
    full = StructType([*made.fields, *(StructField(new, df.schema[old].dataType) for old, new in carry.items())])
    n = len(columns)
    current: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            for b in batches:
                lengths = pc.fill_null(pc.binary_length(b.column(n - 1)), 0).to_numpy(zero_copy_only=False)
                at = total = 0
                cuts = []
                for i, size in enumerate(lengths.tolist()):
                    total += size
                    if total >= CHARS_AT_ONCE:
                        cuts.append((at, i + 1))
                        at, total = i + 1, 0
                if at < b.num_rows:
                    cuts.append((at, b.num_rows))
                for lo, hi in cuts:
                    part = b.slice(lo, hi - lo).columns
                    current[:] = part[n:]
                    yield [c.to_pylist() for c in part[:n]]

        for out in work(groups()):
            arrays = [x if isinstance(x := out[name], pa.Array) else pa.array(x, kind) for name, kind in fields] + current
            yield pa.RecordBatch.from_arrays(arrays, names=full.names)

    picked = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate([*columns, *carry])]
    return df.select(*picked).mapInArrow(run, full)


def _arrow(kind: str) -> pa.DataType:
    known = {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(),
        "double": pa.float64(), "binary": pa.binary(), "float": pa.float32(),
    }
    if kind.startswith("array<struct<"):
        return pa.list_(pa.struct({n: _arrow(k) for n, k in (x.split(":") for x in kind[13:-2].split(","))}))
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return known[kind]


#: A-Z and a-z, for lower-casing that leaves all other characters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts whose other letters have no lower-case form to change take the fast path."""
    other = text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]")
    return F.when(other, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


#: Row keys and small right sides are broadcast up to this many rows (some 16 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Parts in which rows with a frequent key meet their match.
SALTS = 16


def free(df: DataFrame, name: str) -> str:
    """name, or the first longer one that df has no column of (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(df: DataFrame) -> tuple[DataFrame, str, str]:
    """df with two columns that tell rows apart which differ in any column, and their names: 128 bits of hash of the whole row."""
    a, b = free(df, "_row_a"), free(df, "_row_b")
    cells = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    # a hash passes nulls over, so which cells are null is hashed with them
    nulls = F.concat_ws("", *[F.col(f"`{c}`").isNull().cast("string") for c in df.columns])
    return df.withColumns({a: F.xxhash64(nulls, *cells), b: F.xxhash64(F.lit(7), nulls, *reversed(cells))}), a, b


def drop_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs without the rows whose row_key is in the two columns of keys; their columns and all other rows stay."""
    rows, a, b = row_key(docs)
    keys = stored(keys.toDF(a, b).distinct())
    small = keys.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if small else keys, [a, b], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_rows(docs: DataFrame, every: DataFrame, keep: DataFrame) -> DataFrame:
    """docs with the rows whose row_key is in keep, once each; every has the keys of all rows of docs, as often as they occur."""
    left = drop_rows(docs, every.join(keep.distinct(), every.columns, "left_anti"))
    again = stored(every.groupBy(*every.columns).count().where("count > 1").drop("count"))
    if again.isEmpty():
        return left
    rows, a, b = row_key(left)
    again = again.toDF(a, b)
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    once = rows.join(again, [a, b], "left_semi").dropDuplicates([a, b])
    return rows.join(again, [a, b], "left_anti").unionByName(once).drop(a, b)


def frequent(counts: DataFrame, key: str, total: int) -> list:
    """Keys of counts (key, n) with more than a thousandth of total rows, so a thousand of them at most, and none below a thousand rows."""
    return [r[0] for r in counts.where(F.col("n") > max(1000, total // 1000)).select(key).collect()]


def join_frequent(left: DataFrame, right: DataFrame, key: str, often: list, salt: Column, how: str = "inner") -> DataFrame:
    """left joined with right, which has each key once; rows of left with a key in ``often`` meet it in SALTS parts by the hash of salt."""
    if not often:
        return left.join(right, key, how)
    s = free(left, "_salt")
    hot = F.col(key).isin(*often)
    parts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = left.withColumn(s, F.when(hot, F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    return left.join(right.withColumn(s, F.explode(parts)), [key, s], how).drop(s)
