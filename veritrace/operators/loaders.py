"""Loads into node and edge tables: edges that need both ends, what is seen up to a mark, and checkpoints of long loads."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrace.operators.upsert import archived, upsert

WATERMARK = "source string, last_value string, last_id bigint, rows_processed bigint, updated_at timestamp"


def edges(rows: DataFrame, left: tuple[DataFrame, str, str], right: tuple[DataFrame, str, str], keep: tuple[str, ...] = (), now: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, rows refused): each row's two codes become the ids of nodes; a row whose node is not there is refused.

    left and right are (nodes with id, the nodes' code, the row's code). An edge comes once; of rows with the same ends
    the greatest ``keep`` counts. ``now``: the edges so far, which stay unless a row replaces them.
    """
    (a, a_code, a_key), (b, b_code, b_key) = left, right
    ends = rows.join(a.select(F.col("id").alias("src"), F.col(a_code).alias(a_key)), a_key, "left").join(b.select(F.col("id").alias("dst"), F.col(b_code).alias(b_key)), b_key, "left")
    known = ends.where("src IS NOT NULL AND dst IS NOT NULL")
    made = known.groupBy("src", "dst").agg(F.max(F.struct(*keep)).alias("k")).select("src", "dst", "k.*") if keep else known.select("src", "dst").distinct()
    if now is not None:
        made = now.join(made.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(made)
    missing = F.when(F.col("src").isNull() & F.col("dst").isNull(), "both ends").when(F.col("src").isNull(), a_key).otherwise(b_key)
    return made, ends.where("src IS NULL OR dst IS NULL").select(*rows.columns, missing.alias("missing"))


def load(current: DataFrame, incoming: DataFrame, key: str, at: str, keep_old_if_null: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(the new state, the replaced rows for the history) of one load."""
    return upsert(current, incoming, key, keep_old_if_null), archived(current, incoming, key, at)


def subcontracts(subs: DataFrame, wins: DataFrame) -> DataFrame:
    """(src, dst, cig): from each winner of a tender to its subcontractors. subs has company and cig, wins company and cig; none is its own."""
    w = wins.select(F.col("company").alias("src"), "cig")
    return w.join(subs.select(F.col("company").alias("dst"), "cig"), "cig").where("src <> dst").select("src", "dst", "cig").distinct()


def same_as(companies: DataFrame) -> DataFrame:
    """(src, dst, reason): companies (id, cf, piva) with one VAT number and other tax codes, each with the first of its number."""
    rows = companies.where("piva IS NOT NULL AND piva <> ''")
    first = rows.groupBy("piva").agg(F.min(F.struct("id", "cf")).alias("f"))
    met = rows.join(first, "piva").where((F.col("id") != F.col("f.id")) & (F.col("cf") != F.col("f.cf")))
    return met.select(F.col("f.id").alias("src"), F.col("id").alias("dst"), F.lit("same_piva").alias("reason"))


def company_statistics(companies: DataFrame, wins: DataFrame) -> DataFrame:
    """companies with total_wins and total_value of wins (company_id, importo); 0 for those without."""
    n = wins.groupBy("company_id").agg(F.count("*").alias("total_wins"), F.sum("importo").alias("total_value"))
    out = companies.join(n, "company_id", "left")
    return out.withColumns({"total_wins": F.coalesce("total_wins", F.lit(0)), "total_value": F.coalesce("total_value", F.lit(0.0))})


# -- marks and checkpoints


def watermarks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], WATERMARK)


def read_mark(marks: DataFrame, source: str) -> dict:
    """The mark of one source; empty values for one that was never read."""
    found = marks.where(F.col("source") == source).limit(1).collect()
    return found[0].asDict() if found else {"source": source, "last_value": None, "last_id": None, "rows_processed": 0, "updated_at": None}


def save_mark(marks: DataFrame, source: str, last_value: str | None, now: str, rows: int = 0, last_id: int | None = None, total: int | None = None) -> DataFrame:
    """marks with that of a source set; rows are added to its count unless the total is given."""
    before = read_mark(marks, source)["rows_processed"] or 0
    row = marks.sparkSession.createDataFrame([(source, last_value, last_id, before + rows if total is None else total)], "source string, last_value string, last_id bigint, rows_processed bigint")
    return marks.where(F.col("source") != source).unionByName(row.withColumn("updated_at", F.to_timestamp(F.lit(now))))


def fetch_new(rows: DataFrame, marks: DataFrame, source: str, at: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(rows later than the source's mark, marks with the mark set to the latest of them). Without a mark all rows are new."""
    mark = read_mark(marks, source)["last_value"]
    new = rows if mark is None else rows.where(F.col(at) > F.lit(mark).cast(rows.schema[at].dataType))
    seen = new.agg(F.count("*").alias("n"), F.max(F.col(at)).cast("string").alias("last")).first()
    return new, save_mark(marks, source, seen["last"] if seen["n"] else mark, now, seen["n"])


def run_batches(spark: SparkSession, path: str, batches: Iterable[tuple[str, Callable[[], DataFrame]]]) -> list[str]:
    """Write each named batch below path, but those already there whole; a load that broke off goes on where it was.

    Returns the names written now. A batch is whole once Spark has put its _SUCCESS mark, wherever path lies.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    written = []
    for name, make in batches:
        target = f"{path}/batch={name}"
        mark = jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
        if not mark.getFileSystem(conf).exists(mark):
            make().write.mode("overwrite").parquet(target)
            written.append(name)
    return written


def with_validity(rows: DataFrame, start: str, default_from: str) -> DataFrame:
    """rows with valid_from (the day of ``start``, else the default) and an open valid_to."""
    day = F.to_date(F.substring(F.col(start).cast("string"), 1, 10))
    return rows.withColumns({"valid_from": F.coalesce(day, F.to_date(F.lit(default_from))), "valid_to": F.lit(None).cast("date")})


def history(versions: DataFrame, key: str, at: str) -> DataFrame:
    """versions with valid_from, their own day, and valid_to, the day of the key's next one."""
    nxt = F.lead(F.to_date(at)).over(Window.partitionBy(key).orderBy(at))
    return versions.withColumns({"valid_from": F.to_date(at), "valid_to": nxt})


def load_archived(current: DataFrame, archive: DataFrame | None, incoming: DataFrame, key: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(current, archive) after a load at a day: rows whose key came with other values are closed on that day and archived, the new ones are open from it.

    current has the columns of incoming with valid_from and valid_to. Rows that came unchanged or not at all stay; of a key that comes
    several times the greatest row counts; rows without key are left out.
    """
    values = [c for c in incoming.columns if c != key]
    day = F.to_date(F.lit(at))
    new = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*values)).alias("_new"))
    rows = current.join(new, key, "full")
    old = F.struct(*values)
    changed = F.col("valid_from").isNotNull() & F.col("_new").isNotNull() & ~old.eqNullSafe(F.col("_new"))
    closed = rows.where(changed).select(key, *values, "valid_from", day.alias("valid_to"))
    opened = rows.where(changed | F.col("valid_from").isNull()).select(key, *[F.col(f"_new.{c}").alias(c) for c in values], day.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    kept = rows.where(F.col("valid_from").isNotNull() & ~changed).select(key, *values, "valid_from", "valid_to")
    return kept.unionByName(opened), closed if archive is None else archive.unionByName(closed)


def versions(current: DataFrame, archive: DataFrame, key: str) -> DataFrame:
    """All versions of each key with its days, numbered from the oldest."""
    rows = current.unionByName(archive)
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy("valid_from")))
