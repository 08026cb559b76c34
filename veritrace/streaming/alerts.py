"""Alerts and loads from streams: repeats within a day, volumes by window, and tables kept up to date by each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.operators.alerts import WINDOW_HOURS, alert_hash
from veritrace.operators.upsert import archived, upsert


def without_repeats(alerts: DataFrame, hours: int = WINDOW_HOURS) -> DataFrame:
    """A stream of alerts without those whose hash came within so many hours before.

    The state holds a hash for so many hours of the stream's time; alerts that are later than that are dropped.
    """
    return alerts.withColumn("alert_hash", alert_hash()).withWatermark("created_at", f"{hours} hours").dropDuplicatesWithinWatermark(["alert_hash"])


def volumes(alerts: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, severity, n): alerts by window of their creation; a window is told once no alert of it can come any more."""
    rows = alerts.withWatermark("created_at", late).groupBy(F.window("created_at", width).alias("w"), "severity").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "severity", "n")


def keep_up(stream: DataFrame, path: str, key: str, at: str, checkpoint: str, keep_old_if_null: tuple[str, ...] = ()):
    """A writer that loads each batch of a stream into the table below path, as a version of its own, with what it replaced.

    Batch n makes ``path/state/version=n`` of the newest version before it, so a batch that is run again after a failure
    overwrites its own version and nothing else. ``newest`` reads the state.
    """

    def load(batch: DataFrame, n: int) -> None:
        before = newest(batch.sparkSession, path, n)
        clean = batch.where(F.col(key).isNotNull())
        state = upsert(clean.limit(0) if before is None else before, clean, key, keep_old_if_null)
        state.write.mode("overwrite").parquet(f"{path}/state/version={n}")
        if before is not None:
            stamp = batch.agg(F.max(at).cast("string")).first()[0]
            archived(before, clean, key, stamp).write.mode("overwrite").parquet(f"{path}/history/version={n}")

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)


def newest(spark, path: str, below: int | None = None) -> DataFrame | None:
    """The state after the last batch, or the last one before a number; None if there is none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(f"{path}/state")
    fs = top.getFileSystem(conf)
    if not fs.exists(top):
        return None
    whole = []
    for s in fs.listStatus(top):
        name = s.getPath().getName()
        if name.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/state/{name}/_SUCCESS")):
            whole.append(int(name[8:]))
    whole = [n for n in whole if below is None or n < below]
    return spark.read.parquet(f"{path}/state/version={max(whole)}") if whole else None

