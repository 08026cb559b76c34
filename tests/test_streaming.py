"""Streams of files: repeats, windows and a table that keeps up."""

import datetime as dt

from pyspark.sql import functions as F

from veritrace.operators.alerts import ALERT
from veritrace.streaming import alerts


def alert(i, entity, hour, severity="high"):
    return (str(i), "risk_spike", severity, "pending", "t", "d", "Company", entity, None, "x", {"k": "1"}, None, dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour), None, None, None)


def run(spark, tmp_path, batches, schema, make):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = make(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(source))
        q = q.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def test_repeats(spark, tmp_path):
    batches = [[alert(1, "a", 0), alert(2, "b", 1)], [alert(3, "a", 5), alert(4, "c", 6)], [alert(5, "z", 60)], [alert(6, "a", 62)]]
    got = run(spark, tmp_path, batches, ALERT, alerts.without_repeats)
    assert sorted(r["alert_id"] for r in got.collect()) == ["1", "2", "4", "5", "6"]


def test_volumes(spark, tmp_path):
    batches = [[alert(1, "a", 0), alert(2, "b", 1), alert(3, "b", 2, "low")], [alert(4, "c", 30)], [alert(5, "c", 90)]]
    got = run(spark, tmp_path, batches, ALERT, alerts.volumes)
    assert sorted((str(r["start"])[:10], r["severity"], r["n"]) for r in got.collect()) == [("2024-01-01", "high", 2), ("2024-01-01", "low", 1), ("2024-01-02", "high", 1)]


def test_keep_up(spark, tmp_path):
    schema = "k string, v int, at timestamp"
    t = lambda h: dt.datetime(2024, 1, 1, h)
    source, path, check = (str(tmp_path / x) for x in ("in", "table", "c"))
    assert alerts.newest(spark, path) is None
    for rows in ([("a", 1, t(1)), ("b", 2, t(1))], [("a", None, t(2)), ("c", 3, t(2)), (None, 9, t(2))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(source)
        alerts.keep_up(stream, path, "k", "at", check, ("v",)).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["k"], r["v"]) for r in alerts.newest(spark, path).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    assert [r["k"] for r in spark.read.parquet(f"{path}/history").where(F.col("version") == 1).collect()] == ["a"]
