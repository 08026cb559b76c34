"""Append-only logs of runs: risk snapshots, kept findings, batches claimed by what is in them, and syncs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from veritrace.operators.graph import top_per_key

#: Severities from the gravest; others come last.
SEVERITIES = ("critical", "high", "medium")


def keep_run(rows: DataFrame, path: str, run: str, at: str) -> None:
    """Put rows into the log below path as those of one run, with its time; a run that is repeated takes the place of what it wrote before."""
    rows = rows.withColumns({"at": F.to_timestamp(F.lit(at)), "run": F.lit(run)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all runs, with their columns at and run; none if nothing has been kept there."""
    schema = f"{schema}, at timestamp, run string"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


SNAPSHOT = "company_id bigint, risk_score double"
FINDING = "pattern string, severity string, company_id bigint, score double"


def snapshot_risk(companies: DataFrame, path: str, run: str, at: str) -> None:
    """Keep the score of every company (company_id, risk_score) whose score is above 0."""
    keep_run(companies.where("risk_score > 0").select(F.col("company_id").cast("long").alias("company_id"), F.col("risk_score").cast("double").alias("risk_score")), path, run, at)


def risk_log(spark: SparkSession, path: str) -> DataFrame:
    return read_runs(spark, path, SNAPSHOT)


def latest_scores(log: DataFrame) -> DataFrame:
    """(company_id, snapshots, risk_score, before): each company's newest kept score, the one before it, and how many there are."""
    by = F.struct("at", "run", "risk_score")
    rows = log.groupBy("company_id").agg(F.count("*").alias("snapshots"), F.slice(F.sort_array(F.collect_list(by), asc=False), 1, 2).alias("last"))
    return rows.select("company_id", "snapshots", F.col("last")[0]["risk_score"].alias("risk_score"), F.get("last", F.lit(1))["risk_score"].alias("before"))


def keep_findings(links: DataFrame, path: str, run: str, at: str) -> None:
    """Keep what a run of the detectors has found: (pattern, severity, company_id, score)."""
    keep_run(links.select("pattern", "severity", F.col("company_id").cast("long").alias("company_id"), F.col("score").cast("double").alias("score")), path, run, at)


def findings_log(spark: SparkSession, path: str) -> DataFrame:
    return read_runs(spark, path, FINDING)


def gravity(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, F.lit(i)) for i, s in enumerate(SEVERITIES)], F.lit(len(SEVERITIES)))


def latest_findings(log: DataFrame, limit: int | None = 10) -> DataFrame:
    """(pattern, severity, at, affected): patterns of each run with how many companies they flag, the gravest first, then the newest, then by name."""
    rows = log.groupBy("run", "pattern", "severity", "at").agg(F.count_distinct("company_id").alias("affected"))
    rows = rows.orderBy(gravity(F.col("severity")), F.desc("at"), "pattern", "run").select("pattern", "severity", "at", "affected")
    return rows if limit is None else rows.limit(limit)


def digest(rows: DataFrame) -> str:
    """A name of what is in rows, whatever their order and partitions: their number, and sums of two hashes of each whole row."""
    cells = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in rows.schema]
    nulls = F.concat_ws("", *[F.col(f"`{c}`").isNull().cast("string") for c in rows.columns])
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(k), nulls, *cells).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in (1, 2)]
    n, a, b = rows.agg(F.count("*").cast("string"), *sums).first()
    return f"{rows.schema.simpleString()}|{n}|{a}|{b}"


CLAIM = "source string, batch string, digest string, status string, rows bigint, error string"


def claims(spark: SparkSession, log: str) -> DataFrame:
    """(source, batch, digest, status, rows, error, at): the newest state of each batch's content: processing, completed or failed."""
    rows = read_runs(spark, log, CLAIM)
    return top_per_key(rows, ["source", "batch", "digest"], 1, F.desc("at"), F.desc("run")).drop("run")


def run_claimed(spark: SparkSession, log: str, source: str, batches: Iterable[tuple[str, DataFrame]], load: Callable[[str, DataFrame], None], now: Callable[[], str]) -> list[str]:
    """Load each named batch of a source whose content is not completed; returns the names loaded.

    A batch is claimed before it is loaded and told completed or failed after it, so a changed batch under an old name runs again,
    an unchanged one does not, and one that failed or broke off does. A failure is kept in the log and raised.
    """
    done = {(r["batch"], r["digest"]) for r in claims(spark, log).where((F.col("source") == source) & (F.col("status") == "completed")).select("batch", "digest").collect()}  # a row a batch
    loaded = []
    for batch, rows in batches:
        content = digest(rows)
        if (batch, content) in done:
            continue

        def tell(status: str, error: str | None = None, batch=batch, content=content) -> None:
            at = now()
            n = int(content.split("|")[-3]) if status == "completed" else None
            row = spark.createDataFrame([(source, batch, content, status, n, error)], CLAIM)
            keep_run(row, log, f"{source}-{batch}-{status}-{at}".replace("/", "_").replace(":", "_"), at)

        tell("processing")
        try:
            load(batch, rows)
        except Exception as e:
            tell("failed", str(e)[:500])
            raise
        tell("completed")
        loaded.append(batch)
    return loaded


SYNC = "source string, rows_written bigint"


def record_sync(spark: SparkSession, log: str, source: str, at: str, rows: int = 0) -> None:
    """Keep that a source was read to its end."""
    keep_run(spark.createDataFrame([(source, rows)], SYNC), log, f"{source}-{at}".replace("/", "_").replace(":", "_"), at)


def sync_history(spark: SparkSession, log: str, source: str, limit: int = 10) -> DataFrame:
    """(at, rows_written) of the last syncs of a source, the newest first."""
    return read_runs(spark, log, SYNC).where(F.col("source") == source).orderBy(F.desc("at")).limit(limit).select("at", "rows_written")


def should_skip(spark: SparkSession, log: str, source: str, now: str, max_age_hours: float = 24.0) -> bool:
    """Whether the source was read less than so many hours ago."""
    last = read_runs(spark, log, SYNC).where(F.col("source") == source).agg(F.max("at").alias("at"))
    age = (F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("at")) / 3600
    return bool(last.select(F.coalesce(age < max_age_hours, F.lit(False))).first()[0])
