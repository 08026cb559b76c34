"""Registration: a query is a function of Tables; beside it stands DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.sources.tables import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, **given):
    """Register a function of Tables; ``given`` are the arguments of the registered query, beside which defaults stay as they are."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir), **given)
        if sql is not None:
            ORACLE_SQL[name] = with_tables(sql)
        return f

    return add


def total(c: str, name: str, places: int = 2) -> Column:
    return F.round(F.coalesce(F.sum(c), F.lit(0.0)), places).alias(name)


def mean(c: str, name: str, places: int = 2) -> Column:
    return F.round(F.avg(c), places).alias(name)


def valid_at(df: DataFrame, ts: str) -> DataFrame:
    """Rows valid at ts: from valid_from, until just before valid_to; a null valid_to is open."""
    at = F.to_date(F.lit(ts))
    return df.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def top(df: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    df = df.orderBy(*order)
    return df if n is None else df.limit(n)


def spread(t: Tables, rows: DataFrame, *keys: str) -> DataFrame:
    """rows, of which there are no more than lines of orders, dealt out by keys in parts that do not grow with the tables; those of small tables stay as they are."""
    parts = getattr(t, "parts", 0)
    return rows.repartition(parts, *keys) if parts else rows


def joined(c: Column | str, sep: str = ",") -> Column:
    """A sorted array as text, so that engines can be compared."""
    return F.array_join(F.sort_array(c), sep)


def quarter_of(day: str) -> list[Column]:
    return [F.year(day).alias("year"), F.quarter(day).alias("quarter")]
