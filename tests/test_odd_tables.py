"""Every query over tables without rows, and over tables with a row of nulls and rows that repeat."""

import pytest

from veritrace.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations")
#: Each of these stores a table for every step of several algorithms; the queries that they are made of are all here.
LONG = {"fraud_flags", "fraud_summary", "risk_after_findings", "algorithm_suite", "pagerank_projects", "pagerank_procurement"}


@pytest.fixture(scope="module", params=["none", "odd"])
def folder(request, spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp(request.param))
    for name in TABLES:
        df = spark.read.parquet(f"{SF}/{name}.parquet").limit(0 if request.param == "none" else 25)
        if request.param == "odd":
            df = df.union(spark.createDataFrame([(None,) * len(df.columns)], df.schema)).union(df.limit(3))
        df.selectExpr("*", "'x' AS extra", "1 AS company_id").coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def test_all_queries(spark, folder):
    failed = {}
    for name, query in QUERIES.items():
        if name in LONG:
            continue
        try:
            query(spark, folder).collect()
        except Exception as e:  # noqa: BLE001 - all are told at the end
            failed[name] = str(e)[:300]
    assert not failed
