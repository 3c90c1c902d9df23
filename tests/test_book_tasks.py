"""The book query's tasks grow in number with the table, not in size."""

import math
import os

import pytest
from pyspark.sql import functions as F

from tidegrid.plans import audit_queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_orders_by_task(spark, monkeypatch):
    monkeypatch.setattr(audit_queries, "BOOK_ROWS", 2000, raising=False)
    df = audit_queries.book_sweep(spark, DATA)
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    orders = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(orders) == df.count()
    assert max(orders) < 2 * sum(orders) / math.ceil(rows / 2000)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_one_exchange_and_one_sort(spark):
    df = audit_queries.book_sweep(spark, DATA)
    steps = [line.lstrip(" +-:").split("(")[0].split(" ")[0] for line in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    assert steps.count("Exchange") == 1 and steps.count("Sort") == 1 and steps.count("Window") == 2


def test_empty_table(spark, tmp_path):
    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert audit_queries.book_sweep(spark, str(tmp_path)).count() == 0
