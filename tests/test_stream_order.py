"""The event stream takes its files in order of time, whatever the order in which tasks finish to write."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidegrid.plans import catalogue


@pytest.mark.parametrize("name", ["stream_tumbling", "stream_upsert"])
def test_slow_first_files(spark, tmp_path, name):
    # The earliest sixth has long names, so its file is written last; rows of it that come after later files are late.
    long = F.when(F.col("id") < 1000, F.repeat(F.lit("x"), 100_000)).otherwise("view")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).cast("timestamp_ntz")
    events = spark.range(6000).select(F.col("id").alias("event_id"), ts.alias("ts"), long.alias("event_type"), (F.col("id") % 97 / 4).alias("value"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    df = catalogue.queries()[name](spark, str(tmp_path))
    columns = df.columns
    want = duck.sql(catalogue.oracle_sql()[name]).select(*columns).fetchall()
    assert want and sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_empty_events(spark, tmp_path):
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert catalogue.queries()["stream_tumbling"](spark, str(tmp_path)).count() == 0
