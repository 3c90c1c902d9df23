"""Panels made from the star-schema tables, and their oracle CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import densify


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nation(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.date_trunc(unit, "o_orderdate").cast("timestamp_ntz").alias("ts"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("asset"), "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("family"))
    bars = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "ts").agg(F.avg("o_totalprice").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"), F.sum("o_totalprice").alias("vol_quote"))
    # The dimensions have a row a nation, whatever the scale; the planner broadcasts them by size.
    return bars.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("asset", "family", "ts", "close", "volume", "vol_quote")


def nation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(_nation(spark, sf_dir, "month"), ["family"])


def nation_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(_nation(spark, sf_dir, "day"), ["family"])


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("asset"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"), F.sum("value").alias("vol_quote"))


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(event_hours(spark, sf_dir))


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("asset"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.sum("value").alias("vol_quote"), F.count(F.lit(1)).cast("double").alias("volume"))


def supplier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month bars of suppliers: mean price, quantity, turnover."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("asset"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts")).agg(  # noqa: E741
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("vol_quote"))
    return densify(l)


def _nation_sql(unit: str) -> str:
    return f"""
bars AS (
  SELECT n_name AS asset, r_name AS family, date_trunc('{unit}', o_orderdate) AS ts, avg(o_totalprice) AS close,
         CAST(count(*) AS DOUBLE) AS volume, sum(o_totalprice) AS vol_quote
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL),
p AS (
  SELECT a.asset, a.family, t.ts, close, volume, vol_quote
  FROM (SELECT DISTINCT asset, family FROM bars) a CROSS JOIN (SELECT DISTINCT ts FROM bars) t
  LEFT JOIN bars b ON a.asset = b.asset AND t.ts = b.ts)"""


NATION_MONTH = _nation_sql("month")
NATION_DAY = _nation_sql("day")
EVENT_HOURS = """
bars AS (
  SELECT event_type AS asset, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS vol_quote
  FROM events GROUP BY ALL),
p AS (
  SELECT a.asset, t.ts, open, high, low, close, volume, vol_quote
  FROM (SELECT DISTINCT asset FROM bars) a CROSS JOIN (SELECT DISTINCT ts FROM bars) t LEFT JOIN bars b ON a.asset = b.asset AND t.ts = b.ts)"""
EVENT_DAYS = """
p AS (
  SELECT event_type AS asset, date_trunc('day', ts)::TIMESTAMP AS ts, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
         sum(value) AS vol_quote, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY ALL)"""
SUPPLIER_MONTH = """
bars AS (
  SELECT CAST(l_suppkey AS BIGINT) AS asset, date_trunc('month', l_shipdate)::TIMESTAMP AS ts, sum(l_extendedprice) / sum(l_quantity) AS close,
         sum(l_quantity) AS volume, sum(l_extendedprice) AS vol_quote
  FROM lineitem GROUP BY ALL),
p AS (
  SELECT a.asset, t.ts, close, volume, vol_quote
  FROM (SELECT DISTINCT asset FROM bars) a CROSS JOIN (SELECT DISTINCT ts FROM bars) t LEFT JOIN bars b ON a.asset = b.asset AND t.ts = b.ts)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums of doubles depend on the order of rows."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounding(sql: str, doubles: str, others: str, digits: int = 6) -> str:
    """The same over the last CTE ``z``."""
    parts = [c.strip() for c in others.split(",") if c.strip()] + [f"round({c.strip()}, {digits}) + 0.0::DOUBLE AS {c.strip()}" for c in doubles.split(",") if c.strip()]
    return f"WITH {sql.strip()} SELECT {', '.join(parts)} FROM z"


def ema_cte(name: str, source: str, columns: dict[str, tuple[str, int]]) -> str:
    """Recursive CTE ``name (asset, ts, i, columns)`` of exponential means by output, from input and span; over gaps the old weight decays."""
    head, first, step = [], [], []
    for out, (x, span) in columns.items():
        keep, a = f"{(span - 1)}.0::DOUBLE / {span + 1}", f"2.0::DOUBLE / {span + 1}"
        head += [out, f"w_{out}"]
        first += [f"{x}::DOUBLE", f"CASE WHEN {x} IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END"]
        step += [f"CASE WHEN r.{x} IS NULL THEN q.{out} WHEN q.{out} IS NULL THEN r.{x} ELSE (q.w_{out} * ({keep}) * q.{out} + ({a}) * r.{x}) / (q.w_{out} * ({keep}) + {a}) END", f"CASE WHEN r.{x} IS NULL THEN q.w_{out} * ({keep}) ELSE 1.0::DOUBLE END"]
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i FROM {source}),
      {name}(asset, ts, i, {", ".join(head)}) AS (SELECT asset, ts, i, {", ".join(first)} FROM {name}_r WHERE i = 1
        UNION ALL SELECT r.asset, r.ts, r.i, {", ".join(step)} FROM {name} q JOIN {name}_r r ON r.asset = q.asset AND r.i = q.i + 1)"""
