"""Incremental tables: keyed upserts of micro-batches, late rows, freshness, simple traders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.upsert import keep_last


class VersionedTable:
    """A table of month partitions; an upsert rewrites only the months that its rows touch.

    Readers go through ``CURRENT``, a file that names the version of each
    month and is replaced last, so they see all of an upsert or nothing.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], ts: str = "ts"):
        self.spark, self.root, self.keys, self.ts = spark, root.rstrip("/"), keys, ts

    def _index(self) -> dict[str, str]:
        import json

        from ..sources.stores import _read

        raw = _read(f"{self.root}/CURRENT")
        return json.loads(raw) if raw else {}

    def read(self) -> DataFrame | None:
        paths = sorted(self._index().values())
        return self.spark.read.parquet(*paths) if paths else None

    def upsert(self, rows: DataFrame, version: str, since=None) -> None:
        """Adds rows, the last of equal keys winning; rows before ``since`` leave the touched months."""
        import json

        from ..sources.market import _fs

        index = self._index()
        month = F.date_format(self.ts, "yyyy-MM")
        rows = rows.withColumn("_month", month).persist()
        for (m,) in rows.select("_month").distinct().collect():  # months, not rows
            new = rows.where(F.col("_month") == m).drop("_month")
            merged = keep_last(self.spark.read.parquet(index[m]), new, keys=self.keys) if m in index else keep_last(new, keys=self.keys)
            if since is not None:
                merged = merged.where(F.col(self.ts) >= F.lit(since))
            path = f"{self.root}/month={m}/{version}"
            merged.write.mode("overwrite").parquet(path)
            index[m] = path
        rows.unpersist()
        fs, path = _fs(f"{self.root}/CURRENT.{version}")
        with fs.open_output_stream(path) as f:
            f.write(json.dumps(index).encode())
        fs.move(path, path.removesuffix(f".{version}"))


def stream_upsert(rows: DataFrame, table: VersionedTable, checkpoint: str, confirmed: str | None = "confirmed") -> StreamingQuery:
    """Upserts each micro-batch of a stream; a batch that runs twice gives the same table."""
    def merge(batch: DataFrame, number: int) -> None:
        if confirmed and confirmed in batch.columns:
            batch = batch.where(confirmed).drop(confirmed)
        table.upsert(batch, f"v{number:09d}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(rows: DataFrame, ts: str, length: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Windowed sums of a stream that waits ``late`` for late rows."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, length), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(rows: DataFrame, ts: str, length: str, slide: str, late: str, keys: list[str], value: str) -> DataFrame:
    return rows.withWatermark(ts, late).groupBy(F.window(ts, length, slide), *keys).agg(F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), *keys, "mean")


def freshness(df: DataFrame, now, limit_hours: float = 3) -> DataFrame:
    """Age of each asset's last row, and whether it is within the limit."""
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.max("ts").cast("timestamp"))) / 3600
    return df.groupBy("asset").agg(age.alias("age_hours"), F.max("ts").alias("last")).withColumn("fresh", F.col("age_hours") <= limit_hours)


TRADER = "asset string, ts timestamp, position double, capital double, cost double"


def paper_trades(signals: DataFrame, capital: float = 10_000.0, cost_bp: float = 7.0) -> DataFrame:
    """Position and capital after each bar (asset, ts, close, target) of a stream, carried as state."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cash, position, price = state.get if state.exists else (capital, 0.0, None)
        out = []
        for r in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples(index=False):
            if price:
                cash *= 1 + position * (r.close / price - 1)
            cost = cash * abs(r.target - position) * cost_bp / 1e4
            cash, position, price = cash - cost, float(r.target), float(r.close)
            out.append((key[0], r.ts, position, cash, cost))
        state.update((cash, position, price))
        yield pd.DataFrame(out, columns=["asset", "ts", "position", "capital", "cost"])

    return signals.groupBy("asset").applyInPandasWithState(step, TRADER, "cash double, position double, price double", "append", GroupStateTimeout.NoTimeout)
