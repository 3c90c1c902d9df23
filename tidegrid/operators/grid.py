"""Alignment: dense grids, lagged and as-of joins, fills, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import asset_time, col


def densify(bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every time with every asset, bars where there are any.

    The times and the assets are distinct values (small beside the bars);
    ``keys`` are further columns that belong to the asset.
    """
    assets = bars.select("asset", *(keys or [])).distinct()
    times = bars.select("ts").distinct()
    rest = bars.drop(*(keys or []))
    return assets.crossJoin(times).join(rest, ["asset", "ts"], "left")


def reindex(grid: DataFrame, *tables: DataFrame) -> DataFrame:
    """Left joins of tables keyed by (asset, ts) onto the grid; one partitioning serves all."""
    for t in tables:
        grid = grid.join(t, ["asset", "ts"], "left")
    return grid


def fill_forward(x: Column | str, limit: int | None = None) -> Column:
    """Last value, at most ``limit`` rows old."""
    w = asset_time().rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return F.last(col(x), ignorenulls=True).over(w)


def lagged_events(grid: DataFrame, daily: DataFrame, value: str, lag_days: int, rows_per_day: int, name: str) -> DataFrame:
    """Daily values on an intraday grid: known ``lag_days`` later, at exactly that time, and held for less than a day."""
    moved = daily.select("asset", (F.col("ts") + F.make_dt_interval(F.lit(lag_days))).alias("ts"), F.col(value).alias("_v"))
    return grid.join(moved, ["asset", "ts"], "left").withColumn(name, fill_forward("_v", rows_per_day - 1)).drop("_v")


def asof(left: DataFrame, right: DataFrame, value: str, name: str, strict: bool = False, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """The right side's latest value at or before (``strict``: before) each left row's time.

    Both sides are merged by one sort within the key instead of a range join;
    rows of equal time go right first, or left first if strict.
    """
    cols = [c for c in left.columns]
    a = left.select(F.lit(0 if strict else 1).alias("_side"), F.struct(*cols).alias("_row"), *keys, "ts", F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *keys, "ts", F.col(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    merged = a.unionByName(b).withColumn(name, F.last("_v", ignorenulls=True).over(w))
    return merged.where(F.col("_row").isNotNull()).select("_row.*", name)


def in_windows(rows: DataFrame, windows: DataFrame, low: str = "lo", high: str = "hi", seconds: int = 86400) -> DataFrame:
    """Range join ``low <= ts <= high`` by equal time buckets, so that no side is broadcast whatever its size."""
    spread = windows.withColumn("_b", F.explode(F.sequence(F.floor(_seconds(low) / seconds), F.floor(_seconds(high) / seconds))))
    return rows.withColumn("_b", F.floor(_seconds("ts") / seconds)).join(spread, "_b").where(F.col("ts").between(F.col(low), F.col(high))).drop("_b")


def _seconds(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def splits(times: DataFrame, ratios: tuple[float, ...] = (0.5, 0.17, 0.33), names: tuple[str, ...] = ("is", "val", "holdout")) -> DataFrame:
    """``(ts, pos, split)``: contiguous parts of the distinct times by row count; the last takes the rest."""
    everything = Window.partitionBy(F.lit(0))
    t = times.select("ts").distinct()
    t = t.withColumn("pos", F.row_number().over(everything.orderBy("ts")) - 1).withColumn("_n", F.count(F.lit(1)).over(everything))
    bound, label = F.lit(0), None
    for name, ratio in zip(names[:-1], ratios[:-1], strict=True):
        bound = bound + F.floor(F.col("_n") * F.lit(ratio))
        here = F.col("pos") < bound
        label = F.when(here, name) if label is None else label.when(here, name)
    return t.select("ts", "pos", label.otherwise(names[-1]).alias("split"))


def purged_forward(panel: DataFrame, parts: DataFrame, x: str, horizon: int, name: str) -> DataFrame:
    """Forward change over ``horizon`` positions, NULL where its end lies beyond the row's split."""
    last = parts.groupBy("split").agg(F.max("pos").alias("_last"))
    labelled = panel.join(parts, "ts").join(last, "split")
    value = F.try_divide(F.lead(x, horizon).over(asset_time()), F.col(x)) - 1
    return labelled.withColumn("_f", value).withColumn(name, F.when(F.col("pos") + horizon <= F.col("_last"), F.col("_f"))).drop("_f", "_last")
