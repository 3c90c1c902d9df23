"""Weights, execution and P&L over (asset, ts) panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import asset_time, col, div
from .crosssection import at, pct_rank

TAKER_BP, SLIPPAGE_BP = 5.0, 2.0


def rank_weights(df: DataFrame, x: str, least: int, name: str) -> DataFrame:
    """Linear in the average-tie rank, zero sum, unit gross; 0 where there is no weight."""
    d = df.withColumn("_p", F.when(F.count(x).over(at()) >= least, pct_rank(x) - 0.5))
    d = d.withColumn("_p", F.col("_p") - F.avg("_p").over(at()))
    return d.withColumn(name, F.coalesce(div("_p", F.sum(F.abs("_p")).over(at())), F.lit(0.0))).drop("_p")


def sides(df: DataFrame, x: str) -> DataFrame:
    """Places from below and above among the values present, and their number."""
    up = F.row_number().over(at().orderBy(F.col(x).asc_nulls_last(), "asset"))
    down = F.row_number().over(at().orderBy(F.col(x).desc_nulls_last(), "asset"))
    return df.withColumn("_n", F.count(x).over(at())).withColumn("_up", F.when(F.col(x).isNotNull(), up)).withColumn("_down", F.when(F.col(x).isNotNull(), down))


def top_bottom_weights(df: DataFrame, x: str, least: int, share: float, name: str) -> DataFrame:
    """Half long the best, half short the worst ``share``; where they meet, short wins."""
    d = sides(df, x).withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_n") * share)))
    w = F.when(F.col("_up") <= F.col("_k"), -0.5 / F.col("_k")).when(F.col("_down") <= F.col("_k"), 0.5 / F.col("_k"))
    return d.withColumn(name, F.coalesce(F.when(F.col("_n") >= least, w), F.lit(0.0))).drop("_n", "_up", "_down", "_k")


def segment_weights(df: DataFrame, x: str, cap: str, share: float, least: int, name: str, equal: bool = False, apart: bool = False) -> DataFrame:
    """Half long the highest and half short the lowest ``share`` (one asset at least) of those with a value and a cap above 0, by cap or equally.

    Equal values go by asset. Each side takes the first of its own order, so
    that equal values may put an asset on both; it is short then. With
    ``apart`` both sides come from one order, and where they meet nothing is held.
    """
    d = sides(df.withColumn("_x", F.when(F.col(cap) > 0, F.col(x))), "_x").withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_n") * share)))
    ok = (F.col("_n") >= least) & ((2 * F.col("_k") <= F.col("_n")) if apart else F.lit(True))
    below = F.coalesce(ok & (F.col("_up") <= F.col("_k")), F.lit(False))
    above = F.coalesce(ok & ((F.col("_up") > F.col("_n") - F.col("_k")) if apart else (F.col("_down") <= F.col("_k"))), F.lit(False))
    d = d.withColumn("_c", F.lit(1.0) if equal else F.col(cap)).withColumn("_below", below).withColumn("_above", above)
    short = -0.5 * F.col("_c") / F.sum(F.when(F.col("_below"), F.col("_c"))).over(at())
    long = 0.5 * F.col("_c") / F.sum(F.when(F.col("_above"), F.col("_c"))).over(at())
    return d.withColumn(name, F.when(F.col("_below"), short).when(F.col("_above"), long).otherwise(0.0)).drop("_x", "_n", "_up", "_down", "_k", "_c", "_below", "_above")


def rebalance(w: Column | str, hours: int) -> Column:
    """Weights of the first row of each epoch-aligned bucket of hours, held through it."""
    bucket = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (3600 * hours))
    first = F.coalesce(bucket != F.floor(F.unix_seconds(F.lag("ts").over(asset_time()).cast("timestamp")) / (3600 * hours)), F.lit(True))
    return F.last(F.when(first, F.coalesce(col(w), F.lit(0.0))), ignorenulls=True).over(asset_time().rowsBetween(Window.unboundedPreceding, 0))


def held(w: Column | str, lag: int = 1) -> Column:
    return F.coalesce(F.lag(col(w), lag).over(asset_time()), F.lit(0.0))


def turnover(w: Column | str, part: tuple[str, ...] = ()) -> Column:
    """Absolute change of weight, the entry included; it starts anew in each part."""
    before = F.lag(col(w)).over(Window.partitionBy("asset", *part).orderBy("ts"))
    return F.abs(col(w) - F.coalesce(before, F.lit(0.0)))


def pnl(df: DataFrame, weight: str, ret: str, carry: str | None = None, part: tuple[str, ...] = (), cost_bp: float = TAKER_BP + SLIPPAGE_BP) -> DataFrame:
    """Gross, turnover, cost, carry and net by time; a held asset without a return counts as missing.

    Weighted returns are summed by time in one aggregation after the asset
    window; nothing else is shuffled.
    """
    d = df.withColumn("_t", turnover(weight, part))
    lost = F.col(ret).isNull() & (F.abs(weight) > 1e-12)
    out = d.groupBy(*part, "ts").agg(
        F.coalesce(F.sum(F.col(weight) * F.col(ret)), F.lit(0.0)).alias("gross"), F.sum("_t").alias("turnover"), F.sum(F.abs(weight)).alias("exposure"),
        (F.coalesce(F.sum(F.col(weight) * F.col(carry)), F.lit(0.0)) if carry else F.lit(0.0)).alias("carry"), F.count_if(lost).alias("missing"))
    return out.withColumn("cost", F.col("turnover") * cost_bp / 1e4).withColumn("net", F.col("gross") - F.col("cost") - F.col("carry"))


def sharpe(x: Column | str, periods: float) -> Column:
    s = F.stddev_samp(col(x))
    return F.when(s > 1e-12, F.avg(col(x)) / s * periods**0.5).otherwise(F.lit(0.0))


def metrics(path: DataFrame, periods: float, part: tuple[str, ...] = ()) -> DataFrame:
    """Summary of a P&L path by part: returns, risk, drawdown, turnover."""
    keys = list(part) or [F.lit(0).alias("_all")]
    w = Window.partitionBy(*(part or [F.lit(0)])).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    d = path.withColumn("_cum", F.sum("net").over(w))
    d = d.withColumn("_dd", F.max("_cum").over(w) - F.col("_cum"))
    out = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("net").alias("total"), F.avg("net").alias("mean"), sharpe("net", periods).alias("sharpe"), F.max("_dd").alias("max_drawdown"), F.avg("turnover").alias("avg_turnover"),
        F.sum("cost").alias("cost"), F.sum("carry").alias("carry"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"), F.max("missing").alias("missing"), (F.count_if(F.col("net") <= -1) == 0).alias("solvent"),
        (F.exp(F.sum(F.log(F.when(F.col("net") > -1, 1 + F.col("net"))))) - 1).alias("compounded"))
    return out if part else out.drop("_all")


def execute_formations(grid: DataFrame, targets: DataFrame, weight: str, lag: int, hold: int) -> DataFrame:
    """Formation weights from ``lag`` rows after the formation for ``hold`` rows; a later formation takes over.

    ``grid`` has every (asset, ts); ``targets`` rows only at formations. The
    last formation at or before the lagged row is found with a running last,
    not with a range join.
    """
    marked = grid.join(targets.select("asset", "ts", F.col(weight).alias("_w")), ["asset", "ts"], "left")
    w = asset_time()
    d = marked.withColumn("_i", F.row_number().over(w))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_last", F.last(F.when(F.col("_w").isNotNull(), F.struct("_i", "_w")), ignorenulls=True).over(run))
    d = d.withColumn("_use", F.lag("_last", lag).over(w))
    return d.withColumn(weight, F.coalesce(F.when(F.col("_i") - lag - F.col("_use._i") < hold, F.col("_use._w")), F.lit(0.0))).drop("_w", "_i", "_last", "_use")
