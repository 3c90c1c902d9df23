"""Rule library, position backtests, combinations and blends of return paths."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import asset_time, change, clip, correlation, div, lag, pair_moments, rolling
from . import recursive
from .grid import fill_forward
from .portfolio import sharpe
from .timeseries import rank_in_window


def indicators(df: DataFrame) -> DataFrame:
    """What the rules look at, by asset: exponential means (missing before a span's rows), Wilder RSI, simple-mean ATR over
    the close and its median, rolling VWAP, bands, break-out levels, percentile ranks and returns.

    The recursive ones take one pandas pass an asset, the rest windows.
    """
    spans = (20, 50, 100, 200)

    def work(d: pd.DataFrame) -> dict[str, np.ndarray]:
        c = d["close"].to_numpy(dtype=float)
        return {**{f"ema{n}": recursive.ema(c, n, n) for n in spans}, "rsi14": recursive.rsi(c, 14, 1 / 14, 14)}

    d = recursive.by_asset(df, [*[f"ema{n}" for n in spans], "rsi14"], work, ["close"])
    before = lag("close")
    d = d.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    d = d.withColumn("atr_pct", div(rolling(F.avg, "_tr", 14), "close")).withColumn("_pv", F.col("close") * F.col("volume"))
    d = d.withColumn("atr_median", rolling(lambda x: F.percentile(x, F.lit(0.5)), "atr_pct", 120, 60))
    for k in (72, 168):
        d = d.withColumn(f"vwap{k}", div(rolling(F.sum, "_pv", k), rolling(F.sum, "volume", k)))
    mid, width = rolling(F.avg, "close", 20), 2 * rolling(F.stddev_samp, "close", 20)
    d = d.withColumn("_top", rolling(F.max, "close", 72)).withColumn("_bottom", rolling(F.min, "close", 72))
    d = d.withColumns({"band_high": mid + width, "band_low": mid - width, "high72": lag("_top"), "low72": lag("_bottom"), "ema20_rank": rank_in_window("ema20", 100, 60), "volume_rank": rank_in_window("volume", 120, 60)})
    d = d.withColumns({"ret20": change("close", 20), "ret24": change("close", 24), "mean50": rolling(F.avg, "close", 50), "ema100_24": lag("ema100", 24), "ema200_24": lag("ema200", 24)})
    return d.drop("_tr", "_pv", "_top", "_bottom")


def funding_features(df: DataFrame, rate: str, k: int = 24 * 90, least: int = 24 * 30) -> DataFrame:
    """Adds ``funding`` (the filled rate a row late) and ``funding_z``, its z-score within five deviations."""
    d = df.withColumn("_f", fill_forward(rate)).withColumn("funding", lag("_f"))
    s = rolling(F.stddev_samp, "funding", k, least)
    return d.withColumn("funding_z", clip(div(F.col("funding") - rolling(F.avg, "funding", k, least), s), -5, 5)).drop("_f")


# The rules' names and limits. Conditions of a long and a short position, over the columns of ``indicators``.
RULES = {
    "buy_hold_direct": ("true", "false"),
    "random_noise_control": ("substr(noise, 1, 1) < '8'", "substr(noise, 1, 1) >= '8'"),
    "naive_momentum_20_long_short": ("ret20 > 0", "ret20 < 0"),
    "naive_momentum_20_long_flat": ("ret20 > 0", "false"),
    "naive_mean_reversion_50_long_short": ("close < mean50", "close > mean50"),
    "naive_mean_reversion_50_long_flat": ("close < mean50", "false"),
    "ema50_200_long_short": ("ema50 > ema200", "ema50 < ema200"),
    "ema50_200_long_flat": ("ema50 > ema200", "false"),
    "close_ema200_long_short": ("close > ema200", "close < ema200"),
    "close_ema200_long_flat": ("close > ema200", "false"),
    "ema200_slope_long_short": ("ema200 > ema200_24", "ema200 < ema200_24"),
    "ema100_slope_long_flat": ("ema100 > ema100_24", "false"),
    "slow_ema_rank_band_long_short": ("ema20_rank > 0.60", "ema20_rank < 0.40"),
    "slow_ema_rank_band_long_flat": ("ema20_rank > 0.60", "false"),
    "vwap72_trend_long_short": ("close > vwap72", "close < vwap72"),
    "vwap168_trend_long_flat": ("close > vwap168", "false"),
    "vwap72_reversion_long_short": ("close < vwap72 * 0.995", "close > vwap72 * 1.005"),
    "vol_compression_trend_long_flat": ("close > ema200 AND atr_pct < atr_median", "false"),
    "atr_expansion_short_filter": ("close > ema200", "close < ema200 AND atr_pct > atr_median"),
    "breakout72_long_short": ("close > high72", "close < low72"),
    "breakout72_low_vol_long_flat": ("close > high72 AND atr_pct < atr_median", "false"),
    "rsi_reversal_14_long_short": ("rsi14 < 30", "rsi14 > 70"),
    "bollinger_reversion_long_short": ("close < band_low", "close > band_high"),
    "volume_confirmed_momentum": ("ret24 > 0 AND volume_rank > 0.55", "ret24 < 0 AND volume_rank > 0.55"),
    "volume_exhaustion_reversal": ("ret24 < 0 AND volume_rank > 0.80", "ret24 > 0 AND volume_rank > 0.80"),
}
#: Rules that need funding too.
FUNDING_RULES = {
    "funding_carry_long_short": ("funding < -0.00002", "funding > 0.00007"),
    "funding_extreme_reversal_long_short": ("funding_z < -1.5", "funding_z > 1.5"),
    "trend_carry_aligned_long_short": ("close > ema200 AND funding <= 0.00005", "close < ema200 AND funding >= 0.0"),
    "trend_no_euphoria_long_flat": ("close > ema200 AND funding_z < 1.0", "false"),
}


def noise() -> Column:
    """Hexadecimal digits of a row's own, for the control without information: the MD5 of asset and hour."""
    return F.md5(F.concat_ws("|", F.col("asset").cast("string"), F.date_format("ts", "yyyyMMddHH")).cast("binary"))


def rules(funding: bool = False) -> dict[str, Column]:
    """Desired positions of -1, 0 or 1 by rule name; what is not known is no position."""
    return {n: F.when(F.expr(up), 1.0).when(F.expr(down), -1.0).otherwise(0.0) for n, (up, down) in (RULES | (FUNDING_RULES if funding else {})).items()}


def evaluate_rules(df: DataFrame, made: dict[str, Column], cost_bp: float = 7.0) -> DataFrame:
    """Long table (rule, asset, ts, position, pnl): positions held a row late, costs on changes."""
    d = df.withColumns({f"_p_{n}": c for n, c in made.items()}).withColumn("_r", change("close"))
    long = d.select("asset", "ts", "_r", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_p_{n}").alias("position")) for n in made])).alias("x")).select("x.rule", "asset", "ts", "_r", "x.position")
    w = Window.partitionBy("rule", "asset").orderBy("ts")
    long = long.withColumn("held", F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    cost = F.abs(F.col("held") - F.coalesce(F.lag("held").over(w), F.lit(0.0))) * cost_bp / 1e4
    return long.withColumn("pnl", F.coalesce(F.col("held") * F.col("_r"), F.lit(0.0)) - cost).drop("_r")


def position_metrics(path: DataFrame, periods: float, keys: tuple[str, ...] = ("rule", "asset")) -> DataFrame:
    """Return, risk, exposure and trades of positions by key."""
    w = Window.partitionBy(*keys).orderBy("ts")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = path.withColumn("_cum", F.sum("pnl").over(run)).withColumn("_new", (F.col("held") != F.coalesce(F.lag("held").over(w), F.lit(0.0))) & (F.col("held") != 0))
    d = d.withColumn("_dd", F.max("_cum").over(run) - F.col("_cum"))
    gain, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")))
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("total"), sharpe("pnl", periods).alias("sharpe"), F.max("_dd").alias("max_drawdown"), F.avg(F.abs("held")).alias("exposure"), F.avg(F.when(F.col("held") > 0, 1.0).otherwise(0.0)).alias("long_share"),
        F.count_if("_new").alias("trades"), div(gain, loss).alias("profit_factor"), F.max("pnl").alias("best"), F.min("pnl").alias("worst"))


def correlations(paths: DataFrame) -> DataFrame:
    """Correlation of the P&L of path pairs (a < b), from moments of one self join by time; NULL where one never changes."""
    other = paths.select(F.col("path").alias("b"), "ts", F.col("r").alias("_q"))
    both = paths.select(F.col("path").alias("a"), "ts", "r").join(other, "ts").where("a < b")
    return both.groupBy("a", "b").agg(correlation(*pair_moments(F.col("r"), F.col("_q"))).alias("corr"))


def uncorrelated(paths: DataFrame, most: float) -> DataFrame:
    """Path pairs (a < b) whose P&L correlates at most so much."""
    return correlations(paths).where(F.abs("corr") <= most)


def greedy_pool(spark: SparkSession, scores: list[tuple[str, float]], corr: dict[tuple[str, str], float], most: float, size: int) -> list[str]:
    """Admits paths best first unless too like one already in. Order decides, so it runs over a bounded list."""
    pool: list[str] = []
    for name, _ in sorted(scores, key=lambda x: (-x[1], x[0])):
        if len(pool) < size and all(abs(corr.get(tuple(sorted((name, p))), 0.0)) <= most for p in pool):
            pool.append(name)
    return pool


def weight_grid(components: int, units: int = 10, cap: int = 2500) -> list[tuple[float, ...]]:
    """Weights in whole units that sum to one, every component with one unit at least."""
    cuts = combinations(range(1, units), components - 1)
    grid = [tuple(float(b - a) / units for a, b in zip((0, *c), (*c, units), strict=True)) for c in cuts]
    return grid[:cap]


def blends(paths: DataFrame, members: list[str], units: int = 10, periods: float = 365.0, most: int = 3) -> DataFrame:
    """Sharpe of every blend of up to ``most`` members on a weight grid.

    Members meet once in a covariance table; a blend's mean and variance
    follow from it, so no blend touches the rows.
    """
    spark = paths.sparkSession
    wide = paths.where(F.col("path").isin(members)).groupBy("ts").pivot("path", members).agg(F.first("r")).na.fill(0.0)
    quoted = [f"`{m}`" for m in members]
    row = wide.agg(*[F.avg(q) for q in quoted], *[F.covar_samp(a, b) for a in quoted for b in quoted]).first()
    k = len(members)
    mean, cov = np.array(row[:k]), np.array(row[k:]).reshape(k, k)
    out = []
    for n in range(1, min(most, k) + 1):
        for chosen in combinations(range(k), n):
            for w in weight_grid(n, units):
                x = np.zeros(k)
                x[list(chosen)] = w
                var = float(x @ cov @ x)
                out.append(("+".join(f"{members[i]}:{v:g}" for i, v in zip(chosen, w, strict=True)), n, float(x @ mean / np.sqrt(var) * np.sqrt(periods)) if var > 1e-18 else 0.0))
    return spark.createDataFrame(out, "blend string, members int, sharpe double")


def ridge(df: DataFrame, y: str, xs: list[str], alpha: float = 1.0) -> dict[str, float]:
    """Coefficients of standardised regressors with an L2 penalty; moments come from one aggregation."""
    d = df.select(y, *xs).na.drop()
    first = d.agg(*[F.avg(c) for c in xs], *[F.stddev_pop(c) for c in xs]).first()
    mean, std = first[: len(xs)], first[len(xs) :]
    z = [(F.col(c) - float(m)) / float(s) if s else F.lit(0.0) for c, m, s in zip(xs, mean, std, strict=True)]
    sums = d.agg(*[F.sum(a * b) for a in z for b in z], *[F.sum(a * (F.col(y))) for a in z], F.avg(y)).first()
    k = len(xs)
    xtx, xty = np.array(sums[: k * k]).reshape(k, k), np.array(sums[k * k : k * k + k])
    return dict(zip(xs, np.linalg.solve(xtx + alpha * np.eye(k), xty).tolist(), strict=True))


def walk_forward(paths: DataFrame, parts: int, periods: float) -> DataFrame:
    """Sharpe of each path in consecutive near-equal parts."""
    seg = paths.select("ts").distinct().select("ts", F.ntile(parts).over(Window.partitionBy(F.lit(0)).orderBy("ts")).alias("part"))
    return paths.join(seg, "ts").groupBy("path", F.col("part").cast("long").alias("part")).agg(sharpe("r", periods).alias("sharpe"), F.sum("r").alias("total"), F.count(F.lit(1)).alias("n"))


def monthly_targets(grid: DataFrame, targets: DataFrame, weight: str, lag_rows: int = 1) -> DataFrame:
    """Month-end targets held until the next ones, ``lag_rows`` late."""
    marked = grid.join(targets.select("asset", "ts", F.col(weight).alias("_w")), ["asset", "ts"], "left")
    live = F.last("_w", ignorenulls=True).over(asset_time().rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_l", live).withColumn(weight, F.coalesce(F.lag("_l", lag_rows).over(asset_time()), F.lit(0.0))).drop("_w", "_l")
