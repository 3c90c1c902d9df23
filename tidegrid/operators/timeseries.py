"""Rolling and lagged features of one asset's series, as columns over (asset, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import asset_time, clip, col, correlation, div, lag, log, rolling, trailing

#: Frames from this many rows on use running sums instead of one pass a row.
LONG = 100


def zscore(x: Column | str, k: int, least: int | None = None, pop: bool = True) -> Column:
    std = F.stddev_pop if pop else F.stddev_samp
    s = rolling(std, x, k, least)
    return div(col(x) - rolling(F.avg, x, k, least), F.when(s > 1e-12, s))


def rank_in_window(x: Column | str, k: int, least: int | None = None) -> Column:
    """Rank of the current value among the values of the last k rows (ties average), over their number.

    Costs n x k: the window's values are looked at for every row.
    """
    x = col(x)
    values = F.collect_list(x).over(trailing(k))
    below = F.size(F.filter(values, lambda v: v < x))
    same = F.size(F.filter(values, lambda v: v == x))
    return F.when(x.isNotNull() & (F.size(values) >= (k if least is None else least)), (below + (same + 1) / 2) / F.size(values))


def rolling_corr(a: Column | str, b: Column | str, k: int) -> Column:
    a, b = col(a), col(b)
    ok = a.isNotNull() & b.isNotNull()
    x, y, w = F.when(ok, a), F.when(ok, b), trailing(k)
    n = F.count(x).over(w).cast("double")
    return F.when(n >= k, correlation(n, F.sum(x).over(w), F.sum(y).over(w), F.sum(x * x).over(w), F.sum(y * y).over(w), F.sum(x * y).over(w)))


def long_moments(df: DataFrame, x: str, k: int, mean: str, std: str, least: int, pop: bool = False) -> DataFrame:
    """Rolling mean and deviation over many rows in one pass.

    Differences of running sums, of values less the asset's first one so that
    large levels don't cancel; the row cost does not grow with k.
    """
    run = asset_time().rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(x, ignorenulls=True).over(Window.partitionBy("asset").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = df.withColumn("_c", first).withColumn("_x", F.col(x) - F.col("_c"))
    d = d.withColumn("_n", F.count("_x").over(run)).withColumn("_s", F.sum(F.coalesce("_x", F.lit(0.0))).over(run)).withColumn("_q", F.sum(F.coalesce(F.col("_x") * F.col("_x"), F.lit(0.0))).over(run))
    diff = lambda c: F.col(c) - F.coalesce(F.lag(c, k).over(asset_time()), F.lit(0))
    d = d.withColumn("_kn", diff("_n").cast("double")).withColumn("_ks", diff("_s")).withColumn("_kq", diff("_q"))
    enough = F.col("_kn") >= least
    var = F.greatest(F.col("_kq") - F.col("_ks") * F.col("_ks") / F.col("_kn"), F.lit(0.0))
    over = F.col("_kn") if pop else F.col("_kn") - 1
    d = d.withColumn(mean, F.when(enough, F.col("_c") + F.col("_ks") / F.col("_kn"))).withColumn(std, F.when(enough & (over > 0), F.sqrt(var / over)))
    return d.drop("_c", "_x", "_n", "_s", "_q", "_kn", "_ks", "_kq")


def dollar_volume() -> Column:
    return F.when(F.col("vol_quote") > 0, F.col("vol_quote")).otherwise(F.col("close") * F.col("volume"))


def liquidity(k: int, least: int) -> Column:
    """Log of mean dollar volume."""
    return log(rolling(F.avg, dollar_volume(), k, least))


def amihud(r: Column | str, k: int, least: int) -> Column:
    """Sum of absolute returns (a column, as windows don't nest) over the sum of dollar volume."""
    return div(rolling(F.sum, F.abs(col(r)), k, least), rolling(F.sum, dollar_volume(), k, least))


def corwin_schultz(df: DataFrame, window: int, name: str = "cs_spread") -> DataFrame:
    """High-low spread of two-day pairs, averaged over window - 1 pairs."""
    ok = (F.col("high") > 0) & (F.col("low") > 0) & (F.col("high") >= F.col("low"))
    d = df.withColumn("_h", F.when(ok, F.col("high"))).withColumn("_l", F.when(ok, F.col("low")))
    sq = F.pow(log(div("_h", "_l")), F.lit(2.0))
    d = d.withColumn("_sq", sq)
    ph, pl = lag("_h"), lag("_l")
    pair = ph.isNotNull() & F.col("_h").isNotNull()
    d = d.withColumn("_beta", lag("_sq") + F.col("_sq")).withColumn("_gamma", F.when(pair, F.pow(F.log(F.greatest("_h", ph) / F.least("_l", pl)), F.lit(2.0))))
    k = 3 - 2 * 2**0.5
    d = d.withColumn("_alpha", F.least((F.sqrt(2 * F.col("_beta")) - F.sqrt("_beta")) / k - F.sqrt(F.col("_gamma") / k), F.lit(50.0)))
    d = d.withColumn("_alpha", F.when(F.col("_beta").isNotNull() & F.col("_gamma").isNotNull(), F.col("_alpha")))
    d = d.withColumn("_s", clip(2 * (F.exp("_alpha") - 1) / (1 + F.exp("_alpha")), low=0))
    return d.withColumn(name, rolling(F.avg, "_s", window - 1)).drop("_h", "_l", "_sq", "_beta", "_gamma", "_alpha", "_s")


def abdi_ranaldo(df: DataFrame, window: int, name: str = "ar_spread") -> DataFrame:
    """Close-high-low spread, averaged over window - 1 pairs."""
    ok = (F.col("high") > 0) & (F.col("low") > 0) & (F.col("high") >= F.col("low")) & (F.col("close") > 0)
    d = df.withColumn("_m", F.when(ok, (F.log("high") + F.log("low")) / 2)).withColumn("_c", F.when(ok, F.log("close")))
    d = d.withColumn("_s", F.sqrt(clip(4 * (lag("_c") - lag("_m")) * (lag("_c") - F.col("_m")), low=0)))
    return d.withColumn(name, rolling(F.avg, "_s", window - 1)).drop("_m", "_c", "_s")


def turnover_ratio(volume: Column | str, cap: Column | str, most: float) -> Column:
    t = div(volume, F.when(col(cap) > 0, col(cap)))
    return F.when(t <= most, t)


def rolling_beta(df: DataFrame, r: str, market: str, k: int, least: int, name: str) -> DataFrame:
    """Covariance over variance of population moments, pairs complete."""
    ok = F.col(r).isNotNull() & F.col(market).isNotNull()
    d = df.withColumn("_x", F.when(ok, F.col(market))).withColumn("_y", F.when(ok, F.col(r)))
    m = lambda e: rolling(F.avg, e, k, least)
    cov = m(F.col("_x") * F.col("_y")) - m("_x") * m("_y")
    var = m(F.col("_x") * F.col("_x")) - m("_x") * m("_x")
    return d.withColumn(name, div(cov, F.when(var > 1e-15, var))).drop("_x", "_y")


def position(x: Column | str, k: int = 200, least: int = 50, bound: float = 1.0) -> Column:
    """Clipped z-score, 0 where there is none."""
    return F.coalesce(clip(zscore(x, k, least, pop=False), -bound, bound), F.lit(0.0))


def hold_to_update(x: Column | str, update: Column) -> Column:
    """The value at the last row where ``update`` held."""
    return F.last(F.when(update, col(x)), ignorenulls=True).over(asset_time().rowsBetween(Window.unboundedPreceding, 0))


def drawdown(df: DataFrame, pnl: str, order: str = "ts", part: list[str] | None = None, from_zero: bool = False) -> DataFrame:
    """Cumulative P&L, its running peak and the fall from it."""
    w = Window.partitionBy(*(part or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("cum_pnl", F.sum(pnl).over(w))
    peak = F.max("cum_pnl").over(w)
    d = d.withColumn("peak", F.greatest(peak, F.lit(0.0)) if from_zero else peak)
    return d.withColumn("drawdown", F.col("peak") - F.col("cum_pnl"))
