"""Portfolios of pairs: long one leg of an asset, short its twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .crosssection import at
from .portfolio import SLIPPAGE_BP, TAKER_BP, turnover
from .recursive import hysteresis


def _places(df: DataFrame, signal: str) -> DataFrame:
    place = F.row_number().over(at().orderBy(F.col(signal).desc_nulls_last(), "asset"))
    return df.withColumn("_k", F.when(F.col(signal).isNotNull(), place)).withColumn("_n", F.count(signal).over(at()))


def top_weights(formations: DataFrame, signal: str, n: int, gross: float, name: str) -> DataFrame:
    """Half of ``gross`` in equal parts on the ``n`` highest signals of each formation; the other leg holds the other half."""
    d = _places(formations, signal).withColumn("_in", F.coalesce(F.col("_k") <= n, F.lit(False)))
    return d.withColumn(name, F.when(F.col("_in"), gross / 2 / F.count_if("_in").over(at())).otherwise(0.0)).drop("_k", "_n", "_in")


def hysteresis_weights(formations: DataFrame, signal: str, enter: float, hold: float, least: int, gross: float, name: str) -> DataFrame:
    """As ``top_weights``, on assets that entered the highest share ``enter`` and stayed within ``hold``.

    A formation with fewer than ``least`` signals holds nothing and forgets the
    members, so it opens a new book: books are folded apart from each other.
    """
    d = _places(formations, signal)
    inner = F.greatest(F.lit(1), F.ceil(F.col("_n") * enter))
    outer = F.greatest(inner, F.ceil(F.col("_n") * hold))
    d = d.withColumn("_rank", F.when(F.col("_n") < least, 3.0).when(F.col("_k") <= inner, 1.0).when(F.col("_k") <= outer, 2.0).otherwise(3.0))
    times = d.groupBy("ts").agg((F.max("_n") < least).cast("long").alias("_short"))  # one row a formation
    books = times.select("ts", F.sum("_short").over(Window.partitionBy(F.lit(0)).orderBy("ts")).alias("book"))
    members = hysteresis(d.join(books, "ts"), "_rank", 1, 2).where("member").select("asset", "ts", "member")
    d = d.join(members, ["asset", "ts"], "left").withColumn("member", F.coalesce("member", F.lit(False)))
    return d.withColumn(name, F.when(F.col("member"), gross / 2 / F.count_if("member").over(at())).otherwise(0.0)).drop("_k", "_n", "_rank", "member")


def pair_pnl(df: DataFrame, weight: str, spot: str, perp: str, funding: str, part: tuple[str, ...] = (), cost_bp: float = TAKER_BP + SLIPPAGE_BP) -> DataFrame:
    """P&L by time of spot held against the same weight short in the twin; both legs pay for turnover.

    ``carry`` is what the short leg pays, so below 0 when it receives funding. A held pair without one of its returns counts as missing and gains nothing on that leg.
    """
    w, zero = F.col(weight), lambda c: F.coalesce(F.col(c), F.lit(0.0))
    lost = (F.abs(w) > 1e-12) & (F.col(spot).isNull() | F.col(perp).isNull())
    out = df.withColumn("_t", 2 * turnover(weight, part)).groupBy(*part, "ts").agg(
        F.sum(w * (zero(spot) - zero(perp))).alias("gross"), F.sum(-w * zero(funding)).alias("carry"), F.sum("_t").alias("turnover"), (2 * F.sum(F.abs(w))).alias("exposure"), F.count_if(w != 0).alias("held"), F.count_if(lost).alias("missing"))
    return out.withColumn("cost", F.col("turnover") * cost_bp / 1e4).withColumn("net", F.col("gross") - F.col("carry") - F.col("cost"))


def windows_of(times: DataFrame, days: int) -> DataFrame:
    """``(ts, window)``: consecutive windows of so many days from the first time."""
    t = times.select("ts").distinct()
    seconds: Column = F.unix_seconds(F.col("ts").cast("timestamp"))
    return t.select("ts", F.floor((seconds - F.min(seconds).over(Window.partitionBy(F.lit(0)))) / (86400 * days)).alias("window"))


def source_period_splits(times: DataFrame, source_end: str, share: float) -> DataFrame:
    """``(ts, split)``: all times after ``source_end`` are holdout; of those before, is ends with the time that closes ``share`` of those on a month's last day.

    Fewer than three such times give no split: NULL.
    """
    t = times.select("ts").distinct()
    chosen = t.where(F.col("ts") <= F.lit(source_end).cast("timestamp_ntz"))
    ends = chosen.where(F.to_date("ts") == F.last_day("ts")).withColumnRenamed("ts", "_e")
    everything = Window.partitionBy(F.lit(0))
    ends = ends.withColumn("_i", F.row_number().over(everything.orderBy("_e"))).withColumn("_n", F.count(F.lit(1)).over(everything))
    at_ = F.least(F.greatest(F.floor(F.col("_n") * share), F.lit(1)), F.col("_n") - 1)
    bound = ends.where((F.col("_n") >= 3) & (F.col("_i") == at_)).select(F.col("_e").alias("ts"), F.lit(True).alias("_b"))
    d = t.join(bound, "ts", "left").withColumn("_b", F.max(F.when(F.col("_b"), F.col("ts"))).over(everything))
    return d.select("ts", F.when(F.col("_b").isNull(), None).when(F.col("ts") > F.lit(source_end).cast("timestamp_ntz"), "holdout").when(F.col("ts") <= F.col("_b"), "is").otherwise("val").alias("split"))
