"""Statistical evidence: autocorrelation-robust means and regressions, multiplicity, overfitting.

Sums over rows are Spark aggregates; only k x k systems, normal quantiles and
other figures whose size is fixed by the method are worked out on the driver
or in vectorised functions.
"""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.numeric import div, sample_kurtosis, sample_skew

EULER = 0.5772156649015329


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or v != v else 0.5 * math.erfc(-v / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return p.map(lambda v: NormalDist().inv_cdf(v) if v is not None and 0 < v < 1 else None)


def two_sided_p(t: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(t)))


def mean_t(x: Column | str) -> Column:
    """t of a mean from three values on; NULL for a constant."""
    x = F.col(x) if isinstance(x, str) else x
    s = F.stddev_samp(x)
    return F.when((F.count(x) >= 3) & (s > 1e-15), F.avg(x) / (s / F.sqrt(F.count(x))))


def newey_west(df: DataFrame, x: str, max_lag: int, keys: list[str], order: str = "ts") -> DataFrame:
    """Bartlett-weighted t of the mean by key: lagged products from one window, one aggregation."""
    d = df.where(F.col(x).isNotNull())
    d = d.withColumn("_e", F.col(x) - F.avg(x).over(Window.partitionBy(*keys)))
    w = Window.partitionBy(*keys).orderBy(order)
    sums = [F.sum(F.col("_e") * F.col(f"_e{k}")).alias(f"_s{k}") for k in range(1, max_lag + 1)]
    d = d.select("*", *[F.lag("_e", k).over(w).alias(f"_e{k}") for k in range(1, max_lag + 1)])
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.sum(F.col("_e") * F.col("_e")).alias("_s0"), *sums)
    lags = F.least(F.lit(max_lag), F.col("n") - 2)
    lrv = F.col("_s0") / F.col("n")
    for k in range(1, max_lag + 1):
        lrv = lrv + F.when(lags >= k, 2 * (1 - F.lit(float(k)) / (lags + 1)) * F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) / F.col("n")).otherwise(0.0)
    se = F.sqrt(F.greatest(lrv, F.lit(0.0)) / F.col("n"))
    ok = F.col("n") >= max(8, max_lag + 3)
    return g.select(*keys, "n", "mean", F.when(ok, se).alias("se"), F.when(ok & (se > 1e-15), F.col("mean") / se).alias("t"))


def block_t(df: DataFrame, x: str, block: int, keys: list[str], order: str = "ts") -> DataFrame:
    """t of the mean of whole consecutive blocks; the rest of the rows is left out."""
    d = df.where(F.col(x).isNotNull()).withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    b = d.groupBy(*keys, F.floor(F.col("_rn") / block).alias("_b")).agg(F.avg(x).alias("_m"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") == block)
    return b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks"), F.avg("_m").alias("mean"), mean_t("_m").alias("t"))


def false_discovery(df: DataFrame, p: str, q: float, name: str, dependent: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Benjamini-Hochberg adjusted p values, or Benjamini-Yekutieli if ``dependent``; ties by ``id``."""
    part = keys or (F.lit(0),)
    up = Window.partitionBy(*part).orderBy(p, "id")
    whole = Window.partitionBy(*part)
    d = df.withColumn("_j", F.row_number().over(up)).withColumn("_m", F.count(F.lit(1)).over(whole))
    c = F.sum(1 / F.col("_j")).over(whole) if dependent else F.lit(1.0)
    d = d.withColumn("_a", F.col(p) * F.col("_m") * c / F.col("_j"))
    adj = F.least(F.lit(1.0), F.min("_a").over(up.rowsBetween(0, Window.unboundedFollowing)))
    return d.withColumn(name, adj).withColumn("passed", F.col(name) <= q).drop("_j", "_m", "_a")


def sidak(p: Column, n: Column | int) -> Column:
    return 1 - F.pow(1 - p, F.lit(n) if isinstance(n, int) else n)


def expected_maximum_sharpe(spread: float, trials: int) -> float:
    """Of the best of ``trials`` independent Sharpe ratios with deviation ``spread``."""
    if trials < 2 or spread <= 0:
        return 0.0
    q = NormalDist().inv_cdf
    return spread * ((1 - EULER) * q(1 - 1 / trials) + EULER * q(1 - 1 / (trials * math.e)))


def deflated_sharpe(paths: DataFrame, x: str = "r", trials: int | None = None) -> DataFrame:
    """Sharpe of each path less what the best of all trials reaches by luck, as a p value.

    Needs 30 rows a path and two trials. The trials' spread is an aggregate;
    one number comes to the driver.
    """
    d = paths.where(F.col(x).isNotNull()).groupBy("path").agg(
        F.count(x).cast("double").alias("n"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"), F.skewness(x).alias("_g"), F.kurtosis(x).alias("_k"))
    d = d.withColumn("sharpe", div("_m", F.when(F.col("_s") > 1e-15, F.col("_s"))))
    spread, count = d.agg(F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)), F.count("sharpe")).first()
    bar = expected_maximum_sharpe(spread, trials or count)
    skew, kurt = sample_skew(F.col("n"), F.col("_g")), sample_kurtosis(F.col("n"), F.col("_k")) + 3
    var = 1 - skew * F.col("sharpe") + (kurt - 1) / 4 * F.col("sharpe") * F.col("sharpe")
    z = F.when((F.col("n") >= 30) & (var > 0) & F.lit((trials or count) >= 2), (F.col("sharpe") - bar) * F.sqrt(F.col("n") - 1) / F.sqrt(var))
    return d.select("path", F.col("n").cast("long").alias("n"), "sharpe", F.lit(bar).alias("expected_max"), z.alias("z")).withColumn("p", 1 - normal_cdf("z")).withColumn("passed", F.coalesce(F.col("p") < 0.05, F.lit(False)))


def cscv_pbo(paths: DataFrame, segments: int = 10, x: str = "r") -> DataFrame:
    """Probability of backtest overfitting by combinatorial symmetric cross-validation.

    ``paths`` (path, ts, r) fall into near-equal consecutive segments; each
    path and segment keeps n, sum and sum of squares. Every choice of half the
    segments trains: its best path's rank in the other half decides. The
    choices are C(S, S/2), fixed by the method, and only sums are combined.
    """
    spark = paths.sparkSession
    seg = paths.select("ts").distinct().select("ts", (F.ntile(segments).over(Window.partitionBy(F.lit(0)).orderBy("ts")) - 1).alias("seg"))
    s = paths.join(seg, "ts").groupBy("path", "seg").agg(F.count(x).cast("double").alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    rows = [(i, j, j in c) for i, c in enumerate(combinations(range(segments), segments // 2)) for j in range(segments)]
    choice = spark.createDataFrame(rows, "choice int, seg int, train boolean")
    t = s.join(F.broadcast(choice), "seg").groupBy("choice", "path", "train").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    t = t.withColumn("sr", F.coalesce(F.when(var > 1e-18, F.col("s") / F.col("n") / F.sqrt(var)), F.lit(float("-inf"))))
    both = t.groupBy("choice", "path").agg(F.max(F.when(F.col("train"), F.col("sr"))).alias("a"), F.max(F.when(~F.col("train"), F.col("sr"))).alias("b"))
    w = Window.partitionBy("choice")
    rank = F.rank().over(w.orderBy("b")) + (F.count(F.lit(1)).over(Window.partitionBy("choice", "b")) - 1) / 2
    both = both.withColumn("omega", rank / (F.count(F.lit(1)).over(w) + 1)).withColumn("_first", F.row_number().over(w.orderBy(F.desc("a"), "path")))
    best = both.where("_first = 1")
    return best.select("choice", "path", "omega", F.log(F.col("omega") / (1 - F.col("omega"))).alias("logit"))


def ols_hac(df: DataFrame, y: str, xs: list[str], max_lag: int, order: str = "ts") -> list[dict]:
    """Regression with a Bartlett HAC sandwich and the n / (n - k) factor.

    X'X, X'y and the lagged score products are two aggregations; the k x k
    algebra is the driver's.
    """
    cols = ["_one", *xs]
    d = df.select(order, y, *xs).na.drop().withColumn("_one", F.lit(1.0))
    k = len(cols)
    first = d.agg(F.count(F.lit(1)), *[F.sum(F.col(a) * F.col(b)) for a in cols for b in cols], *[F.sum(F.col(a) * F.col(y)) for a in cols], F.sum(F.col(y) * F.col(y)), F.sum(y)).first()
    n = first[0]
    if n <= k + 2:
        return []
    xtx, xty = np.array(first[1 : 1 + k * k], dtype=float).reshape(k, k), np.array(first[1 + k * k : 1 + k * k + k], dtype=float)
    if np.linalg.matrix_rank(xtx) < k:
        return []
    inverse = np.linalg.inv(xtx)
    beta = inverse @ xty
    u = F.col(y) - sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, cols, strict=True)), F.lit(0.0))
    d = d.select(order, *[(u * F.col(c)).alias(f"_g{i}") for i, c in enumerate(cols)])
    lags = min(max_lag, n - 1)
    w = Window.partitionBy(F.lit(0)).orderBy(order)  # one regression's rows in time order
    d = d.select("*", *[F.lag(f"_g{i}", m).over(w).alias(f"_g{i}_{m}") for m in range(1, lags + 1) for i in range(k)])
    sums = d.agg(*[F.sum(F.col(f"_g{i}") * F.col(f"_g{j}" if m == 0 else f"_g{j}_{m}")) for m in range(lags + 1) for i in range(k) for j in range(k)]).first()
    gamma = np.array([v or 0.0 for v in sums]).reshape(lags + 1, k, k)
    middle = gamma[0] + sum((1 - m / (lags + 1)) * (gamma[m] + gamma[m].T) for m in range(1, lags + 1))
    cov = inverse @ middle @ inverse * n / (n - k)
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    return [{"term": "intercept" if c == "_one" else c, "beta": float(b), "se": float(s), "t": float(b / s) if s > 0 else None, "n": int(n)} for c, b, s in zip(cols, beta, se, strict=True)]


def slopes(df: DataFrame, y: str, x: str, least: int, keys: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The slope of y on x in each cross-section, from moments."""
    d = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    n = F.count(F.lit(1)).cast("double")
    sxy, sxx = F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y) / n, F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.sum(x) / n
    return d.groupBy(*keys).agg(F.when((n >= least) & (sxx > 1e-12), sxy / sxx).alias("slope"))


def seeded_draws(spark: SparkSession, seeds: int, schema: str, draw) -> DataFrame:
    """One independent simulation a seed, in parallel: ``draw(seed) -> dict`` of plain values."""
    def work(batches):
        for pdf in batches:
            yield pd.DataFrame([draw(int(s)) for s in pdf["id"]])

    return spark.range(seeds, numPartitions=min(seeds, 64)).mapInPandas(work, schema)


def ar1(rng: np.random.Generator, n: int, rho: float, sigma: float) -> np.ndarray:
    shocks = rng.normal(0, sigma * math.sqrt(1 - rho * rho), n)
    out = np.empty(n)
    out[0] = rng.normal(0, sigma)
    for i in range(1, n):
        out[i] = rho * out[i - 1] + shocks[i]
    return out


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, c = k / n, F.lit(z * z) / n
    mid, half = (p + c / 2) / (1 + c), F.sqrt(p * (1 - p) / n + c / (4 * n)) * z / (1 + c)
    return mid - half, mid + half
