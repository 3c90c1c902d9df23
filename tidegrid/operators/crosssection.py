"""Operators across assets at one time, as columns over windows by time.

Ties are always broken by the asset, so results do not depend on row order.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numeric import col, correlation, div, pair_moments

def at() -> WindowSpec:
    """All assets at one time."""
    return Window.partitionBy("ts")


def average_rank(x: Column | str, part: list[str] | None = None) -> Column:
    """Rank among the values present, ties averaged; NULL for NULL."""
    x = col(x)
    keys = part or ["ts"]
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(x.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), rank + (ties - 1) / 2)


def pct_rank(x: Column | str, part: list[str] | None = None) -> Column:
    return average_rank(x, part) / F.count(col(x)).over(Window.partitionBy(*(part or ["ts"])))


def rank_ic(df: DataFrame, x: str, y: str, least: int, pairs_first: bool, keys: list[str] | None = None) -> DataFrame:
    """Spearman by time. Ranks are taken over each side's own values, or over complete pairs only."""
    keys = keys or ["ts"]
    if pairs_first:
        df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = df.select(*keys, average_rank(x, keys).alias("_rx"), average_rank(y, keys).alias("_ry"))
    n, sx, sy, sxx, syy, sxy = (f"_m{i}" for i in range(6))
    m = ranked.groupBy(*keys).agg(*[c.alias(a) for c, a in zip(pair_moments(F.col("_rx"), F.col("_ry")), (n, sx, sy, sxx, syy, sxy), strict=True)])
    ic = F.when(F.col(n) >= least, correlation(*[F.col(c) for c in (n, sx, sy, sxx, syy, sxy)]))
    return m.select(*keys, ic.alias("ic"), F.col(n).cast("long").alias("n_pairs"))


def residual(df: DataFrame, y: str, x: str, least: int, name: str) -> DataFrame:
    """Residual of y on x at each time over complete pairs; the demeaned y if x is constant."""
    ok = F.col(y).isNotNull() & F.col(x).isNotNull()
    d = df.withColumn("_y", F.when(ok, F.col(y))).withColumn("_x", F.when(ok, F.col(x)))
    d = d.withColumn("_dy", F.col("_y") - F.avg("_y").over(at())).withColumn("_dx", F.col("_x") - F.avg("_x").over(at()))
    sxx = F.sum(F.col("_dx") * F.col("_dx")).over(at())
    beta = F.coalesce(F.when(sxx > 1e-12, F.sum(F.col("_dx") * F.col("_dy")).over(at()) / sxx), F.lit(0.0))
    return d.withColumn(name, F.when(F.count("_y").over(at()) >= least, F.col("_dy") - beta * F.col("_dx"))).drop("_y", "_x", "_dy", "_dx")


def quantile_bucket(df: DataFrame, x: str, buckets: int, least: int, name: str) -> DataFrame:
    """Equal-rank buckets from 0, by (value, asset); NULL where fewer than ``least`` have a value."""
    n = F.count(x).over(at())
    rn = F.row_number().over(at().orderBy(F.col(x).asc_nulls_last(), "asset"))
    bucket = F.least(F.lit(buckets - 1), F.floor((rn - 1) * F.lit(buckets) / F.greatest(n - 1, F.lit(1))))
    return df.withColumn(name, F.when(F.col(x).isNotNull() & (n >= least), bucket).cast("int"))


def bucket_neutral(df: DataFrame, x: str, size: str, least: int, name: str, buckets: int = 3) -> DataFrame:
    """x less its bucket's mean; a bucket of one has none."""
    ok = F.col(x).isNotNull() & F.col(size).isNotNull()
    d = quantile_bucket(df.withColumn("_s", F.when(ok, F.col(size))), "_s", buckets, least, "_b").withColumn("_v", F.when(F.col("_b").isNotNull(), F.col(x)))
    w = Window.partitionBy("ts", "_b")
    return d.withColumn(name, F.when(F.count("_v").over(w) > 1, F.col("_v") - F.avg("_v").over(w))).drop("_s", "_b", "_v")


def family_neutral(df: DataFrame, x: str, family: str, name: str, least: int = 2) -> DataFrame:
    """x less its family's mean, in families of at least ``least`` assets of the panel."""
    sizes = df.select("asset", family).distinct().groupBy(family).agg(F.count(F.lit(1)).alias("_size"))
    d = df.join(sizes, family)
    w = Window.partitionBy("ts", family)
    return d.withColumn(name, F.when(F.col("_size") >= least, F.col(x) - F.avg(x).over(w))).drop("_size")


def standardize(x: Column | str) -> Column:
    x = col(x)
    s = F.stddev_samp(x).over(at())
    return div(x - F.avg(x).over(at()), F.when(s > 1e-12, s))


def top_n(value: Column | str, base: Column, n: int, largest: bool = True) -> Column:
    """Whether the row is among the n first by value within ``base``."""
    v = F.when(base, col(value))
    order = v.desc_nulls_last() if largest else v.asc_nulls_last()
    return F.coalesce(v.isNotNull() & (F.row_number().over(at().orderBy(order, "asset")) <= n), F.lit(False))


def at_least_median(x: Column | str, base: Column) -> Column:
    v = F.when(base, col(x))
    return F.coalesce(v >= F.percentile(v, F.lit(0.5)).over(at()), F.lit(False))


def residualize(df: DataFrame, y: str, controls: list[str], least: int, name: str) -> DataFrame:
    """Residual of y on standardised controls at each time, by pseudo-inverse.

    Needs max(least, k + 5) complete rows and controls that vary. A group is
    one time's cross-section.
    """
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["asset", "ts"]].copy()
        out[name] = np.nan
        ok = pdf[[y, *controls]].notna().all(axis=1).to_numpy()
        if ok.sum() >= max(least, len(controls) + 5):
            x = pdf.loc[ok, controls].to_numpy(dtype=float)
            s = x.std(axis=0, ddof=1)
            if (s > 1e-12).all():
                design = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / s])
                v = pdf.loc[ok, y].to_numpy(dtype=float)
                out.loc[ok, name] = v - design @ (np.linalg.pinv(design) @ v)
        return out

    res = df.select("asset", "ts", y, *controls).groupBy("ts").applyInPandas(group, f"asset {kind['asset']}, ts {kind['ts']}, {name} double")
    return df.join(res.withColumn(name, F.when(~F.isnan(name), F.col(name))), ["asset", "ts"], "left")


def apply_controls(df: DataFrame, signal: str, spec: dict, name: str) -> DataFrame:
    """A candidate's controls in order: mask, neutralisation, bucket policy, direction.

    ``spec``: eligible and size columns, ``neutralization`` (none, residual,
    bucket, family), ``bucket_policy`` (all, large_liquid with ``top``),
    ``direction`` (long or short) and ``least`` assets.
    """
    least = spec.get("least", 5)
    base = F.coalesce(F.col(spec["eligible"]), F.lit(False)) if spec.get("eligible") else F.lit(True)
    d = df.withColumn("_m", F.when(base, F.col(signal)))
    how = spec.get("neutralization", "none")
    if how == "residual":
        d = residual(d, "_m", spec["size"], least, "_m2")
    elif how == "bucket":
        d = bucket_neutral(d, "_m", spec["size"], least, "_m2")
    elif how == "family":
        d = family_neutral(d, "_m", "family", "_m2")
    elif how == "none":
        d = d.withColumn("_m2", F.col("_m"))
    else:
        raise ValueError(f"no neutralization {how}")
    if spec.get("bucket_policy", "all") == "large_liquid":
        d = d.withColumn("_m2", F.when(top_n(spec["size"], F.col("_m2").isNotNull(), spec["top"]), F.col("_m2")))
    sign = -1.0 if spec.get("direction", "long") == "short" else 1.0
    return d.withColumn(name, F.lit(sign) * F.col("_m2")).drop("_m", "_m2")


