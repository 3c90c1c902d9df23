"""Null-safe arithmetic for ANSI mode: missing is always NULL, never NaN or infinity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """NULL for NaN and infinities."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def div(a: Column | str, b: Column | str) -> Column:
    """a / b in doubles; NULL if b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bounded value; NULL stays NULL (``greatest`` alone would skip it)."""
    out = x = col(x)
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def log(x: Column | str) -> Column:
    x = col(x)
    return F.when(x > 0, F.log(x))


def asset_time(asset: str = "asset", ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(asset).orderBy(ts)


def trailing(k: int, base: WindowSpec | None = None) -> WindowSpec:
    """The current row and the k - 1 before it."""
    if k < 1:
        raise ValueError("a window has one row at least")
    return (base or asset_time()).rowsBetween(-(k - 1), 0)


def rolling(agg: Callable[[Column], Column], x: Column | str, k: int, least: int | None = None, base: WindowSpec | None = None) -> Column:
    """An aggregate over k rows, NULL with fewer than ``least`` (default k) values among them."""
    x, w = col(x), trailing(k, base)
    return F.when(F.count(x).over(w) >= (k if least is None else least), agg(x).over(w))


def lag(x: Column | str, n: int = 1, base: WindowSpec | None = None) -> Column:
    w = base or asset_time()
    return F.lag(col(x), n).over(w) if n >= 0 else F.lead(col(x), -n).over(w)


def change(x: Column | str, n: int = 1, base: WindowSpec | None = None) -> Column:
    """x / x[-n] - 1 without filling gaps."""
    x = col(x)
    return div(x, lag(x, n, base)) - 1


def forward(x: Column | str, n: int, base: WindowSpec | None = None) -> Column:
    """x[+n] / x - 1."""
    x = col(x)
    return div(lag(x, -n, base), x) - 1


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson from moments; NULL if a side is constant."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 1e-12 * F.abs(n * sxx)) & (vy > 1e-12 * F.abs(n * syy)), (n * sxy - sx * sy) / F.sqrt(vx) / F.sqrt(vy))


def pair_moments(x: Column, y: Column) -> list[Column]:
    """n, Σx, Σy, Σxx, Σyy, Σxy over complete pairs, as aggregates to be named or windowed."""
    ok = x.isNotNull() & y.isNotNull()
    x, y = F.when(ok, x.cast("double")), F.when(ok, y.cast("double"))
    return [F.count(x).cast("double"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)]


def sample_skew(n: Column, skew: Column) -> Column:
    """Bias-corrected from population skewness."""
    return F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(n: Column, kurt: Column) -> Column:
    """Bias-corrected excess kurtosis from the population one."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6))
