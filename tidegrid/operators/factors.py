"""The factor catalogue: 25 named cross-sectional factors over one panel, computed on demand.

Every factor is a chain of columns over the dense (asset, ts) grid. Asking for a
few computes only what these need: Catalyst prunes the other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import change, clip, div, lag, log, rolling
from . import crosssection as xs

# Name, family, direction.
CATALOGUE = {
    "momentum_24h": ("momentum", 1),
    "momentum_7d": ("momentum", 1),
    "short_reversal_24h": ("reversal", -1),
    "low_vol_7d": ("risk", -1),
    "liquidity_size": ("liquidity", 1),
    "liquidity_change_7d": ("liquidity", 1),
    "amihud_illiquidity_7d": ("liquidity", -1),
    "volume_shock_24h": ("liquidity", 1),
    "funding_carry": ("carry", -1),
    "funding_extreme_reversal": ("carry_reversal", -1),
    "trend_carry_aligned": ("composite", 1),
    "liquidity_neutral_momentum_7d": ("momentum", 1),
    "liquidity_neutral_funding_carry": ("carry", -1),
    "basis_carry": ("carry", -1),
    "funding_persistence": ("carry", -1),
    "basis_funding_dislocation": ("carry", -1),
    "liquidity_bucket_momentum": ("momentum", 1),
    "liquidity_bucket_reversal": ("reversal", -1),
    "vol_managed_funding_carry": ("carry", -1),
    "vol_managed_momentum": ("momentum", 1),
    "oi_change_7d": ("open_interest", 1),
    "oi_price_crowding_reversal": ("open_interest_crowding", -1),
    "oi_funding_crowding_reversal": ("open_interest_crowding", -1),
    "oi_price_crowding_reversal_v2": ("open_interest_crowding", -1),
    "oi_funding_crowding_reversal_v2": ("open_interest_crowding", -1),
}


def long_zscore(x: str, k: int, least: int) -> Column:
    """Z-score over k rows within five deviations."""
    return clip(div(F.col(x) - rolling(F.avg, x, k, least), rolling(F.stddev_samp, x, k, least)), -5, 5)


def compute(panel: DataFrame, names: list[str] | None = None, day: int = 24, least: int = 5) -> DataFrame:
    """``asset, ts`` and the named factors (default: all), before direction.

    ``panel``: asset, ts, close, volume, vol_quote, ``spot`` (the other leg's
    price), ``funding`` (the rate known at the row), ``open_interest`` (lagged by
    its source already) and ``eligible``. ``day`` is the rows of a day. Two
    factors are compared within ``eligible`` assets only; fewer than ``least``
    of them give none.
    """
    wanted = list(CATALOGUE) if names is None else names
    unknown = set(wanted) - set(CATALOGUE)
    if unknown:
        raise KeyError(f"no such factors: {sorted(unknown)}")
    week, quarter = 7 * day, 90 * day
    d = panel.withColumns({"_r": change("close"), "_dv": F.when(F.col("vol_quote") > 0, F.col("vol_quote")).otherwise(F.col("close") * F.col("volume")), "_m1": change("close", day), "_m7": change("close", week), "_basis": div("close", "spot") - 1, "_oi0": clip(change("open_interest", week), -1, 3)})
    d = d.withColumns({"_vol": rolling(F.stddev_samp, "_r", week, 3 * day), "_size": log(rolling(F.avg, "_dv", week, 3 * day)), "_fz": long_zscore("funding", quarter, 30 * day), "_bz": long_zscore("_basis", quarter, 30 * day), "_oi": lag("_oi0", day)})
    d = d.withColumns({"_f1": lag("funding"), "_fz1": lag("_fz"), "_gap": F.col("_bz") - F.col("_fz"), "_fv": div("funding", "_vol"), "_fm": rolling(F.avg, "funding", 14 * day, 5 * day), "_up": clip("_oi", low=0)})
    masked = lambda c: F.when(F.col("eligible"), F.col(c))
    d = d.withColumns({"_e_size": masked("_size"), "_e_m7": masked("_m7"), "_e_m1": masked("_m1"), "_e_f1": F.when(lag("eligible"), F.col("_f1"))})
    if "liquidity_neutral_momentum_7d" in wanted:
        d = xs.residual(d, "_e_m7", "_e_size", least, "liquidity_neutral_momentum_7d")
    if "liquidity_neutral_funding_carry" in wanted:
        d = xs.residual(d, "_e_f1", "_e_size", least, "liquidity_neutral_funding_carry")
    if "liquidity_bucket_momentum" in wanted:
        d = xs.bucket_neutral(d, "_e_m7", "_e_size", least, "liquidity_bucket_momentum")
    if "liquidity_bucket_reversal" in wanted:
        d = xs.bucket_neutral(d, "_e_m1", "_e_size", least, "liquidity_bucket_reversal")
    made = {
        "momentum_24h": F.col("_m1"), "momentum_7d": F.col("_m7"), "short_reversal_24h": F.col("_m1"), "low_vol_7d": F.col("_vol"), "liquidity_size": F.col("_size"), "liquidity_change_7d": F.col("_size") - lag("_size", week),
        "amihud_illiquidity_7d": div(rolling(lambda x: F.sum(F.abs(x)), "_r", week, 3 * day), rolling(F.sum, "_dv", week, 3 * day)),
        "volume_shock_24h": div(rolling(F.sum, "volume", day, max(day // 2, 1)), rolling(F.avg, "volume", 14 * day, 7 * day)),
        "funding_carry": F.col("_f1"), "funding_extreme_reversal": F.col("_fz1"), "trend_carry_aligned": F.col("_m7") - clip("_fz1", low=0), "basis_carry": lag("_basis"), "funding_persistence": lag("_fm"), "basis_funding_dislocation": lag("_gap"),
        "vol_managed_funding_carry": lag("_fv"), "vol_managed_momentum": div("_m7", "_vol"), "oi_change_7d": F.col("_oi"),
        **{f"oi_price_crowding_reversal{v}": F.col("_m7") * F.col("_up") for v in ("", "_v2")}, **{f"oi_funding_crowding_reversal{v}": F.col("_fz1") * F.col("_up") for v in ("", "_v2")},
    }
    return d.select("asset", "ts", *[(made[n] if n in made else F.col(n)).alias(n) for n in wanted])
