"""Operators whose state goes from row to row: one pandas pass for each asset.

An asset's rows are sorted by time within its group; a group is one asset's
series, never the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ewm(x: np.ndarray, alpha: float, least: int = 0) -> np.ndarray:
    """Exponential mean; over gaps the old weight decays on. Missing before ``least`` values."""
    return pd.Series(x, dtype=float).ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy()


def ema(x: np.ndarray, span: int, least: int = 0) -> np.ndarray:
    return ewm(x, 2 / (span + 1), least)


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate([[np.nan], close[:-1]])
    return np.fmax(np.fmax(high - low, np.abs(high - before)), np.abs(low - before))


def rsi(close: np.ndarray, span: int, alpha: float | None = None, least: int = 0) -> np.ndarray:
    step = np.concatenate([[np.nan], np.diff(close)])
    a = 2 / (span + 1) if alpha is None else alpha
    with np.errstate(invalid="ignore", divide="ignore"):
        gain, loss = ewm(np.where(step > 0, step, np.where(step == step, 0.0, np.nan)), a, least), ewm(np.where(step < 0, -step, np.where(step == step, 0.0, np.nan)), a, least)
        return np.where(loss == 0, np.nan, 100 - 100 / (1 + gain / loss))


def regime(high: np.ndarray, low: np.ndarray, close: np.ndarray, span: int = 14, limit: float = 25.0) -> dict[str, np.ndarray]:
    """Average true range and its ratio to its own mean, directional index, and whether both show a trend.

    A missing directional index counts as 0; the mean is over 50 rows, 20 at least.
    """
    up, down = np.concatenate([[np.nan], np.diff(high)]), -np.concatenate([[np.nan], np.diff(low)])
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr = ema(true_range(high, low, close), span)
    with np.errstate(invalid="ignore", divide="ignore"):
        p, m = 100 * ema(plus, span) / tr, 100 * ema(minus, span) / tr
        dx = np.where(p + m == 0, np.nan, 100 * np.abs(p - m) / (p + m))
    adx = ema(dx, span)
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = tr / pd.Series(tr).rolling(50, min_periods=20).mean().to_numpy()
        trend = (np.nan_to_num(adx) > limit) & (ratio > 1)
    return {"atr": tr, "atr_ratio": ratio, "plus_di": p, "minus_di": m, "adx": adx, "trend": trend.astype(float)}


def squeeze(high, low, close, bn: int, bk: float, kn: int, kk: float) -> np.ndarray:
    roll = pd.Series(close).rolling(bn)
    mid, half = roll.mean().to_numpy(), bk * roll.std(ddof=0).to_numpy()
    centre, width = ema(close, kn), kk * ema(true_range(high, low, close), kn)
    with np.errstate(invalid="ignore"):
        return ((mid + half < centre + width) & (mid - half > centre - width)).astype(float)


KERNELS: dict[str, Callable[..., np.ndarray]] = {
    "ema": ema,
    "rsi": rsi,
    "atr": lambda h, l, c, n: ema(true_range(h, l, c), n),  # noqa: E741
    "squeeze": squeeze,
}


def by_asset(df: DataFrame, outputs: list[str], work: Callable[[pd.DataFrame], dict[str, np.ndarray]], inputs: list[str] | None = None, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Adds double columns that ``work`` computes from an asset's sorted rows.

    Only the ``inputs`` that ``work`` reads go through Python together with the
    key, when they are given; the rest joins back by (key, ts).
    """
    carried = [*keys, "ts", *inputs] if inputs is not None else df.columns
    part = df.select(*carried)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields if inputs is None or f.name in (*keys, "ts")] + [f"{c} double" for c in outputs])
    kept = carried if inputs is None else [*keys, "ts"]

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        made = work(pdf)
        return pd.concat([pdf[kept].reset_index(drop=True), pd.DataFrame({c: made[c] for c in outputs})], axis=1)

    out = part.groupBy(*keys).applyInPandas(group, schema)
    out = out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in outputs})
    return out if inputs is None else df.join(out, [*keys, "ts"], "left")


def apply(df: DataFrame, name: str, args: list, made: str) -> DataFrame:
    """One expression-language operator; series arguments are columns, the rest numbers."""
    series = {f"_arg{i}": a for i, a in enumerate(args) if isinstance(a, Column)}
    kernel = KERNELS[name]
    plain = [None if isinstance(a, Column) else a for a in args]
    named = list(series)  # the worker gets names, not columns

    def work(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        return {made: kernel(*[pdf[f"_arg{i}"].to_numpy(dtype=float) if f"_arg{i}" in named else a for i, a in enumerate(plain)])}

    return by_asset(df.withColumns(series), [made], work).drop(*named)


def hysteresis(df: DataFrame, rank: str, enter: int, hold: int) -> DataFrame:
    """Membership by time: kept while ranked within ``hold``, entered within ``enter``.

    The state is a set of assets, so the times of one grouping (column
    ``book``) are folded in order. Only rows ranked within ``hold`` can be
    members, so only those, ``hold`` a time at most but for ties, are folded;
    all others join the result.
    """
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, members = [], set()
        for t, part in pdf.sort_values(["ts", "asset"], kind="stable").groupby("ts", sort=True):
            r = dict(zip(part["asset"], part[rank], strict=True))
            members = {a for a in members if r.get(a, np.inf) <= hold} | {a for a, v in r.items() if v <= enter}
            rows += [(part["book"].iloc[0], t, a) for a in part["asset"] if a in members]
        return pd.DataFrame(rows, columns=["book", "ts", "asset"])

    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    near = df.where(F.col(rank) <= max(enter, hold)).select("book", "ts", "asset", rank)
    members = near.groupBy("book").applyInPandas(group, f"book {kind['book']}, ts {kind['ts']}, asset {kind['asset']}").withColumn("member", F.lit(True))
    return df.select("book", "ts", "asset").join(members, ["book", "ts", "asset"], "left").withColumn("member", F.coalesce("member", F.lit(False)))
