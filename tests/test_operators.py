import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.numeric import change
from tidegrid.operators import audit, grid, inference, portfolio, recursive, upsert
from tidegrid.operators import crosssection as xs
from tidegrid.operators import timeseries as ts

T0 = dt.datetime(2024, 1, 1)


def panel(spark, data, step=dt.timedelta(days=1)):
    rows = [(a, T0 + i * step, None if v is None else float(v)) for a, vs in data.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "asset string, ts timestamp, close double")


def values(df, col, *order):
    return [r[col] for r in df.orderBy(*order).collect()]


def test_no_padding_in_changes(spark):
    p = panel(spark, {"a": [1, None, 2, 4], "b": [0, 1, 1, 1]})
    assert values(p.withColumn("r", change("close")), "r", "asset", "ts") == [None, None, None, 1.0, None, None, 0.0, 0.0]


def test_fill_limit(spark):
    p = panel(spark, {"a": [1, None, None, None, 5]})
    assert values(p.withColumn("f", grid.fill_forward("close", 2)), "f", "ts") == [1.0, 1.0, 1.0, None, 5.0]


def test_splits_by_count(spark):
    p = panel(spark, {"a": range(10)})
    assert values(grid.splits(p), "split", "ts") == ["is"] * 5 + ["val"] + ["holdout"] * 4


def test_purge_ends_in_split(spark):
    p = panel(spark, {"a": range(1, 11)})
    out = grid.purged_forward(p, grid.splits(p), "close", 2, "f")
    assert [v is None for v in values(out, "f", "ts")] == [False] * 3 + [True] * 3 + [False] * 2 + [True] * 2


def test_lagged_events_are_late_and_stale(spark):
    hours = spark.createDataFrame([("a", T0 + dt.timedelta(hours=6 * i)) for i in range(16)], "asset string, ts timestamp")
    daily = spark.createDataFrame([("a", T0, 7.0)], "asset string, ts timestamp, v double")
    out = grid.lagged_events(hours, daily, "v", 1, 4, "k")
    assert [v for v in values(out, "k", "ts")] == [None] * 4 + [7.0] * 4 + [None] * 8


def test_long_moments_equal_frames(spark):
    rng = np.random.default_rng(0)
    v = [None if rng.random() < 0.2 else 1e6 + rng.normal() for _ in range(120)]
    p = ts.long_moments(panel(spark, {"a": v}), "close", 30, "m", "s", 10).orderBy("ts").toPandas()
    s = pd.Series(v, dtype=float).rolling(30, min_periods=10)
    assert p.m.to_numpy() == pytest.approx(s.mean().to_numpy(), nan_ok=True)
    assert p.s.to_numpy(dtype=float) == pytest.approx(s.std().to_numpy(), rel=1e-5, nan_ok=True)


def test_average_rank(spark):
    d = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 5.0), ("c", 1, 9.0), ("d", 1, None)], "asset string, ts long, x double")
    assert values(d.withColumn("r", xs.pct_rank("x")), "r", "asset") == pytest.approx([0.5, 0.5, 1.0, None])


@pytest.mark.parametrize("n", [3, 4, 7, 9, 20])
def test_buckets_equal_qcut(spark, n):
    d = spark.createDataFrame([(f"{i:03d}", 1, float(i)) for i in range(n)], "asset string, ts long, x double")
    got = values(xs.quantile_bucket(d, "x", 3, 3, "b"), "b", "asset")
    assert got == pd.qcut(pd.Series(range(1, n + 1)), 3, labels=False).tolist()


def test_residual_is_orthogonal(spark):
    rng = np.random.default_rng(1)
    d = spark.createDataFrame([(f"{i}", 1, float(x), float(2 * x + e)) for i, (x, e) in enumerate(rng.normal(size=(20, 2)))], "asset string, ts long, x double, y double")
    out = xs.residual(d, "y", "x", 5, "r").toPandas()
    assert abs((out.r * out.x).sum()) < 1e-9 and abs(out.r.sum()) < 1e-9
    flat = xs.residual(d.withColumn("x", F.lit(3.0)), "y", "x", 5, "r").toPandas()
    assert flat.r.to_numpy() == pytest.approx((flat.y - flat.y.mean()).to_numpy())


def test_residualize_agrees_with_one_control(spark):
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(f"{i}", 1, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(20, 2)))], "asset string, ts long, x double, y double")
    out = xs.residual(xs.residualize(d, "y", ["x"], 5, "m"), "y", "x", 5, "r").toPandas()
    assert out.m.to_numpy() == pytest.approx(out.r.to_numpy())


def test_weights(spark):
    d = spark.createDataFrame([(c, 1, float(i)) for i, c in enumerate("abcde")], "asset string, ts long, x double")
    w = values(portfolio.rank_weights(d, "x", 3, "w"), "w", "asset")
    assert sum(w) == pytest.approx(0) and sum(map(abs, w)) == pytest.approx(1) and w == sorted(w)
    assert values(portfolio.top_bottom_weights(d, "x", 3, 0.3, "w"), "w", "asset") == [-0.5, 0, 0, 0, 0.5]
    assert values(portfolio.rank_weights(d, "x", 9, "w"), "w", "asset") == [0] * 5
    one = spark.createDataFrame([("a", 1, 1.0)], "asset string, ts long, x double")
    assert values(portfolio.top_bottom_weights(one, "x", 1, 0.3, "w"), "w", "asset") == [-0.5]


def test_turnover_restarts_by_part(spark):
    d = spark.createDataFrame([("a", i, "s" if i < 2 else "t", 0.5) for i in range(4)], "asset string, ts long, split string, w double")
    assert values(d.withColumn("t", portfolio.turnover("w", ("split",))), "t", "ts") == [0.5, 0.0, 0.5, 0.0]


def test_newey_west_by_hand(spark):
    x = np.random.default_rng(3).normal(0.1, 1, 40)
    d = spark.createDataFrame([("p", i, float(v)) for i, v in enumerate(x)], "path string, ts long, r double")
    r = inference.newey_west(d, "r", 3, ["path"]).first()
    e = x - x.mean()
    lrv = (e @ e + 2 * sum((1 - k / 4) * (e[k:] @ e[:-k]) for k in (1, 2, 3))) / 40
    assert r.t == pytest.approx(x.mean() / np.sqrt(lrv / 40))
    short = inference.newey_west(d.where("ts < 7"), "r", 3, ["path"]).first()
    assert short.t is None


def test_deflated_sharpe_falls_with_trials(spark):
    rng = np.random.default_rng(4)
    rows = [(f"p{k}", i, float(v)) for k in range(5) for i, v in enumerate(rng.normal(0.02 * k, 1, 200))]
    d = spark.createDataFrame(rows, "path string, ts long, r double")
    few, many = (inference.deflated_sharpe(d, trials=n).where("path = 'p4'").first().p for n in (5, 500))
    assert few < many


def test_false_discovery(spark):
    p = [0.001, 0.02, 0.03, 0.5, 0.04]
    d = spark.createDataFrame([(str(i), v) for i, v in enumerate(p)], "id string, p double")
    got = {r.id: r.a for r in inference.false_discovery(d, "p", 0.1, "a").collect()}
    assert [got[str(i)] for i in range(5)] == pytest.approx([0.005, 0.05, 0.05, 0.5, 0.05])


def test_leak_is_found(spark):
    p = panel(spark, {"a": range(1, 20), "b": range(3, 22)})
    cut = T0 + dt.timedelta(days=9)
    clean = audit.leaks(p, lambda d: d.withColumn("f", change("close", 2)), "f", cut, ["close"])
    ahead = audit.leaks(p, lambda d: d.withColumn("f", change("close", -1)), "f", cut, ["close"])
    assert clean.count() == 0 and ahead.count() > 0


def test_sweep_by_hand(spark):
    d = spark.createDataFrame([(1, "ask", 101.0, 1.0), (1, "ask", 102.0, 2.0), (1, "bid", 99.0, 1.0)], "k long, side string, price double, size double")
    r = audit.book_metrics(d, ["k"], (150.0,), (150.0, 1000.0)).first()
    vwap = 150 / (1 + 49 / 102)
    assert r.ask_impact_150 == pytest.approx((vwap / 100 - 1) * 1e4) and r.ask_impact_1000 is None and r.bid_fill_150 == pytest.approx(0.66)


def test_hysteresis(spark):
    rows = [("k", t, a, float(r)) for t, ranks in enumerate([{"a": 1, "b": 2, "c": 3}, {"a": 3, "b": 2, "c": 1}, {"a": 4, "b": 2, "c": 1}]) for a, r in ranks.items()]
    d = spark.createDataFrame(rows, "book string, ts long, asset string, rk double")
    out = recursive.hysteresis(d, "rk", 1, 3)
    got = {(r.ts, r.asset): r.member for r in out.collect()}
    assert [got[k] for k in [(0, "a"), (1, "a"), (1, "c"), (2, "a"), (2, "b")]] == [True, True, True, False, False]


def test_recursive_kernels():
    x = np.array([1.0, 2, 3, 2, 1, np.nan, 4])
    assert recursive.ema(x, 3) == pytest.approx(pd.Series(x).ewm(span=3, adjust=False).mean().to_numpy())
    up = recursive.rsi(np.arange(10.0), 3)
    assert np.isnan(up).all()


def test_upsert(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, "z")], "k long, v string")
    assert {tuple(r) for r in upsert.keep_last(a, b, keys=["k"]).collect()} == {(1, "x"), (2, "z")}
