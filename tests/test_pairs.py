"""Pair portfolios against plain Python."""

import datetime as dt
import math
import random

import pytest

from tidegrid.operators import pairs, strategy
from tidegrid.operators import portfolio as pf

DAY0 = dt.datetime(2024, 1, 1)


def _days(n):
    return [DAY0 + dt.timedelta(days=i) for i in range(n)]


def test_hysteresis_forgets_members_when_signals_are_few(spark):
    rng = random.Random(5)
    names = [f"a{i:02d}" for i in range(12)]
    rows = [(a, t, None if rng.random() < (0.8 if i in (4, 5, 11) else 0.1) else float(rng.randint(0, 6))) for i, t in enumerate(_days(16)) for a in names]
    df = spark.createDataFrame(rows, "asset string, ts timestamp_ntz, s double")
    got = {(r.asset, r.ts): r.w for r in pairs.hysteresis_weights(df, "s", 0.2, 0.5, 6, 1.0, "w").collect()}
    want, members, thin = {}, set(), 0
    for t in _days(16):
        live = sorted((-s, a) for a, u, s in rows if u == t and s is not None)
        order = [a for _, a in live]
        if len(order) < 6:
            members, thin = set(), thin + 1
        else:
            inner = max(1, math.ceil(len(order) * 0.2))
            outer = max(inner, math.ceil(len(order) * 0.5))
            members = (members & set(order[:outer])) | set(order[:inner])
        want |= {(a, t): (0.5 / len(members) if a in members else 0.0) for a in names}
    assert thin >= 2
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_top_weights_share_half_the_gross(spark):
    df = spark.createDataFrame([("a", DAY0, 2.0), ("b", DAY0, 2.0), ("c", DAY0, None), ("d", DAY0, 1.0)], "asset string, ts timestamp_ntz, s double")
    assert {r.asset: r.w for r in pairs.top_weights(df, "s", 2, 1.0, "w").collect()} == {"a": 0.25, "b": 0.25, "c": 0.0, "d": 0.0}
    assert {r.asset: r.w for r in pairs.top_weights(df, "s", 5, 1.0, "w").collect()}["d"] == pytest.approx(1 / 6)


def test_both_legs_pay_and_funding_is_received(spark):
    d = _days(3)
    rows = [("a", d[0], 0.5, 0.10, 0.04, 0.01), ("a", d[1], 0.5, None, 0.02, 0.0), ("a", d[2], 0.0, 0.10, 0.10, 0.01)]
    got = pairs.pair_pnl(spark.createDataFrame(rows, "asset string, ts timestamp_ntz, w double, s double, p double, f double"), "w", "s", "p", "f", cost_bp=10.0).orderBy("ts").collect()
    assert [r.gross for r in got] == pytest.approx([0.03, -0.01, 0.0])
    assert [r.carry for r in got] == pytest.approx([-0.005, 0.0, 0.0])
    assert [r.cost for r in got] == pytest.approx([0.001, 0.0, 0.001])
    assert [r.net for r in got] == pytest.approx([0.034, -0.01, -0.001])
    assert [(r.missing, r.held) for r in got] == [(0, 1), (1, 1), (0, 0)]


def test_source_period_splits(spark):
    t = spark.createDataFrame([(x,) for x in _days(180)], "ts timestamp_ntz")
    by = {r.ts: r.split for r in pairs.source_period_splits(t, "2024-05-10 00:00:00", 0.6).collect()}
    assert (by[dt.datetime(2024, 2, 29)], by[dt.datetime(2024, 3, 1)], by[dt.datetime(2024, 5, 10)], by[dt.datetime(2024, 5, 11)]) == ("is", "val", "val", "holdout")
    assert len(by) == 180
    few = {r.split for r in pairs.source_period_splits(t, "2024-03-10 00:00:00", 0.6).collect()}
    assert few == {None}


def test_windows_start_at_the_first_time(spark):
    t = spark.createDataFrame([(x,) for x in _days(10)], "ts timestamp_ntz")
    assert [r.window for r in pairs.windows_of(t, 4).orderBy("ts").collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


@pytest.mark.parametrize(("equal", "apart"), [(False, False), (True, True), (False, True)])
def test_segment_weights_with_ties(spark, equal, apart):
    rng = random.Random(3)
    rows = [(f"a{i}", t, rng.choice([None, 0.0, 0.0, 1.0, 2.0]), rng.choice([0.0, 1.0, 3.0, 8.0])) for t in _days(60) for i in range(12)]
    df = spark.createDataFrame(rows, "asset string, ts timestamp_ntz, x double, c double")
    got = {(r.asset, r.ts): r.w for r in pf.segment_weights(df, "x", "c", 0.3, 5, "w", equal, apart).collect()}
    want = dict.fromkeys(got, 0.0)
    for t in _days(60):
        live = [(x, a, 1.0 if equal else c) for a, u, x, c in rows if u == t and x is not None and c > 0]
        k = max(1, math.floor(len(live) * 0.3))
        low = sorted(live)
        high = low[::-1] if apart else sorted(live, key=lambda v: (-v[0], v[1]))
        if len(live) < 5 or (apart and 2 * k > len(live)):
            continue
        for side, sign in ((high[:k], 0.5), (low[:k], -0.5)):
            want |= {(a, t): sign * c / sum(v[2] for v in side) for _, a, c in side}
    assert len(got) == len(rows)
    assert all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    assert any(want.values())


def test_correlation_with_a_constant_path_is_null(spark):
    rows = [(p, t, float(v)) for p, xs in {"a": [1, 2, 4], "b": [2, 4, 8], "c": [0, 0, 0]}.items() for t, v in zip(_days(3), xs, strict=True)]
    df = spark.createDataFrame(rows, "path string, ts timestamp_ntz, r double")
    got = {(r.a, r.b): r["corr"] for r in strategy.correlations(df).collect()}
    assert got == {("a", "b"): pytest.approx(1.0), ("a", "c"): None, ("b", "c"): None}
    assert strategy.uncorrelated(df, 0.5).count() == 0


def test_greedy_pool_takes_the_best_of_what_is_alike(spark):
    scores = [("a", 1.0), ("b", 3.0), ("c", 2.0), ("d", 2.0)]
    assert strategy.greedy_pool(spark, scores, {("b", "c"): 0.9, ("a", "d"): -0.8}, 0.5, 3) == ["b", "d"]
    assert strategy.greedy_pool(spark, scores, {}, 0.5, 3) == ["b", "c", "d"]
