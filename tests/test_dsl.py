import datetime as dt

import pytest

from tidegrid.functions import dsl


@pytest.mark.parametrize("text", ["sma(close)", "sma(close, 0)", "ts_delay(close, -5)", "ts_delay(close, --1.5)", "quantile(close, -3, 0.5)", "close.__class__", "foo(close)", "sma(close, n=3)", "lambda: 1", "[close]", "bb_bw(close, 2)", "unknown", "sma(close, 2"])
def test_rejects(text):
    with pytest.raises(dsl.ExpressionError):
        dsl.parse(text)


def test_depth_and_size():
    with pytest.raises(dsl.ExpressionError):
        dsl.parse("neg(" * 9 + "close" + ")" * 9)
    with pytest.raises(dsl.ExpressionError):
        dsl.parse("add(" + "add(close, close), " * 1 + "mul(" + "close, " * 60 + "close))")


def test_text_form():
    assert dsl.to_text(dsl.parse("if(gt( close ,open), -1, sma(close,3))")) == "if(gt(close, open), -1, sma(close, 3))"


def test_registry():
    with pytest.raises(dsl.ExpressionError):
        dsl.register("sma", "sw", None)


def test_values(spark):
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(v) if v is not None else None) for i, v in enumerate([1, 2, 4, 8, None, 16, 32])]
    df = spark.createDataFrame(rows, "asset string, ts timestamp, close double").selectExpr("*", "close as open", "close as high", "close as low", "1D as volume")
    out = dsl.evaluate(df, {"r": "returns(close, 1)", "m": "sma(close, 2)", "e": "ema(close, 3)", "d": "div(close, sub(close, close))", "n": "sma(returns(close, 1), 2)", "k": "ts_rank(close, 3)"}).orderBy("ts").collect()
    assert [x.r for x in out] == [None, 1.0, 1.0, 1.0, None, None, 1.0]
    assert [x.m for x in out] == [None, 1.5, 3.0, 6.0, None, None, 24.0]
    assert [x.d for x in out] == [None] * 7
    assert [x.n for x in out] == [None, None, 1.0, 1.0, None, None, None]
    assert [x.k for x in out][2:4] == [1.0, 1.0]
    e, w, want = None, 0.0, []
    for v in [1, 2, 4, 8, None, 16, 32]:
        w *= 0.5
        if v is not None:
            e = v if e is None else (w * e + 0.5 * v) / (w + 0.5)
            w = 1.0
        want.append(e)
    assert [x.e for x in out] == pytest.approx(want)
