"""Expression language: text to a checked tree to Spark columns.

``operators`` is an open registry: an entry has argument kinds (series or
window), a builder from columns to a column, and help. Windows are whole
numbers of at least one after folding of signs, so no expression looks ahead.
Recursive operators (``ema`` and what rests on it) can't be framed windows;
``evaluate`` computes them by asset in one pandas pass before the rest.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import timeseries as ts
from .numeric import asset_time, div, lag, log, rolling

MAX_DEPTH, MAX_NODES = 8, 50
FIELDS = ("open", "high", "low", "close", "volume")


class ExpressionError(ValueError):
    """The text is not a valid expression."""


@dataclass(frozen=True)
class Operator:
    kinds: str  # a letter an argument: s series, w window, n number
    build: Callable[..., Column] | None  # None: recursive
    help: str


operators: dict[str, Operator] = {}


def register(name: str, kinds: str, build: Callable[..., Column] | None, help: str = "") -> None:
    if name in operators:
        raise ExpressionError(f"{name} is registered already")
    operators[name] = Operator(kinds, build, help)


def _band(c: Column, n: int, k: float) -> tuple[Column, Column]:
    return rolling(F.avg, c, n), k * rolling(F.stddev_pop, c, n)


def _inside(c: Column, n: int, k: float) -> Column:
    mid, half = _band(c, n, k)
    return div(c - mid + half, 2 * half)


register("returns", "sw", lambda s, n: div(s - lag(s, n), lag(s, n)), "change over n rows")
register("log_returns", "sw", lambda s, n: log(div(s, lag(s, n))), "log change over n rows")
register("diff", "sw", lambda s, n: s - lag(s, n), "difference over n rows")
register("sma", "sw", lambda s, n: rolling(F.avg, s, n), "mean of n rows")
register("ts_mean", "sw", lambda s, n: rolling(F.avg, s, n), "mean of n rows")
register("std", "sw", lambda s, n: rolling(F.stddev_pop, s, n), "population deviation")
register("ts_rank", "sw", ts.rank_in_window, "rank in the window over its length")
register("quantile", "swn", lambda s, n, q: rolling(lambda x: F.percentile(x, F.lit(float(q))), s, n), "linear quantile")
register("zscore", "sw", lambda s, n: ts.zscore(s, n), "deviations from the mean")
register("bb_bw", "swn", lambda c, n, k: div(2 * _band(c, n, k)[1], _band(c, n, k)[0]), "band width over its middle")
register("bb_pctb", "swn", _inside, "place in the band")
register("ts_max", "sw", lambda s, n: rolling(F.max, s, n), "maximum of n rows")
register("ts_min", "sw", lambda s, n: rolling(F.min, s, n), "minimum of n rows")
register("ts_corr", "ssw", ts.rolling_corr, "correlation over n rows")
register("ts_delay", "sw", lambda s, n: lag(s, n), "value n rows ago")
register("add", "ss", lambda a, b: a + b)
register("sub", "ss", lambda a, b: a - b)
register("mul", "ss", lambda a, b: a * b)
register("div", "ss", div, "quotient, missing for 0")
register("max", "ss", lambda a, b: F.greatest(a, b), "row maximum of those present")
register("min", "ss", lambda a, b: F.least(a, b))
register("abs", "s", F.abs)
register("neg", "s", lambda a: -a)
register("if", "sss", lambda c, a, b: F.when(c > 0, a).otherwise(b), "a where c is positive, else b")
register("gt", "ss", lambda a, b: F.coalesce((a > b).cast("double"), F.lit(0.0)))
register("lt", "ss", lambda a, b: F.coalesce((a < b).cast("double"), F.lit(0.0)))
register("ema", "sw", None, "exponential mean of span n")
register("rsi", "sw", None, "relative strength from exponential means")
register("atr", "sssw", None, "exponential mean of the true range")
register("squeeze", "ssswnwn", None, "1 where the bands lie inside the range channel")


def _number(node: ast.AST) -> float | None:
    """The value of a literal with any signs before it."""
    sign = 1
    while isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        sign, node = (-sign if isinstance(node.op, ast.USub) else sign), node.operand
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return sign * node.value
    return None


def parse(text: str) -> ast.AST:
    """A checked tree: known calls, fields and numbers only, right arity, windows of one row at least."""
    source = text.replace("if(", "if_(").replace("if (", "if_(")
    try:
        root = ast.parse(source.strip(), mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"can't read {text!r}") from e
    if sum(isinstance(n, (ast.Call, ast.Name, ast.Constant, ast.UnaryOp)) for n in ast.walk(root)) > MAX_NODES:
        raise ExpressionError("too many parts")
    _check(root, 1)
    return root


def _check(node: ast.AST, depth: int) -> None:
    if depth > MAX_DEPTH:
        raise ExpressionError("nested too deeply")
    if _number(node) is not None:
        return
    if isinstance(node, ast.Name):
        if node.id not in FIELDS:
            raise ExpressionError(f"no field {node.id}")
        return
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return _check(node.operand, depth + 1)
    if not isinstance(node, ast.Call) or not isinstance(node.func, ast.Name) or node.keywords:
        raise ExpressionError(f"{type(node).__name__} is not allowed")
    name = node.func.id.rstrip("_")
    if name in FIELDS and not node.args:
        return
    if name not in operators:
        raise ExpressionError(f"no operator {name}")
    kinds = operators[name].kinds
    if len(node.args) != len(kinds):
        raise ExpressionError(f"{name} takes {len(kinds)} arguments")
    for kind, arg in zip(kinds, node.args, strict=True):
        value = _number(arg)
        if kind == "w" and (value is None or value != int(value) or value < 1):
            raise ExpressionError(f"a window of {name} must be a whole number from 1")
        if kind == "n" and value is None:
            raise ExpressionError(f"{name} needs a number")
        if kind == "s":
            _check(arg, depth + 1)


def to_text(node: ast.AST) -> str:
    """The tree in one normal form."""
    value = _number(node)
    if value is not None:
        return f"{value:g}"
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.UnaryOp):
        return f"neg({to_text(node.operand)})"
    return f"{node.func.id.rstrip('_')}({', '.join(map(to_text, node.args))})" if node.args else node.func.id


class _Steps:
    """Stages of columns: a windowed operator over another needs the inner one as a column first."""

    def __init__(self, df: DataFrame):
        self.df, self.made = df, {}

    def column(self, node: ast.AST) -> Column:
        value = _number(node)
        if value is not None:
            return F.lit(float(value))
        if isinstance(node, ast.Name):
            return F.col(node.id)
        if isinstance(node, ast.UnaryOp):
            return -self.column(node.operand)
        name = node.func.id.rstrip("_")
        if name in FIELDS:
            return F.col(name)
        key = to_text(node)
        if key not in self.made:  # equal parts are computed once
            op = operators[name]
            args = [int(_number(a)) if k == "w" else _number(a) if k == "n" else self.column(a) for k, a in zip(op.kinds, node.args, strict=True)]
            made = f"_dsl{len(self.made)}"
            if op.build is None:
                from ..operators import recursive

                self.df = recursive.apply(self.df, name, args, made)
            else:
                self.df = self.df.withColumn(made, op.build(*args))
            self.made[key] = made
        return F.col(self.made[key])


def evaluate(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Adds a column for each expression to a panel (asset, ts and the fields)."""
    steps = _Steps(df)
    trees = {name: parse(text) for name, text in expressions.items()}
    columns = {name: steps.column(tree) for name, tree in trees.items()}
    return steps.df.withColumns(columns).drop(*steps.made.values())


__all__ = ["ExpressionError", "asset_time", "evaluate", "operators", "parse", "register", "to_text"]
