"""Tree -> Column.  Every function nests freely; windows inside windows are left to Catalyst."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import cross, rolling, scalar
from ..functions.axes import AXES, Axes
from ..operators import OPERATORS, Operator
from .parser import Node

MODES = ("sql", "strict")
_ALIASES = {
    "delay": "ref", "ma": "mean", "ts_mean": "mean", "ts_std": "std", "stddev": "std", "ts_sum": "sum", "ts_max": "max", "ts_min": "min",
    "csrank": "rank", "if": "iif", "ts_count": "count",
}
_ROLLING: dict[str, Callable[..., Column]] = {"mean": rolling.mean, "std": rolling.std, "sum": rolling.total, "max": rolling.highest, "min": rolling.lowest}


class Compiler:
    """mode "sql": partial windows count and Rank is (rank - 1) / (n - 1); "strict": windows need all their values,
    and Rank is the average rank over n."""

    def __init__(self, mode: str = "sql", axes: Axes = AXES) -> None:
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
        self.mode, self.axes = mode, axes

    def column(self, node: Node) -> Column:
        """As a number: comparisons are 1 or 0."""
        c = self._build(node)
        return c.cast("double") if node.kind == "compare" else c

    def _build(self, node: Node) -> Column:
        if node.kind == "column":
            return F.col(str(node.value)).cast("double")
        if node.kind == "literal":
            return F.lit(float(node.value))
        if node.kind == "unary":
            x = self.column(node.children[0])
            return -x if node.value == "-" else x
        if node.kind == "binary":
            a, b = map(self.column, node.children)
            return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[str(node.value)]
        if node.kind == "compare":
            a, b = map(self.column, node.children)
            return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b, "==": a == b, "!=": a != b}[str(node.value)]
        return self._call(str(node.value), node.children)

    def _number(self, name: str, args: tuple[Node, ...], i: int, default: int | None, least: int = 1) -> int:
        """A whole-number argument: a literal, maybe with a sign."""
        if i >= len(args):
            if default is None:
                raise ValueError(f"{name} needs argument {i + 1}")
            return default
        node, sign = args[i], 1
        while node.kind == "unary":
            sign, node = -sign if node.value == "-" else sign, node.children[0]
        if node.kind != "literal" or float(node.value) != int(node.value) or sign * int(node.value) < least:
            raise ValueError(f"{name}: argument {i + 1} must be a whole number" + (f" of at least {least}" if least > -(1 << 30) else ""))
        return sign * int(node.value)

    def _call(self, written: str, args: tuple[Node, ...]) -> Column:
        name = _ALIASES.get(written.lower(), written.lower())
        axes = self.axes

        def need(low: int, high: int) -> None:
            if not low <= len(args) <= high:
                raise ValueError(f"{written} takes {low if low == high else f'{low} to {high}'} arguments, {len(args)} given")

        if name in ("log", "abs", "sign", "sqrt"):
            need(1, 1)
            return {"log": scalar.log, "abs": scalar.absolute, "sign": scalar.sign, "sqrt": scalar.sqrt}[name](self.column(args[0]))
        if name == "power":
            need(2, 2)
            return scalar.power(self.column(args[0]), self.column(args[1]))
        if name in ("ref", "delta"):
            need(1, 2)
            return {"ref": rolling.ref, "delta": rolling.delta}[name](self.column(args[0]), self._number(written, args, 1, 1, -(1 << 31)), axes)
        if name in _ROLLING:
            need(1, 2)
            n = self._number(written, args, 1, 20)
            return _ROLLING[name](self.column(args[0]), n, axes, n if self.mode == "strict" else 1)
        if name == "count":
            need(1, 2)
            return rolling.count(self.column(args[0]), self._number(written, args, 1, 20), axes)
        if name == "rank":
            need(1, 1)
            return (cross.percent_rank if self.mode == "sql" else cross.rank_pct)(self.column(args[0]), axes)
        if name == "ts_rank":
            need(1, 2)
            n = self._number(written, args, 1, 10)
            return rolling.ts_rank_average(self.column(args[0]), n, axes, n if self.mode == "strict" else 1)
        if name in ("corr", "cov"):
            need(2, 3)
            n = self._number(written, args, 2, 20, 2)
            x, y = self.column(args[0]), self.column(args[1])
            if self.mode == "strict":
                return {"corr": rolling.corr, "cov": rolling.cov}[name](x, y, n, axes, n)
            return partial_pair(name, x, y, n, axes)
        if name == "iif":
            need(2, 3)
            test = self._build(args[0]) if args[0].kind == "compare" else self.column(args[0]) > 0
            other = self.column(args[2]) if len(args) == 3 else F.lit(None).cast("double")
            return F.when(test, self.column(args[1])).otherwise(other)
        if written in OPERATORS:
            op = OPERATORS.get(written)
            need(op.n_series + op.window, op.n_series + op.window)
            extra = [self._number(written, args, op.n_series, None, -(1 << 31))] if op.window else []
            return op(*[self.column(a) for a in args[: op.n_series]], *extra, axes=axes)
        raise ValueError(f"unknown function {written}")


def partial_pair(name: str, x: Column, y: Column, n: int, axes: Axes) -> Column:
    """Correlation or covariance over windows that may still be filling."""
    xm, ym = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    w = axes.rows(n)
    if name == "cov":
        return F.covar_samp(xm, ym).over(w)
    return rolling.corr_over(xm, ym, w)


def reach_levels(node: Node) -> tuple[float, ...]:
    """A symbol's rows before a row that its value may depend on, at most, cut where values of a date meet: first those of the
    symbol itself, then, before the earliest of these, those of the names it is ranked with, and so on.  Infinite for
    exponential means and other operators without a window."""
    inner: tuple[float, ...] = (0,)
    for child in node.children:
        other = reach_levels(child)
        size = max(len(inner), len(other))
        inner = tuple(max(a, b) for a, b in zip(inner + (0,) * (size - len(inner)), other + (0,) * (size - len(other)), strict=True))
    if node.kind != "call":
        return inner
    name = _ALIASES.get(str(node.value).lower(), str(node.value).lower())
    operator = OPERATORS.get(str(node.value)) if str(node.value) in OPERATORS else None
    if name == "rank" or (name not in _BUILT_IN and operator and operator.kind == "cross"):
        return (0, *inner)
    return (inner[0] + _own_reach(name, node, operator), *inner[1:])


_BUILT_IN = {"log", "abs", "sign", "sqrt", "power", "iif", "ref", "delta", "count", "rank", "ts_rank", "corr", "cov", *_ROLLING}


def _own_reach(name: str, node: Node, operator: Operator | None) -> float:
    last = node.children[-1] if node.children else None
    number = int(float(last.value)) if last is not None and last.kind == "literal" else None
    if name in ("log", "abs", "sign", "sqrt", "power", "iif"):
        return 0
    if name in ("ref", "delta"):
        # A literal with a minus is another kind of node, and looks ahead.
        return number if len(node.children) > 1 and number is not None else 1 if len(node.children) == 1 else 0
    if name in _BUILT_IN:
        return number if number is not None else 10 if name == "ts_rank" else 20
    if operator is None or operator.kind == "scalar":
        return 0
    return math.inf if not operator.bounded else number or 0


def reach(node: Node) -> float:
    """Rows before a row that its value may depend on, at most."""
    return sum(reach_levels(node))
