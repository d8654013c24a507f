"""Recurrences along a symbol's history, a state carried from row to row: linear in the number of rows.

A Column can't say that rows reach it in order, so recurrences are steps of a DataFrame: columns that are built within
``Steps`` name the results of steps, and ``apply`` adds these to the panel before the columns are selected.  A step numbers
a symbol's rows by a window and hands them to Python in that order, batch by batch; what a batch leaves to the next
is a few numbers.  The numbers also prove the order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from contextvars import ContextVar
from typing import Iterator, Tuple  # noqa: UP035  (the forms that pandas_udf reads)

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .axes import Axes

#: (values of a row's columns, NaN for missing; where symbols begin) -> results
Kernel = Callable[[list[np.ndarray], np.ndarray], np.ndarray]
#: Weights within a block span e**300 at most, far inside the range of doubles.
_SPAN = 300.0


class Steps:
    """The recurrences of columns built inside ``with Steps() as steps:``, in the order in which they were asked for."""

    _current: ContextVar[Steps | None] = ContextVar("recurrences", default=None)

    def __init__(self) -> None:
        self.steps: list[tuple[str, Callable[[], Kernel], Sequence[Column], Axes]] = []

    def __enter__(self) -> Steps:
        self._token = Steps._current.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        Steps._current.reset(self._token)

    @staticmethod
    def current() -> Steps | None:
        return Steps._current.get()

    def add(self, make: Callable[[], Kernel], xs: Sequence[Column], axes: Axes) -> Column:
        """A column with the results of a kernel over ``xs``; ``make`` gives a fresh one for each task."""
        name = f"__recurrence_{uuid.uuid4().hex}"
        self.steps.append((name, make, xs, axes))
        return F.col(name)

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with a column for each recurrence; those that don't need each other share one pass over sorted rows."""
        left = self.steps
        while left:
            ready = [s for s in left if _known(df, s[2])]
            if not ready:
                return df.select("*", *left[0][2])  # raises: a column isn't there
            axes = ready[0][3]
            ready = [s for s in ready if s[3] == axes]
            names = df.columns
            inputs = {s[0]: [f"{s[0]}_{i}" for i in range(len(s[2]))] for s in ready}
            df = df.select("*", *[x.cast("double").alias(n) for s in ready for x, n in zip(s[2], inputs[s[0]], strict=True)])
            # A select of its own, so that this window is the last thing before Python.
            number = f"{ready[0][0]}_number"
            df = df.select("*", F.row_number().over(axes.history()).alias(number))
            df = df.select(*[F.col(f"`{n}`") for n in names], *[_udf(s[1])(F.col(number), *map(F.col, inputs[s[0]])).alias(s[0]) for s in ready])
            left = [s for s in left if s not in ready]
        return df


def _known(df: DataFrame, xs: Sequence[Column]) -> bool:
    try:
        df.select(*xs).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def _udf(make: Callable[[], Kernel]) -> Callable[..., Column]:
    def run(batches: Iterator[Tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        kernel, last = make(), 0
        for number, *columns in batches:
            at = number.to_numpy(np.int64)
            if not len(at):
                yield pd.Series([], dtype=float)
                continue
            before = np.concatenate([[last], at[:-1]])
            if not ((at == 1) | (at == before + 1)).all():
                raise RuntimeError("rows of a symbol reached a recurrence out of order")
            last = int(at[-1])
            yield pd.Series(kernel([c.to_numpy(np.float64, na_value=np.nan) for c in columns], at == 1))

    # Not deterministic for Catalyst, since a row's result depends on those before it: filters must stay behind it.
    return F.pandas_udf(run, "double").asNondeterministic()


class Decay:
    """An exponentially weighted mean as pandas has it: weights decay over missing rows too, and missing rows show the
    mean before them."""

    def __init__(self, alpha: float, adjust: bool) -> None:
        if not 0 < alpha <= 1:
            raise ValueError(f"alpha must be in (0, 1], not {alpha}")
        self.alpha, self.adjust = alpha, adjust
        # Of the symbol that the last batch ended in: the mean's numerator and weight, and rows since its last value.
        self.sums, self.since = (np.nan, np.nan), 0

    def __call__(self, x: np.ndarray, begins: np.ndarray) -> np.ndarray:
        symbol = np.cumsum(begins)
        there = np.flatnonzero(~np.isnan(x))
        if not len(there):
            if symbol[-1]:
                self.sums, self.since = (np.nan, np.nan), int(len(x) - np.flatnonzero(begins)[-1])
            else:
                self.since += len(x)
            carried = np.where(symbol == 0, self.mean(), np.nan)
            return carried
        own, of = x[there], symbol[there]
        first = np.concatenate([[of[0] > 0 or np.isnan(self.sums[0])], of[1:] != of[:-1]])
        gap = np.diff(there, prepend=-1 - self.since).astype(np.float64)
        if self.alpha == 1:
            keep, new = np.zeros(len(own)), np.ones(len(own))
        else:
            decay = np.exp(gap * np.log1p(-self.alpha))
            keep, new = (decay, np.ones(len(own))) if self.adjust else (decay / (decay + self.alpha), self.alpha / (decay + self.alpha))
        keep, new = np.where(first, 0.0, keep), np.where(first, 1.0, new)
        start = (0.0, 0.0) if np.isnan(self.sums[0]) else self.sums
        top = linear(keep, new * own, start[0])
        weight = linear(keep, new, start[1]) if self.adjust else np.ones(len(own))
        mean = top / weight
        # Rows without a value show the mean before them, if the symbol has one.
        last = np.searchsorted(there, np.arange(len(x)), "right") - 1
        before = np.where(symbol == 0, self.mean(), np.nan)
        shown = np.where((last >= 0) & (symbol[there[np.maximum(last, 0)]] == symbol), mean[np.maximum(last, 0)], before)
        if of[-1] == symbol[-1]:
            self.sums, self.since = (float(top[-1]), float(weight[-1])), int(len(x) - 1 - there[-1])
        else:
            self.sums, self.since = (np.nan, np.nan), int(len(x) - np.flatnonzero(begins)[-1])
        return shown

    def mean(self) -> float:
        return self.sums[0] / self.sums[1]


def linear(keep: np.ndarray, add: np.ndarray, start: float) -> np.ndarray:
    """s[i] = keep[i] * s[i - 1] + add[i] with s[-1] = ``start``, 0 <= keep <= 1, by sums of rescaled terms in blocks."""
    with np.errstate(divide="ignore"):
        logs = -np.log(keep)
    # A block ends before a weight of 0 or a step too long for its span, and where its span is full.
    out = np.empty(len(keep))
    cuts = np.flatnonzero(~(logs < _SPAN))
    edges = np.unique(np.concatenate([[0], cuts, [len(keep)]]))
    before = start
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        while a < b:
            total = np.cumsum(logs[a + 1 : b])
            stop = a + 1 + int(np.searchsorted(total, _SPAN, "right"))
            scale = np.exp(total[: stop - a - 1])
            out[a] = keep[a] * before + add[a]
            out[a + 1 : stop] = (out[a] + np.cumsum(add[a + 1 : stop] * scale)) / scale
            before = out[stop - 1]
            a = stop
    return out
