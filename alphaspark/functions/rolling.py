"""Rolling operators along a symbol's history.

``min_periods`` is the number of non-null values a window needs; ``full`` asks for that number of rows instead, as
the operators do that read their window as a sequence.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from .axes import AXES, Axes, finite
from .recurrence import Decay, Kernel, Steps

TINY = 1e-12


def _over(agg: Column, x: Column, n: int, axes: Axes, min_periods: int) -> Column:
    value = agg.over(axes.rows(n))
    return value if min_periods <= 1 else F.when(F.count(x).over(axes.rows(n)) >= min_periods, value)


def full(value: Column, n: int, axes: Axes) -> Column:
    return F.when(F.count(F.lit(1)).over(axes.rows(n)) == n, value)


def values(x: Column, n: int, axes: Axes = AXES) -> Column:
    """The window as array<double>, oldest first, NULLs kept (a bare collect_list drops them)."""
    return F.transform(F.collect_list(F.struct(settled(x, axes).cast("double").alias("v"))).over(axes.rows(n)), lambda s: s["v"])


def settled(x: Column, axes: Axes) -> Column:
    """An expression as a column of its own, by a window of one row: a sliding frame evaluates its argument
    again for every row of every frame, which is dear where the argument is itself a fold."""
    return x if re.fullmatch(r"Column<'\w+'>", str(x)) else F.first(x).over(axes.rows(1))


def ref(x: Column, n: int = 1, axes: Axes = AXES) -> Column:
    """n rows ago; negative n looks ahead; 0 is x."""
    return x if n == 0 else F.lag(x, n).over(axes.history())


def delta(x: Column, n: int = 1, axes: Axes = AXES) -> Column:
    return x - ref(x, n, axes)


def change(x: Column, n: int = 1, axes: Axes = AXES) -> Column:
    """(x - before) / before, NULL where before is 0."""
    return F.try_divide(delta(x, n, axes), ref(x, n, axes))


def total(x: Column, n: int, axes: Axes = AXES, min_periods: int = 1) -> Column:
    return _over(F.sum(x), x, n, axes, min_periods)


def mean(x: Column, n: int, axes: Axes = AXES, min_periods: int = 1) -> Column:
    return _over(F.avg(x), x, n, axes, min_periods)


def std(x: Column, n: int, axes: Axes = AXES, min_periods: int = 1) -> Column:
    return _over(F.stddev_samp(x), x, n, axes, min_periods)


def var(x: Column, n: int, axes: Axes = AXES, min_periods: int = 1) -> Column:
    return _over(F.var_samp(x), x, n, axes, min_periods)


def highest(x: Column, n: int, axes: Axes = AXES, min_periods: int = 1) -> Column:
    return _over(F.max(x), x, n, axes, min_periods)


def lowest(x: Column, n: int, axes: Axes = AXES, min_periods: int = 1) -> Column:
    return _over(F.min(x), x, n, axes, min_periods)


def median(x: Column, n: int, axes: Axes = AXES, min_periods: int = 1) -> Column:
    return _over(F.percentile(x, 0.5), x, n, axes, min_periods)


def skew(x: Column, n: int, axes: Axes = AXES) -> Column:
    """Bias-corrected; at least 3 values; 0 for a constant window."""
    w, k = axes.rows(n), F.count(x).over(axes.rows(n))
    value = F.skewness(x).over(w) * F.sqrt(k * (k - 1)) / F.greatest(k - 2, F.lit(1))
    return F.when(k >= 3, F.when(F.stddev_pop(x).over(w) < TINY, 0.0).otherwise(value))


def kurt(x: Column, n: int, axes: Axes = AXES) -> Column:
    """Bias-corrected excess; at least 4 values; -3 for a constant window."""
    w, k = axes.rows(n), F.count(x).over(axes.rows(n))
    value = F.try_divide(((k + 1) * F.kurtosis(x).over(w) + 6) * (k - 1), (k - 2) * (k - 3))
    return F.when(k >= 4, F.when(F.stddev_pop(x).over(w) < TINY, -3.0).otherwise(value))


def prod(x: Column, n: int, axes: Axes = AXES, min_periods: int = 1) -> Column:
    return _over(F.product(x), x, n, axes, min_periods)


def count(x: Column, n: int, axes: Axes = AXES) -> Column:
    return F.count(x).over(axes.rows(n)).cast("double")


def sem(x: Column, n: int, axes: Axes = AXES, pandas_compat: bool = False) -> Column:
    """Standard error of the mean, s / sqrt(k); with pandas_compat s / sqrt(k - 1)."""
    k = F.count(x).over(axes.rows(n))
    return F.try_divide(std(x, n, axes), F.sqrt(k - 1 if pandas_compat else k))


def first(x: Column, n: int, axes: Axes = AXES) -> Column:
    return F.first(x).over(axes.rows(n))


def last(x: Column, n: int, axes: Axes = AXES) -> Column:
    return F.last(x).over(axes.rows(n))


def _pair(x: Column, y: Column) -> tuple[Column, Column]:
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def _pairs_ok(value: Column, x: Column, n: int, axes: Axes, min_pairs: int) -> Column:
    return full(F.when(F.count(x).over(axes.rows(n)) >= min_pairs, value), n, axes)


def corr(x: Column, y: Column, n: int, axes: Axes = AXES, min_pairs: int = 3) -> Column:
    """Pearson over a full window; NULL where one side is constant, or with fewer than ``min_pairs`` complete pairs."""
    return _pairs_ok(corr_over(*_pair(x, y), axes.rows(n)), _pair(x, y)[0], n, axes, min_pairs)


def corr_over(x: Column, y: Column, w: WindowSpec) -> Column:
    """Of columns that are missing together; constant means equal extremes, whatever rounding does to the deviation."""
    varied = (F.max(x).over(w) > F.min(x).over(w)) & (F.max(y).over(w) > F.min(y).over(w))
    return F.when(varied, F.try_divide(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)))


def cov(x: Column, y: Column, n: int, axes: Axes = AXES, min_pairs: int = 3) -> Column:
    x, y = _pair(x, y)
    return _pairs_ok(F.covar_samp(x, y).over(axes.rows(n)), x, n, axes, min_pairs)


def beta(x: Column, y: Column, n: int, axes: Axes = AXES, min_pairs: int = 3) -> Column:
    """Slope of y on x over a full window."""
    x, y = _pair(x, y)
    w = axes.rows(n)
    value = F.when(F.max(x).over(w) > F.min(x).over(w), F.try_divide(F.covar_pop(x, y).over(w), F.var_pop(x).over(w)))
    return _pairs_ok(value, x, n, axes, min_pairs)


def ts_rank(x: Column, n: int, axes: Axes = AXES) -> Column:
    """Share of the window's values at or below the current one; full windows."""
    v = values(x, n, axes)
    below = F.size(F.filter(v, lambda a: a <= x)).cast("double")
    return full(F.when(x.isNotNull(), F.try_divide(below, F.size(F.filter(v, lambda a: a.isNotNull())))), n, axes)


def ts_rank_strict(x: Column, n: int, axes: Axes = AXES) -> Column:
    """Share of the window strictly below the current value; n values."""
    below = F.size(F.filter(values(x, n, axes), lambda a: a < x)).cast("double") / n
    return F.when(F.count(x).over(axes.rows(n)) >= n, below)


def ts_rank_average(x: Column, n: int, axes: Axes = AXES, min_periods: int | None = None) -> Column:
    """Average rank of the current value in the window, from 1/k to 1."""
    v = values(x, n, axes)
    low, same = (F.size(F.filter(v, f)).cast("double") for f in (lambda a: a < x, lambda a: a == x))
    k = F.count(x).over(axes.rows(n))
    return F.when(x.isNotNull() & (k >= (n if min_periods is None else min_periods)), F.try_divide(low + (same + 1) / 2, k))


def ts_quantile(x: Column, n: int, axes: Axes = AXES) -> Column:
    """The window's percentile (0 .. 100) that the current value names, between neighbours by a line; full windows."""
    v = F.sort_array(F.filter(values(x, n, axes), lambda a: a.isNotNull()))
    at = (F.size(v) - 1) * x / 100
    low = F.floor(at).cast("int")
    here, there = F.get(v, low), F.get(v, F.least(low + 1, F.size(v) - 1))
    return full(F.when((x >= 0) & (x <= 100), here + (at - low) * (there - here)), n, axes)


def weighted(x: Column, weights: list[float], axes: Axes = AXES, missing: str = "zero") -> Column:
    """Weighted sum of a full window, oldest weight first.  Missing values count 0 ("zero") or void it ("null")."""
    n = len(weights)
    w = F.array(*[F.lit(float(a)) for a in weights])
    v = values(x, n, axes)
    parts = F.zip_with(v, w, lambda a, b: (F.coalesce(a, F.lit(0.0)) if missing == "zero" else a) * b)
    return full(F.aggregate(parts, F.lit(0.0), lambda s, a: s + a), n, axes)


def decay_linear(x: Column, n: int, axes: Axes = AXES, missing: str = "zero") -> Column:
    """Weights 1 .. n over their sum, the newest heaviest."""
    return weighted(x, [(i + 1) / (n * (n + 1) / 2) for i in range(n)], axes, missing)


def decay_exp(x: Column, n: int, alpha: float = 0.5, axes: Axes = AXES) -> Column:
    raw = [(1 - alpha) ** (n - 1 - j) for j in range(n)]
    return weighted(x, [a / sum(raw) for a in raw], axes)


def ewm(x: Column, alpha: float, adjust: bool = False, axes: Axes = AXES) -> Column:
    """Exponentially weighted mean of the whole history; weights decay over missing rows too, which show the mean before
    them.

    Within ``Steps`` (factors, expressions and queries are) one pass over a symbol's rows with a carried state.  As a Column
    of its own, a fold over the rows that still carry a weight of 1e-16.
    """
    if not 0 < alpha <= 1:
        raise ValueError(f"alpha must be in (0, 1], not {alpha}")
    steps = Steps.current()
    if steps is None:
        return _folded(x, alpha, adjust, axes)

    def make() -> Kernel:
        mean = Decay(alpha, adjust)
        return lambda columns, begins: mean(columns[0], begins)

    return steps.add(make, [x], axes)


def _folded(x: Column, alpha: float, adjust: bool, axes: Axes) -> Column:
    if alpha == 1:
        return F.last(x, ignorenulls=True).over(axes.so_far())
    rows = math.ceil(math.log(1e-16) / math.log(1 - alpha))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(1.0).alias("o"))

    def step(s: Column, v: Column) -> Column:
        old = s["o"] * (1 - alpha)
        new = 1.0 if adjust else alpha
        y = F.when(v.isNull(), s["y"]).when(s["y"].isNull(), v).otherwise((old * s["y"] + new * v) / (old + new))
        weight = F.when(s["y"].isNull() & v.isNull(), 1.0).when(v.isNull(), old).when(F.lit(not adjust) | s["y"].isNull(), 1.0).otherwise(old + 1.0)
        return F.struct(y.alias("y"), weight.alias("o"))

    folded = F.aggregate(values(x, rows, axes), start, step, lambda s: s["y"])
    # Missing rows show the mean before them, whose own rows are counted from the last value.
    return F.last(F.when(settled(x, axes).isNotNull(), folded), ignorenulls=True).over(axes.so_far())


def ewm_spread(x: Column, fast: float, slow: float, signal: float, axes: Axes = AXES) -> Column:
    """Two exponential means' difference, less its own exponential mean."""
    steps = Steps.current()
    if steps is None:
        spread = ewm(x, fast, axes=axes) - ewm(x, slow, axes=axes)
        return spread - ewm(spread, signal, axes=axes)

    def make() -> Kernel:
        means = [Decay(a, False) for a in (fast, slow, signal)]

        def run(columns: list[np.ndarray], begins: np.ndarray) -> np.ndarray:
            spread = means[0](columns[0], begins) - means[1](columns[0], begins)
            return spread - means[2](spread, begins)

        return run

    return steps.add(make, [x], axes)


def ewm_twice(x: Column, alpha: float, weights: tuple[float, float], axes: Axes = AXES) -> Column:
    """weights[0] * k + weights[1] * (the exponential mean of k), k that of x."""
    steps = Steps.current()
    if steps is None:
        k = ewm(x, alpha, axes=axes)
        return weights[0] * k + weights[1] * ewm(k, alpha, axes=axes)

    def make() -> Kernel:
        first, second = Decay(alpha, False), Decay(alpha, False)

        def run(columns: list[np.ndarray], begins: np.ndarray) -> np.ndarray:
            k = first(columns[0], begins)
            return weights[0] * k + weights[1] * second(k, begins)

        return run

    return steps.add(make, [x], axes)


def ema(x: Column, span: int, adjust: bool = True, axes: Axes = AXES) -> Column:
    return ewm(x, 2 / (span + 1), adjust, axes)


def arg_max(x: Column, n: int, axes: Axes = AXES) -> Column:
    """Place from the oldest (1) of the first highest value; full windows."""
    return full(F.array_position(values(x, n, axes), F.max(x).over(axes.rows(n)).cast("double")).cast("double"), n, axes)


def arg_min(x: Column, n: int, axes: Axes = AXES) -> Column:
    return full(F.array_position(values(x, n, axes), F.min(x).over(axes.rows(n)).cast("double")).cast("double"), n, axes)


def days_since_high(x: Column, n: int, axes: Axes = AXES) -> Column:
    """Rows since the latest highest value of a full window."""
    return full((F.array_position(F.reverse(values(x, n, axes)), F.max(x).over(axes.rows(n)).cast("double")) - 1).cast("double"), n, axes)


def days_since_low(x: Column, n: int, axes: Axes = AXES) -> Column:
    return full((F.array_position(F.reverse(values(x, n, axes)), F.min(x).over(axes.rows(n)).cast("double")) - 1).cast("double"), n, axes)


def rolling_zscore(x: Column, n: int, axes: Axes = AXES) -> Column:
    """By the population deviation; full windows; NULL for a constant one."""
    w = axes.rows(n)
    s = F.stddev_pop(x).over(w)
    return full(F.when(s > TINY, (x - F.avg(x).over(w)) / s), n, axes)


def slope(x: Column, n: int, axes: Axes = AXES, scale: float = 1.0) -> Column:
    """Slope over 1 .. n of a full window without gaps, times ``scale``."""
    m = (n + 1) / 2
    d = sum((i + 1 - m) ** 2 for i in range(n))
    return weighted(x, [scale * (i + 1 - m) / d for i in range(n)], axes, "null")


def cumulative(x: Column, axes: Axes = AXES) -> Column:
    return F.sum(x).over(axes.so_far())


def long_total(x: Column, n: int, axes: Axes = AXES, min_periods: int = 1) -> Column:
    """total() as a difference of sums so far, whose cost doesn't grow with ``n``.  NaN and infinities are missing."""
    x = finite(x)
    here, there = _between(x, n, axes), _between(x.isNotNull().cast("long"), n, axes)
    return F.when(there >= min_periods, here)


def long_corr(x: Column, y: Column, n: int, axes: Axes = AXES) -> Column:
    """corr() over ``n`` complete pairs by differences of sums so far.

    Both sides are taken relative to their first value, so that sums stay small; a side is constant where it didn't
    change within the window.  NaN and infinities are missing.
    """
    x, y = _pair(finite(x), finite(y))
    x, y = (v - F.first(v, ignorenulls=True).over(axes.so_far()) for v in (x, y))
    moved = lambda v: _between(F.coalesce(v != ref(v, 1, axes), F.lit(True)).cast("long"), n - 1, axes) > 0
    s, sx, sy = F.lit(float(n)), _between(x, n, axes), _between(y, n, axes)
    shared, own = _between(x * y, n, axes) - sx * sy / s, [_between(v * v, n, axes) - a * a / s for v, a in ((x, sx), (y, sy))]
    value = F.try_divide(shared, F.sqrt(F.greatest(own[0], F.lit(0.0))) * F.sqrt(F.greatest(own[1], F.lit(0.0))))
    return F.when((_between(x.isNotNull().cast("long"), n, axes) == n) & moved(x) & moved(y), value)


def _between(v: Column, n: int, axes: Axes) -> Column:
    """Sum over the last ``n`` rows: the sum so far less that of n rows ago."""
    so_far = F.coalesce(F.sum(v).over(axes.so_far()), F.lit(0))
    return so_far - F.coalesce(F.lag(so_far, n).over(axes.history()), F.lit(0))


__all__ = [k for k in dir() if not k.startswith("_") and k not in ("annotations", "math", "re", "np", "F", "Column", "AXES", "Axes", "WindowSpec", "Decay", "Kernel", "Steps", "finite", "TINY")]
