"""Technical indicators, along each symbol's history."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rolling
from ..functions.axes import Axes
from .alphas import EPS, field
from .registry import register_factor


@register_factor(needs=("close",), window=498)
def rsi14(ax: Axes) -> Column:
    """Wilder's relative strength index over 14 rows; 0 where it is undefined."""
    move = rolling.delta(field("close"), 1, ax)
    up = rolling.ewm(F.greatest(move, F.lit(0.0)) * F.when(move.isNotNull(), 1.0), 1 / 14, False, ax)
    down = rolling.ewm(F.greatest(-move, F.lit(0.0)) * F.when(move.isNotNull(), 1.0), 1 / 14, False, ax)
    return F.coalesce(100 * F.try_divide(up, up + down), F.lit(0.0))


@register_factor(needs=("close",), window=480)
def macd_diff(ax: Axes) -> Column:
    """EMA 12 less EMA 26 of the close, less its own EMA 9."""
    return rolling.ewm_spread(field("close"), 2 / 13, 2 / 27, 2 / 10, ax)


@register_factor(needs=("close",), window=20)
def bb_pct(ax: Axes) -> Column:
    """(close - mean of 20) / (2 * population deviation of 20)"""
    c, w = field("close"), ax.rows(20)
    return (c - rolling.mean(c, 20, ax, 20)) / (2 * F.when(F.count(c).over(w) >= 20, F.stddev_pop(c).over(w)) + EPS)


@register_factor(needs=("high", "low", "close"), window=498)
def atr14(ax: Axes) -> Column:
    """Wilder's average true range over 14 rows."""
    before = rolling.ref(field("close"), 1, ax)
    h, l = field("high"), field("low")  # noqa: E741
    return rolling.ewm(F.greatest(h - l, F.abs(h - before), F.abs(l - before)), 1 / 14, False, ax)


@register_factor(needs=("close", "volume"))
def obv(ax: Axes) -> Column:
    """Volume summed with the sign of the close's move."""
    return rolling.cumulative(F.coalesce(F.signum(rolling.delta(field("close"), 1, ax)), F.lit(0.0)) * field("volume"), ax)
