"""Cross-sectional operators over one date."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .axes import AXES, Axes

TINY = 1e-12


def rank(x: Column, axes: Axes = AXES) -> Column:
    """1 .. n, ties share the average; missing stays missing and ranks nobody."""
    same = F.count(x).over(Window.partitionBy(axes.date, x))
    return F.when(x.isNotNull(), F.rank().over(axes.day().orderBy(x.asc_nulls_last())) + (same - 1) / 2.0)


def rank_pct(x: Column, axes: Axes = AXES) -> Column:
    return F.try_divide(rank(x, axes), F.count(x).over(axes.day()))


def percent_rank(x: Column, axes: Axes = AXES) -> Column:
    """(rank - 1) / (rows - 1), ties share the lowest; missing values rank last."""
    return F.percent_rank().over(axes.day().orderBy(x.asc_nulls_last()))


def quantile(x: Column, axes: Axes = AXES) -> Column:
    """Average rank over (rows + 1), missing rows counted."""
    return rank(x, axes) / (F.count(F.lit(1)).over(axes.day()) + 1)


def decile(x: Column, axes: Axes = AXES) -> Column:
    """ceil(10 * place / rows), ties by symbol, missing rows counted."""
    place = F.row_number().over(axes.day().orderBy(x.asc_nulls_last(), F.col(axes.symbol)))
    return F.when(x.isNotNull(), F.ceil(place * 10 / F.count(F.lit(1)).over(axes.day())).cast("double"))


def scale(x: Column, low: float = 0.0, high: float = 1.0, axes: Axes = AXES) -> Column:
    """To [low, high] by minimum and maximum; the middle for a constant date."""
    lo, hi = F.min(x).over(axes.day()), F.max(x).over(axes.day())
    value = low + F.try_divide(x - lo, hi - lo) * (high - low)
    return F.when(x.isNotNull(), F.when(hi - lo > TINY, value).otherwise((low + high) / 2))


def zscore(x: Column, ddof: int = 0, axes: Axes = AXES) -> Column:
    """0 for a constant date with ddof 0."""
    s = (F.stddev_samp(x) if ddof else F.stddev_pop(x)).over(axes.day())
    value = F.when(s > TINY, (x - F.avg(x).over(axes.day())) / s)
    return value if ddof else F.when(x.isNotNull(), F.coalesce(value, F.lit(0.0)))


def demean(x: Column, axes: Axes = AXES, *groups: str) -> Column:
    """Less the mean of the date, or of the date and groups."""
    return x - F.avg(x).over(Window.partitionBy(axes.date, *groups))


def winsorize(x: Column, limit: float = 0.01, axes: Axes = AXES) -> Column:
    """Clipped to the date's [limit, 1 - limit] quantiles."""
    q = F.percentile(x, F.array(F.lit(limit), F.lit(1 - limit))).over(axes.day())
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.get(q, F.lit(0))), F.get(q, F.lit(1))))


def qcut(x: Column, q: int, axes: Axes = AXES) -> Column:
    """1 .. q by the date's quantiles, equal edges merged; NULL where fewer than two edges are left."""
    edges = F.array_distinct(F.percentile(x, F.array(*[F.lit(i / q) for i in range(q + 1)])).over(axes.day()))
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(x.isNotNull() & (F.size(edges) >= 2), 1 + F.size(F.filter(inner, lambda e: x > e)))
