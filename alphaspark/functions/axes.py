"""The two axes of a panel and the windows along them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axes:
    """Names of the key columns.  All builders that need a window take one of these, so expressions over
    the same axes share one shuffle and sort."""

    date: str = "date"
    symbol: str = "symbol"

    def history(self) -> WindowSpec:
        return Window.partitionBy(self.symbol).orderBy(self.date)

    def rows(self, n: int) -> WindowSpec:
        if n < 1:
            raise ValueError(f"a window has at least one row, not {n}")
        return self.history().rowsBetween(-(n - 1), 0)

    def so_far(self) -> WindowSpec:
        return self.history().rowsBetween(Window.unboundedPreceding, 0)

    def day(self) -> WindowSpec:
        return Window.partitionBy(self.date)


AXES = Axes()


def finite(x: Column) -> Column:
    """NULL in place of NaN and infinities."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)
