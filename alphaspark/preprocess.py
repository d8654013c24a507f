"""Preparing panels: completeness, outliers, neutrality and scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import cross
from .functions.axes import AXES, Axes


class DataPreprocessor:
    def __init__(self, axes: Axes = AXES) -> None:
        self.axes = axes

    def align(self, df: DataFrame, fields: Sequence[str]) -> DataFrame:
        """Rows that have all of ``fields``."""
        return df.dropna(subset=list(fields))

    def align_frames(self, *frames: DataFrame) -> DataFrame:
        """One wide frame of the keys that all frames have."""
        keys = [self.axes.date, self.axes.symbol]
        out = frames[0]
        for f in frames[1:]:
            out = out.join(f, keys)
        return out

    def dropna(self, df: DataFrame, pct: float = 0.5, fields: Sequence[str] = ("close", "volume")) -> DataFrame:
        """Rows of the symbols that have at least ``pct`` of each of the fields."""
        share = [F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in fields]
        full = df.groupBy(self.axes.symbol).agg(*share)
        for c in fields:
            full = full.where(F.col(c) >= pct)
        return df.join(full.select(self.axes.symbol), self.axes.symbol, "left_semi")

    def winsorize(self, df: DataFrame, column: str, limit: float = 0.01) -> DataFrame:
        return df.withColumn(column, cross.winsorize(F.col(column), limit, self.axes))

    def neutralise(self, df: DataFrame, column: str, *groups: str) -> DataFrame:
        return df.withColumn(column, cross.demean(F.col(column), self.axes, *groups))

    def standardise(self, df: DataFrame, column: str) -> DataFrame:
        return df.withColumn(column, cross.zscore(F.col(column), 1, self.axes))
