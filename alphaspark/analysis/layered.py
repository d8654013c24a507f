"""Quantile backtests: mean returns of each date's quantiles, their spread, and turnover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cross
from ..functions.axes import AXES, Axes
from .ic import safe_corr

TINY = 1e-12


class LayeredBacktest:
    """``df``: date, symbol, ``factor`` and ``ret``.  Everything but ``stats_row`` is lazy; the tables with
    one row a date are all that global windows run over."""

    def __init__(self, df: DataFrame, n_quantiles: int = 5, factor: str = "factor", ret: str = "ret", axes: Axes = AXES) -> None:
        if n_quantiles < 2:
            raise ValueError("at least two quantiles")
        self.axes, self.n = axes, n_quantiles
        both = df.select(axes.date, axes.symbol, F.col(factor).cast("double").alias("factor"), F.col(ret).cast("double").alias("ret")).dropna(subset=["factor", "ret"])
        self.assigned = both.withColumn("quantile", cross.qcut(F.col("factor"), n_quantiles, axes)).where("quantile IS NOT NULL")

    def quantile_returns(self) -> DataFrame:
        """date, Q1 .. Qn: mean return of each quantile."""
        wide = self.assigned.groupBy(self.axes.date).pivot("quantile", list(range(1, self.n + 1))).agg(F.avg("ret"))
        return wide.withColumnsRenamed({str(i): f"Q{i}" for i in range(1, self.n + 1)})

    def long_short(self) -> DataFrame:
        """date, long_short: Qn - Q1 where both are there."""
        return self.quantile_returns().select(self.axes.date, (F.col(f"Q{self.n}") - F.col("Q1")).alias("long_short")).dropna()

    def cumulative(self) -> DataFrame:
        """date, Q1 .. Qn, long_short: products of 1 + return so far, less 1; missing returns leave them as they are."""
        wide = self.quantile_returns().withColumn("long_short", F.col(f"Q{self.n}") - F.col("Q1"))
        so_far = Window.orderBy(self.axes.date).rowsBetween(Window.unboundedPreceding, 0)
        names = [f"Q{i}" for i in range(1, self.n + 1)] + ["long_short"]
        return wide.select(self.axes.date, *[F.when(F.col(c).isNotNull(), F.product(1 + F.col(c)).over(so_far) - 1).alias(c) for c in names])

    def stats(self) -> DataFrame:
        """One row: mean, sample deviation and their ratio for top, bottom and spread."""
        wide = self.quantile_returns().select(F.col(f"Q{self.n}").alias("top"), F.col("Q1").alias("bottom"), (F.col(f"Q{self.n}") - F.col("Q1")).alias("long_short"))
        out = []
        for c in ("top", "bottom", "long_short"):
            mean, std = F.avg(c), F.stddev_samp(c)
            out += [mean.alias(f"{c}_mean"), std.alias(f"{c}_std"), F.when(std > TINY, mean / std).otherwise(0.0).alias(f"{c}_ir")]
        return wide.agg(*out)

    def layered_ic(self, min_names: int = 2) -> DataFrame:
        """date, quantile, ic: Spearman inside each quantile; NULL where it has fewer names."""
        both = Window.partitionBy(self.axes.date, "quantile")
        average = lambda c: F.rank().over(both.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(self.axes.date, "quantile", c)) - 1) / 2.0
        ranked = self.assigned.select(self.axes.date, "quantile", average("factor").alias("x"), average("ret").alias("y"))
        value = F.when(F.count(F.lit(1)) >= min_names, safe_corr(F.col("x"), F.col("y")))
        return ranked.groupBy(self.axes.date, "quantile").agg(value.alias("ic"))

    def turnover(self) -> DataFrame:
        """date, turnover: of the top quantile, 1 - common names / names of either, against the date before.

        Each top name is counted on its date and once more on the next one, so common names meet without a join of the panel
        with itself; only the table with one row a date is sorted as a whole.
        """
        date, symbol = self.axes.date, self.axes.symbol
        top = self.assigned.groupBy(date).agg(F.collect_set(F.when(F.col("quantile") == self.n, F.col(symbol))).alias("top"))
        in_order = Window.orderBy(date)
        dates = top.select(F.col(date).alias("day"), F.lead(date).over(in_order).alias("next"), F.lag(date).over(in_order).isNull().alias("first"))
        one = lambda when, now, was, first: F.struct(when.alias("day"), F.lit(now).alias("now"), F.lit(was).alias("was"), first.alias("first"))
        both = F.array(one(F.col("day"), 1, 0, F.col("first")), one(F.col("next"), 0, 1, F.lit(False)))
        names = top.join(dates, F.col(date) == F.col("day")).select(F.explode("top").alias("name"), both.alias("both")).select("name", F.explode("both").alias("b"))
        held = names.where("b.day IS NOT NULL").groupBy("b.day", "name").agg(F.max("b.now").alias("now"), F.max("b.was").alias("was"), F.max("b.first").alias("first"))
        sums = held.groupBy("day").agg(F.sum("now").alias("names"), F.sum("was").alias("were"), F.sum(F.col("now") * F.col("was")).alias("common"), F.max("first").alias("first"))
        return sums.where("NOT first").select(F.col("day").alias(date), (1 - F.col("common") / (F.col("names") + F.col("were") - F.col("common"))).alias("turnover"))

    def stats_row(self) -> dict[str, float]:
        return self.stats().first().asDict()
