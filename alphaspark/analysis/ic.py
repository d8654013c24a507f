"""Information coefficients: per date, the correlation of a factor and what followed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cross, rolling
from ..functions.axes import AXES, Axes
from .stats import t_test_p

MIN_NAMES = 5
TINY = 1e-12


def forward_returns(panel: DataFrame, periods: Sequence[int] = (1, 5, 10), price: str = "close", axes: Axes = AXES) -> DataFrame:
    """The panel with ret_p = price p rows ahead / price - 1, for each period."""
    return panel.select("*", *[(F.try_divide(rolling.ref(F.col(price), -p, axes), F.col(price)) - 1).alias(f"ret_{p}") for p in periods])


def safe_corr(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; NULL where one side is constant."""
    return F.when((F.max(x) > F.min(x)) & (F.max(y) > F.min(y)), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def daily_ic(df: DataFrame, factor: str = "factor", ret: str = "ret", method: str = "spearman", axes: Axes = AXES, min_names: int = MIN_NAMES) -> DataFrame:
    """(date, ic, n) of the dates with at least ``min_names`` names that have both.

    Spearman ranks among those names.  One shuffle by date serves ranks and correlation.
    """
    if method not in ("spearman", "pearson"):
        raise ValueError(f"method must be spearman or pearson, not {method!r}")
    both = df.select(axes.date, F.col(factor).cast("double").alias("x"), F.col(ret).cast("double").alias("y")).dropna(subset=["x", "y"])
    if method == "spearman":
        both = both.select(axes.date, cross.rank(F.col("x"), axes).alias("x"), cross.rank(F.col("y"), axes).alias("y"))
    return both.groupBy(axes.date).agg(safe_corr(F.col("x"), F.col("y")).alias("ic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_names)


def moving_ic(ic: DataFrame, n: int = 20, axes: Axes = AXES) -> DataFrame:
    """With ``ic_mean``, the mean over up to ``n`` dates that have a value; one row a date, sorted as a whole."""
    return ic.withColumn("ic_mean", F.avg("ic").over(Window.orderBy(axes.date).rowsBetween(-(n - 1), 0)))


def ic_summary(ic: DataFrame) -> DataFrame:
    """One row: mean, sample deviation, their ratio (0 for no deviation), share of positive days, t and number of days."""
    mean, std, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    ratio = F.when(std > TINY, mean / std).otherwise(0.0)
    return ic.agg(
        F.coalesce(mean, F.lit(0.0)).alias("ic_mean"), F.coalesce(std, F.lit(0.0)).alias("ic_std"), ratio.alias("ic_ir"),
        F.coalesce(F.avg((F.col("ic") > 0).cast("double")), F.lit(0.0)).alias("ic_positive_ratio"),
        F.coalesce(F.when(std > TINY, mean / (std / F.sqrt(n))), F.lit(0.0)).alias("t_stat"), n.alias("n_days"),
    )


@dataclass(frozen=True)
class ICResult:
    ic_series: DataFrame
    ic_mean: float
    ic_std: float
    ic_ir: float
    ic_positive_ratio: float
    rank_ic_mean: float
    rank_ic_std: float
    rank_ic_ir: float
    t_stat: float
    p_value: float
    n_days: int

    def row(self) -> dict[str, float]:
        return {k: getattr(self, k) for k in self.__dataclass_fields__ if k != "ic_series"}


class ICAnalysis:
    """``factor`` and ``returns``: (date, symbol, value); names are matched on both keys."""

    def __init__(self, factor: DataFrame, returns: DataFrame, axes: Axes = AXES) -> None:
        keys = [axes.date, axes.symbol]
        value = lambda df, name: df.select(*keys, F.col(next(c for c in df.columns if c not in keys)).alias(name))
        self.axes = axes
        self.joined = value(factor, "factor").join(value(returns, "ret"), keys)

    def run(self, method: str = "spearman") -> ICResult:
        series = daily_ic(self.joined, method=method, axes=self.axes)
        r = ic_summary(series).first()
        p = t_test_p(r["t_stat"], r["n_days"] - 1) if r["n_days"] > 1 and r["ic_std"] > TINY else 0.0
        own = (r["ic_mean"], r["ic_std"], r["ic_ir"])
        return ICResult(series.orderBy(self.axes.date), *own, r["ic_positive_ratio"], *own, r["t_stat"], p, r["n_days"])

    def summary(self, method: str = "spearman") -> DataFrame:
        """The figures of run() as a table of one row."""
        row = self.run(method).row()
        return self.joined.sparkSession.createDataFrame([tuple(row.values())], list(row))
