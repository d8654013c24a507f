"""Expression text -> factor rows, lazily."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.axes import Axes
from ..functions.recurrence import Steps
from .compiler import Compiler, reach_levels
from .parser import FIELDS, Node, parse


@dataclass(frozen=True)
class ExprEngine:
    """Evaluates expressions over a table or DataFrame of bars.

    ``universe``: none, the name of a pool in ``instruments`` (pool_id, stock_code, entry_date, exit_date),
    a query text of one column of symbols, or a DataFrame whose first column has them.  Membership is tested on the date of
    each row and before any window, so windows count member days only.  ``lookback`` reads the rows before ``start``
    that the windows reach into, counted by symbol, and drops them afterwards, so values are those of the full history;
    without it windows begin at ``start``.
    """

    spark: SparkSession
    table: str | DataFrame = "daily_ohlcv"
    date: str = "date"
    symbol: str = "symbol"
    mode: str = "sql"
    universe: str | DataFrame | None = None
    instruments: str | DataFrame = "instruments"
    traded_only: bool = True
    fill: bool = True

    @property
    def axes(self) -> Axes:
        return Axes(self.date, self.symbol)

    def base(self, start: str | None = None, end: str | None = None, universe: str | DataFrame | None = None) -> DataFrame:
        """Key columns and the six fields of the traded rows in range."""
        df = self.spark.table(self.table) if isinstance(self.table, str) else self.table
        if start is not None:
            df = df.where(F.col(self.date) >= F.lit(start).cast("date"))
        if end is not None:
            df = df.where(F.col(self.date) <= F.lit(end).cast("date"))
        if self.traded_only:
            df = df.where(F.col("volume") > 0)
        df = self._members(df, self.universe if universe is None else universe)
        number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if self.fill else F.col(c).cast("double")
        return df.select(self.date, self.symbol, *[number(c).alias(c) for c in FIELDS if c in df.columns])

    def _members(self, df: DataFrame, universe: str | DataFrame | None) -> DataFrame:
        if universe is None:
            return df
        if isinstance(universe, DataFrame) or universe.lstrip().upper().startswith("SELECT"):
            pool = universe if isinstance(universe, DataFrame) else self.spark.sql(universe)
            pool = pool.select(F.col(pool.columns[0]).alias("__member"))
            return df.join(pool, F.col(self.symbol) == F.col("__member"), "left_semi")
        pools = self.spark.table(self.instruments) if isinstance(self.instruments, str) else self.instruments
        pool = pools.where(F.col("pool_id") == universe).select(F.col("stock_code").alias("__member"), F.col("entry_date").alias("__entry"), F.col("exit_date").alias("__exit"))
        day = F.col(self.date)
        member = (F.col(self.symbol) == F.col("__member")) & (day >= F.col("__entry")) & (F.col("__exit").isNull() | (day <= F.col("__exit")))
        return df.join(pool, member, "left_semi")

    def _first_needed(self, levels: tuple[float, ...], start: str, end: str | None, universe: str | DataFrame | None) -> str | None:
        """The first date that rows from ``start`` on depend on, None for all dates.  Rows are counted by symbol, since a
        suspended one has fewer than the market has dates: for each level, so many rows of each symbol that is
        there on the date reached or later."""
        if math.inf in levels:
            return None
        rows = self.base(None, end, universe).select(self.date, self.symbol)
        first = start
        for n in levels:
            if n:
                day = F.lit(first).cast("date")
                there = rows.where(F.col(self.date) >= day).select(self.symbol).distinct()
                before = rows.where(F.col(self.date) < day).join(there, self.symbol, "left_semi")
                latest = Window.partitionBy(self.symbol).orderBy(F.col(self.date).desc())
                found = before.withColumn("__n", F.row_number().over(latest)).where(F.col("__n") <= int(n)).agg(F.min(self.date)).first()[0]
                first = str(found) if found else first
        return first

    def compile(self, expression: str | Node):
        return Compiler(self.mode, self.axes).column(parse(expression) if isinstance(expression, str) else expression)

    def factor(self, expression: str, start: str | None = None, end: str | None = None, universe: str | DataFrame | None = None, name: str = "factor", lookback: bool = False, ordered: bool = True) -> DataFrame:
        """(date, symbol, factor) where the factor is not missing."""
        tree = parse(expression)
        if lookback and start is not None:
            base = self.base(self._first_needed(reach_levels(tree), start, end, universe), end, universe)
        else:
            base = self.base(start, end, universe)
        with Steps() as steps:
            value = Compiler(self.mode, self.axes).column(tree)
        out = steps.apply(base).select(self.date, self.symbol, value.alias(name)).where(F.col(name).isNotNull())
        if lookback and start is not None:
            out = out.where(F.col(self.date) >= F.lit(start).cast("date"))
        return out.orderBy(self.date, self.symbol) if ordered else out

    def features(self, expressions: dict[str, str], start: str | None = None, end: str | None = None) -> DataFrame:
        """Several expressions over one base: one shuffle by symbol and one by date serve them all."""
        compiler = Compiler(self.mode, self.axes)
        with Steps() as steps:
            columns = [compiler.column(parse(e)).alias(n) for n, e in expressions.items()]
        return steps.apply(self.base(start, end)).select(self.date, self.symbol, *columns)

    def batch(self, expressions: dict[str, str], start: str | None = None, end: str | None = None) -> DataFrame:
        """(name, date, symbol, value) of several expressions where they aren't missing, from one pass over their base."""
        wide = self.features(expressions, start, end)
        pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("double").alias("value")) for n in expressions])
        return wide.select(self.date, self.symbol, F.explode(pairs).alias("v")).where("v.value IS NOT NULL").select("v.name", self.date, self.symbol, "v.value")

    def explain(self, expression: str, start: str | None = None, end: str | None = None) -> str:
        """The expression, its tree, and Spark's plan."""
        df = self.factor(expression, start, end)
        plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return f"Expression: {expression}\nTree: {parse(expression)}\nPlan:\n{plan}"
