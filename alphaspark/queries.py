"""The registered queries over the factor library, each with DuckDB SQL for the same rows.

``SPECS`` is filled by small helpers: a Column over the test panel and the SQL steps that give the same value.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store_queries
from .analysis import LayeredBacktest, daily_ic, forward_returns, ic_summary
from .calendar_tools import calendar_parts
from .factors import FACTORS
from .functions import cross, rolling
from .functions.recurrence import Steps
from .operators import OPERATORS
from .plans import ExprEngine
from .preprocess import DataPreprocessor
from .sources.bars import bars
from .streaming.bars import event_bars
from .warehouse import transforms as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# SQL building blocks

_ORDER = "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey"
_ISO = "OVER (PARTITION BY symbol ORDER BY date)"


def bars_sql(every: str) -> str:
    return (
        f"t AS (SELECT CAST(date_trunc('{every}', l_shipdate) AS DATE) AS date, l_suppkey AS symbol, l_extendedprice / l_quantity AS px, l_quantity AS q, l_extendedprice AS a, "
        f"l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem), bars AS (SELECT date, symbol, first(px {_ORDER}) AS open, max(px) AS high, min(px) AS low, "
        f"last(px {_ORDER}) AS close, sum(q)::DOUBLE AS volume, round(sum(a), 4) AS amount FROM t GROUP BY date, symbol)"
    )


def w(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) {_ISO}"


def roll(agg: str, x: str, n: int, least: int = 1) -> str:
    return f"CASE WHEN count({x}) {w(n)} >= {least} THEN {agg}({x}) {w(n)} END"


def full(value: str, n: int) -> str:
    return f"CASE WHEN count(*) {w(n)} = {n} THEN {value} END"


def rank_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2.0 END"


def pct(x: str) -> str:
    return f"({rank_sql(x)}) / count({x}) OVER (PARTITION BY date)"


def corr_sql(x: str, y: str, n: int, least: int) -> str:
    """Of columns that are missing together."""
    return full(f"CASE WHEN count({x}) {w(n)} >= {least} THEN {partial_corr_sql(x, y, n)} END", n)


def partial_corr_sql(x: str, y: str, n: int) -> str:
    varied = " AND ".join(f"max({c}) {w(n)} > min({c}) {w(n)}" for c in (x, y))
    return f"CASE WHEN {varied} THEN covar_pop({x}, {y}) {w(n)} / (stddev_pop({x}) {w(n)} * stddev_pop({y}) {w(n)}) END"


def ewm_sql(x: str, alpha: float) -> tuple[str, str]:
    """Steps' expressions: the values so far, and their fold.  For series whose missing values all come first."""
    return f"list({x}) FILTER ({x} IS NOT NULL) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)", f"list_reduce({{}}, lambda s, v: s * (1 - {alpha!r}::DOUBLE) + v * {alpha!r}::DOUBLE)"


def chain(steps: list[tuple[str, str]], value: str, every: str = "month") -> str:
    """bars with one more column a step, then date, symbol and the value in single precision."""
    inner = "SELECT *, CASE WHEN (symbol + month(date)) % 7 = 0 THEN NULL ELSE round(close - open, 6) END AS x, volume AS y FROM bars"
    for name, expression in steps:
        inner = f"SELECT *, {expression} AS {name} FROM ({inner})"
    return f"WITH {bars_sql(every)} SELECT date, symbol, CASE WHEN abs(v) < 1e30 THEN v::FLOAT::DOUBLE + 0.0 END AS value FROM (SELECT date, symbol, CAST({value} AS DOUBLE) AS v FROM ({inner}))"


# Spark side

def x() -> Column:
    return F.col("x")


def y() -> Column:
    return F.col("y")


def with_gaps(df: DataFrame) -> DataFrame:
    """x: the bar's move, missing in some bars; y: its volume."""
    gaps = F.when((F.col("symbol") + F.month("date")) % 7 != 0, F.round(F.col("close") - F.col("open"), 6))
    return df.withColumn("x", gaps).withColumn("y", F.col("volume"))


def single(value: Column) -> Column:
    """Finite values below 1e30 in single precision, no negative zero: sums differ between engines in their last digits."""
    # An array of one binds the value, so that a costly expression is evaluated once.
    return F.get(F.transform(F.array(value.cast("double")), lambda v: F.when(~F.isnan(v) & (F.abs(v) < 1e30), v.cast("float").cast("double") + 0.0)), F.lit(0))


def call(name: str, *args, **options) -> Callable[[], Column]:
    """An operator on columns that are made when the query is."""
    return lambda: OPERATORS.get(name)(*[a() if callable(a) else a for a in args], **options)


def panel_value(spark: SparkSession, sf_dir: str, value: Callable[[], Column], every: str = "month") -> DataFrame:
    with Steps() as steps:
        column = single(value()).alias("value")
    return steps.apply(with_gaps(bars(spark, sf_dir, every))).select("date", "symbol", column)


def spec(name: str, value: Callable[[], Column], steps: list[tuple[str, str]], sql: str, every: str = "month") -> None:
    QUERIES[name] = partial(panel_value, value=value, every=every)
    ORACLES[name] = chain(steps, sql, every)


def table_query(name: str, sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _ops() -> None:
    scalar = {
        "Abs": "abs(x)", "Sign": "sign(x)", "Log": "CASE WHEN x > 0 THEN ln(x) END", "LogN": "CASE WHEN x > 0 THEN log10(x) END", "Sqrt": "CASE WHEN x >= 0 THEN sqrt(x) END",
        "Square": "x * x", "Power": "pow(x, 2)", "Exp": "exp(x / 1000)", "Tanh": "tanh(x / 1000)", "Sigmoid": "1 / (1 + exp(-x / 1000))", "Sin": "sin(x)", "Cos": "cos(x)",
        "Floor": "floor(x)", "Ceil": "ceil(x)", "Round": "round_even(x, 0)", "Clip": "CASE WHEN x IS NOT NULL THEN least(greatest(x, -100), 250) END",
        "IsNa": "CASE WHEN x IS NULL THEN 1 ELSE 0 END", "NotNa": "CASE WHEN x IS NULL THEN 0 ELSE 1 END", "FillNa": "coalesce(x, 0)",
    }
    for name, sql in scalar.items():
        argument = (lambda: x() / 1000) if name in ("Exp", "Tanh", "Sigmoid") else x
        options = {"low": -100, "high": 250} if name == "Clip" else {}
        spec(f"op_{name.lower()}", call(name, argument, **options), [], sql)
    for name, sql in {"Add": "x + y", "Sub": "x - y", "Mul": "x * y", "Div": "x / nullif(z, 0)", "Mod": "x - z * floor(x / nullif(z, 0))"}.items():
        z = lambda: F.bround(y() / 10 - 5, 0)
        spec(f"op_{name.lower()}", call(name, x, z if name in ("Div", "Mod") else y), [("z", "round_even(y / 10 - 5, 0)")], sql)
    for name in ("Iif", "Where"):
        spec(f"op_{name.lower()}", call(name, lambda: x() > 0, x, y), [], "CASE WHEN x > 0 THEN x ELSE y END")

    n = 5
    aggregates = {"Sum": "sum", "Mean": "avg", "Std": "stddev_samp", "Var": "var_samp", "Max": "max", "Min": "min", "Median": "median", "Ts_Max": "max", "Ts_Min": "min", "SMA": "avg", "RollingSum": "sum"}
    for name, sql in aggregates.items():
        spec(f"ts_{name.lower().removeprefix('ts_')}" + "_nan" * name.startswith("Ts_"), call(name, x, n), [], f"{sql}(x) {w(n)}")
    for name, shift in {"Ref": 3, "Shift": -2}.items():
        spec(f"ts_{name.lower()}", call(name, x, shift), [], lag("x", shift))
    spec("ts_delta", call("Delta", x, 2), [], f"x - {lag('x', 2)}")
    for name in ("Return", "PctChange"):
        spec(f"ts_{name.lower()}", call(name, x, 2), [("b", lag("x", 2))], "(x - b) / nullif(b, 0)")
    # Moments about the window's mean
    moment = [("k", f"count(x) {w(8)}"), ("l", f"list(x) {w(8)}"), ("m", f"avg(x) {w(8)}"), ("d", "list_transform(list_filter(l, lambda v: v IS NOT NULL), lambda v: v - m)")] + [(f"m{p}", f"list_sum(list_transform(d, lambda v: pow(v, {p}))) / k") for p in (2, 3, 4)]
    spec("ts_skew", call("Skew", x, 8), moment, "CASE WHEN k >= 3 THEN CASE WHEN m2 <= 1e-24 THEN 0 ELSE m3 / pow(m2, 1.5) * sqrt(k * (k - 1)) / (k - 2) END END")
    spec("ts_kurt", call("Kurt", x, 8), moment, "CASE WHEN k >= 4 THEN CASE WHEN m2 <= 1e-24 THEN -3 ELSE ((k + 1) * (m4 / (m2 * m2) - 3) + 6) * (k - 1) / ((k - 2) * (k - 3)) END END")
    spec("ts_prod", call("Prod", lambda: x() / 100, 4), [("p", "x / 100")], f"product(p) {w(4)}")
    spec("ts_count", call("Count", x, n), [], f"count(x) {w(n)}")
    spec("ts_sem", call("Sem", x, n), [], f"stddev_samp(x) {w(n)} / sqrt(nullif(count(x) {w(n)}, 0))")
    spec("ts_first", call("First", x, n), [], f"first_value(x) {w(n)}")
    spec("ts_last", call("Last", x, n), [], f"last_value(x) {w(n)}")

    pair = [("xm", "x"), ("ym", "CASE WHEN x IS NOT NULL THEN y END")]
    spec("ts_corr", call("Corr", x, y, 8), pair, corr_sql("xm", "ym", 8, 3))
    spec("ts_cov", call("Cov", x, y, 8), pair, full(f"CASE WHEN count(xm) {w(8)} >= 3 THEN covar_samp(xm, ym) {w(8)} END", 8))
    spec("ts_beta", call("Beta", x, y, 8), pair, full(f"CASE WHEN count(xm) {w(8)} >= 3 AND max(xm) {w(8)} > min(xm) {w(8)} THEN covar_pop(xm, ym) {w(8)} / var_pop(xm) {w(8)} END", 8))
    listed = [("k", f"count(*) {w(6)}"), ("l", f"list(x) {w(6)}"), ("f", "list_filter(l, lambda v: v IS NOT NULL)")]
    spec("ts_rank", call("Ts_Rank", x, 6), listed, "CASE WHEN k = 6 AND x IS NOT NULL THEN len(list_filter(f, lambda v: v <= x)) / len(f) END")
    at = [*listed, ("p", "abs(x) % 100"), ("l2", f"list(p) {w(6)}"), ("f2", "list_sort(list_filter(l2, lambda v: v IS NOT NULL))"), ("a", "(len(f2) - 1) * p / 100"), ("lo", "CAST(floor(a) AS BIGINT)")]
    spec("ts_quantile", call("Ts_Quantile", lambda: F.abs(x()) % 100, 6), at, "CASE WHEN k = 6 AND p IS NOT NULL THEN f2[lo + 1] + (a - lo) * (f2[least(lo + 1, len(f2) - 1) + 1] - f2[lo + 1]) END")
    for name, label in {"DecayLinear": "decay_linear", "WMA": "wma"}.items():
        spec(label, call(name, x, 6), listed, "CASE WHEN k = 6 THEN list_sum(list_transform(range(1, 7), lambda i: coalesce(l[i], 0) * i / 21.0)) END")
    spec("decay_exp", call("DecayExp", x, 6), listed, "CASE WHEN k = 6 THEN list_sum(list_transform(range(1, 7), lambda i: coalesce(l[i], 0) * pow(0.5, 6 - i))) / 1.96875 END")
    values, fold = ewm_sql("close", 1 / 3)
    spec("ema", call("EMA", lambda: F.col("close"), 5), [("l", values), ("n", "len(l)")], "list_reduce(list_prepend(0, l), lambda s, v: s * (2.0 / 3) + v) / ((1 - pow(2.0 / 3, n)) * 3)")
    spec("ewm", lambda: rolling.ewm(F.col("close"), 1 / 3), [("l", values)], fold.format("l"))
    for name, agg in {"ArgMax": "max", "ArgMin": "min"}.items():
        spec(f"ts_{name.lower()}", call(name, x, 6), [*listed, ("e", f"{agg}(x) {w(6)}")], "CASE WHEN k = 6 AND e IS NOT NULL THEN list_position(l, e) END")
    spec("ts_rollingzscore", call("RollingZScore", x, 6), [], full(f"CASE WHEN stddev_pop(x) {w(6)} > 1e-12 THEN (x - avg(x) {w(6)}) / stddev_pop(x) {w(6)} END", 6))

    day = "OVER (PARTITION BY date)"
    spec("xs_rank", call("Rank", x), [], rank_sql("x"))
    spec("xs_quantile", call("Quantile", x), [], f"({rank_sql('x')}) / (count(*) {day} + 1)")
    spec("xs_decile", call("Decile", x), [], f"CASE WHEN x IS NOT NULL THEN ceil(row_number() OVER (PARTITION BY date ORDER BY x NULLS LAST, symbol) * 10 / count(*) {day}) END")
    spec("xs_scale", call("Scale", x), [("lo", f"min(x) {day}"), ("hi", f"max(x) {day}")], "CASE WHEN x IS NOT NULL THEN CASE WHEN hi - lo > 1e-12 THEN (x - lo) / (hi - lo) ELSE 0.5 END END")
    spec("xs_zscore", call("ZScore", x), [("s", f"stddev_pop(x) {day}"), ("m", f"avg(x) {day}")], "CASE WHEN x IS NOT NULL THEN CASE WHEN s > 1e-12 THEN (x - m) / s ELSE 0 END END")
    spec("xs_rank_pct", lambda: cross.rank_pct(x()), [], pct("x"))
    spec("xs_percent_rank", lambda: cross.percent_rank(x()), [], "percent_rank() OVER (PARTITION BY date ORDER BY x NULLS LAST)")
    spec("winsorize", lambda: cross.winsorize(x(), 0.05), [("lo", f"quantile_cont(x, 0.05) {day}"), ("hi", f"quantile_cont(x, 0.95) {day}")], "CASE WHEN x IS NOT NULL THEN least(greatest(x, lo), hi) END")
    spec("neutralise", lambda: cross.demean(x()), [], f"x - avg(x) {day}")
    spec("neutralise_groups", lambda: cross.demean(x(), cross.AXES, "g"), [("g", "symbol % 3")], "x - avg(x) OVER (PARTITION BY date, g)")
    QUERIES["neutralise_groups"] = lambda spark, sf: with_gaps(bars(spark, sf)).withColumn("g", F.col("symbol") % 3).select("date", "symbol", single(cross.demean(x(), cross.AXES, "g")).alias("value"))
    spec("standardise", lambda: cross.zscore(x(), 1), [("s", f"stddev_samp(x) {day}")], f"CASE WHEN s > 1e-12 THEN (x - avg(x) {day}) / s END")
    # Formula helpers
    six = [("k", f"count(x) {w(6)}"), ("l", f"list(x) {w(6)}"), ("r", "list_reverse(l)"), ("hi", f"max(x) {w(6)}"), ("lo", f"min(x) {w(6)}"), ("n", f"count(*) {w(6)}")]
    spec("fn_tsrank_strict", lambda: rolling.ts_rank_strict(x(), 6), six, "CASE WHEN k = 6 THEN len(list_filter(l, lambda v: v < x)) / 6 END")
    spec("fn_highday", lambda: rolling.days_since_high(x(), 6), six, "CASE WHEN n = 6 AND hi IS NOT NULL THEN list_position(r, hi) - 1 END")
    spec("fn_lowday", lambda: rolling.days_since_low(x(), 6), six, "CASE WHEN n = 6 AND lo IS NOT NULL THEN list_position(r, lo) - 1 END")
    spec("fn_mean_full", lambda: rolling.mean(x(), 6, min_periods=6), six, f"CASE WHEN k = 6 THEN avg(x) {w(6)} END")
    spec("fn_decaylinear_strict", lambda: rolling.decay_linear(x(), 6, missing="null"), six, "CASE WHEN n = 6 AND k = 6 THEN list_sum(list_transform(range(1, 7), lambda i: l[i] * i / 21.0)) END")
    spec("fn_regbeta", lambda: rolling.beta(y(), x(), 6, min_pairs=6), [("xm", "x"), ("ym", "CASE WHEN x IS NOT NULL THEN y END")], full(f"CASE WHEN count(xm) {w(6)} >= 6 AND max(ym) {w(6)} > min(ym) {w(6)} THEN covar_pop(xm, ym) {w(6)} / var_pop(ym) {w(6)} END", 6))


_ops()


# Factors

VW = ("vw", "amount / nullif(volume, 0)")
RET = [("pc", lag("close", 1)), ("ret", "(close - pc) / nullif(pc, 0)")]
BAL = ("bal", "((close - low) - (high - close)) / (high - low + 1e-9)")


def d(x: str, n: int) -> str:
    return f"{x} - {lag(x, n)}"


def ew(name: str, x: str, alpha: float) -> list[tuple[str, str]]:
    values, fold = ewm_sql(x, alpha)
    return [(f"l_{name}", values), (name, fold.format(f"l_{name}"))]


def tsr(name: str, x: str, n: int) -> list[tuple[str, str]]:
    return [(f"l_{name}", f"list({x}) {w(n)}"), (name, f"CASE WHEN count({x}) {w(n)} >= {n} THEN len(list_filter(l_{name}, lambda v: v < {x})) / {n} END")]


_S20 = ("s20", roll("stddev_samp", "ret", 20, 20))
FACTOR_SQL: dict[str, tuple[list[tuple[str, str]], str]] = {
    "alpha001": ([("lv", "ln(volume)"), ("dv", f"round({d('lv', 1)}, 9)"), ("oc", "(close - open) / (open + 1e-9)"), ("p", pct("dv")), ("q0", pct("oc")), ("q", "CASE WHEN p IS NOT NULL THEN q0 END")], f"-({corr_sql('p', 'q', 6, 6)})"),
    "alpha002": ([BAL], f"-({d('bal', 1)})"),
    "alpha003": ([("pc", lag("close", 1)), ("s", "CASE WHEN close = pc THEN 0 WHEN close > pc THEN close - least(low, pc) WHEN pc IS NOT NULL THEN close - greatest(high, pc) END")], f"-({roll('sum', 's', 6, 6)})"),
    "alpha004": ([("m8", roll("avg", "close", 8, 8)), ("s8", roll("stddev_samp", "close", 8, 8)), ("m2", roll("avg", "close", 2, 2)), ("v20", roll("avg", "volume", 20, 20))], "CASE WHEN m8 + s8 < m2 THEN -1 WHEN m2 < m8 - s8 THEN 1 WHEN volume / nullif(v20, 0) >= 1 THEN 1 ELSE -1 END"),
    "alpha005": ([*tsr("a", "volume", 5), *tsr("b", "high", 5), ("c", corr_sql("a", "b", 5, 5))], f"-({roll('max', 'c', 3, 3)})"),
    "alpha006": ([("s", "open * 0.85 + high * 0.15"), ("e", d("s", 4))], f"-({pct('e')})"),
    "alpha007": ([VW, ("a", "CASE WHEN vw IS NOT NULL THEN least(vw - close, 3) END"), ("b", "CASE WHEN vw IS NOT NULL THEN least(-(vw - close), 3) END"), ("c", d("volume", 3))], f"(({pct('a')}) + ({pct('b')})) * ({pct('c')})"),
    "alpha008": ([VW, ("s", "(high + low) / 10 + vw * 0.8"), ("e", d("s", 4))], f"-({pct('e')})"),
    "alpha009": ([("m", "(high + low) / 2"), ("s", f"({d('m', 1)}) * (high - low) / (volume + 1)"), *ew("e", "s", 2 / 7)], "e"),
    "alpha010": ([*RET, _S20, ("s", "CASE WHEN ret < 0 THEN s20 ELSE close END"), ("q", "s * s"), ("m", roll("max", "q", 5, 5))], pct("m")),
    "alpha011": ([BAL, ("s", "bal * volume")], roll("sum", "s", 6, 6)),
    "alpha012": ([VW, ("m", roll("avg", "vw", 10, 10)), ("a", "open - m"), ("b", "abs(close - vw)")], f"-({pct('a')}) * ({pct('b')})"),
    "alpha013": ([VW], "sqrt(high * low) - vw"),
    "alpha014": ([], d("close", 5)),
    "alpha015": ([], f"open / nullif({lag('close', 1)}, 0) - 1"),
    "alpha016": ([VW, ("a", pct("volume")), ("b", pct("vw")), ("c", f"round({corr_sql('a', 'b', 5, 5)}, 9)"), ("e", pct("c"))], f"-({roll('max', 'e', 5, 5)})"),
    "alpha017": ([VW, ("a", "vw - greatest(vw, 15)"), ("p", pct("a")), ("e", d("close", 5))], "pow(p, e)"),
    "alpha018": ([], f"close / nullif({lag('close', 5)}, 0)"),
    "alpha019": ([("p", lag("close", 5))], "CASE WHEN close < p THEN close / nullif(p, 0) - 1 WHEN close = p THEN 0 ELSE 1 - p / nullif(close, 0) END"),
    "alpha020": ([], f"(close / nullif({lag('close', 6)}, 0) - 1) * 100"),
    "alpha021": ([("m", roll("avg", "close", 6, 6)), ("i", f"row_number() {_ISO}::DOUBLE")], f"CASE WHEN count(m) {w(6)} = 6 THEN 1.2 * regr_slope(m, i) {w(6)} END"),
    "alpha022": ([("m", roll("avg", "close", 6, 6)), ("r", "close / nullif(m, 0) - 1"), ("e", d("r", 3)), *ew("z", "e", 1 / 12)], "z"),
    "alpha023": ([*RET, _S20, ("u", "CASE WHEN close > pc THEN s20 * close ELSE 0 END"), ("n", "CASE WHEN close <= pc THEN s20 * close ELSE 0 END")], ""),
    "alpha024": ([("e", d("close", 5)), *ew("z", "e", 1 / 5)], "z"),
    "alpha025": ([*RET, ("v20", roll("avg", "volume", 20, 20)), ("b", "volume / (v20 + 1)"), ("l", f"list(b) {w(9)}"), ("f", "1 - CASE WHEN len(l) = 9 AND len(list_filter(l, lambda v: v IS NOT NULL)) = 9 THEN list_sum(list_transform(range(1, 10), lambda i: l[i] * i / 45.0)) END"), ("e", d("close", 7)), ("s", roll("sum", "ret", 250, 250))], f"-({pct('e')}) * ({pct('f')}) * (1 + ({pct('s')}))"),
    "alpha026": ([VW, ("p", lag("close", 5)), ("q", "CASE WHEN p IS NOT NULL THEN vw END")], f"{roll('sum', 'close', 7, 7)} / 7 - close + ({corr_sql('q', 'p', 230, 230)})"),
    "alpha027": ([("m", f"(close / nullif({lag('close', 3)}, 0) - 1 + close / nullif({lag('close', 6)}, 0) - 1) * 100"), ("l", f"list(m) {w(12)}")], "CASE WHEN len(l) = 12 AND len(list_filter(l, lambda v: v IS NOT NULL)) = 12 THEN list_sum(list_transform(range(1, 13), lambda i: l[i] * i / 78.0)) END"),
    "alpha028": ([("lo", roll("min", "close", 9, 9)), ("hi", roll("max", "close", 9, 9)), ("r", "(close - lo) / (hi - lo + 1e-9) * 100"), *ew("k", "r", 1 / 3), *ew("e", "k", 1 / 3)], "3 * k - 2 * e"),
    "rsi14": ([("m", d("close", 1)), ("u", "CASE WHEN m IS NOT NULL THEN greatest(m, 0) END"), ("n", "CASE WHEN m IS NOT NULL THEN greatest(-m, 0) END"), *ew("a", "u", 1 / 14), *ew("b", "n", 1 / 14)], "coalesce(100 * a / nullif(a + b, 0), 0)"),
    "macd_diff": ([*ew("a", "close", 2 / 13), *ew("b", "close", 2 / 27), ("m", "a - b"), *ew("s", "m", 2 / 10)], "m - s"),
    "bb_pct": ([], f"CASE WHEN count(close) {w(20)} >= 20 THEN (close - avg(close) {w(20)}) / (2 * stddev_pop(close) {w(20)} + 1e-9) END"),
    "atr14": ([("p", lag("close", 1)), ("r", "greatest(high - low, abs(high - p), abs(low - p))"), *ew("a", "r", 1 / 14)], "a"),
    "obv": ([("s", f"coalesce(sign({d('close', 1)}), 0) * volume")], "sum(s) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"),
}
#: alpha023's series have gaps (a move without deviation yet): its fold carries the weights of missing rows.
_GAP = "list_reduce(list_prepend([NULL, 1], list_transform({l}, lambda v: [v, NULL])), lambda s, v: CASE WHEN v[1] IS NULL THEN CASE WHEN s[1] IS NULL THEN s ELSE [s[1], s[2] * 0.95] END WHEN s[1] IS NULL THEN [v[1], 1] ELSE [(s[2] * 0.95 * s[1] + 0.05 * v[1]) / (s[2] * 0.95 + 0.05), 1] END)[1]"
_SOFAR = "OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"
FACTOR_SQL["alpha023"] = (
    [*FACTOR_SQL["alpha023"][0], ("lu", f"list(u::DOUBLE) {_SOFAR}"), ("ln_", f"list(n::DOUBLE) {_SOFAR}"), ("a", _GAP.replace("{l}", "lu")), ("b", _GAP.replace("{l}", "ln_"))],
    "a / (a + b + 1e-9) * 100",
)
_WEEKLY = {"alpha025", "alpha026"}
for _name, (_steps, _sql) in FACTOR_SQL.items():
    spec(_name, partial(lambda n: FACTORS.get(n).column(), _name), _steps, _sql, "week" if _name in _WEEKLY else "month")


# Expressions

EXPRESSIONS: dict[str, tuple[str, list[tuple[str, str]], str]] = {
    "expr_close": ("$close", [], "close"),
    "expr_return": ("($close - Ref($close, 1)) / Ref($close, 1)", [("p", lag("close", 1))], "(close - p) / nullif(p, 0)"),
    "expr_lead": ("Ref($close, -1) / $close - 1", [("p", lag("close", -1))], "p / nullif(close, 0) - 1"),
    "expr_mean_std": ("Mean(Std($close, 20), 60)", [("s", f"stddev_samp(close) {w(20)}")], f"avg(s) {w(60)}"),
    "expr_sum": ("Sum($volume, 5)", [], f"sum(volume) {w(5)}"),
    "expr_max_min": ("($close - Min($low, 9)) / (Max($high, 9) - Min($low, 9))", [("a", f"min(low) {w(9)}"), ("b", f"max(high) {w(9)}")], "(close - a) / nullif(b - a, 0)"),
    "expr_delta": ("Delta(Log($volume), 2)", [("l", "ln(volume)")], d("l", 2)),
    "expr_rank": ("Rank($close / $open)", [("r", "close / nullif(open, 0)")], "percent_rank() OVER (PARTITION BY date ORDER BY r NULLS LAST)"),
    "expr_ts_rank": ("Ts_Rank($close, 6)", [("l", f"list(close) {w(6)}")], "(len(list_filter(l, lambda v: v < close)) + (len(list_filter(l, lambda v: v = close)) + 1) / 2) / len(l)"),
    "expr_corr": ("Corr($close, $volume, 10)", [], partial_corr_sql("close", "volume", 10)),
    "expr_cov": ("Cov($high, $low, 10)", [], f"covar_samp(high, low) {w(10)}"),
    "expr_iif": ("Iif($close > $open, $volume, -$volume)", [], "CASE WHEN close > open THEN volume ELSE -volume END"),
    "expr_count": ("Count($close, 7)", [], f"count(close) {w(7)}"),
    "expr_math": ("Abs($close - $open) + Sign($close - $open) * Sqrt($high) + Power($low, 0.5)", [], "abs(close - open) + sign(close - open) * sqrt(high) + pow(low, 0.5)"),
    "expr_compare": ("($close >= $open) + ($high == $low) * 2", [], "(close >= open)::INT + (high = low)::INT * 2"),
    "expr_precedence": ("-1 * $close + 2 * ($open - $low) / 4 - -$high", [], "-close + 2 * (open - low) / 4 + high"),
    "expr_alpha001": ("-1 * Corr(Rank(Delta(Sqrt($volume), 1)), Rank(($close - $open) / $open), 6)", [("l", "sqrt(volume)"), ("e", d("l", 1)), ("o", "(close - open) / nullif(open, 0)"), ("a", "percent_rank() OVER (PARTITION BY date ORDER BY e NULLS LAST)"), ("b", "percent_rank() OVER (PARTITION BY date ORDER BY o NULLS LAST)")], f"-({partial_corr_sql('a', 'b', 6)})"),
    "expr_aliases": ("MA(Delay($close, 1), 3) + TS_SUM($open, 2)", [("p", lag("close", 1))], f"avg(p) {w(3)} + sum(open) {w(2)}"),
    "expr_library_operator": ("DecayLinear($close, 6)", [("l", f"list(close) {w(6)}")], "CASE WHEN len(l) = 6 THEN list_sum(list_transform(range(1, 7), lambda i: l[i] * i / 21.0)) END"),
}


def expression_query(spark: SparkSession, sf_dir: str, text: str, mode: str = "sql") -> DataFrame:
    rows = ExprEngine(spark, bars(spark, sf_dir), mode=mode).factor(text, ordered=False)
    return rows.select("date", "symbol", single(F.col("factor")).alias("value"))


for _name, (_text, _steps, _sql) in EXPRESSIONS.items():
    QUERIES[_name] = partial(expression_query, text=_text)
    ORACLES[_name] = f"SELECT * FROM ({chain(_steps, _sql)}) WHERE value IS NOT NULL"
QUERIES["expr_strict"] = partial(expression_query, text="Mean(Rank($close), 6)", mode="strict")
ORACLES["expr_strict"] = f"SELECT * FROM ({chain([('r', pct('close'))], roll('avg', 'r', 6, 6))}) WHERE value IS NOT NULL"

_POOL = "SELECT 'big' AS pool_id, s_suppkey AS stock_code, DATE '1992-01-01' + CAST(s_suppkey % 30 AS INTEGER) * 30 AS entry_date, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE DATE '1994-01-01' + CAST(s_suppkey % 50 AS INTEGER) * 30 END AS exit_date FROM supplier WHERE s_suppkey % 2 = 0"


@table_query("expr_universe", f"WITH pool AS ({_POOL}), {bars_sql('month')}, m AS (SELECT * FROM bars WHERE EXISTS (SELECT 1 FROM pool WHERE stock_code = symbol AND date >= entry_date AND (exit_date IS NULL OR date <= exit_date))) SELECT date, symbol, (avg(close) {w(3)})::FLOAT::DOUBLE AS value FROM m")
def expr_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 2 = 0")
    entry = F.date_add(F.lit("1992-01-01").cast("date"), (F.col("s_suppkey") % 30).cast("int") * 30)
    leave = F.when(F.col("s_suppkey") % 3 != 0, F.date_add(F.lit("1994-01-01").cast("date"), (F.col("s_suppkey") % 50).cast("int") * 30))
    pools = supplier.select(F.lit("big").alias("pool_id"), F.col("s_suppkey").alias("stock_code"), entry.alias("entry_date"), leave.alias("exit_date"))
    rows = ExprEngine(spark, bars(spark, sf_dir), universe="big", instruments=pools).factor("Mean($close, 3)", ordered=False)
    return rows.select("date", "symbol", single(F.col("factor")).alias("value"))


@table_query("expr_date_range", f"WITH {bars_sql('month')} SELECT date, symbol, (avg(close) {w(3)})::FLOAT::DOUBLE AS value FROM bars WHERE date >= DATE '1995-01-01' AND date <= DATE '1996-12-31'")
def expr_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ExprEngine(spark, bars(spark, sf_dir)).factor("Mean($close, 3)", "1995-01-01", "1996-12-31", ordered=False)
    return rows.select("date", "symbol", single(F.col("factor")).alias("value"))


# Bars and analysis

for _every in ("month", "week", "day"):
    _n = {"month": "bars_monthly", "week": "bars_weekly", "day": "bars_daily"}[_every]
    QUERIES[_n] = partial(lambda spark, sf, every: bars(spark, sf, every).select("date", "symbol", *[single(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume", "amount")]), every=_every)
    ORACLES[_n] = f"WITH {bars_sql(_every)} SELECT date, symbol, {', '.join(f'{c}::FLOAT::DOUBLE AS {c}' for c in ('open', 'high', 'low', 'close', 'volume', 'amount'))} FROM bars"

_JOINED = f"{bars_sql('month')}, a0 AS (SELECT date, symbol, {d('close', 5)} AS factor, lead(close, 1) {_ISO} / nullif(close, 0) - 1 AS ret FROM bars), a AS (SELECT * FROM a0 WHERE factor IS NOT NULL AND ret IS NOT NULL)"
_CORR = "CASE WHEN max(p) > min(p) AND max(q) > min(q) THEN covar_pop(p, q) / (stddev_pop(p) * stddev_pop(q)) END"
_RANKED = f"r AS (SELECT date, {rank_sql('factor')} AS p, {rank_sql('ret')} AS q FROM a)"
_IC = f"WITH {_JOINED}, {_RANKED}, ic AS (SELECT date, {_CORR} AS ic, count(*) AS n FROM r GROUP BY date HAVING count(*) >= 5)"


def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, symbol, factor (the close less that of five bars before) and ret (to the next bar)."""
    ahead = forward_returns(bars(spark, sf_dir), (1,))
    return ahead.select("date", "symbol", FACTORS.get("alpha014").column().alias("factor"), F.col("ret_1").alias("ret"))


@table_query("ic_momentum", f"{_IC} SELECT date, round(ic, 6) AS ic, n FROM ic")
def ic_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_ic(momentum(spark, sf_dir)).select("date", F.round("ic", 6).alias("ic"), "n")


QUERIES["ic_spearman"], ORACLES["ic_spearman"] = ic_momentum, ORACLES["ic_momentum"]


@table_query("ic_pearson", f"WITH {_JOINED}, r AS (SELECT date, factor AS p, ret AS q FROM a) SELECT date, round({_CORR}, 6) AS ic, count(*) AS n FROM r GROUP BY date HAVING count(*) >= 5")
def ic_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_ic(momentum(spark, sf_dir), method="pearson").select("date", F.round("ic", 6).alias("ic"), "n")


@table_query("ic_summary", f"{_IC} SELECT round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / stddev_samp(ic), 6) AS ic_ir, round(avg((ic > 0)::INT), 6) AS ic_positive_ratio, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) AS t_stat, count(ic) AS n_days FROM ic")
def ic_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = ic_summary(daily_ic(momentum(spark, sf_dir)))
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns if c != "n_days"], "n_days")


@table_query("forward_returns", f"WITH {bars_sql('month')} SELECT date, symbol, {', '.join(f'round(lead(close, {p}) {_ISO} / nullif(close, 0) - 1, 6) AS ret_{p}' for p in (1, 5, 10))} FROM bars")
def forward_returns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forward_returns(bars(spark, sf_dir)).select("date", "symbol", *[F.round(f"ret_{p}", 6).alias(f"ret_{p}") for p in (1, 5, 10)])


_LAYERS = (
    f"WITH {_JOINED}, e AS (SELECT date, [" + ", ".join(f"quantile_cont(factor, {i / 5!r})" for i in range(6)) + "] AS e FROM a GROUP BY date), "
    "u AS (SELECT date, list_sort(list_distinct(e)) AS e FROM e), "
    "l AS (SELECT a.*, 1 + len(list_filter(u.e[2:-2], lambda v: a.factor > v)) AS quantile FROM a JOIN u USING (date) WHERE len(u.e) >= 2), "
    "qr AS (SELECT date, " + ", ".join(f"avg(ret) FILTER (quantile = {i}) AS Q{i}" for i in range(1, 6)) + " FROM l GROUP BY date)"
)


def layers(spark: SparkSession, sf_dir: str) -> LayeredBacktest:
    return LayeredBacktest(momentum(spark, sf_dir), 5)


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in df.columns if c not in keys])


@table_query("layered_returns", f"{_LAYERS} SELECT date, {', '.join(f'round(Q{i}, 6) AS Q{i}' for i in range(1, 6))} FROM qr")
def layered_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(layers(spark, sf_dir).quantile_returns(), "date")


@table_query("layered_long_short", f"{_LAYERS} SELECT date, round(Q5 - Q1, 6) AS long_short FROM qr WHERE Q5 - Q1 IS NOT NULL")
def layered_long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(layers(spark, sf_dir).long_short(), "date")


@table_query("layered_cumulative", f"{_LAYERS}, c AS (SELECT *, Q5 - Q1 AS long_short FROM qr) SELECT date, " + ", ".join(f"CASE WHEN {c} IS NOT NULL AND abs(product(1 + {c}) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1) < 1e30 THEN (product(1 + {c}) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1)::FLOAT::DOUBLE END AS {c}" for c in ("Q1", "Q2", "Q3", "Q4", "Q5", "long_short")) + " FROM c")
def layered_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = layers(spark, sf_dir).cumulative()
    return df.select("date", *[single(F.col(c)).alias(c) for c in df.columns[1:]])


@table_query("layered_stats", f"{_LAYERS}, s AS (SELECT Q5 AS top, Q1 AS bottom, Q5 - Q1 AS long_short FROM qr) SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, round(avg({c}) / stddev_samp({c}), 6) AS {c}_ir" for c in ("top", "bottom", "long_short")) + " FROM s")
def layered_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(layers(spark, sf_dir).stats())


_INSIDE = "rank() OVER (PARTITION BY date, quantile ORDER BY {c}) + (count(*) OVER (PARTITION BY date, quantile, {c}) - 1) / 2.0"


@table_query("layered_ic", f"{_LAYERS}, r AS (SELECT date, quantile, {_INSIDE.format(c='factor')} AS p, {_INSIDE.format(c='ret')} AS q FROM l) SELECT date, quantile, CASE WHEN count(*) >= 2 THEN round({_CORR}, 6) END AS ic FROM r GROUP BY date, quantile")
def layered_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).layered_ic().select("date", F.col("quantile").cast("long").alias("quantile"), F.round("ic", 6).alias("ic"))


@table_query("turnover", f"{_LAYERS}, i AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM l)), s AS (SELECT i.i, i.date, list(symbol) FILTER (quantile = 5) AS s FROM l JOIN i USING (date) GROUP BY ALL), p AS (SELECT b.date, coalesce(b.s, []) AS b, coalesce(a.s, []) AS a FROM s b JOIN s a ON a.i + 1 = b.i) SELECT date, round(1 - len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS turnover FROM p WHERE len(a || b) > 0")
def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(layers(spark, sf_dir).turnover(), "date")


# Preparation and warehouse

@table_query("dropna_stocks", f"WITH {bars_sql('month')}, m AS (SELECT date, symbol, CASE WHEN (symbol + month(date)) % (2 + symbol % 3) = 0 THEN NULL ELSE close END AS close, volume FROM bars), k AS (SELECT symbol FROM m GROUP BY symbol HAVING avg((close IS NOT NULL)::INT) >= 0.6 AND avg((volume IS NOT NULL)::INT) >= 0.6) SELECT date, symbol, round(close, 6) AS close FROM m WHERE symbol IN (SELECT symbol FROM k)")
def dropna_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = F.when((F.col("symbol") + F.month("date")) % (2 + F.col("symbol") % 3) != 0, F.col("close"))
    kept = DataPreprocessor().dropna(bars(spark, sf_dir).withColumn("close", gaps), 0.6)
    return kept.select("date", "symbol", F.round("close", 6).alias("close"))


@table_query("align_fields", f"WITH {bars_sql('month')}, m AS (SELECT date, symbol, CASE WHEN (symbol + month(date)) % 7 = 0 THEN NULL ELSE close - open END AS x FROM bars) SELECT date, symbol, round(x, 6) AS x FROM m WHERE x IS NOT NULL")
def align_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataPreprocessor().align(with_gaps(bars(spark, sf_dir)), ["x"]).select("date", "symbol", F.round("x", 6).alias("x"))


def _stats_sql(keys: str) -> str:
    return (
        f"WITH {bars_sql('week')}, s AS (SELECT symbol, {keys}, min(date) AS first_date, max(date) AS last_date, arg_min(open, date) AS open, arg_max(close, date) AS close, max(high) AS high, min(low) AS low, sum(volume) AS volume, sum(amount) AS amount FROM bars GROUP BY ALL) "
        "SELECT *  REPLACE (open::FLOAT::DOUBLE AS open, close::FLOAT::DOUBLE AS close, high::FLOAT::DOUBLE AS high, low::FLOAT::DOUBLE AS low, volume::FLOAT::DOUBLE AS volume, round(amount, 2) AS amount), ((close - open) / nullif(open, 0) * 100)::FLOAT::DOUBLE AS pct_change FROM s"
    )


def _stats(spark: SparkSession, sf_dir: str, monthly: bool) -> DataFrame:
    df = T.roll_up(bars(spark, sf_dir, "week"), monthly=monthly).drop("avg_turnover")
    whole = {"year": "long", "month": "long"}
    return df.select(*[F.col(c).cast(whole[c]).alias(c) if c in whole else F.round(c, 2).alias(c) if c == "amount" else single(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


QUERIES["monthly_stats"], ORACLES["monthly_stats"] = partial(_stats, monthly=True), _stats_sql("year(date) AS year, month(date) AS month")
QUERIES["yearly_stats"], ORACLES["yearly_stats"] = partial(_stats, monthly=False), _stats_sql("year(date) AS year")


@table_query("calendar_dim", "SELECT date, year(date) AS year, quarter(date) AS quarter, month(date) AS month, week(date) AS week, isodow(date) - 1 AS day_of_week, isodow(date) = 5 AS is_week_end, date = last_day(date) AS is_month_end, date = last_day(date) AND month(date) % 3 = 0 AS is_quarter_end, date = last_day(date) AND month(date) = 12 AS is_year_end FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)")
def calendar_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("date")).distinct()
    parts = calendar_parts(days)
    return parts.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in parts.dtypes])


@table_query("instruments_dim", "SELECT s_name AS symbol, n_name AS industry, r_name AS market, CASE WHEN s_suppkey % 5 = 0 THEN 'DELISTED' ELSE 'ACTIVE' END AS status, CASE WHEN s_suppkey::VARCHAR LIKE '688%' THEN 'STAR' WHEN s_suppkey::VARCHAR LIKE '002%' OR s_suppkey::VARCHAR LIKE '003%' THEN 'SME' WHEN s_suppkey::VARCHAR LIKE '300%' OR s_suppkey::VARCHAR LIKE '301%' THEN 'GEM' WHEN s_suppkey::VARCHAR LIKE '430%' OR s_suppkey::VARCHAR LIKE '830%' THEN 'BSE' ELSE 'MAIN' END AS board_type FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def instruments_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    ods = (
        read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_name").alias("name"), F.col("r_name").alias("market"), F.col("n_name").alias("industry"), F.lit("2000-01-01").cast("date").alias("list_date"), F.when(F.col("s_suppkey") % 5 == 0, F.lit("2020-01-01").cast("date")).alias("delist_date"))
    )
    return T.to_instruments(ods).select(F.col("name").alias("symbol"), "industry", "market", "status", "board_type")


@table_query("index_members", "SELECT s_name AS symbol, n_name AS industry, s_acctbal AS weight FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3 WHERE s_suppkey % 4 = 1")
def index_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey < 3")
    components = s.select(F.lit("IDX").alias("index_code"), F.col("s_name").alias("symbol"), F.col("s_acctbal").alias("weight"), (F.col("s_suppkey") % 4 == 1).alias("is_current"))
    instruments = s.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_name").alias("symbol"), F.col("n_name").alias("industry"))
    return T.index_members(components, instruments, "IDX").select("symbol", "industry", "weight")


_OLD, _NEW = "l_linenumber <= 4", "l_linenumber >= 3"


@table_query("upsert_dedup", f"WITH o AS (SELECT l_orderkey AS k, l_linenumber AS n, sum(l_quantity)::DOUBLE AS v FROM lineitem WHERE {_OLD} GROUP BY ALL), u AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity)::DOUBLE AS v FROM lineitem WHERE {_NEW} GROUP BY ALL) SELECT * FROM u UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.k = o.k AND u.n = o.n)")
def upsert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("v"))
    return T.upsert(rows.where("n <= 4").groupBy("k", "n").agg(F.sum("v").alias("v")), rows.where("n >= 3").groupBy("k", "n").agg(F.max("v").alias("v")), ["k", "n"])


@table_query("anti_insert", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def anti_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return T.insert_missing(have, spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), ["o_orderkey"])


@table_query("latest_rows", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts")
    return T.latest(events, ["user_id"], "ts")


@table_query("validation_rules", f"WITH {bars_sql('day')}, v AS (SELECT count(*) FILTER (high < low OR high < close OR low > open) AS a, count(*) FILTER (volume < 0 OR amount < 0) AS b, count(*) FILTER (close > open) AS c FROM bars) SELECT unnest(['price_order', 'negative_size', 'rising']) AS rule, unnest([a, b, c]) AS failed, unnest([a = 0, b = 0, c = 0]) AS passed FROM v")
def validation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {n: T.RULES[n][1] for n in ("price_order", "negative_size")} | {"rising": "close > open"}
    return T.check_rules(bars(spark, sf_dir, "day"), rules)


@table_query("table_stats", f"WITH {bars_sql('month')} SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date FROM bars")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.extent(bars(spark, sf_dir))


@table_query("column_stats", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS avg, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.column_stats(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_quantity", "l_discount", "l_tax")
    return s.select("column", "n", F.round("avg", 6).alias("avg"), F.round("std", 6).alias("std"), "min", "max")


@table_query("describe", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, {f'round(avg({c}), 6)' if k else 'NULL'} AS mean, {f'round(quantile_cont({c}, 0.5), 6)' if k else 'NULL'} AS q50, count(DISTINCT {c}) AS nunique FROM part" for c, k in (("p_size", 1), ("p_retailprice", 1), ("p_brand", 0))))
def describe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.describe(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size", "p_retailprice", "p_brand"))
    return s.select("column", "count", F.round("mean", 6).alias("mean"), F.round("q50", 6).alias("q50"), "nunique")


@table_query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.duplicate_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@table_query("gap_fill", "WITH h AS (SELECT o_custkey AS symbol, max(o_orderdate) AS last FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY ALL) SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS date, o_orderkey FROM orders LEFT JOIN h ON o_custkey = symbol WHERE last IS NULL OR CAST(o_orderdate AS DATE) > CAST(last AS DATE)")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_orderpriority")
    return T.gap_rows(rows.where("o_orderpriority LIKE '1%'"), rows.drop("o_orderpriority"))


@table_query("freshness", "SELECT user_id, CASE WHEN d <= 1 THEN 'fresh' WHEN d <= 7 THEN 'stale' ELSE 'outdated' END AS status FROM (SELECT user_id, date_diff('day', max(ts)::DATE, (SELECT max(ts)::DATE FROM events)) AS d FROM events GROUP BY user_id)")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.groupBy("user_id").agg(F.to_date(F.max("ts")).alias("last"))
    newest = events.agg(F.to_date(F.max("ts")).alias("today"))
    return last.join(F.broadcast(newest)).select("user_id", T.freshness(F.col("last"), F.col("today")).alias("status"))


@table_query("event_bars", "SELECT CAST(ts AS DATE) AS date, user_id AS symbol, round(arg_min(value, k), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, k), 6) AS close, count(*) AS volume FROM (SELECT *, epoch_us(ts)::HUGEINT * 1000000000 + event_id AS k FROM events) GROUP BY ALL")
def event_bars_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = event_bars(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return b.select(F.to_date("ts").alias("date"), "symbol", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "volume")


store_queries.register(QUERIES, ORACLES, sys.modules[__name__])
