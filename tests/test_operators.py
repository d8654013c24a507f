from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaspark.functions import cross, rolling, scalar
from alphaspark.functions.axes import AXES
from alphaspark.functions.recurrence import Steps
from alphaspark.operators import OPERATORS, Operator, OperatorRegistry

NAN = float("nan")
VALUES = [1.0, None, 3.0, None, 5.0, 6.0, None, 8.0, 9.0, 10.0]
START = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(4):
        for t in range(40):
            x = None if (s + t) % 7 == 0 else float(round(rng.normal(), 1))
            rows.append((START + dt.timedelta(days=t), f"s{s}", x, float(rng.normal() + t / 10)))
    return spark.createDataFrame(rows, "date date, symbol string, x double, y double").cache()


def series(spark, values, build):
    rows = [(START + dt.timedelta(days=i), "a", None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "date date, symbol string, x double")
    return [r["v"] for r in df.select("date", build(F.col("x")).cast("double").alias("v")).orderBy("date").collect()]


def by_symbol(panel, column, how):
    """Our column against pandas, symbol by symbol."""
    got = panel.select("date", "symbol", column.cast("double").alias("v")).toPandas().sort_values(["symbol", "date"])["v"].to_numpy()
    pdf = panel.toPandas().sort_values(["symbol", "date"])
    want = np.concatenate([np.asarray(how(g.reset_index(drop=True)), float) for _, g in pdf.groupby("symbol")])
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


X, Y = (lambda: F.col("x")), (lambda: F.col("y"))


@pytest.mark.parametrize("name", ["sum", "mean", "std", "var", "max", "min", "median", "skew", "kurt"])
@pytest.mark.parametrize("n", [2, 5, 9])
def test_rolling_as_pandas(panel, name, n):
    ours = {"sum": rolling.total, "max": rolling.highest, "min": rolling.lowest}.get(name) or getattr(rolling, name)
    need = {"skew": 3, "kurt": 4}.get(name, 1)
    by_symbol(panel, ours(X(), n), lambda g: getattr(g.x.rolling(n, min_periods=min(need, n)), name)() if n >= need else [NAN] * len(g))


@pytest.mark.parametrize("n", [3, 6])
def test_full_windows(panel, n):
    by_symbol(panel, rolling.mean(X(), n, min_periods=n), lambda g: g.x.rolling(n).mean())
    by_symbol(panel, rolling.total(X(), n, min_periods=n), lambda g: g.x.rolling(n).sum())


@pytest.mark.parametrize("alpha", [1 / 3, 0.05, 1.0])
@pytest.mark.parametrize("adjust", [True, False])
def test_ewm_as_pandas(panel, alpha, adjust):
    by_symbol(panel, rolling.ewm(X(), alpha, adjust), lambda g: g.x.ewm(alpha=alpha, adjust=adjust).mean())


def test_corr_and_beta(panel):
    def pair(g, f):
        out = []
        for i in range(len(g)):
            own = g.iloc[max(0, i - 7) : i + 1].dropna()
            out.append(f(own) if i >= 7 and len(own) >= 3 and own.x.std() > 0 else NAN)
        return out

    by_symbol(panel, rolling.corr(X(), Y(), 8), lambda g: pair(g, lambda o: o.x.corr(o.y)))
    by_symbol(panel, rolling.cov(X(), Y(), 8), lambda g: pair(g, lambda o: o.x.cov(o.y)))
    by_symbol(panel, rolling.beta(X(), Y(), 8), lambda g: pair(g, lambda o: o.x.cov(o.y) / o.x.var()))


def test_lags_and_changes(panel):
    by_symbol(panel, rolling.ref(X(), 2), lambda g: g.x.shift(2))
    by_symbol(panel, rolling.ref(X(), -2), lambda g: g.x.shift(-2))
    by_symbol(panel, rolling.ref(X(), 0), lambda g: g.x)
    by_symbol(panel, rolling.delta(X(), 3), lambda g: g.x.diff(3))
    by_symbol(panel, rolling.change(Y(), 2), lambda g: g.y / g.y.shift(2) - 1)


def test_ranks_in_windows(panel):
    def ranks(g, f):
        return [f(g.x.iloc[i - 5 : i + 1], g.x.iloc[i]) if i >= 5 and not math.isnan(g.x.iloc[i]) else NAN for i in range(len(g))]

    by_symbol(panel, rolling.ts_rank(X(), 6), lambda g: ranks(g, lambda v, x: (v <= x).sum() / v.notna().sum()))
    by_symbol(panel, rolling.ts_rank_average(X(), 6, min_periods=1), lambda g: g.x.rolling(6, min_periods=1).rank(pct=True))


def test_cross_section_as_pandas(panel):
    pdf = panel.toPandas().sort_values(["date", "symbol"])
    day = pdf.groupby("date").x
    for column, want in ((cross.rank(X()), day.rank()), (cross.rank_pct(X()), day.rank(pct=True)), (cross.demean(X()), pdf.x - day.transform("mean")), (cross.zscore(X(), 1), (pdf.x - day.transform("mean")) / day.transform("std"))):
        got = panel.select("date", "symbol", column.alias("v")).toPandas().sort_values(["date", "symbol"])["v"].to_numpy()
        np.testing.assert_allclose(got, want.to_numpy(), atol=1e-9)


def test_decays(spark):
    assert series(spark, [1, 2, 3, 4], lambda x: rolling.decay_linear(x, 3)) == [None, None, pytest.approx(14 / 6), pytest.approx(20 / 6)]
    assert series(spark, [1, None, 3], lambda x: rolling.decay_linear(x, 3))[2] == pytest.approx(10 / 6)
    assert series(spark, [1, None, 3], lambda x: rolling.decay_linear(x, 3, missing="null"))[2] is None
    assert series(spark, [1, 2, 4], lambda x: rolling.decay_exp(x, 3))[2] == pytest.approx((0.25 + 1 + 4) / 1.75)


def test_places_of_extremes(spark):
    v = [3, 5, 5, 1, 1, 2]
    assert series(spark, v, lambda x: rolling.arg_max(x, 4)) == [None, None, None, 2, 1, 1]
    assert series(spark, v, lambda x: rolling.arg_min(x, 4)) == [None, None, None, 4, 3, 2]
    assert series(spark, v, lambda x: rolling.days_since_high(x, 4))[3:] == [1, 2, 3]
    assert series(spark, v, lambda x: rolling.days_since_low(x, 4))[3:] == [0, 0, 1]


def test_missing_and_undefined(spark):
    assert series(spark, VALUES, lambda x: rolling.count(x, 3)) == [1, 1, 2, 1, 2, 2, 2, 2, 2, 3]
    assert series(spark, [0.0, -1.0, None, math.e], scalar.log) == [None, None, None, pytest.approx(1)]
    assert series(spark, [4.0, -1.0], scalar.sqrt) == [2, None]
    assert series(spark, [0.5, 1.5, 2.5, -0.5], scalar.round_even) == [0, 2, 2, 0]
    assert series(spark, [7.0, -7.0], lambda x: scalar.mod(x, F.lit(-3.0))) == [-2, -1]
    assert series(spark, [1.0], lambda x: scalar.div(x, F.lit(0.0))) == [None]
    assert series(spark, [1e9, 1.0], scalar.exp) == [None, pytest.approx(math.e)]
    assert series(spark, [5.0, None, -9.0], lambda x: scalar.clip(x, -1, 2)) == [2, None, -1]
    assert series(spark, [2.0] * 6, lambda x: rolling.skew(x, 4))[3:] == [0, 0, 0]
    assert series(spark, [2.0] * 6, lambda x: rolling.kurt(x, 4))[3:] == [-3, -3, -3]
    assert series(spark, [2.0] * 4, lambda x: rolling.rolling_zscore(x, 3)) == [None] * 4
    assert series(spark, [2.0] * 4, lambda x: rolling.corr(x, x, 3)) == [None] * 4
    assert series(spark, [], lambda x: rolling.mean(x, 3)) == []


def test_qcut(spark):
    rng = np.random.default_rng(0)
    rows = [(START, f"s{i}", float(v)) for i, v in enumerate(rng.normal(size=53))] + [(START + dt.timedelta(1), f"s{i}", 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "date date, symbol string, x double").select("date", "symbol", "x", cross.qcut(F.col("x"), 5).alias("q")).toPandas()
    own = df[df.date == START]
    assert (own.q.to_numpy() == pd.qcut(own.x, 5, labels=False).to_numpy() + 1).all() and df[df.date != START].q.isna().all()


def test_registry():
    assert len(OPERATORS) == 66 and {o.kind for o in OPERATORS} == {"scalar", "rolling", "cross"}
    assert "mean" in OPERATORS and "Mean" in OPERATORS and "nope" not in OPERATORS
    with pytest.raises(KeyError):
        OPERATORS.get("nope")
    own = OperatorRegistry()
    own.register(Operator("Twice", "scalar", 1, lambda x: x * 2))
    with pytest.raises(ValueError):
        own.register(Operator("twice", "scalar", 1, lambda x: x))
    with pytest.raises(ValueError):
        OPERATORS.get("Mean")(1)
    with pytest.raises(ValueError):
        OPERATORS.get("Mean")(1, 2.5)
    with pytest.raises(ValueError):
        rolling.ewm(None, 0)


def test_a_mean_outlives_a_thousand_missing_rows(spark):
    """As pandas has it, whatever the batches are cut at: missing rows show the last mean, weights decay over them."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    frames = []
    for s, n in (("a", 1500), ("b", 7), ("c", 2500), ("d", 3)):
        x = rng.normal(100, 3, n)
        x[5:1005] = np.nan
        if s == "d":
            x[:] = np.nan
        frames.append(pd.DataFrame({"symbol": s, "date": pd.date_range("2015-01-01", periods=n).date, "x": x}))
    pdf = pd.concat(frames)
    df = spark.createDataFrame([(s, d, None if v != v else float(v)) for s, d, v in pdf.itertuples(index=False)], "symbol string, date date, x double").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("97", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for alpha in (0.9, 0.1):
                for adjust in (False, True):
                    with Steps() as steps:
                        one_pass = rolling.ewm(X(), alpha, adjust).alias("z")
                    both = steps.apply(df).select("symbol", "date", rolling.ewm(X(), alpha, adjust).alias("y"), one_pass).toPandas().sort_values(["symbol", "date"])
                    want = pdf.groupby("symbol").x.transform(lambda g: g.ewm(alpha=alpha, adjust=adjust).mean()).to_numpy()  # noqa: B023
                    np.testing.assert_allclose(both["y"].to_numpy(), want, rtol=1e-9)
                    np.testing.assert_allclose(both["z"].to_numpy(), want, rtol=1e-9)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_long_windows_by_sums_so_far(panel):
    for n in (5, 40):
        ours = panel.select("symbol", "date", rolling.total(X(), n, min_periods=2).alias("a"), rolling.long_total(X(), n, min_periods=2).alias("b"), rolling.corr(X(), F.lag("x", 2).over(AXES.history()), n, min_pairs=n).alias("c"), rolling.long_corr(X(), F.lag("x", 2).over(AXES.history()), n).alias("d")).collect()
        for r in ours:
            assert (r["a"] is None) == (r["b"] is None) and (r["c"] is None) == (r["d"] is None)
            assert r["a"] is None or r["b"] == pytest.approx(r["a"], abs=1e-9)
            assert r["c"] is None or r["d"] == pytest.approx(r["c"], abs=1e-7)


def test_long_windows_of_constants_and_jumps(spark):
    rows = [("s", i, 1e6 if i < 30 else 5.0 + i % 3 if i < 60 else 7.0, float(i % 5)) for i in range(100)]
    got = spark.createDataFrame(rows, "symbol string, date int, x double, y double").select("date", rolling.corr(F.col("x"), F.col("y"), 10, min_pairs=10).alias("a"), rolling.long_corr(F.col("x"), F.col("y"), 10).alias("b")).orderBy("date").collect()
    for r in got:
        assert (r["a"] is None) == (r["b"] is None) and (r["a"] is None or r["b"] == pytest.approx(r["a"], abs=1e-3))


def test_recurrences_beside_and_above_windows_of_dates(panel):
    """A recurrence has its symbols' order whatever else a select sorts by, and recurrences of recurrences too."""
    with Steps() as steps:
        mean = rolling.ewm(cross.rank_pct(X()), 0.3)
        twice = rolling.ewm(mean + rolling.mean(Y(), 3), 0.5)
        value = cross.rank_pct(twice) + rolling.mean(mean, 4)
    got = steps.apply(panel).select("symbol", "date", value.alias("v"), cross.rank_pct(Y()).alias("r")).toPandas().sort_values(["symbol", "date"])
    pdf = panel.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    g = lambda s: s.groupby(pdf.symbol)
    first = g(pdf.x.groupby(pdf.date).rank(pct=True)).transform(lambda s: s.ewm(alpha=0.3, adjust=False).mean())
    second = g(first + g(pdf.y).transform(lambda s: s.rolling(3, min_periods=1).mean())).transform(lambda s: s.ewm(alpha=0.5, adjust=False).mean())
    want = second.groupby(pdf.date).rank(pct=True) + g(first).transform(lambda s: s.rolling(4, min_periods=1).mean())
    np.testing.assert_allclose(got["v"].to_numpy(), want.to_numpy(), rtol=1e-9)
    assert got.columns.tolist() == ["symbol", "date", "v", "r"]
