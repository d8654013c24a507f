from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from alphaspark.operators import OPERATORS, Operator
from alphaspark.plans import ExprEngine, parse
from alphaspark.plans.compiler import reach


@pytest.fixture(scope="module")
def bars(spark):
    rows = []
    for s, base in (("SH.600000", 10.0), ("SH.600001", 20.0)):
        for i in range(10):
            o = base + i
            rows.append((dt.date(2024, 1, 1) + dt.timedelta(days=i), s, o, o + 2, o - 1, o + 1, 1000.0 * (i + 1), (o + 1) * 1000 * (i + 1)))
    return spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, volume double, amount double").cache()


@pytest.fixture
def engine(spark, bars):
    return ExprEngine(spark, bars)


def values(df, symbol="SH.600000"):
    return [r["factor"] for r in df.where(F.col("symbol") == symbol).orderBy("date").collect()]


@pytest.mark.parametrize("text", ["$foo", "$close & $open", "close", "Mean($close", "($close", "$close $open", "1 +", "", "Mean(,)", "$close > 1 > 2", "1..2", "@"])
def test_rejected(text):
    with pytest.raises(SyntaxError):
        parse(text)


@pytest.mark.parametrize("text", ["Nope($close)", "Mean()", "Mean($close, $open)", "Mean($close, 1.5)", "Mean($close, 0)", "Corr($close)", "Log($close, $open)", "Mean($close, 5, 6)"])
def test_wrong_calls(engine, text):
    with pytest.raises(ValueError):
        engine.factor(text)


def test_tree():
    assert str(parse("-$close * 2 + Mean($OPEN, 3)")) == "binary(+, binary(*, unary(-, column(close)), literal(2.0)), call(Mean, column(open), literal(3.0)))"
    assert parse("1 - 2 - 3").children[0].value == "-" and parse("2 * (1 + 3)").value == "*"
    assert reach(parse("Mean(Ref($close, 5), 20) + Delta($open, 2)")) == 25


def test_arithmetic(engine):
    assert values(engine.factor("($close - Ref($close, 1)) / Ref($close, 1)")) == [pytest.approx(1 / (11 + i)) for i in range(9)]
    assert values(engine.factor("$close / ($open - $open)")) == []
    assert values(engine.factor("Iif($close > 15, 1, 0)")) == [0] * 5 + [1] * 5
    assert values(engine.factor("Iif($close > 15, 1)")) == [1] * 5
    assert values(engine.factor("Ref($close, -1)")) == [12.0 + i for i in range(9)]
    assert values(engine.factor("$close > 15")) == [0.0] * 5 + [1.0] * 5


def test_modes(spark, bars):
    assert len(values(ExprEngine(spark, bars).factor("Mean($close, 4)"))) == 10
    assert values(ExprEngine(spark, bars, mode="strict").factor("Mean($close, 4)")) == [12.5 + i for i in range(7)]
    assert set(values(ExprEngine(spark, bars).factor("Rank($close)"))) == {0.0} and set(values(ExprEngine(spark, bars, mode="strict").factor("Rank($close)"))) == {0.5}
    with pytest.raises(ValueError):
        ExprEngine(spark, bars, mode="loose").factor("$close")


def test_nesting(engine):
    out = engine.factor("-1 * Corr(Rank(Delta(Log($volume), 1)), Rank(($close - $open) / $open), 6)")
    assert out.columns == ["date", "symbol", "factor"] and out.count() == 0  # ranks of two names are constant
    assert len(values(engine.factor("Mean(Std(Mean($close, 2), 3), 4)"))) == 9


def test_range_and_lookback(engine):
    assert values(engine.factor("Mean($close, 3)", "2024-01-05", "2024-01-06")) == [15.0, 15.5]
    assert values(engine.factor("Mean($close, 3)", "2024-01-05", "2024-01-06", lookback=True)) == [14.0, 15.0]


def test_untraded_rows_are_left_out_before_windows(spark, bars):
    paused = bars.withColumn("volume", F.when(F.dayofmonth("date") == 3, 0).otherwise(F.col("volume")))
    assert values(ExprEngine(spark, paused).factor("Ref($close, 1)"))[:3] == [11.0, 12.0, 14.0]


def test_universe(spark, bars):
    pools = spark.createDataFrame([("p", "SH.600000", dt.date(2024, 1, 3), dt.date(2024, 1, 5)), ("p", "SH.600001", dt.date(2024, 1, 8), None), ("q", "SH.600000", dt.date(2024, 1, 1), None)], "pool_id string, stock_code string, entry_date date, exit_date date")
    engine = ExprEngine(spark, bars, instruments=pools)
    assert values(engine.factor("Mean($close, 2)", universe="p")) == [13.0, 13.5, 14.5]
    assert len(values(engine.factor("$close", universe="p"), "SH.600001")) == 3
    pools.createOrReplaceTempView("pools")
    assert engine.factor("$close", universe="SELECT stock_code FROM pools WHERE pool_id = 'q'").select("symbol").distinct().count() == 1
    assert engine.factor("$close", universe=pools.where("pool_id = 'q'").select("stock_code")).count() == 10


def test_other_names_views_and_explain(spark, bars):
    bars.withColumnsRenamed({"date": "day", "symbol": "code"}).createOrReplaceTempView("daily_kline")
    engine = ExprEngine(spark, "daily_kline", date="day", symbol="code")
    assert engine.factor("Mean($close, 2)").columns == ["day", "code", "factor"]
    text = engine.explain("Mean($close, 2)")
    assert "Tree: call(Mean" in text and "Window" in text


def test_many_features_share_their_shuffles(engine):
    df = engine.features({"a": "Mean($close, 3)", "b": "Std($close, 5)", "c": "Ref($open, 2)", "r": "Rank($close)"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and df.columns == ["date", "symbol", "a", "b", "c", "r"]


def test_registered_operators_work_in_expressions(engine):
    OPERATORS.register(Operator("Half", "scalar", 1, lambda x: x / 2), replace=True)
    try:
        assert values(engine.factor("Half($close)"))[0] == 5.5
    finally:
        OPERATORS._by_name.pop("half")


def test_lookback_counts_a_symbol_s_own_rows(spark):
    """A symbol suspended for 20 days has its window of traded rows, and an exponential mean its whole history."""
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    rows = [(day(i), s, *[float(p)] * 4, 0.0 if s == "b" and 20 <= i < 40 else 100.0, 1.0) for s, k in (("a", 1), ("b", 2), ("c", 3)) for i, p in enumerate((j * k * 7) % 31 + 5 for j in range(50))]
    df = spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, volume double, amount double")
    engine = ExprEngine(spark, df, mode="strict")
    for text in ("Mean($close, 5)", "EMA($close, 5)", "Mean(Rank(Mean($close, 3)), 4)", "Ref($close, 2) + Std(Delta($close, 3), 6)"):
        want = [tuple(r) for r in engine.factor(text).where("date >= DATE'2024-02-10'").collect()]
        got = [tuple(r) for r in engine.factor(text, "2024-02-10", lookback=True).collect()]
        assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want]) and got
    plan = engine.factor("Mean($close, 5)", "2024-02-10", lookback=True)
    assert plan.count() > 0


def test_reach():
    from alphaspark.plans.compiler import reach_levels

    assert reach_levels(parse("Mean(Rank(Mean($close, 20)), 5) + Delta($close, 30)")) == (30, 20)
    assert reach_levels(parse("Ref($close, -3) + Abs($open)")) == (0,) and reach(parse("EMA($close, 5)")) == float("inf")
