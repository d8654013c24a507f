from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaspark.analysis import FactorReport, ICAnalysis, LayeredBacktest, daily_ic, forward_returns
from alphaspark.analysis.report import histogram, moving_average
from alphaspark.analysis.stats import t_test_p
from alphaspark.preprocess import DataPreprocessor

SCHEMA = "date date, symbol string, factor double, ret double"


def frame(spark, n_days=30, n=20, signal=0.3, seed=42, hole=0):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(n_days):
        f = rng.normal(size=n)
        r = signal * f + 0.5 * rng.normal(size=n)
        for i in range(n):
            rows.append((dt.date(2024, 1, 1) + dt.timedelta(days=t), f"S{i:03d}", None if hole and i % hole == 0 else float(f[i]), float(r[i])))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("method", ["spearman", "pearson"])
@pytest.mark.parametrize("hole", [0, 5])
def test_ic_as_pandas(spark, method, hole):
    df = frame(spark, hole=hole)
    got = {r["date"]: r["ic"] for r in daily_ic(df, method=method).collect()}
    rank = (lambda s: s.rank()) if method == "spearman" else (lambda s: s)
    want = {d: rank(g.factor).corr(rank(g.ret)) for d, g in df.toPandas().dropna().groupby("date")}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in want)


def test_ic_summary(spark):
    df = frame(spark)
    r = ICAnalysis(df.select("date", "symbol", "factor"), df.select("date", "symbol", "ret")).run()
    ics = [x["ic"] for x in r.ic_series.collect()]
    assert r.n_days == 30 and r.ic_mean == pytest.approx(np.mean(ics)) and r.ic_std == pytest.approx(np.std(ics, ddof=1)) and r.ic_ir == pytest.approx(r.ic_mean / r.ic_std)
    assert r.ic_mean > 0.3 and r.ic_positive_ratio > 0.9 and r.p_value < 1e-6 and r.rank_ic_mean == r.ic_mean
    assert ICAnalysis(df.select("date", "symbol", "factor"), df.select("date", "symbol", "ret")).summary().count() == 1
    with pytest.raises(ValueError):
        daily_ic(df, method="kendall")


def test_ic_edges(spark):
    few = frame(spark, 4, 4)
    assert daily_ic(few).count() == 0 and daily_ic(frame(spark, 2, 5)).count() == 2
    r = ICAnalysis(few.select("date", "symbol", "factor"), few.select("date", "symbol", "ret")).run()
    assert (r.ic_mean, r.n_days, r.p_value) == (0.0, 0, 0.0)
    constant = frame(spark).withColumn("factor", F.lit(1.0))
    assert daily_ic(constant).where("ic IS NOT NULL").count() == 0
    other = frame(spark).withColumn("symbol", F.concat(F.lit("other"), "symbol"))
    assert ICAnalysis(few.select("date", "symbol", "factor"), other.select("date", "symbol", "ret")).run().n_days == 0


@pytest.mark.parametrize("n", [3, 5, 10])
def test_layers_as_pandas(spark, n):
    df = frame(spark, hole=10)
    pdf = df.toPandas().dropna()
    pdf["q"] = pdf.groupby("date").factor.transform(lambda s: pd.qcut(s, n, labels=False, duplicates="drop") + 1)
    wide = pdf.pivot_table(index="date", columns="q", values="ret", aggfunc="mean")
    layers = LayeredBacktest(df, n)
    got = layers.quantile_returns().toPandas().set_index("date").sort_index()
    np.testing.assert_allclose(got.to_numpy(float), wide.to_numpy(float))
    ls = layers.long_short().toPandas().set_index("date").sort_index().long_short
    np.testing.assert_allclose(ls, wide[n] - wide[1])
    cumulative = layers.cumulative().toPandas().set_index("date").sort_index()
    np.testing.assert_allclose(cumulative.Q1, (1 + wide[1]).cumprod() - 1)
    assert layers.stats_row()["long_short_mean"] == pytest.approx((wide[n] - wide[1]).mean())
    top = pdf[pdf.q == n].groupby("date").symbol.agg(set).sort_index()
    want = [1 - len(a & b) / len(a | b) for a, b in zip(top, top[1:])]
    np.testing.assert_allclose([r["turnover"] for r in layers.turnover().orderBy("date").collect()], want)
    assert layers.layered_ic().select("quantile").distinct().count() == n


def test_layers_of_one_name_and_none(spark):
    assert LayeredBacktest(frame(spark, 10, 1)).quantile_returns().count() == 0
    assert LayeredBacktest(frame(spark, 3, 20).limit(0)).turnover().count() == 0
    with pytest.raises(ValueError):
        LayeredBacktest(frame(spark, 2, 5), 1)


def test_forward_returns(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), "a", float(2**i)) for i in range(6)]
    got = forward_returns(spark.createDataFrame(rows, "date date, symbol string, close double"), (1, 3)).orderBy("date").collect()
    assert [r["ret_1"] for r in got] == [1.0] * 5 + [None] and [r["ret_3"] for r in got] == [7.0] * 3 + [None] * 3


@pytest.mark.parametrize(("t", "df", "p"), [(2.0, 10, 0.07338803477074045), (0.0, 5, 1.0), (-2.042272456, 30, 0.05), (12.706204736, 1, 0.05)])
def test_t(t, df, p):
    assert t_test_p(t, df) == pytest.approx(p, rel=1e-5)


def test_report(spark, tmp_path):
    df = frame(spark, 40)
    panel = df.select("date", "symbol", (F.exp(F.sum("ret").over(__import__("pyspark.sql").sql.Window.partitionBy("symbol").orderBy("date")) * 0.01) * 10).alias("close"))
    text = FactorReport(panel, df.select("date", "symbol", "factor"), "my <factor>", (1, 5)).to_html(str(tmp_path / "r.html"))
    assert (tmp_path / "r.html").read_text() == text and text.count("<svg") == 4 and "my &lt;factor&gt;" in text and "nan" not in text.lower().split("<svg")[0]
    assert moving_average([1, None, 3], 2) == [1, 1, 3] and sum(c for _, c in histogram([1, 2, None, 2], 4)) == 3 and histogram([]) == []


def test_preprocessing(spark):
    df = frame(spark, hole=5)
    p = DataPreprocessor()
    assert p.align(df, ["factor"]).where("factor IS NULL").count() == 0
    assert p.dropna(df, 0.5, ("factor", "ret")).select("symbol").distinct().count() == 16
    assert p.align_frames(df.select("date", "symbol", "factor"), df.where("symbol < 'S005'").select("date", "symbol", "ret")).count() == 150
    w = p.winsorize(df, "ret", 0.1).toPandas().groupby("date").ret.agg(["min", "max"])
    own = df.toPandas().groupby("date").ret
    np.testing.assert_allclose(w["max"], own.quantile(0.9))
    np.testing.assert_allclose(w["min"], own.quantile(0.1))
    s = p.standardise(p.neutralise(df, "ret"), "ret").toPandas().groupby("date").ret
    np.testing.assert_allclose(s.mean(), 0, atol=1e-9)
    np.testing.assert_allclose(s.std(), 1)
