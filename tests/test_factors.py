from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaspark.factors import FACTORS, FactorRegistry, register_factor
from alphaspark.factors.registry import FactorABC, FactorResult, compute
from alphaspark.functions import rolling


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(42)
    rows = []
    for s in range(12):
        close = 20 + s + rng.normal(size=60).cumsum() * 0.3
        for t in range(60):
            c, o = float(close[t]), float(close[t] * (1 + rng.normal() * 0.01))
            v = float(rng.integers(10**6, 10**7))
            rows.append((dt.date(2024, 1, 1) + dt.timedelta(days=t), f"S{s:03d}", o, max(o, c) * 1.01, min(o, c) * 0.99, c, v, v * (o + c) / 2))
    return spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, volume double, amount double").cache()


def test_catalogue():
    assert len(FACTORS.list()) == 191 + 5 and len(FACTORS.list(implemented=True)) == 28 + 5
    assert FACTORS.info("alpha032")["doc"].startswith("RANK(VWAP-CLOSE)") and not FACTORS.info("alpha191")["implemented"]
    with pytest.raises(KeyError):
        FACTORS.get("alpha999")


def test_all_factors_in_one_pass(panel):
    names = [n for n in FACTORS.list(implemented=True) if FACTORS.get(n).window < 230 or n in ("alpha022", "alpha023", "rsi14", "macd_diff", "atr14")]
    out = compute(panel, *names)
    row = out.agg(*[F.count(n).alias(n) for n in names]).first()
    assert all(row[n] > 0 for n in names), {n: row[n] for n in names if not row[n]}
    assert compute(panel, "alpha100").agg(F.count("alpha100")).first()[0] == 0


def test_against_pandas(panel):
    pdf = panel.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    g = pdf.groupby("symbol")
    pct = lambda s: s.groupby(pdf.date).rank(pct=True)
    vwap = pdf.amount / pdf.volume
    mid = pdf.open * 0.85 + pdf.high * 0.15
    want = {
        "alpha006": -pct(mid - mid.groupby(pdf.symbol).shift(4)),
        "alpha012": -pct(pdf.open - vwap.groupby(pdf.symbol).transform(lambda s: s.rolling(10).mean())) * pct((pdf.close - vwap).abs()),
        "alpha014": pdf.close - g.close.shift(5),
        "alpha024": (pdf.close - g.close.shift(5)).groupby(pdf.symbol).transform(lambda s: s.ewm(alpha=0.2, adjust=False).mean()),
        "macd_diff": g.close.transform(lambda s: (m := s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()) - m.ewm(span=9, adjust=False).mean()),
        "obv": (np.sign(g.close.diff()).fillna(0) * pdf.volume).groupby(pdf.symbol).cumsum(),
    }
    got = compute(panel, *want).toPandas().sort_values(["symbol", "date"])
    for name, w in want.items():
        np.testing.assert_allclose(got[name].to_numpy(), w.to_numpy(float), rtol=1e-8, atol=1e-8, err_msg=name)


def test_registering():
    own = FactorRegistry()

    @register_factor(registry=own, name="x", needs=("close",))
    def anything(ax):
        """Twice the close."""
        return F.col("close") * 2

    assert "x" in own and own.info("x")["doc"] == "Twice the close." and list(own) == ["x"] and own.count() == 1
    with pytest.raises(ValueError):
        register_factor(anything, registry=own, name="x")
    own.clear()
    assert len(own) == 0


def test_missing_fields(panel):
    with pytest.raises(KeyError):
        compute(panel.drop("amount"), "alpha013")


def test_class_and_result(panel):
    class Mine(FactorABC):
        """Close over its mean."""

        name, dependencies, max_window = "mine", ("close",), 5

        def compute(self):
            return F.col("close") / self.MEAN(F.col("close"), 5)

    result = Mine().run(panel)
    assert result.validate() and result.max_window == 5 and result.description == "Close over its mean."
    with pytest.raises(KeyError):
        Mine().run(panel.drop("close"))
    with pytest.raises(ValueError):
        FactorResult(panel.select("date", "symbol", F.lit(None).cast("double").alias("f")), "f").validate()
    assert not FactorResult(result.values.limit(0), "mine").validate()
    with pytest.raises(TypeError):
        FactorABC()


def test_helpers(panel):
    class H(FactorABC):
        name = "h"

        def compute(self):
            return self.SUM(F.col("close"), 3)

    h, c, v = H(), F.col("close"), F.col("volume")
    columns = [h.DELAY(c, 1), h.DELTA(c, 2), h.STD(c, 4), h.TSMIN(c, 3), h.TSMAX(c, 3), h.TSRANK(c, 5), h.CORR(c, v, 5), h.COVIANCE(c, v, 5), h.RANK(c), h.ABS(c), h.LOG(c), h.SIGN(c), h.SMA(c, 5, 1), h.WMA(c, 4), h.DECAYLINEAR(c, 4), h.REGBETA(c, v, 5, True), h.HIGHDAY(c, 4), h.LOWDAY(c, 4, True), h.PROD(c / 20, 3)]
    row = panel.select(*[x.cast("double").alias(f"c{i}") for i, x in enumerate(columns)]).agg(*[F.count(f"c{i}") for i in range(len(columns))]).first()
    assert all(n > 0 for n in row)
    both = panel.select(h.HIGHDAY(c, 4).alias("a"), h.HIGHDAY(c, 4, True).alias("b"), rolling.days_since_high(c, 4).alias("d")).dropna()
    assert both.where("a + b != 3 OR a != d").count() == 0
    assert panel.select(h.SEQUENCE(3)).first()[0] == [1.0, 2.0, 3.0]
