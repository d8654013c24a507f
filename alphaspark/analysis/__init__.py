"""Information coefficients, quantile backtests and reports."""

from .ic import ICAnalysis, ICResult, daily_ic, forward_returns, ic_summary
from .layered import LayeredBacktest
from .report import FactorReport

__all__ = ["FactorReport", "ICAnalysis", "ICResult", "LayeredBacktest", "daily_ic", "forward_returns", "ic_summary"]
