"""Scalar operators.  Missing is NULL; results out of the domain are NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .axes import finite


def absolute(x: Column) -> Column:
    return F.abs(x)


def sign(x: Column) -> Column:
    return F.signum(x)


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log_n(x: Column, base: float = 10.0) -> Column:
    return log(x) / math.log(base)


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def square(x: Column) -> Column:
    return x * x


def power(x: Column, p: float | Column = 2.0) -> Column:
    return finite(F.pow(x, p if isinstance(p, Column) else F.lit(float(p))))


def exp(x: Column) -> Column:
    return finite(F.exp(x))


def tanh(x: Column) -> Column:
    return F.tanh(x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sin(x: Column) -> Column:
    return F.sin(x)


def cos(x: Column) -> Column:
    return F.cos(x)


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def round_even(x: Column, decimals: int = 0) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(x, decimals)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def add(x: Column, y: Column) -> Column:
    return x + y


def sub(x: Column, y: Column) -> Column:
    return x - y


def mul(x: Column, y: Column) -> Column:
    return x * y


def div(x: Column, y: Column) -> Column:
    return F.try_divide(x, y)


def mod(x: Column, y: Column) -> Column:
    """Floored modulo: the sign of the divisor; NULL for a divisor of 0."""
    return x - y * F.floor(F.try_divide(x, y))


def pick(condition: Column, x: Column, y: Column) -> Column:
    """x where the condition holds (a missing one doesn't), else y."""
    return F.when(condition, x).otherwise(y)


def is_na(x: Column) -> Column:
    return x.isNull().cast("double")


def not_na(x: Column) -> Column:
    return x.isNotNull().cast("double")


def fill_na(x: Column, value: float = 0.0) -> Column:
    return F.coalesce(x, F.lit(float(value)))


def both(x: Column, y: Column, how) -> Column:
    """how(x, y) where neither is missing: greatest and least skip NULLs otherwise."""
    return F.when(x.isNotNull() & y.isNotNull(), how(x, y))
