"""The catalogue of factors, and the classes to write one with."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cross, rolling, scalar
from ..functions.axes import AXES, Axes
from ..functions.recurrence import Steps


@dataclass(frozen=True)
class Factor:
    """``build(axes)`` makes the Column; ``needs`` are the panel's fields that it reads."""

    name: str
    build: Callable[[Axes], Column] | None
    needs: tuple[str, ...] = ()
    window: int = 0
    doc: str = ""

    @property
    def implemented(self) -> bool:
        return self.build is not None

    def column(self, axes: Axes = AXES) -> Column:
        """Formulas that are only declared are missing everywhere."""
        return self.build(axes) if self.build else F.lit(None).cast("double")


class FactorRegistry:
    def __init__(self) -> None:
        self._by_name: dict[str, Factor] = {}

    def register(self, factor: Factor) -> Factor:
        if factor.name in self._by_name:
            raise ValueError(f"factor {factor.name} is already registered")
        self._by_name[factor.name] = factor
        return factor

    def get(self, name: str) -> Factor:
        try:
            return self._by_name[name]
        except KeyError:
            raise KeyError(f"no factor {name!r}") from None

    def info(self, name: str) -> dict:
        f = self.get(name)
        return {"name": f.name, "doc": f.doc, "needs": f.needs, "window": f.window, "implemented": f.implemented}

    def list(self, implemented: bool | None = None) -> list[str]:
        return sorted(n for n, f in self._by_name.items() if implemented in (None, f.implemented))

    def count(self) -> int:
        return len(self)

    def clear(self) -> None:
        self._by_name.clear()

    def __len__(self) -> int:
        return len(self._by_name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.list())

    def __contains__(self, name: object) -> bool:
        return name in self._by_name


FACTORS = FactorRegistry()


def register_factor(build: Callable[[Axes], Column] | None = None, *, name: str | None = None, needs: tuple[str, ...] = (), window: int = 0, registry: FactorRegistry | None = None):
    """Decorator for a function axes -> Column, bare or with options."""

    def add(f: Callable[[Axes], Column]):
        (FACTORS if registry is None else registry).register(Factor(name or f.__name__, f, needs, window, (f.__doc__ or "").strip()))
        return f

    return add(build) if build is not None else add


def compute(panel: DataFrame, *names: str, axes: Axes = AXES, registry: FactorRegistry | None = None) -> DataFrame:
    """The panel's keys and one column for each factor, in one pass over shared windows."""
    found = [(FACTORS if registry is None else registry).get(n) for n in names]
    missing = sorted({c for f in found for c in f.needs} - set(panel.columns))
    if missing:
        raise KeyError(f"the panel lacks {', '.join(missing)}")
    with Steps() as steps:
        columns = [f.column(axes).alias(f.name) for f in found]
    return steps.apply(panel).select(axes.date, axes.symbol, *columns)


@dataclass
class FactorResult:
    values: DataFrame
    name: str
    dependencies: list[str] = field(default_factory=list)
    max_window: int = 0
    description: str = ""
    computed_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def validate(self) -> bool:
        """False without rows; ValueError where keys or the factor's column lack, or every value is missing."""
        if len(self.values.columns) < 3 or self.name not in self.values.columns:
            raise ValueError(f"{self.name}: a factor has columns date, symbol and {self.name}")
        rows, there = self.values.agg(F.count(F.lit(1)), F.count(self.name)).first()
        if rows and not there:
            raise ValueError(f"{self.name}: every value is missing")
        return rows > 0


class FactorABC(ABC):
    """A factor as a class: declare ``dependencies`` and write ``compute`` with the helpers below, which need full windows."""

    name: str = ""
    dependencies: tuple[str, ...] = ()
    max_window: int = 0

    def __init__(self, axes: Axes = AXES) -> None:
        self.axes = axes

    @abstractmethod
    def compute(self) -> Column: ...

    def run(self, panel: DataFrame) -> FactorResult:
        missing = [c for c in self.dependencies if c not in panel.columns]
        if missing:
            raise KeyError(f"{self.name}: the panel lacks {', '.join(missing)}")
        with Steps() as steps:
            value = self.compute().alias(self.name)
        values = steps.apply(panel).select(self.axes.date, self.axes.symbol, value)
        return FactorResult(values, self.name, list(self.dependencies), self.max_window, (type(self).__doc__ or "").strip())

    def DELAY(self, x: Column, n: int) -> Column:
        return rolling.ref(x, n, self.axes)

    def DELTA(self, x: Column, n: int) -> Column:
        return rolling.delta(x, n, self.axes)

    def SUM(self, x: Column, n: int) -> Column:
        return rolling.total(x, n, self.axes, n)

    def MEAN(self, x: Column, n: int) -> Column:
        return rolling.mean(x, n, self.axes, n)

    def STD(self, x: Column, n: int) -> Column:
        return rolling.std(x, n, self.axes, n)

    def TSMIN(self, x: Column, n: int) -> Column:
        return rolling.lowest(x, n, self.axes, n)

    def TSMAX(self, x: Column, n: int) -> Column:
        return rolling.highest(x, n, self.axes, n)

    def TSRANK(self, x: Column, n: int) -> Column:
        return rolling.ts_rank_strict(x, n, self.axes)

    def CORR(self, x: Column, y: Column, n: int) -> Column:
        return rolling.corr(x, y, n, self.axes, n)

    def COVIANCE(self, x: Column, y: Column, n: int) -> Column:
        return rolling.cov(x, y, n, self.axes, n)

    def RANK(self, x: Column) -> Column:
        return cross.rank_pct(x, self.axes)

    def ABS(self, x: Column) -> Column:
        return scalar.absolute(x)

    def LOG(self, x: Column) -> Column:
        return scalar.log(x)

    def SIGN(self, x: Column) -> Column:
        return scalar.sign(x)

    def SMA(self, x: Column, n: int, m: int) -> Column:
        return rolling.ewm(x, m / n, False, self.axes)

    def WMA(self, x: Column, n: int) -> Column:
        return rolling.decay_linear(x, n, self.axes, "null")

    def DECAYLINEAR(self, x: Column, n: int) -> Column:
        return rolling.decay_linear(x, n, self.axes, "null")

    def REGBETA(self, y: Column, x: Column, n: int, coded: bool = False) -> Column:
        """Slope of y on x; ``coded`` scales by n / (n - 1), a sample covariance over a population variance."""
        value = rolling.beta(x, y, n, self.axes, n)
        return value * (n / (n - 1)) if coded else value

    def HIGHDAY(self, x: Column, n: int, from_oldest: bool = False) -> Column:
        """Rows since the latest high; ``from_oldest`` its place from the oldest row, 0 first."""
        since = rolling.days_since_high(x, n, self.axes)
        return n - 1 - since if from_oldest else since

    def LOWDAY(self, x: Column, n: int, from_oldest: bool = False) -> Column:
        since = rolling.days_since_low(x, n, self.axes)
        return n - 1 - since if from_oldest else since

    def PROD(self, x: Column, n: int) -> Column:
        return rolling.prod(x, n, self.axes, n)

    def SEQUENCE(self, n: int) -> Column:
        return F.array(*[F.lit(float(i)) for i in range(1, n + 1)])
