"""Named operators: how many series they take, whether they need a window, and what builds them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column

from ..functions import cross, rolling, scalar
from ..functions.axes import AXES, Axes


@dataclass(frozen=True)
class Operator:
    """``build(*series, window, axes=..., **options)``; no window for scalar and cross-sectional operators.  ``bounded``: a rolling
    operator that reads no more rows than its window tells."""

    name: str
    kind: str  # scalar, rolling or cross
    n_series: int
    build: Callable[..., Column]
    window: bool = False
    semantics: str = ""
    bounded: bool = False

    def __call__(self, *args, axes: Axes = AXES, **options) -> Column:
        wanted = self.n_series + self.window
        if len(args) != wanted:
            raise ValueError(f"{self.name} takes {self.n_series} series" + " and a window" * self.window + f", {len(args)} arguments given")
        if self.window and (not isinstance(args[-1], int) or isinstance(args[-1], bool)):
            raise ValueError(f"{self.name}: the window must be a whole number, not {args[-1]!r}")
        return self.build(*args, **options) if self.kind == "scalar" else self.build(*args, axes=axes, **options)


class OperatorRegistry:
    """name -> Operator; further ones can be registered and then used in expressions."""

    def __init__(self) -> None:
        self._by_name: dict[str, Operator] = {}

    def register(self, operator: Operator, replace: bool = False) -> Operator:
        key = operator.name.lower()
        if not key:
            raise ValueError("an operator needs a name")
        if key in self._by_name and not replace:
            raise ValueError(f"operator {operator.name} is already registered")
        self._by_name[key] = operator
        return operator

    def get(self, name: str) -> Operator:
        try:
            return self._by_name[name.lower()]
        except KeyError:
            raise KeyError(f"no operator {name!r}") from None

    def list_operators(self, kind: str | None = None) -> list[str]:
        return sorted(o.name for o in self._by_name.values() if kind in (None, o.kind))

    def __contains__(self, name: object) -> bool:
        return isinstance(name, str) and name.lower() in self._by_name

    def __iter__(self) -> Iterator[Operator]:
        return iter(self._by_name.values())

    def __len__(self) -> int:
        return len(self._by_name)


OPERATORS = OperatorRegistry()


def _add(kind: str, n_series: int, window: bool, **builders: Callable[..., Column]) -> None:
    for name, build in builders.items():
        OPERATORS.register(Operator(name, kind, n_series, build, window, (build.__doc__ or "").strip(), build is not rolling.ema))


_add("scalar", 1, False, Abs=scalar.absolute, Sign=scalar.sign, Log=scalar.log, LogN=scalar.log_n, Sqrt=scalar.sqrt, Square=scalar.square, Power=scalar.power, Exp=scalar.exp)
_add("scalar", 1, False, Tanh=scalar.tanh, Sigmoid=scalar.sigmoid, Sin=scalar.sin, Cos=scalar.cos, Floor=scalar.floor, Ceil=scalar.ceil, Round=scalar.round_even, Clip=scalar.clip)
_add("scalar", 2, False, Add=scalar.add, Sub=scalar.sub, Mul=scalar.mul, Div=scalar.div, Mod=scalar.mod)
_add("scalar", 3, False, Iif=scalar.pick, Where=scalar.pick)
_add("scalar", 1, False, IsNa=scalar.is_na, NotNa=scalar.not_na, FillNa=scalar.fill_na)
_add("rolling", 1, True, Ref=rolling.ref, Delta=rolling.delta, Sum=rolling.total, Mean=rolling.mean, Std=rolling.std, Var=rolling.var, Max=rolling.highest, Min=rolling.lowest)
_add("rolling", 1, True, Median=rolling.median, Skew=rolling.skew, Kurt=rolling.kurt, Prod=rolling.prod, Count=rolling.count, Sem=rolling.sem, First=rolling.first, Last=rolling.last)
_add("rolling", 2, True, Corr=rolling.corr, Cov=rolling.cov, Beta=rolling.beta)
_add("cross", 1, False, Rank=cross.rank, Quantile=cross.quantile, Decile=cross.decile, Scale=cross.scale, ZScore=cross.zscore)
_add("rolling", 1, True, Ts_Rank=rolling.ts_rank, Ts_Quantile=rolling.ts_quantile, DecayLinear=rolling.decay_linear, DecayExp=rolling.decay_exp, WMA=rolling.decay_linear, EMA=rolling.ema, SMA=rolling.mean)
_add("rolling", 1, True, Ts_Max=rolling.highest, Ts_Min=rolling.lowest, ArgMax=rolling.arg_max, ArgMin=rolling.arg_min, Shift=rolling.ref, RollingSum=rolling.total)
_add("rolling", 1, True, RollingZScore=rolling.rolling_zscore, Return=rolling.change, PctChange=rolling.change)
