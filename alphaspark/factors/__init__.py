"""Named factors over a panel."""

from . import alphas, technical  # noqa: F401  they register their factors
from .registry import FACTORS, FactorRegistry, register_factor

__all__ = ["FACTORS", "FactorRegistry", "register_factor"]
