"""The operator library by name."""

from .library import OPERATORS, Operator, OperatorRegistry

__all__ = ["OPERATORS", "Operator", "OperatorRegistry"]
