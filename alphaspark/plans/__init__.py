"""The expression language: text -> tokens -> tree -> Column."""

from .engine import ExprEngine
from .parser import Node, parse

__all__ = ["ExprEngine", "Node", "parse"]
