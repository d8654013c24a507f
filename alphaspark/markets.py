"""Exchanges and indexes."""

from __future__ import annotations

from enum import Enum

#: Code and exchange of each index.
INDEXES = {"SSE50": ("000016", "SH"), "CSI300": ("000300", "SH"), "CSI500": ("000905", "SH"), "CSI1000": ("000852", "SH")}

Market = Enum("Market", {m: m for m in ("SSE", "SZSE", "BSE")})
IndexCode = Enum("IndexCode", {name: ".".join(parts) for name, parts in INDEXES.items()})


def full_code(index: IndexCode) -> str:
    """Code with exchange, as in 000300.SH."""
    return index.value
