"""A layered warehouse of Parquet tables: ODS (raw), DWD (cleaned), APP (aggregated), META."""

from .store import Store

__all__ = ["Store"]
