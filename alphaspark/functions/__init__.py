"""Column builders: scalar, rolling (by symbol) and cross-sectional (by date)."""
