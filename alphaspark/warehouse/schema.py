"""Tables of the warehouse: layer, columns with comments, key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType, _parse_datatype_string


@dataclass(frozen=True)
class Table:
    name: str
    ddl: str
    key: tuple[str, ...]
    layer: str
    about: str

    def schema(self) -> StructType:
        return _parse_datatype_string(self.ddl)  # type: ignore[return-value]


_OHLCV = "date date, symbol string, open double, high double, low double, close double, volume double, amount double"
_ALL = (
    Table("daily_ohlcv", f"{_OHLCV}, factor double", ("date", "symbol"), "simple", "daily bars"),
    Table("instruments", "symbol string, name string, market string, industry string, list_date date, delist_date date", ("symbol",), "simple", "listed instruments"),
    Table("calendars", "date date, is_trading_day boolean", ("date",), "simple", "trading calendar"),
    Table("factor_cache", "name string, expression string, date date, symbol string, value double", ("name", "date", "symbol"), "simple", "computed factors"),
    Table("ods_calendars", "source string, date date, is_trading_day boolean, fetched_at timestamp", ("source", "date"), "ods", "calendar as delivered"),
    Table("ods_instruments", "source string, symbol string, name string, market string, industry string, list_date date, delist_date date, fetched_at timestamp", ("source", "symbol"), "ods", "instruments as delivered"),
    Table("ods_index_components", "source string, index_code string, symbol string, in_date date, weight double, fetched_at timestamp", ("source", "index_code", "symbol", "in_date"), "ods", "index members as delivered"),
    Table("ods_daily_ohlcv", f"source string, {_OHLCV}, turnover double, adjust_flag string, fetched_at timestamp", ("source", "date", "symbol", "adjust_flag"), "ods", "bars as delivered"),
    Table("dwd_calendars", "date date, is_trading_day boolean, year int, quarter int, month int, week int, day_of_week int, is_week_end boolean, is_month_end boolean, is_quarter_end boolean, is_year_end boolean", ("date",), "dwd", "calendar with its parts"),
    Table("dwd_instruments", "symbol string, name string, market string, industry string, board_type string, list_date date, delist_date date, status string", ("symbol",), "dwd", "instruments with board and status"),
    Table("dwd_index_components", "index_code string, symbol string, in_date date, out_date date, weight double, is_current boolean", ("index_code", "symbol", "in_date"), "dwd", "index members, current ones marked"),
    Table("dwd_daily_ohlcv", f"{_OHLCV}, turnover double, factor double, raw_close double", ("date", "symbol"), "dwd", "adjusted bars"),
    Table("app_monthly_stats", "symbol string, year int, month int, first_date date, last_date date, open double, close double, high double, low double, volume double, amount double, avg_turnover double, pct_change double", ("symbol", "year", "month"), "app", "monthly roll-up"),
    Table("app_yearly_stats", "symbol string, year int, first_date date, last_date date, open double, close double, high double, low double, volume double, amount double, avg_turnover double, pct_change double", ("symbol", "year"), "app", "yearly roll-up"),
    Table("app_index_daily", "index_code string, date date, close double, members bigint", ("index_code", "date"), "app", "index levels"),
    Table("app_index_members", "index_code string, date date, symbol string, weight double", ("index_code", "date", "symbol"), "app", "members by day"),
    Table("app_limit_up_down", "date date, symbol string, limit_kind string", ("date", "symbol"), "app", "bars at their limits"),
    Table("app_factors_registry", "name string, expression string, description string", ("name",), "app", "known factors"),
    Table("app_factors_values", "name string, date date, symbol string, value double", ("name", "date", "symbol"), "app", "values of factors"),
    Table("app_factors_ic", "name string, date date, ic double, n bigint", ("name", "date"), "app", "information coefficients"),
    Table("meta_table_params", "table_name string, start_date date, end_date date, row_count bigint, updated_at timestamp", ("table_name",), "meta", "extent of each table"),
    Table("meta_update_log", "id string, table_name string, status string, row_count bigint, message string, started_at timestamp, finished_at timestamp", ("id",), "meta", "runs"),
    Table("meta_validation_log", "id string, table_name string, rule string, failed bigint, passed boolean, details string, checked_at timestamp", ("id",), "meta", "results of the rules"),
    Table("meta_data_sources", "name string, priority int, is_active boolean, config string", ("name",), "meta", "sources by priority"),
    Table("meta_ods_tables", "source string, table_type string, table_name string, created_at timestamp", ("source", "table_type"), "meta", "ODS tables of each source"),
)
TABLES: dict[str, Table] = {t.name: t for t in _ALL}


def data_dictionary(name: str | None = None) -> dict:
    """Layer, purpose, key and column types of one table or of all."""
    one = lambda t: {"layer": t.layer, "about": t.about, "key": list(t.key), "columns": {f.name: f.dataType.simpleString() for f in t.schema().fields}}
    return one(TABLES[name]) if name else {n: one(t) for n, t in TABLES.items()}
