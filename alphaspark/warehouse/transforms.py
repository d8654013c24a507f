"""The warehouse's transforms as functions on DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..calendar_tools import calendar_parts

ADJUSTED = "2"


def latest(df: DataFrame, key: Sequence[str], newest: str) -> DataFrame:
    """One row a key: the one with the greatest ``newest``, equal ones by all columns."""
    rest = [c for c in df.columns if c not in key and c != newest]
    best = df.groupBy(*key).agg(F.max(F.struct(newest, *rest)).alias("__best"))
    return best.select(*[F.col(c) if c in key else F.col(f"__best.{c}").alias(c) for c in df.columns])


def one_a_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row a key, the greatest of its rows by all other columns in order, so that reruns agree."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    best = df.groupBy(*key).agg(F.max(F.struct(*rest)).alias("__best"))
    return best.select(*[F.col(c) if c in key else F.col(f"__best.{c}").alias(c) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` (unique in ``key``) added, or in place of those with the same key;
    columns in ``keep`` stay as the old row has them.  Columns are matched by name; keys aren't null."""
    new = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in old.dtypes])
    if keep:
        was = old.select(*[F.col(c).alias(f"__k_{c}") for c in key], F.lit(True).alias("__there"), *[F.col(c).alias(f"__o_{c}") for c in keep])
        on = [F.col(c) == F.col(f"__k_{c}") for c in key]
        new = new.join(was, on, "left").select(*[F.when(F.col("__there"), F.col(f"__o_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in old.columns])
    return old.join(new, list(key), "left_anti").select(*old.columns).unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of ``new`` whose key ``old`` lacks."""
    return new.join(old, list(key), "left_anti")


def board_type(symbol: Column) -> Column:
    def starts(*prefixes: str) -> Column:
        out = symbol.startswith(prefixes[0])
        for p in prefixes[1:]:
            out = out | symbol.startswith(p)
        return out

    return F.when(starts("688"), "STAR").when(starts("002", "003"), "SME").when(starts("300", "301"), "GEM").when(starts("430", "830"), "BSE").otherwise("MAIN")


def to_calendars(ods: DataFrame) -> DataFrame:
    return calendar_parts(ods.select("date", "is_trading_day"))


def to_instruments(ods: DataFrame) -> DataFrame:
    status = F.when(F.col("delist_date").isNull(), "ACTIVE").otherwise("DELISTED")
    return ods.select("symbol", "name", "market", "industry", board_type(F.col("symbol")).alias("board_type"), "list_date", "delist_date", status.alias("status"))


def to_index_components(dwd: DataFrame, ods: DataFrame) -> DataFrame:
    """The incoming members are the current ones; earlier members stay, no longer current."""
    new = ods.select("index_code", "symbol", "in_date", F.lit(None).cast("date").alias("out_date"), "weight", F.lit(True).alias("is_current"))
    return upsert(dwd.withColumn("is_current", F.lit(False)), new, ["index_code", "symbol", "in_date"], keep=["out_date"])


def to_ohlcv(ods: DataFrame) -> DataFrame:
    own = ods.where(F.col("adjust_flag") == ADJUSTED)
    return own.select("date", "symbol", "open", "high", "low", "close", "volume", "amount", "turnover", F.lit(1.0).alias("factor"), F.col("close").alias("raw_close"))


def roll_up(bars: DataFrame, *, monthly: bool = True, start: str | None = None, end: str | None = None) -> DataFrame:
    """OHLCV by symbol and month or year: first open and last close by date, percent change between them."""
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
    keys = ["symbol", F.year("date").alias("year")] + ([F.month("date").alias("month")] if monthly else [])
    turnover = F.avg("turnover") if "turnover" in bars.columns else F.lit(None).cast("double")
    out = bars.groupBy(*keys).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min_by("open", "date").alias("open"), F.max_by("close", "date").alias("close"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), turnover.alias("avg_turnover"),
    )
    return out.withColumn("pct_change", F.try_divide(F.col("close") - F.col("open"), F.col("open")) * 100)


def freshness(last: Column, today: Column) -> Column:
    days = F.date_diff(today, last)
    return F.when(days <= 1, "fresh").when(days <= 7, "stale").otherwise("outdated")


def active(instruments: DataFrame, today: str) -> DataFrame:
    day = F.lit(today).cast("date")
    return instruments.where((F.col("list_date") <= day) & (F.col("delist_date").isNull() | (F.col("delist_date") >= day)))


def listed_through(instruments: DataFrame, market: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Of a market, listed by ``start`` and not delisted before ``end``; unknown dates pass."""
    if market is not None:
        instruments = instruments.where(F.col("market") == market)
    if start is not None:
        instruments = instruments.where(F.col("list_date").isNull() | (F.col("list_date") <= F.lit(start).cast("date")))
    if end is not None:
        instruments = instruments.where(F.col("delist_date").isNull() | (F.col("delist_date") >= F.lit(end).cast("date")))
    return instruments


def index_members(components: DataFrame, instruments: DataFrame, index_code: str) -> DataFrame:
    """Current members of an index with what is known of them, heaviest first."""
    own = components.where((F.col("index_code") == index_code) & F.col("is_current"))
    return own.join(instruments, "symbol", "left").orderBy(F.col("weight").desc(), "symbol")


RULES: dict[str, tuple[str, str]] = {
    "trading_day_on_weekend": ("dwd_calendars", "is_trading_day AND weekday(date) >= 5"),
    "list_date_range": ("dwd_instruments", "list_date < DATE'1990-01-01' OR list_date > current_date()"),
    "price_order": ("dwd_daily_ohlcv", "high < low OR high < close OR low > open"),
    "negative_size": ("dwd_daily_ohlcv", "volume < 0 OR amount < 0"),
}


def check_rules(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, failed, passed): rows for which each condition holds, all counted in one pass."""
    counts = df.agg(*[F.coalesce(F.sum(F.coalesce(F.expr(c), F.lit(False)).cast("long")), F.lit(0).cast("long")).alias(n) for n, c in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("failed")) for n in rules])).alias("r")
    return counts.select(pairs).select("r.rule", "r.failed", (F.col("r.failed") == 0).alias("passed"))


def recency(df: DataFrame, today: str, days: int = 1) -> DataFrame:
    """(rule, failed, passed): 1 failed where the last date is more than ``days`` before today."""
    late = F.coalesce(F.max("date") < F.date_sub(F.lit(today).cast("date"), days), F.lit(True)).cast("long")
    return df.agg(late.alias("failed")).select(F.lit("recency").alias("rule"), "failed", (F.col("failed") == 0).alias("passed"))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def null_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in key])


def column_stats(df: DataFrame, *columns: str) -> DataFrame:
    """(column, n, avg, std, min, max) of numeric columns in one pass."""
    one = lambda c: F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("avg"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"))
    return df.agg(F.array(*[one(c) for c in columns]).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def describe(df: DataFrame) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max, nunique), exact; figures of numbers for numeric columns only."""
    number = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    out = []
    for c, t in df.dtypes:
        d = F.col(c).cast("double") if t in number or t.startswith("decimal") else F.lit(None).cast("double")
        q = F.percentile(d, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        out.append(F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.min(d).alias("min"), F.get(q, F.lit(0)).alias("q25"), F.get(q, F.lit(1)).alias("q50"), F.get(q, F.lit(2)).alias("q75"), F.max(d).alias("max"), F.countDistinct(c).alias("nunique")))
    return df.agg(F.array(*out).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def extent(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"), F.countDistinct("date").alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def gap_rows(have: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` after the last date that ``have`` holds of their symbol."""
    last = have.groupBy("symbol").agg(F.max("date").alias("__last"))
    return new.join(last, "symbol", "left").where(F.col("__last").isNull() | (F.col("date") > F.col("__last"))).select(*new.columns)


def next_ids(df: DataFrame, order: Sequence[str], start: int = 0) -> DataFrame:
    """Numbers after ``start`` in order; for tables that are small, such as the meta tables."""
    return df.select((F.row_number().over(Window.orderBy(*order)) + start).alias("id"), "*")
