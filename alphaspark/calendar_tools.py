"""Calendars: weekdays less holidays, and the parts of a date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trading_days(spark: SparkSession, start: str, end: str, holidays: Sequence[str] = ()) -> DataFrame:
    """(date) of Mondays to Fridays from start to end that aren't holidays."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")).where(F.weekday("date") < 5)
    return days.where(~F.col("date").isin([F.lit(h).cast("date") for h in holidays])) if holidays else days


def calendar(spark: SparkSession, start: str, end: str, holidays: Sequence[str] = ()) -> DataFrame:
    """Every day with is_trading_day."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    closed = F.col("date").isin([F.lit(h).cast("date") for h in holidays]) if holidays else F.lit(False)
    return days.select("date", ((F.weekday("date") < 5) & ~closed).alias("is_trading_day"))


def calendar_parts(df: DataFrame, date: str = "date") -> DataFrame:
    """With year, quarter, month, ISO week, weekday (Monday 0) and the ends of week (Friday), month, quarter and year."""
    d = F.col(date)
    month_end = d == F.last_day(d)
    return df.select(
        "*", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.weekofyear(d).alias("week"), F.weekday(d).alias("day_of_week"),
        (F.weekday(d) == 4).alias("is_week_end"), month_end.alias("is_month_end"), (month_end & (F.month(d) % 3 == 0)).alias("is_quarter_end"),
        (month_end & (F.month(d) == 12)).alias("is_year_end"),
    )


def days_after(spark: SparkSession, last: str, today: str, holidays: Sequence[str] = ()) -> DataFrame:
    """Trading days after ``last`` until ``today``; none where last is today or later."""
    return trading_days(spark, last, max(today, last), holidays).where(F.col("date") > F.lit(last).cast("date"))
