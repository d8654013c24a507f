"""Bars from trades: the panel that our queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bars(spark: SparkSession, sf_dir: str, every: str = "month") -> DataFrame:
    """One bar a period and supplier from lineitem: price is extendedprice / quantity, in order of
    (shipdate, orderkey, linenumber, partkey).  One aggregation with partial sums, no window."""
    trades = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.to_date(F.date_trunc(every, "l_shipdate")).alias("date"),
        F.col("l_suppkey").alias("symbol"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("at"),
        F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("a"),
    )
    return trades.groupBy("date", "symbol").agg(
        F.min_by("px", "at").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "at").alias("close"),
        F.sum("q").alias("volume"), F.round(F.sum("a"), 4).alias("amount"),
    )
