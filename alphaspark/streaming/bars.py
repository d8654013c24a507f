"""Structured Streaming: events to bars with a watermark, and their upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..warehouse.transforms import upsert


def event_stream(spark: SparkSession, path: str, pattern: str = "events*.parquet", files_a_trigger: int | None = None) -> DataFrame:
    """Event files as they come in; the schema is that of the files already there."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else reader).parquet(path)


def event_bars(events: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """date, symbol (user), open .. close of ``value``, volume (events): a bar is final once the watermark passes it.
    Works on batches alike."""
    at = F.struct("ts", "event_id")
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), F.col("user_id").alias("symbol"))
    bars = own.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume"))
    return bars.select(F.col("w.start").alias("ts"), "symbol", "open", "high", "low", "close", "volume")


def upsert_bars(bars: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of bars over those that ``read`` gives, handed to ``write``: repeating a batch changes nothing."""

    def batch(df: DataFrame, _: int) -> None:
        write(upsert(read(), df, ["ts", "symbol"]))

    return bars.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
