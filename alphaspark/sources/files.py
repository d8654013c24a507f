"""Files in and out."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, columns_map: dict[str, str] | None = None, encoding: str = "utf-8", **options) -> DataFrame:
    """A file, folder or glob with header; text columns where no schema is given.  An empty input has no columns."""
    reader = spark.read.option("header", True).option("encoding", encoding).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    return df.withColumnsRenamed(columns_map) if columns_map else df


def read_source_csv(spark: SparkSession, path: str | list[str], pattern: str | None = None, recursive: bool = False, **options) -> DataFrame:
    """CSV files with header as text columns; each file as UTF-8, or as GBK where any line of it isn't UTF-8.  Columns are matched
    by name.  Lines end records, as in Spark's reader without its option multiLine."""
    chosen = {"recursiveFileLookup": recursive} | ({"pathGlobFilter": pattern} if pattern else {})
    lines = spark.read.options(**chosen).text(path)
    sound = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.bool_and(F.is_valid_utf8("value")).alias("ok")).collect()
    broken = [r["file"] for r in sound if not r["ok"]]
    if not broken:
        return spark.read.options(**chosen).option("header", True).options(**options).csv(path)
    out = read_encoded_csv(spark, broken, "gb18030", **options)
    good = [r["file"] for r in sound if r["ok"]]
    return read_csv(spark, good, **options).unionByName(out, allowMissingColumns=True) if good else out


def read_encoded_csv(spark: SparkSession, path: str | list[str], encoding: str, **options) -> DataFrame:
    """CSV files with header in an encoding that Spark's reader lacks, as text columns: Python decodes lines, wherever files are
    split, and the JVM reads their fields.  Files of one header are read together.  For encodings in which the byte of a
    newline is nothing else; a byte that can't be read raises."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(line or b"").decode(encoding) for line in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], ["line", "file", "start", "at"])

    raw = spark.read.text(path).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    lines = raw.mapInArrow(decode, "line string, file string, start long, at long")
    # The first line of a file; ids grow along a file's part.
    heads = lines.where("start = 0").groupBy("file").agg(F.min(F.struct("at", "line")).alias("head")).select("file", "head.line").collect()
    by_head: dict[str, list[str]] = {}
    for r in heads:
        by_head.setdefault(r["line"], []).append(r["file"])
    out = None
    for head, files in by_head.items():
        names = next(csv.reader([head], delimiter=options.get("sep", options.get("delimiter", ","))), [])
        fields = F.from_csv("line", F.lit(", ".join(f"c{i} string" for i in range(len(names)))), {k: str(v) for k, v in options.items()})
        own = lines.where(F.col("file").isin(files) & (F.trim("line") != "") & (F.col("line") != head)).select(fields.alias("f"))
        own = own.select(*[F.col(f"f.c{i}").alias(n) for i, n in enumerate(names)])
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return spark.createDataFrame([], "") if out is None else out


def read_folder(spark: SparkSession, folder: str, kind: str = "csv", pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """All files of a folder in one scan; CSV files as read_source_csv() has them."""
    pattern = pattern or f"*.{kind}"
    if kind != "parquet":
        return read_source_csv(spark, folder, pattern, recursive)
    return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).parquet(folder)


def read_excel(spark: SparkSession, path: str, sheet_name: str | int = 0) -> DataFrame:
    """Through pandas on the driver: workbooks are small, and Spark has no reader for them."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet_name))


def load_panel(df: DataFrame, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, date: str = "date", symbol: str = "symbol") -> DataFrame:
    """A panel's rows of some symbols and dates; the filters reach the scan."""
    if symbols is not None:
        df = df.where(F.col(symbol).isin(list(symbols)))
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def write_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",", single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", header).option("sep", delimiter).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def query_to_file(df: DataFrame, path: str) -> None:
    """By extension: .json, .parquet, else CSV."""
    {".json": write_json, ".parquet": write_parquet}.get(Path(path).suffix, write_csv)(df, path)


def synthetic_bars(spark: SparkSession, n_symbols: int = 50, start: str = "2020-01-01", end: str = "2025-05-01", seed: int = 42) -> DataFrame:
    """Geometric walks on weekdays, made on the executors from seeded hashes: the same rows every time."""
    from .. import calendar_tools
    from ..functions.axes import AXES

    noise = lambda tag: F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), "date", "symbol"), F.lit(1 << 20)).cast("double") / (1 << 20) - 0.5
    days = calendar_tools.trading_days(spark, start, end)
    keys = days.crossJoin(F.broadcast(spark.range(n_symbols).select(F.format_string("%06d", F.col("id") + 1).alias("symbol"))))
    walk = F.exp(F.sum(noise("step") * 0.07).over(AXES.so_far())) * (10 + F.pmod(F.xxhash64("symbol"), F.lit(90)))
    bars = keys.withColumn("close", F.round(walk, 4)).withColumn("open", F.round(F.col("close") * (1 + noise("open") * 0.02), 4))
    bars = bars.withColumn("high", F.round(F.greatest("open", "close") * 1.01, 4)).withColumn("low", F.round(F.least("open", "close") * 0.99, 4))
    volume = (1_000_000 + (noise("volume") + 0.5) * 99_000_000).cast("long")
    return bars.withColumn("volume", volume).withColumn("amount", F.round(F.col("volume") * F.col("close"), 2)).select("date", "symbol", "open", "high", "low", "close", "volume", "amount")
