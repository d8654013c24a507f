"""The corpus pipeline: five stages from documents to a training order.

Each stage takes (spark, docs, sf_dir) and returns all it keeps; all but the last return the columns of
``docs``, n_chars brought up to date where the text changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaspark.llm.common import fresh_names, without_rows, work_folder
from alphaspark.llm.decontaminate import without_leaks
from alphaspark.llm.line_dedup import line_dedup
from alphaspark.llm.mixing import mix_sources
from alphaspark.llm.near_dedup import near_duplicates
from alphaspark.llm.quality import scores_by_row


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.3.

    Null and empty texts are scored by the statistics of an empty text.  Rows that repeat an id are judged one by one by
    their texts, and equal rows alike; rows without an id go or stay by their own text.  No labels: all stay.  No rows: no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return without_rows(docs, scores_by_row(docs, labels).where("predicted = 0"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that at least 10 of the documents share; n_chars is brought up to date where lines went.

    Null and empty texts have one empty line, which stays, so they are as they were.  A text whose lines all go is empty.
    Rows of one id count as one document, and rows without an id as one more.  No rows: no rows.
    """
    lines, dropped = fresh_names(docs, "__n_lines", "__n_dropped")
    kept = line_dedup(docs, min_docs=10, n_lines=lines, n_dropped=dropped)
    length = F.when(F.col(dropped) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates, by 5-word shingles and similarity 0.8.

    Null, empty and blank texts and rows without an id are in no group and stay.  Rows that repeat the id that stays all
    stay; of an id that doesn't, all rows go.  No rows: no rows.
    """
    (gone_id,) = fresh_names(docs, "__gone_id")
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks.

    Null and empty texts stay.  Rows that repeat an id, or have none, go or stay by their own text.  An empty benchmark: all
    stay.  No rows: no rows.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken and first training position of each row.

    Null and empty texts have no words: none are taken, and the position is null.  Null sources are one source, the last.
    Repeated rows are taken one by one.  No rows: no rows.
    """
    mixed = mix_sources(docs)
    first = F.round(F.try_element_at("positions", F.lit(1)), 6).alias("first_position")
    return mixed.select("doc_id", "source", "size", "source_size", F.round("target", 3).alias("target"), "taken", F.size("positions").cast("long").alias("n_copies"), first)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
]
#: SQL can't express the quality model; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.option("compression", "zstd").parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
