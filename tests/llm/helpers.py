from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark: SparkSession, texts, ids=None, sources=None, parts: int = 3) -> DataFrame:
    """documents with the given texts; ids from 0 where none are given."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def rows_of(df: DataFrame, *columns: str) -> list[tuple]:
    out = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(out, key=repr)
