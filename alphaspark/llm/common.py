"""Helpers shared by the training-data operators: row keys, staged tables, hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import checkpoint_root, work_folder  # noqa: F401  checkpoint_root is used by tests and stages

#: ASCII white space, 0x20 and 0x09-0x0D: what bytes.split() splits at.
ASCII_SPACE = " \t\n\x0b\x0c\r"
NULL_ID = -(1 << 63)
U64 = np.uint64


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a cut in the lineage
    that outlives executors.  Two readers of the result do the work above it once."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """Two longs, never null, that name a row: its id and a hash of id and text.
    Repeated rows share them, and so do all results that depend on the row's contents."""
    own = doc_id.cast("long")
    return [F.coalesce(own, F.lit(NULL_ID)).alias("k1"), F.xxhash64(own, text).alias("k2")]


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, changed where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) whose row_keys() aren't among ``gone`` (doc_id, k2)."""
    a, b = fresh_names(docs, "__k1", "__k2")
    keys = gone.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(a), F.col("k2").alias(b)).distinct()
    k1, k2 = row_keys(F.col("doc_id"), F.col("text"))
    return docs.join(keys, (k1 == F.col(a)) & (k2 == F.col(b)), "left_anti")


def chunks(batches: Iterable[pa.RecordBatch], step: int = 256) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Small slices of each batch as Python columns, so that few texts are in memory twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, [c.to_pylist() for c in part.columns]


def byte_chunks(batches: Iterable[pa.RecordBatch], column: int, limit: int = 1 << 23, step: int = 256) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Like chunks(), but a slice ends where the values of a binary column have ``limit`` bytes, so that long ones come alone."""
    for batch in batches:
        sizes = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            n = max(1, min(step, int(np.searchsorted(sizes, before + limit, "right")) - at))
            part = batch.slice(at, n)
            yield part, [c.to_pylist() for c in part.columns]
            at += n


class WordHasher(dict):
    """word bytes -> 64-bit hash, remembered for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: spreads every bit of the 64-bit values over all others."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Prefix:
    """Hashes of any run of words of a document from prefix sums of h[j] * base**j."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)
    _up = _down = np.ones(1, U64)

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes) + 1
        if n > len(Prefix._up):
            size = max(4096, 2 * n)
            Prefix._up = np.concatenate([[U64(1)], np.cumprod(np.full(size, self.BASE, U64))]).astype(U64)
            Prefix._down = np.concatenate([[U64(1)], np.cumprod(np.full(size, self.INVERSE, U64))]).astype(U64)
        self.sums = np.zeros(n, U64)
        np.cumsum(hashes * Prefix._up[: n - 1], out=self.sums[1:])

    def run(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Of words start .. start + length - 1."""
        end = start + length
        raw = (self.sums[end] - self.sums[start]) * Prefix._down[start]
        return mix(raw + U64(0x632BE59BD9B4E019) * np.asarray(length, U64))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
