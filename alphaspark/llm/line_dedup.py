"""Line dedup: keep bitmaps from range-partitioned line hashes.  DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, fresh_names, row_keys, staged

#: Documents of one line are dealt over so many parts at least, and over more where a part would have more documents than
#: this, so that no line has all its rows in one task.
SALTS, SALT_DOCS = 64, 1 << 20


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case, all else as it is."""
    bare = F.btrim(line, F.lit(ASCII_SPACE))
    ascii_only = F.char_length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_chars: int = 1) -> DataFrame:
    """One row (k1, k2, n_lines, n_dropped, keep_runs) per distinct row of ``docs`` (doc_id, text).

    ``keep_runs`` is the run-length compressed bitmap of the lines that stay: [start, len] pairs, in order.
    A line whose key has at least ``min_chars`` code points and is found in at least ``min_docs`` documents
    goes everywhere (keep="none") or everywhere but at its first place by document and position (keep="first").

    Lines are hashed to 128 bits, range-partitioned by (hash, salt of the document) and sorted there by document
    and position; a streaming window passes on the first ``min_docs`` documents of each range and no more, so a
    line in a third of all documents costs SALTS x ``min_docs`` rows beyond the range sort.  A hash and salt has about
    SALT_DOCS documents at most, however many there are.  Joins by hash carry a few integers a line, and Spark's skew
    join splits a hot hash.

    Null text: one empty line.  Empty lines are never dropped where min_chars >= 1.  Null ids: one document of
    that name.  Repeated rows of one id count as one document.  No rows: no rows.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be 'none' or 'first', not {keep!r}")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    per_doc = staged(
        docs.select(*row_keys(F.col("doc_id"), F.col("text")), lines.alias("lines")).select(
            "k1", "k2", F.size("lines").alias("n_lines"),
            F.transform("lines", lambda x: line_key(x)).alias("keys"),
        ).select(
            "k1", "k2", "n_lines",
            F.transform("keys", lambda x: F.when(F.char_length(x) >= min_chars, F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2")))).alias("hashes"),
        ),
        "lines",
    )
    seen = per_doc.select("k1", "k2", F.posexplode("hashes").alias("pos", "h")).where("h IS NOT NULL").select("h.h1", "h.h2", "k1", "k2", "pos")

    salts = max(SALTS, -(-per_doc.count() // SALT_DOCS))
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("k1"), F.lit(salts)).cast("int")).repartitionByRange("h1", "h2", "salt")
    order = Window.partitionBy("h1", "h2", "salt").orderBy("k1", "k2", "pos")
    first = (
        salted.withColumn("nth", F.dense_rank().over(Window.partitionBy("h1", "h2", "salt").orderBy("k1")))
        .withColumn("again", F.lag("k1").over(order) == F.col("k1"))
        .where((F.col("nth") <= min_docs) & ~F.coalesce("again", F.lit(False)))
    )
    # Staged, so that the join below stands on two plain exchanges, whose hot hashes Spark can split.
    spread = staged(
        first.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("first"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", *([F.col("first")] if keep == "first" else [])),
        "spread",
    )
    gone = seen.join(spread, ["h1", "h2"], "inner" if keep == "first" else "left_semi")
    if keep == "first":
        gone = gone.where(F.struct("k1", "k2", "pos") != F.col("first"))
    dropped = gone.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))

    sizes = per_doc.select("k1", "k2", "n_lines").distinct()
    none = F.array().cast("array<int>")
    before = F.concat(F.array(F.lit(-1)), F.col("dropped"))
    after = F.concat(F.col("dropped"), F.array(F.col("n_lines")))
    runs = F.filter(
        F.transform(F.arrays_zip(before.alias("b"), after.alias("a")), lambda z: F.struct((z["b"] + 1).alias("start"), (z["a"] - z["b"] - 1).alias("len"))),
        lambda r: r["len"] > 0,
    )
    return (
        sizes.join(dropped, ["k1", "k2"], "left")
        .withColumn("dropped", F.coalesce("dropped", none))
        .select("k1", "k2", "n_lines", F.size("dropped").alias("n_dropped"), runs.alias("keep_runs"))
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """Each row of ``docs`` with what its bitmap keeps of ``text``, and the counts in columns of the names given, which
    take the place of columns that ``docs`` has of those names.  Rows whose lines all go get an empty text; rows that lose none keep
    theirs, null as null."""
    a, b, keep = fresh_names(docs, "__k1", "__k2", "__keep")
    k1, k2 = row_keys(F.col("doc_id"), F.col("text"))
    marks = bitmaps.select(F.col("k1").alias(a), F.col("k2").alias(b), F.struct("n_lines", "n_dropped", "keep_runs").alias(keep))
    lines = F.split("text", "\n")
    kept = F.array_join(F.flatten(F.transform(F.col(f"{keep}.keep_runs"), lambda r: F.slice(lines, r["start"] + 1, r["len"]))), "\n")
    joined = docs.join(marks, (k1 == F.col(a)) & (k2 == F.col(b)), "left")
    text = F.when(F.col(f"{keep}.n_dropped") > 0, kept).otherwise(F.col("text"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in (n_lines.lower(), n_dropped.lower())],
        F.col(f"{keep}.n_lines").cast("long").alias(n_lines),
        F.col(f"{keep}.n_dropped").cast("long").alias(n_dropped),
    )


def line_dedup(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_chars: int = 1, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` without the lines that ``keep_bitmaps`` drops; see apply_bitmaps for the columns."""
    return apply_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text"), min_docs, keep, min_chars), n_lines, n_dropped)
