"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Each source is cut by the first four hex digits of its documents' md5 into so many parts.
PARTS_HEX = 4
WORD = r"[^\x20\x09-\x0D]+"


def capped_targets(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float) -> list[float]:
    """Shares of ``budget`` by weight, none above ``most`` times its size; what is cut off is shared again."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(budget)
    while open_:
        total = sum(weights[i] for i in sorted(open_))
        full = [i for i in sorted(open_) if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in full:
            target[i] = most * sizes[i]
            open_.discard(i)
        left = max(0.0, left - sum(target[i] for i in full))
    return target


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, ramps: Sequence[float] = (0.0, 0.6, -0.6)
) -> DataFrame:
    """Row per row of ``docs`` (doc_id, source, text): doc_id, source, size, source_size, target, taken, positions.

    Sources in code point order (null last) get ``weights`` in turn.  A source's words are wanted along the training
    run t in [0, 1] at the rate target * (1 + ramp * (2t - 1)), so up to t it wants
    target * (t + ramp * (t*t - t)), |ramp| < 1; ``ramps`` go by weight.  The documents of a source stand in the order of
    their md5; ``taken`` words are its whole text as often as the target holds the whole source, and once more
    for the documents that the rest of the target covers (a part of the last one).  The demand is inverted where a
    copy starts: ``positions`` has t for each copy.  Rows are range-sorted by their first position.

    Prefix sums take three levels: 256 tops of a source, 256 parts of a top, documents of a part, so no task holds a source.
    Only one row for each source goes to the driver.  Null text: 0 words.  Null sources are one source.  Null
    ids hash as empty text.  No rows: no rows.
    """
    words = docs.select(
        "doc_id", "source",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("__u"),
    )
    # Staged: sums, places and the sampling of the range sort read a few numbers a document instead of its text.
    words = staged(words.withColumn("__part", F.conv(F.substring("__u", 1, PARTS_HEX), 16, 10).cast("int")), "words")
    parts = words.groupBy("source", "__part").agg(F.sum("size").alias("__sum"))
    totals = [(r["source"], int(r["n"])) for r in parts.groupBy("source").agg(F.sum("__sum").alias("n")).collect()]
    totals.sort(key=lambda x: (x[0] is None, x[0] or ""))
    by = [float(weights[i % len(weights)]) for i in range(len(totals))]
    target = capped_targets([n for _, n in totals], by, share * sum(n for _, n in totals), most)
    rows = [(s, n, t, float(ramps[i % len(ramps)])) for i, ((s, n), t) in enumerate(zip(totals, target, strict=True))]
    plan = docs.sparkSession.createDataFrame(rows, "__source string, source_size long, target double, __ramp double")

    # Of a source's words, those before each 256 parts, and those before a part among its 256.
    tops = parts.groupBy(F.col("source").alias("__source"), F.shiftright("__part", 8).alias("__top")).agg(F.sum("__sum").alias("__n"))
    above = Window.partitionBy("__source").orderBy("__top").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("__above", F.coalesce(F.sum("__n").over(above), F.lit(0))).join(plan.withColumnRenamed("__source", "__name"), F.col("__source").eqNullSafe(F.col("__name")))
    beside = Window.partitionBy("source", "__top2").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parts.withColumn("__top2", F.shiftright("__part", 8)).withColumn("__beside", F.coalesce(F.sum("__sum").over(beside), F.lit(0)))
        .join(tops, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__top2") == F.col("__top")))
        .select(F.col("source").alias("__source"), F.col("__part").alias("__part2"), (F.col("__above") + F.col("__beside")).alias("__start"), "source_size", "target", "__ramp")
    )
    inside = Window.partitionBy("source", "__part").orderBy("__u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        words.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__part") == F.col("__part2")))
        .withColumn("__at", F.col("__start") + F.col("__in"))
    )
    goal = F.round("target").cast("long")
    size, n = F.col("size"), F.col("source_size")
    whole = F.when(n > 0, F.floor(goal / n)).otherwise(0).cast("long")
    rest = F.greatest(F.lit(0), F.least(size, goal - whole * n - F.col("__at")))
    copies = whole + (rest > 0).cast("long")
    out = placed.withColumn("taken", (whole * size + rest).cast("long")).withColumn("__copies", F.when(size > 0, copies).otherwise(0))
    starts_at = F.transform(
        F.when(F.col("__copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda c: moment((F.col("__at") + c * n) / F.greatest(goal, F.lit(1)), F.col("__ramp")),
    )
    out = out.withColumn("positions", starts_at)
    first = F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(2.0))
    return (
        out.withColumn("__first", first).repartitionByRange("__first", "__u").sortWithinPartitions("__first", "__u", "doc_id")
        .select("doc_id", "source", "size", "source_size", "target", "taken", "positions")
    )


def moment(done: Column, ramp: Column) -> Column:
    """The t at which t + ramp * (t*t - t) is ``done``: the share of the source's words wanted so far."""
    half = (1 - ramp) / 2
    root = F.sqrt(F.greatest(half * half + ramp * done, F.lit(0.0)))
    return F.when(F.abs(ramp) < 1e-9, done).otherwise(done / F.greatest(half + root, F.lit(1e-12)))
