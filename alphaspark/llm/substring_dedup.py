"""Substring dedup: winnowed anchors as seeds, extended both ways to maximal repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Prefix, WordHasher, chunks, mix, row_keys, signed, staged

#: Words of a seed.  Every window of ``window`` words holds window - SEED + 1 seeds and selects the smallest.
SEED = 12
_STEP = 1 << 14


def anchored(prefix: Prefix, n_words: int, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """The windows of a document by the seed each selects (the leftmost smallest): runs of windows
    first .. first + count - 1, the seed's place and hash, and the hash of all words of the run."""
    starts = n_words - window + 1
    if starts < 1:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    grams = prefix.run(np.arange(n_words - seed + 1), seed)
    order = mix(grams)  # any order that depends on the words alone
    reach = window - seed + 1
    chosen = np.concatenate([sliding_window_view(order[a : min(a + _STEP, starts) + reach - 1], reach).argmin(axis=1) + np.arange(a, min(a + _STEP, starts)) for a in range(0, starts, _STEP)])
    first = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
    count = np.diff(np.concatenate([first, [starts]]))
    # A run's words and the seed's place among them, which the words alone determine.
    return first, count, chosen[first], grams[chosen[first]], prefix.run(first, count + window - 1)


def segments(prefix: Prefix, n_words: int, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """What anchored() gives, without the seeds' places."""
    first, count, _, gram, run = anchored(prefix, n_words, window, seed)
    return first, count, gram, run


def _seeds(window: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for _, (k1, k2, texts) in chunks(batches):
            out = []
            for one, two, text in zip(k1, k2, texts, strict=True):
                words = (text or b"").split()
                if len(words) >= window:
                    first, count, at, gram, run_hash = anchored(Prefix(hasher.of(words)), len(words), window, seed)
                    out.append((np.full(len(first), one), np.full(len(first), two), first, count, at, gram, run_hash))
            if out:
                a, b, first, count, at, gram, run_hash = (np.concatenate(x) for x in zip(*out, strict=True))
                numbers = [pa.array(x.astype(np.int32)) for x in (first, count, at)]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *numbers, signed(gram), signed(run_hash)], ["k1", "k2", "first", "count", "at", "seed", "run"])

    return run


def _contexts(window: int, seed: int):
    """Runs -> the hashes of the words on either side of their seed, 1, 2, .. words to the left and to the right."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for _, (k1, k2, texts, runs) in chunks(batches, 64):
            out = []
            for one, two, text, todo in zip(k1, k2, texts, runs, strict=True):
                prefix = Prefix(hasher.of((text or b"").split()))
                first, count, at, seeds, copies = (np.array([r[c] for r in todo], np.int64) for c in ("first", "count", "at", "seed", "copies"))
                sides = []
                for n, left in ((at - first, True), (first + count + window - 1 - at - seed, False)):
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
                    start = np.repeat(at, n) - step if left else np.repeat(at + seed, n)
                    sides += [n, prefix.run(start, step)]
                out.append((np.full(len(at), one), np.full(len(at), two), first, count, at, seeds, copies, *sides))
            if out:
                *numbers, n_left, left, n_right, right = (np.concatenate(x) for x in zip(*out, strict=True))
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), signed(flat)) for n, flat in ((n_left, left), (n_right, right))]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), *lists], ["k1", "k2", "first", "count", "at", "seed", "copies", "left", "right"])

    return run


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix, 0 where a list has ended: no hash of words is 0 but by a chance of 2**-64."""
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
    return out


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, how many words two sides share from the seed on.  Hashes of more words never agree again once those of fewer
    don't, so the place is found by bisection."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), a.shape[1])
    rows = np.arange(len(a))
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = (a[rows, np.maximum(middle, 1) - 1] == b[rows, np.maximum(middle, 1) - 1]) & (a[rows, np.maximum(middle, 1) - 1] != 0)
        going = low < high
        low, high = np.where(going & same, middle, low), np.where(going & ~same, middle - 1, high)
    return low


def _extend(window: int, seed: int):
    """Occurrences beside their seed's pivot -> the repeats that they share, on both sides, and their windows that the pivot lacks."""
    around = window - seed

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            k1, k2, first, count, at, seeds, copies, p1, p2, p_at, own = (c[n].to_numpy(zero_copy_only=False) for n in ("k1", "k2", "first", "count", "at", "seed", "copies", "p1", "p2", "p_at", "own"))
            left, right, p_left, p_right = (_matrix(c[n], around) for n in ("left", "right", "p_left", "p_right"))
            to_left, to_right = common(left, p_left), common(right, p_right)
            other = ~own.astype(bool)
            # Starts of the windows that the pivot has too, as words before the seed: from to_left down to around - to_right.
            most, least = np.minimum(to_left, at - first), np.maximum(around - to_right, at - first - count + 1)
            hit = other & (most >= least)
            spans = [np.concatenate([a[hit], b[hit]]) for a, b in ((k1, p1), (k2, p2), (at - most, p_at - most), (at - least + window, p_at - least + window))]
            # The rest is looked for among the other occurrences, window by window.
            before = np.repeat(np.arange(len(at)), np.where(other, count, 0))
            n = np.where(other, count, 0)
            words = np.repeat(at - first, n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            rest = ~(hit[before] & (words <= most[before]) & (words >= least[before]))
            before, words = before[rest], words[rest]
            sides = [np.where(x > 0, side[before, np.maximum(x, 1) - 1], 0).view(np.uint64) for side, x in ((left, words), (right, around - words))]
            key = mix(mix(sides[0] + U64(1) + words.astype(np.uint64)) * U64(0x9E3779B97F4A7C15) + sides[1]).view(np.int64)
            start = at[before] - words
            nothing = pa.nulls(len(spans[0]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())]) for a, b in zip(spans, (k1[before], k2[before], start, start + window), strict=True)]
                + [pa.concat_arrays([nothing, pa.array(x[before], pa.int64()) if x is not key else pa.array(key)]) for x in (seeds, key, copies)],
                ["k1", "k2", "start", "stop", "seed", "window", "copies"],
            )

    return run


def repeated_spans(docs: DataFrame, window: int = 35, seed: int = SEED) -> DataFrame:
    """(k1, k2, spans): for rows of ``docs`` (doc_id, text) with repeated windows, the words [start, stop) that such
    windows cover, in order.  Spans may overlap; merged, they are the maximal repeats of at least ``window`` words.

    Each window of ``window`` words selects one seed of ``seed`` words (winnowing), so equal windows select equal
    seeds.  Neighbouring windows of one seed form a run.  Documents are joined on seeds found more than once, a count that is
    partly summed before its shuffle.  Runs whose words all occur again with the same seed are repeated from end to end,
    and one of them stands for all.  Of the different runs of a seed one, with most copies, is the pivot: each other run is
    extended from the seed to the left and to the right as far as the pivot agrees, and what is at least ``window`` words
    long is a repeat in both.  What two other runs share and the pivot lacks can't lie in these repeats, so the windows
    left are counted among themselves.  No pair of two occurrences is made but with the pivot: work grows with
    the words near repeated seeds, however often a passage occurs.

    Words are split at ASCII white space and not changed.  Null or short texts have no windows.  Rows that
    repeat an id and text are two places (so all their runs have copies).  No rows: no rows.
    """
    texts = docs.select(*row_keys(F.col("doc_id"), F.col("text")), F.col("text").cast("binary").alias("text"))
    kinds = "k1 long, k2 long, first int, count int, at int, seed long, run long"
    found = staged(texts.mapInArrow(_seeds(window, seed), kinds), "seeds")
    # Counts are staged, so that the joins with them stand on plain exchanges, whose hot seeds Spark can split.
    again = staged(found.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed"), "again")
    near = staged(found.join(again, "seed", "left_semi"), "near")

    runs = staged(near.groupBy("seed", "run").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "first", "count", "at")).alias("p")), "runs")
    several = staged(runs.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("seed"), "several")
    whole = near.join(runs.where("copies > 1").select("seed", "run"), ["seed", "run"], "left_semi").select("k1", "k2", F.col("first").cast("long").alias("start"), (F.col("first") + F.col("count") + window - 1).cast("long").alias("stop"))
    todo = runs.join(several, "seed", "left_semi").select("p.k1", "p.k2", F.struct("p.first", "p.count", "p.at", "seed", "copies").alias("r")).groupBy("k1", "k2").agg(F.collect_list("r").alias("runs"))
    kinds = "k1 long, k2 long, first long, count long, at long, seed long, copies long, left array<long>, right array<long>"
    contexts = staged(texts.join(todo, ["k1", "k2"]).select("k1", "k2", "text", "runs").mapInArrow(_contexts(window, seed), kinds), "contexts")
    best = F.max(F.struct("copies", "count", "k1", "k2", "at", "left", "right")).alias("p")
    pivots = staged(contexts.groupBy("seed").agg(best).select(F.col("seed").alias("p_seed"), F.col("p.k1").alias("p1"), F.col("p.k2").alias("p2"), F.col("p.at").alias("p_at"), F.col("p.left").alias("p_left"), F.col("p.right").alias("p_right")), "pivots")
    beside = contexts.join(pivots, F.col("seed") == F.col("p_seed")).drop("p_seed").withColumn("own", (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")) & (F.col("at") == F.col("p_at")))
    extended = staged(beside.mapInArrow(_extend(window, seed), "k1 long, k2 long, start long, stop long, seed long, window long, copies long"), "extended")
    twice = staged(extended.where("window IS NOT NULL").groupBy("seed", "window").agg(F.sum("copies").alias("n")).where("n > 1").select("seed", "window"), "twice")
    shared = extended.where("copies = 1").join(twice, ["seed", "window"], "left_semi").select("k1", "k2", "start", "stop")
    spans = whole.union(extended.where("window IS NULL").select("k1", "k2", "start", "stop")).union(shared)
    return spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, (_, texts, spans) in chunks(batches):
        n, gone, kept, digest = [], [], [], []
        for text, marks in zip(texts, spans, strict=True):
            words = (text or b"").split()
            n.append(len(words))
            for start, stop in reversed(merged((m["start"], m["stop"]) for m in marks or ())):
                del words[start:stop]
            gone.append(n[-1] - len(words))
            kept.append(b" ".join(words))
            digest.append(hashlib.sha256(kept[-1]).hexdigest())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])


def substring_dedup(docs: DataFrame, window: int = 35, seed: int = SEED) -> DataFrame:
    """Row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept (the words that no repeated window
    covers, joined by one space) and kept_sha256.  See repeated_spans for the cases."""
    spans = repeated_spans(docs, window, seed)
    texts = docs.select("doc_id", *row_keys(F.col("doc_id"), F.col("text")), F.col("text").cast("binary").alias("text"))
    joined = texts.join(spans, ["k1", "k2"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
