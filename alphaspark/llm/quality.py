"""Quality classifier: random Fourier features, ridge from summed normal equations, isotonic calibration."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, row_keys, staged

STATS = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "line_words", "upper", "lower", "digit", "space", "period_comma",
    "other_marks", "high", "marks_a_word", "upper_words", "mark_words", "distinct_words", "top_word", "same_next", "distinct_lines",
    "short_lines", "line_end_stop", "byte_entropy",
)
BINS = 1024
_CLASSES = np.zeros(256, np.int64)
_CLASSES[ord("A") : ord("Z") + 1] = 1
_CLASSES[ord("a") : ord("z") + 1] = 2
_CLASSES[ord("0") : ord("9") + 1] = 3
_CLASSES[[9, 10, 11, 12, 13, 32]] = 4
_CLASSES[[ord("."), ord(",")]] = 5
_CLASSES[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"]] = 6
_CLASSES[128:] = 7


def statistics(text: bytes) -> list[float]:
    """STATS of a whole text; all 0 for an empty one."""
    if not text:
        return [0.0] * len(STATS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    of = np.bincount(_CLASSES, counts, minlength=8)
    n = len(text)
    words, lines = text.split(), text.split(b"\n")
    w, k = max(1, len(words)), len(lines)
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    p = counts[counts > 0] / n
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(k), sum(map(len, words)) / w, len(words) / k, of[1] / n, of[2] / n, of[3] / n, of[4] / n, of[5] / n,
        of[6] / n, of[7] / n, of[6] / w, sum(map(bytes.isupper, words)) / w, sum(1 for x in words if x[-1] < 128 and not chr(x[-1]).isalnum() and x[-1] not in b".,") / w,
        len(seen) / w, max(seen.values(), default=0) / w, sum(map(bytes.__eq__, words, words[1:])) / w, len(set(lines)) / k,
        sum(1 for x in lines if len(x) < 20) / k, sum(1 for x in lines if x[-1:] in (b".", b"!", b"?")) / k, float(-(p * np.log2(p)).sum()),
    ]


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, (ids, texts, _) in chunks(batches):
        flat = np.array([statistics(t or b"") for t in texts], np.float64).reshape(len(ids), len(STATS))
        held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0 for i in ids]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), len(STATS)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held), lists, part.column(2)], ["doc_id", "held_out", "stats", "k2"])


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, stats, k2) of each row of ``docs`` (doc_id, text); k2 is the row's second key (see row_keys)."""
    own = F.col("doc_id").cast("long")
    texts = docs.select(own.alias("doc_id"), F.col("text").cast("binary").alias("text"), row_keys(own, F.col("text"))[1])
    return texts.mapInArrow(_measure, "doc_id long, held_out boolean, stats array<double>, k2 long")


@dataclass(frozen=True)
class Model:
    """Standardisation, Fourier features, ridge weights, and the calibration's values by raw-score bin."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale, self.omega, self.phase)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.levels[bins(self.raw(stats))]


def fourier(z: np.ndarray, omega: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """sqrt(2/D) cos(omega z + phase) approximates a Gaussian kernel; a last column of ones is the intercept."""
    z = np.clip(z, -8, 8)
    return np.hstack([np.cos(z @ omega + phase) * np.sqrt(2 / len(phase)), np.ones((len(z), 1))])


def bins(raw: np.ndarray) -> np.ndarray:
    """Raw scores lie about 0 and 1; -0.5 .. 1.5 is cut into BINS."""
    return np.clip(((raw + 0.5) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


def isotonic(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over bins: the best non-decreasing shares of good rows, in between filled by lines.
    Bins get half a row of the overall share, so that no share is 0 or 1 from a handful of rows."""
    used = np.flatnonzero(total)
    if not len(used):
        return np.full(len(total), 0.5)
    prior = good.sum() / total.sum()
    blocks: list[list[float]] = []
    for i in used:
        blocks.append([good[i], total[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g, blocks[-1][1] + n, blocks[-1][2], last]
    at, value = [], []
    for g, n, first, last in blocks:
        at += [first, last]
        value += [(g + 0.5 * prior) / (n + 0.5)] * 2
    return np.interp(np.arange(len(total)), at, np.maximum.accumulate(value))


def _summed(df: DataFrame, width: int, partial) -> np.ndarray:
    """Sum over all rows of partial(stats, y, fold) -> (rows, width): each partition makes its own sum, row
    by row these are added up in a shuffle, and only the total goes to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                stats = np.array(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                part = partial(stats, np.array(batch.column(1), np.float64), np.array(batch.column(2)))
                total = part if total is None else total + part
        if total is not None:
            flat = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), flat], ["i", "v"])

    sums = df.select("stats", "y", "fold").mapInArrow(run, "i int, v array<double>")
    rows = sums.select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    if not rows:
        return np.empty((0, width))
    out = np.zeros((1 + max(r["i"] for r in rows), width))
    for r in rows:
        out[r["i"], r["j"]] = r["x"]
    return out


def fit(spark: SparkSession, train: DataFrame, n_features: int = 160, bandwidth: float = 6.0, ridge: float = 0.1, folds: int = 3, seed: int = 7) -> Model | None:
    """``train``: stats, y (0 or 1), fold (0 .. folds - 1).  All rows count.

    Two passes of sums: means and squares, then one normal-equation matrix a fold.  The calibration learns
    from raw scores by the model of the other folds, so it isn't flattered by rows it was fitted on; a
    third pass counts good and all rows in BINS bins.  The driver sees sums of (n_features + 2)**2 numbers a fold, however
    many rows there are.  Rows of one class only, or none: None.
    """
    d = len(STATS)
    sums = _summed(train, d, lambda x, y, f: np.stack([x.sum(0), (x * x).sum(0), np.full(x.shape[1], len(x)), np.full(x.shape[1], y.sum())]))
    if not len(sums) or not 0 < sums[3, 0] < sums[2, 0]:
        return None
    mean = sums[0] / sums[2]
    scale = np.sqrt(np.maximum(sums[1] / sums[2] - mean**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    r = np.random.default_rng(seed)
    omega, phase = r.normal(size=(d, n_features)) / bandwidth, r.uniform(0, 2 * np.pi, n_features)
    w = n_features + 2
    # Both classes weigh the same, so a rare one is not drowned; calibration gives back its true share.
    share = sums[3, 0] / sums[2, 0]
    weight = (0.5 / (1 - share), 0.5 / share)

    def normal(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        z = np.hstack([fourier((x - mean) / scale, omega, phase), y[:, None]])
        u = np.where(y > 0, weight[1], weight[0])[:, None]
        return np.vstack([(z[fold == k] * u[fold == k]).T @ z[fold == k] for k in range(folds)])

    grams = _summed(train, w, normal).reshape(folds, w, w)

    def solve(g: np.ndarray) -> np.ndarray:
        a = g[:-1, :-1] + ridge * np.diag([1.0] * n_features + [0.0])
        return np.linalg.lstsq(a, g[:-1, -1], rcond=None)[0]

    beta = solve(grams.sum(0))
    others = np.stack([solve(grams.sum(0) - grams[k]) for k in range(folds)])

    def counted(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        raw = (fourier((x - mean) / scale, omega, phase) * others[fold]).sum(1)
        at = bins(raw)
        return np.stack([np.bincount(at, y, minlength=BINS), np.bincount(at, minlength=BINS)])

    good, total = _summed(train, BINS, counted)
    return Model(mean, scale, omega, phase, beta, np.round(isotonic(good, total), 6))


def _apply(model: Model | None, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            score = model.score(stats) if model and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), batch.column(3)], ["doc_id", "held_out", "score", "predicted", "k2"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text), by a model fitted on the rows of
    ``labels`` (doc_id, quality) with crc32(doc_id) mod 5 not 0.

    Inputs are statistics of the whole text alone.  Null or empty texts: statistics 0, and a score like any other.
    Null ids: held out by the crc32 of the empty string, never trained on.  Null or other labels than 0 and 1 are
    left out; a doc_id with several labels trains once for each.  No usable labels: every score 0.5.
    """
    return scores_by_row(docs, labels, threshold, **options).drop("k2")


def scores_by_row(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """What score_quality() returns, and the row's second key (see row_keys)."""
    measured = staged(measure(docs), "stats")
    known = labels.where("quality IN (0, 1)").select(F.col("doc_id").alias("__id"), F.col("quality").cast("double").alias("y"))
    folds = options.get("folds", 3)
    train = measured.where(~F.col("held_out")).join(known, F.col("doc_id") == F.col("__id")).select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int").alias("fold"))
    model = fit(docs.sparkSession, staged(train, "train"), **options)
    return measured.mapInArrow(_apply(model, threshold), "doc_id long, held_out boolean, score double, predicted int, k2 long")
