from __future__ import annotations

import zlib

import numpy as np
import pytest

from alphaspark.llm.quality import BINS, STATS, bins, fourier, isotonic, score_quality, statistics

from .helpers import docs_of, rows_of


def test_held_out_accuracy(spark, sf_small):
    big = sf_small.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = score_quality(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    score, predicted, truth = (np.array(x) for x in zip(*rows, strict=True))
    order = (score[truth == 1][:, None] > score[truth == 0]).mean() + 0.5 * (score[truth == 1][:, None] == score[truth == 0]).mean()
    assert order > 0.95 and (predicted == truth).mean() > 0.93 and ((score - truth) ** 2).mean() < 0.06


def test_held_out_rows_and_labels_stay_out(spark):
    good, bad = "Some words of a plain text stand here. They end.", "XX!! YY!! ZZ!! QQ!! RR!!"
    texts = [good + f" {i}" if i % 2 else bad + f" {i}!!" for i in range(80)]
    label = [(i, int(i % 2)) for i in range(80)]
    held = {i for i in range(80) if zlib.crc32(str(i).encode()) % 5 == 0}
    flipped = [(i, 1 - q if i in held else q) for i, q in label]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    a = rows_of(score_quality(docs_of(spark, texts), frame(label)))
    b = rows_of(score_quality(docs_of(spark, texts, sources=[str(i) for i in range(80)]), frame(flipped)))
    assert a == b and {i for i, h, _, _ in a if h} == held
    assert all(p == (s >= 0.3) and 0 <= s <= 1 for _, _, s, p in a)
    assert np.mean([p == i % 2 for i, _, _, p in a]) > 0.95


def test_odd_rows(spark):
    df = docs_of(spark, ["text one", None, "", "text one", "y " * 100_000], ids=[1, 2, 3, 1, None]).withColumnRenamed("lang", "quality").withColumnRenamed("source", "stats")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    assert [r[0] for r in rows_of(score_quality(df, labels), "doc_id")] == sorted([1, 2, 3, 1, None], key=repr)
    none = labels.where("doc_id = 99")
    assert {r[0] for r in rows_of(score_quality(df, none), "score")} == {0.5}
    assert score_quality(docs_of(spark, []), labels).count() == 0


def test_statistics():
    assert statistics(b"") == [0.0] * len(STATS)
    assert all(np.isfinite(statistics(t)).all() for t in (b" ", b"\n", b"a", "é".encode(), b"A!! B!!", b"x" * 10**6))


def test_fourier_approximates_the_kernel():
    r = np.random.default_rng(0)
    z = r.normal(size=(40, 5))
    omega, phase = r.normal(size=(5, 6000)) / 2.0, r.uniform(0, 2 * np.pi, 6000)
    f = fourier(z, omega, phase)[:, :-1]
    true = np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / (2 * 2.0**2))
    assert np.abs(f @ f.T - true).max() < 0.08


@pytest.mark.parametrize("seed", range(3))
def test_isotonic(seed):
    r = np.random.default_rng(seed)
    total = r.integers(0, 30, BINS).astype(float)
    good = np.array([r.binomial(int(n), (i + 1) / (BINS + 2)) for i, n in enumerate(total)], float)
    levels = isotonic(good, total)
    assert (np.diff(levels) >= 0).all() and abs((levels * total).sum() - good.sum()) < 0.02 * good.sum()
    assert bins(np.array([-9.0, -0.5, 0.5, 9.0])).tolist() == [0, 0, BINS // 2, BINS - 1]
