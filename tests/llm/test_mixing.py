from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alphaspark.llm.mixing import capped_targets, mix_sources
from pyspark.sql import functions as F

from .helpers import docs_of, rows_of


@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12), st.floats(0.1, 1.9))
@settings(max_examples=200, deadline=None)
def test_targets(sizes, share):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    budget = share * sum(sizes)
    got = capped_targets(sizes, weights, budget, 2)
    assert all(0 <= t <= 2 * n + 1e-6 for t, n in zip(got, sizes, strict=True))
    assert sum(got) == pytest.approx(budget, abs=1e-3)
    rates = [t / w for t, w, n in zip(got, weights, sizes, strict=True) if t < 2 * n - 1e-6]
    assert all(r == pytest.approx(rates[0], rel=1e-6, abs=1e-6) for r in rates)


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [" ".join(["w"] * rng.randrange(0, 300)) for _ in range(400)]
    sources = [rng.choice(["a", "a", "a", "a", "b", "c", "Z", None]) for _ in texts]
    return texts, sources


def test_words_taken(spark):
    texts, sources = corpus()
    rows = mix_sources(docs_of(spark, texts, sources=sources)).collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    by: dict = {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["taken"]
        s[1] += r["size"]
    assert all(abs(taken - target) <= 1 and total == n for taken, total, target, n in by.values())
    assert sum(t for _, _, t, _ in by.values()) == pytest.approx(1.5 * sum(size))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = capped_targets([by[s][1] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(size), 2)
    assert [by[s][2] for s in names] == pytest.approx(want)


def test_positions_follow_the_schedule(spark):
    texts, sources = corpus(2)
    out = mix_sources(docs_of(spark, texts, sources=sources))
    rows = out.collect()
    firsts = [r["positions"][0] for r in rows if r["positions"]]
    assert firsts == sorted(firsts) and all(0 <= t <= 1 for r in rows for t in r["positions"])
    assert all(len(r["positions"]) == -(-r["taken"] // r["size"]) for r in rows if r["size"])
    ramps = {s: (0.0, 0.6, -0.6)[i % 3] for i, s in enumerate(sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or "")))}
    for source, ramp in ramps.items():
        own = sorted((t, min(r["size"], r["taken"] - k * r["size"])) for r in rows if r["source"] == source for k, t in enumerate(r["positions"]))
        total, done = sum(n for _, n in own), 0
        for t, n in own:
            assert done / total == pytest.approx(t + ramp * (t * t - t), abs=0.01)
            done += n


def test_reruns_agree_over_any_partitioning(spark):
    texts, sources = corpus(3)
    a = rows_of(mix_sources(docs_of(spark, texts, sources=sources, parts=2)), "doc_id", "taken", "positions")
    assert a == rows_of(mix_sources(docs_of(spark, texts, sources=sources, parts=7)), "doc_id", "taken", "positions")


def test_odd_rows(spark):
    df = docs_of(spark, ["a b c", "a b c", None, "", "x " * 100_000], ids=[1, 1, 2, None, 5], sources=["s", "s", "t", None, None]).withColumn("target", F.lit("mine")).withColumnRenamed("lang", "__at")
    got = rows_of(mix_sources(df), "doc_id", "size", "source_size")
    assert got == sorted([(1, 3, 6), (1, 3, 6), (2, 0, 0), (None, 0, 100_000), (5, 100_000, 100_000)], key=repr)
    assert mix_sources(docs_of(spark, [])).count() == 0
