from __future__ import annotations

import random

import numpy as np
import pytest

from alphaspark.llm.common import WordHasher
from alphaspark.llm.components import connected_components
from alphaspark.llm.near_dedup import near_duplicates, permutations, shingle_set, signature

from .helpers import docs_of, rows_of


def brute(texts, width, percent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            inter, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * inter >= percent * union:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))]


def family(rng, n, words=60, change=0.04):
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = [f"n{rng.randrange(10**6)}" if rng.random() < change else w for w in base]
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_components_against_all_pairs(spark, width):
    rng = random.Random(3)
    texts = [t for k in range(12) for t in family(rng, 12, 40 + 6 * k, 0.01 + 0.012 * (k % 5))]
    texts += texts[:15] + ["", None, " \t\n", "one", "ONE", "one two", "Two one", "É a b c", "é a b c"]
    rng.shuffle(texts)
    want = brute(texts, width)
    assert rows_of(near_duplicates(docs_of(spark, texts), width)) == sorted(want, key=repr)
    assert len({c for _, _, c, _ in want}) < len(texts) - 40


def test_large_group_of_near_copies_is_one_component_with_its_strays(spark):
    rng = random.Random(5)
    texts = family(rng, 300, 80, 0.05)
    assert rows_of(near_duplicates(docs_of(spark, texts), 2)) == sorted(brute(texts, 2), key=repr)


def test_odd_rows(spark):
    df = docs_of(spark, ["a b c d e f", "a b c d e f", None, "a b c d e f", "x"], ids=[7, 7, 3, None, 9]).withColumnRenamed("lang", "bands")
    got = rows_of(near_duplicates(df, 2))
    assert got == sorted([(7, 5, 7, True), (7, 5, 7, True), (3, 0, 3, True), (None, 5, None, True), (9, 1, 9, True)], key=repr)
    assert near_duplicates(docs_of(spark, [])).count() == 0


def test_minmax_estimate_is_unbiased():
    a, b = permutations(64)
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.5, 0.8, 0.9):
        for _ in range(20):
            common = rng.integers(0, 1 << 62, int(300 * share)).astype(np.uint64)
            x, y = (np.unique(np.concatenate([common, rng.integers(0, 1 << 62, 300 - len(common)).astype(np.uint64)])) for _ in range(2))
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            errors.append((signature(x, a, b) == signature(y, a, b)).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_shingles():
    h = WordHasher()
    assert len(shingle_set(b"a b a b a".split(), 2, h)) == 2
    assert len(shingle_set([], 2, h)) == 0
    assert len(shingle_set([b"a"], 2, h)) == 1
    assert shingle_set([b"a", b"b"], 5, h)[0] != shingle_set([b"b", b"a"], 5, h)[0]


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 180)] + [(200, 200), (300, 301), (301, 300)]
    got = dict(rows_of(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 100 for i in range(100, 180)) and got[301] == got[300] == 300 and 200 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_of_many_blocks(spark, monkeypatch):
    """Near copies whose links run through others than the pivot, and templated texts that aren't linked at all."""
    for name, n in (("BLOCK", 8), ("CHUNK", 16), ("PROBES", 3)):
        monkeypatch.setattr(f"alphaspark.llm.near_dedup.{name}", n)
    rng = random.Random(11)
    template = [f"t{i}" for i in range(60)]
    texts = family(rng, 120, 70, 0.055) + [" ".join(template + [f"u{rng.randrange(10**6)}" for _ in range(18)]) for _ in range(60)]
    rng.shuffle(texts)
    want = brute(texts, 2)
    assert rows_of(near_duplicates(docs_of(spark, texts), 2)) == sorted(want, key=repr)
    assert len({c for _, _, c, _ in want}) > 61


def test_an_id_with_several_texts_ties_their_groups(spark):
    a, b = "one two three four five six seven eight nine ten", "red green blue black white brown pink grey cyan lime"
    df = docs_of(spark, [a, a, b, b, a + " x", "lone text"], ids=[5, 9, 9, 3, 7, 9])
    assert rows_of(near_duplicates(df, 2)) == sorted([(5, 9, 3, False), (9, 9, 3, False), (9, 9, 3, False), (3, 9, 3, True), (7, 10, 3, False), (9, 1, 3, False)], key=repr)
