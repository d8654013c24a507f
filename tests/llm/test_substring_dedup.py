from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from alphaspark.llm.common import Prefix, WordHasher
from alphaspark.llm.substring_dedup import common, merged, segments, substring_dedup

from .helpers import docs_of, rows_of


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for d, w in enumerate(words):
        gone = {p for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    w = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    shared = [w(n) for n in (34, 35, 36, 50, 70, 140)]
    docs = []
    for i in range(60):
        own = w(rng.randrange(0, 160))
        for s in rng.sample(shared, rng.randrange(0, 3)):
            at = rng.randrange(0, len(own) + 1)
            a = rng.randrange(0, 4)
            own[at:at] = s[a:] if rng.random() < 0.4 else s
        docs.append(" ".join(own))
    loop = ["x", "y", "z"] * 40
    return [*docs, docs[3], docs[3], " ".join(loop), " ".join(["same"] * 80), "  ", "", None, " ".join(w(20) + loop[:50]), "A\tb c"]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    got = substring_dedup(docs_of(spark, texts))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute(texts, 35), key=repr)


def test_segments_tile_the_windows():
    rng = random.Random(1)
    words = [b"%d" % rng.randrange(9) for _ in range(500)]
    first, count, seeds, runs = segments(Prefix(WordHasher().of(words)), len(words), 35, 12)
    assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all() and first[-1] + count[-1] == 500 - 34
    assert count.max() <= 24 and len(seeds) == len(runs) == len(first)


def test_prefix_hashes_depend_on_words_alone():
    words = [b"a", b"b", b"c"] * 30
    p = Prefix(WordHasher().of(words))
    h = p.run(np.arange(60), 30)
    assert len(set(h.tolist())) == 3 and (h[:3] == h[3:6]).all()


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    df = docs_of(spark, [long, None, long, "short"], ids=[1, None, None, 4]).withColumnRenamed("lang", "spans").withColumnRenamed("source", "k1")
    assert [r[:3] for r in rows_of(substring_dedup(df), "doc_id", "n_words", "n_removed")] == sorted([(1, 40_000, 40_000), (None, 0, 0), (None, 40_000, 40_000), (4, 1, 0)], key=repr)
    again = docs_of(spark, [long[:3000]] * 2, ids=[5, 5])
    assert {r["n_removed"] for r in substring_dedup(again).collect()} == {len(long[:3000].split())}
    assert substring_dedup(docs_of(spark, [])).count() == 0


def test_merged():
    assert merged([(5, 9), (0, 3), (3, 4), (8, 12)]) == [(0, 4), (5, 12)]


def test_sides_in_common_by_bisection():
    rng = np.random.default_rng(2)
    a = rng.integers(1, 1 << 40, (200, 23))
    b, want = a.copy(), rng.integers(0, 24, 200)
    for i, n in enumerate(want):
        b[i, n:] = rng.integers(1 << 41, 1 << 42, 23 - n)
        if i % 3 == 0:
            a[i, n:] = b[i, n:] = 0
    assert common(a, b).tolist() == want.tolist() and len(common(a[:0], b[:0])) == 0


def test_repeats_that_the_pivot_lacks(spark):
    """One seed in many contexts: some share words with the most frequent one, others only with each other, on either side."""
    rng = random.Random(9)
    w = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    seed, lefts, rights = w(14), [w(30) for _ in range(4)], [w(30) for _ in range(4)]
    texts = []
    for _ in range(70):
        a, b = rng.choice(lefts), rng.choice(rights)
        texts.append(" ".join([*w(rng.randrange(5)), *(w(3) if rng.random() < 0.3 else []), *a[rng.randrange(30) :], *seed, *b[: rng.randrange(31)], *w(rng.randrange(20))]))
    texts += [" ".join([*lefts[0], *seed, *rights[0]])] * 5
    got = substring_dedup(docs_of(spark, texts))
    want = brute(texts, 35)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert 10 < sum(n > 0 for _, _, n, _ in want) < len(texts)
