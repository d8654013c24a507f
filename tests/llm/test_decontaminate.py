from __future__ import annotations

import random

import pytest

from alphaspark.llm.decontaminate import Items, Tokens, find_leaks, template, window_hashes, without_leaks
from pyspark.sql import functions as F

from .helpers import docs_of, rows_of

BENCH = [
    (1, "A train with 120 passengers leaves Boston at 9 and meets 120 more in Denver after 45 minutes of travel. How many passengers are there?"),
    (2, "The quick brown fox jumps over the lazy dog while seven wizards quietly brew strong coffee."),
    (3, "short item text"),
    (4, None),
    (5, ""),
]


def bench(spark, rows=BENCH):
    return spark.createDataFrame(rows, "item_id long, text string")


def leaks(spark, texts, **kw):
    return {(r["doc_id"], r["item_id"]): (r["exact"], r["n_changed"]) for r in find_leaks(docs_of(spark, texts), bench(spark), **kw).collect()}


def test_exact_reparameterised_and_inconsistent(spark):
    changed = "A train with 77 passengers leaves Austin at 8 and meets 77 more in Fargo after 31 minutes of travel. How many passengers are there?"
    broken = changed.replace("meets 77", "meets 78")
    merged = changed.replace("at 8", "at 77")
    texts = [f"Intro here.\n{BENCH[0][1]} And more.", f"x y z. {changed}", f"x y z. {broken}", f"x y z. {merged}", "THE QUICK BROWN FOX!! jumps OVER the lazy dog, while seven wizards quietly brew strong coffee", "nothing of the kind here at all", "a short item TEXT inside"]
    got = leaks(spark, texts)
    assert got == {(0, 1): (True, 0), (1, 1): (False, 5), (4, 2): (True, 0), (6, 3): (True, 0)}


def test_every_window_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(9, 40)))) for i in range(25)]
    texts = []
    for _ in range(60):
        own = [rng.choice(words) for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.5:
            item = rng.choice(items)[1].split()
            cut = item[: rng.randrange(1, len(item) + 1)]
            at = rng.randrange(0, len(own) + 1)
            own[at:at] = cut
        texts.append(" ".join(own))
    want = set()
    for d, t in enumerate(texts):
        grams = {tuple(t.split()[i : i + 8]) for i in range(len(t.split()) - 7)}
        for i, q in items:
            own = [tuple(q.split()[k : k + 8]) for k in range(len(q.split()) - 7)]
            if sum(g in grams for g in own) >= 0.25 * len(own):
                want.add((d, i))
    # letters only, so that no word is a number
    letters = lambda s: " ".join("".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in s.split())
    got = find_leaks(docs_of(spark, [letters(t) for t in texts]), bench(spark, [(i, letters(q)) for i, q in items]))
    assert set(rows_of(got, "doc_id", "item_id")) == want and want
    blocks = find_leaks(docs_of(spark, [letters(t) for t in texts]), bench(spark, [(i, letters(q)) for i, q in items]), block_windows=50)
    assert set(rows_of(blocks, "doc_id", "item_id")) == want


def test_odd_rows(spark):
    leak = BENCH[1][1]
    df = docs_of(spark, [leak, leak, None, "", leak, "word " * 50_000 + leak], ids=[1, 1, 2, 3, None, 6]).withColumnRenamed("lang", "item_id")
    assert rows_of(find_leaks(df, bench(spark)), "doc_id", "item_id") == sorted([(1, 2), (1, 2), (None, 2), (6, 2)], key=repr)
    assert rows_of(without_leaks(df.withColumn("__x", F.lit(1)), bench(spark)), "doc_id") == [(2,), (3,)]
    assert find_leaks(docs_of(spark, []), bench(spark)).count() == 0
    assert find_leaks(df, bench(spark, [])).count() == 0


@pytest.mark.parametrize(("text", "kinds"), [("We saw Paris. Berlin was 5 km off, 3,200 miles", [0, 0, 1, 0, 0, 2, 3, 0, 2, 3]), ("km km 5 words", [0, 0, 2, 0]), ("", []), ("one\nTwo Three", [0, 0, 1])])
def test_template(text, kinds):
    canonical, own = template(text, Tokens())
    assert [int(c) if c < 8 else 0 for c in canonical] == kinds and len(own) == len(kinds)


def test_windows():
    canonical, own = template("a b c d e", Tokens())
    assert len(window_hashes(canonical, 3)) == 3 and len(window_hashes(canonical, 6)) == 0
    assert Items([], 8).find(canonical, own, 0.5) == []


LONG = [f"{a}{b}" for a in "bcdfghklmn" for b in ("alo", "eru", "ima", "osa", "uti", "ane")][:59]


def test_words_put_in_and_excerpts(spark):
    put_in = " ".join(w + (" really" if i % 15 == 14 else "") for i, w in enumerate(LONG))
    left_out = " ".join(w for i, w in enumerate(LONG) if i % 12 != 11)
    excerpt, shorter = " ".join(LONG[20:33]), " ".join(LONG[20:32])
    items = bench(spark, [(1, " ".join(LONG))])
    got = {r["doc_id"]: (r["n_matched"], r["exact"]) for r in find_leaks(docs_of(spark, [f"x y {put_in} z", left_out, f"x {excerpt} y", f"x {shorter} y"]), items).collect()}
    assert got == {0: (31, True), 1: (20, True), 2: (6, True)}


def test_one_slot_that_contradicts_the_others(spark):
    words = [*LONG[:20], "120", *LONG[20:40], "120", *LONG[40:], "7"]
    item = " ".join(words)
    second = words.copy()
    second[41] = "121"
    changed = [{"120": "55", "7": "9"}.get(w, w) for w in words * 3]
    changed[-21] = "56"
    items = bench(spark, [(1, item), (2, " ".join(f"q{w}" if i % 7 else w for i, w in enumerate(words))), (3, " ".join(words * 3))])
    got = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["n_windows"], r["exact"]) for r in find_leaks(docs_of(spark, ["x y " + " ".join(second), " ".join(changed)]), items).collect()}
    assert got[0, 1] == (47, 55, False) and got[1, 3][0] < got[1, 3][1] and not got[1, 3][2]


def test_names_however_they_are_written(spark):
    text = "Yesterday Anna took Ben and Carla from Boston to Denver while Dora and Emil met Frank near Geneva with Hugo for Ivan and Judy"
    words = text.split()
    texts = [text.lower(), text.upper(), "\n".join(words), "\n".join(" ".join(words[i : i + 3]) for i in range(0, len(words), 3)), text.title(), text.replace("Boston", "Austin"), " ".join(words[::-1])]
    got = {r["doc_id"]: (r["exact"], r["n_changed"]) for r in find_leaks(docs_of(spark, texts), bench(spark, [(1, text)])).collect()}
    assert got == {**{i: (True, 0) for i in range(5)}, 5: (False, 1)}


def slow_leaks(text, item, least=0.25, width=8):
    """The rule in plain Python: windows that agree as templates or as words, in copies whose slots map one to one."""
    import re

    from alphaspark.llm.decontaminate import CONSISTENT, NEAR, UNITS, VERBATIM

    def tokens(t):
        out, before = [], "stop"
        for x in re.findall(r"\n|[.!?]+(?=\s|$)|\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*", t):
            low = x.lower()
            kind = "number" if x[0].isdigit() else "stop" if x[0] in "\n.!?" else "unit" if low in UNITS else "name" if len(x) > 1 and x[0].isupper() and x[1:].islower() else "word"
            if kind != "stop":
                slot = kind == "number" or (kind == "name" and before != "stop") or (kind == "unit" and before == "number")
                out.append((low, kind if slot else None))
            before = kind
        return out

    a, b = tokens(item), tokens(text)
    w = min(width, len(a))
    if not w:
        return False
    form = lambda t: [s or x for x, s in t]
    plain = lambda t: ["number" if s == "number" else "w:" + x for x, s in t]
    pairs = [(j - i, i, j) for i in range(len(a) - w + 1) for j in range(len(b) - w + 1) if form(a[i : i + w]) == form(b[j : j + w]) or plain(a[i : i + w]) == plain(b[j : j + w])]
    pairs.sort()
    copies = []
    for p in pairs:
        if copies and p[0] - copies[-1][-1][0] <= NEAR:
            copies[-1].append(p)
        else:
            copies.append([p])
    n = len(a) - w + 1
    for copy in copies:
        slots = {}
        for p in copy:
            here = [(a[p[1] + k], b[p[2] + k]) for k in range(w)]
            numbers_only = all(x[0] == y[0] or x[1] == "number" for x, y in here)
            slots[p] = [(x[0], y[0]) for x, y in here if x[1] and (x[1] == "number" or not numbers_only)]
        counts = {}
        for p in copy:
            for s in slots[p]:
                counts[s] = counts.get(s, 0) + 1
        same = {p: all(a[p[1] + k][0] == b[p[2] + k][0] for k in range(w)) for p in copy}
        chosen, left, right = set(), set(), set()
        for s in sorted(counts, key=lambda s: (-counts[s], s[0] != s[1])):
            if s[0] not in left and s[1] not in right:
                chosen.add(s)
                left.add(s[0])
                right.add(s[1])
        fits = [p for p in copy if all(s in chosen for s in slots[p])]
        if len({p[1] for p in fits}) < CONSISTENT * len({p[1] for p in copy}):
            fits = [p for p in copy if same[p]]
        counted = [p for p in copy if p in set(fits) or same[p]]
        if len({p[1] for p in counted}) >= least * n and counted:
            return True
        run = best = 0
        last = None
        for p in counted:
            if same[p]:
                run = run + 1 if last and p == (last[0], last[1] + 1, last[2] + 1) else 1
                best, last = max(best, run), p
        if best and best + w - 1 >= VERBATIM:
            return True
    return False


def test_placeholders_and_slots_against_brute_force(spark):
    """Questions with numbers, names and units, copied with other values, consistent or not, and with words put in."""
    rng = random.Random(8)
    names, units, words = ["Anna", "Boris", "Clara", "Dario", "Emil", "Fatima"], ["km", "kg", "hours", "miles", "litres"], [f"{x}{y}o" for x in "bdfgklmn" for y in ("ar", "el", "im", "os", "ut")]
    items, texts = [], []
    for _ in range(14):
        shape = [rng.choice("wwwwwNnu") for _ in range(rng.randrange(10, 45))]

        def filled(shape, people, numbers, measures):
            out, k = [], {"N": 0, "n": 0, "u": 0}
            for c in shape:
                if c == "N":
                    out.append(people[k["N"] % 3])
                elif c in "nu":
                    out.append(str(numbers[(k["n"] + k["u"]) % 4]) + (" " + measures[k["u"] % 2] if c == "u" else ""))
                else:
                    out.append(c)
                if c in k:
                    k[c] += 1
            return " ".join(out)

        shape = [rng.choice(words) if c == "w" else c for c in shape]
        item = filled(shape, rng.sample(names, 3), rng.sample(range(2, 99), 4), rng.sample(units, 2))
        items.append(item)
        for _ in range(4):
            copy = filled(shape, rng.sample(names, 3), rng.sample(range(2, 99), 4), rng.sample(units, 2)).split()
            kind = rng.random()
            if kind < 0.3:
                copy = [str(rng.randrange(100, 999)) if x.isdigit() and rng.random() < 0.5 else x for x in copy]
            elif kind < 0.5:
                copy.insert(rng.randrange(len(copy)), "indeed")
            elif kind < 0.7:
                copy = copy[: rng.randrange(4, len(copy) + 1)]
            elif kind < 0.8:
                copy = item.split()
                copy[rng.randrange(len(copy))] = "7"
            texts.append(f"{' '.join(rng.choices(words, k=rng.randrange(12)))} {' '.join(copy)} {' '.join(rng.choices(words, k=rng.randrange(12)))}")
    texts += [" ".join(rng.choices([*words, *names, "12", "km"], k=60)) for _ in range(10)]
    rows = [(i, q) for i, q in enumerate(items)]
    want = {(d, i) for d, t in enumerate(texts) for i, q in rows if slow_leaks(t, q)}
    assert set(rows_of(find_leaks(docs_of(spark, texts), bench(spark, rows)), "doc_id", "item_id")) == want and 10 < len(want) < len(texts) + 20
    assert set(rows_of(find_leaks(docs_of(spark, texts), bench(spark, rows), block_windows=4), "doc_id", "item_id")) == want
    in_memory = Items(rows, 8)
    assert {(d, hit[0]) for d, t in enumerate(texts) for hit in in_memory.find(*template(t, Tokens()), 0.25)} == want


def test_documents_are_read_once_whatever_the_benchmark(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    items = spark.read.parquet(f"{sf_small}/documents.parquet").selectExpr("doc_id AS item_id", "text")
    plan = find_leaks(docs, items, block_windows=100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("documents.parquet") + plan.count("doc_id#") > 0 and plan.count("MapInArrow") == 1


def test_clashing_names_and_a_width_that_is_too_large(spark):
    df = docs_of(spark, [BENCH[1][1], "other words"]).selectExpr("*", "1 AS row", "2 AS item", "3 AS hash", "4 AS __k1", "5 AS k2")
    assert rows_of(find_leaks(df, bench(spark)), "doc_id", "item_id") == [(0, 2)]
    kept = without_leaks(df, bench(spark))
    assert kept.columns == df.columns and rows_of(kept, "doc_id", "__k1", "k2") == [(1, 4, 5)]
    with pytest.raises(ValueError):
        find_leaks(df, bench(spark), width=63)
