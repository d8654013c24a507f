from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from alphaspark.llm.line_dedup import keep_bitmaps, line_dedup

from .helpers import docs_of, rows_of

SPACE = " \t\n\x0b\x0c\r"


def ascii_lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_docs, keep="none"):
    seen = defaultdict(set)
    key = lambda line: ascii_lower(line.strip(SPACE))
    order = defaultdict(list)
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if key(line):
                seen[key(line)].add(i)
                order[key(line)].append((i, p))
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [len(seen[key(x)]) < min_docs or (keep == "first" and min(order[key(x)]) == (i, p)) for p, x in enumerate(lines)]
        text = "\n".join(x for x, s in zip(lines, stay) if s)
        out[i] = (len(lines), len(lines) - sum(stay), text)
    return out


TEXTS = ["A b\nc\n A B \nd", "a b\n\nÉcole\n", None, "", "école\nx\ta b", "\x0ba b\x0c\nc", "c", "C\r\n tail", " a b", "a b"]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("min_docs", [2, 3, 5])
def test_against_brute_force(spark, keep, min_docs):
    rows = list(enumerate(TEXTS))
    want = brute(rows, min_docs, keep)
    got = line_dedup(docs_of(spark, TEXTS), min_docs, keep).select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want


def test_other_columns_and_null_texts_stay(spark):
    df = docs_of(spark, TEXTS).withColumn("k1", F.lit("mine")).withColumn("pos", F.lit(7)).withColumn("n_lines", F.lit(-1))
    out = line_dedup(df, 2)
    assert {(r["k1"], r["pos"]) for r in out.collect()} == {("mine", 7)}
    assert out.where("text IS NULL").count() == 1
    assert out.where("n_lines = -1").count() == 0


def test_repeated_rows_and_null_ids(spark):
    df = docs_of(spark, ["same", "same", "same", "other"], ids=[1, 1, None, 2])
    assert rows_of(line_dedup(df, 3), "doc_id", "n_dropped") == sorted([(1, 0), (1, 0), (None, 0), (2, 0)], key=repr)
    assert rows_of(line_dedup(df, 2), "doc_id", "n_dropped") == sorted([(1, 1), (1, 1), (None, 1), (2, 0)], key=repr)


def test_empty_table_and_long_text(spark):
    assert line_dedup(docs_of(spark, []), 2).count() == 0
    long = "\n".join(f"line {i}" for i in range(30_000))
    got = line_dedup(docs_of(spark, [long, "line 5\nline 29999"]), 2).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert (by_id[0]["n_lines"], by_id[0]["n_dropped"], by_id[1]["text"]) == (30_000, 2, "")
    assert hashlib.sha256(by_id[0]["text"].encode()).hexdigest() == hashlib.sha256("\n".join(x for x in long.split("\n") if x not in ("line 5", "line 29999")).encode()).hexdigest()


def test_bitmaps_hold_no_text(spark):
    df = keep_bitmaps(docs_of(spark, ["a\nb\nc\na", "a"]).select("doc_id", "text"), 2)
    assert df.columns == ["k1", "k2", "n_lines", "n_dropped", "keep_runs"]
    assert [[tuple(x) for x in r["keep_runs"]] for r in df.orderBy(F.col("n_lines").desc()).collect()] == [[(1, 2)], []]
    with pytest.raises(ValueError):
        keep_bitmaps(df, keep="last")
