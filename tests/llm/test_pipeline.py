from __future__ import annotations

import pytest

import corpus_pipeline as P
from alphaspark.llm.queries import QUERIES

from .helpers import rows_of
from .test_line_dedup import brute as brute_lines
from .test_near_dedup import brute as brute_near


@pytest.fixture(scope="module")
def stages(spark, sf_small):
    docs, out = spark.read.parquet(f"{sf_small}/documents.parquet"), []
    for name, stage in P.STAGES:
        kept = stage(spark, docs, sf_small).cache()
        out.append((name, docs, kept))
        docs = kept
    return out


def test_stages_keep_the_columns(stages):
    assert len(P.STAGES) == 5
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()


def test_quality_rejects_what_it_scores_low(stages, spark, sf_small):
    _, before, after = stages[0]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after.collect()}
    gone = {r["doc_id"] for r in before.collect()} - kept
    wrong = sum(labels.get(i) == 1 for i in gone) + sum(labels.get(i) == 0 for i in kept)
    assert gone and wrong <= 0.08 * len(labels)


def test_lines_against_brute_force(stages):
    _, before, after = stages[1]
    want = brute_lines([(r["doc_id"], r["text"]) for r in before.collect()], 10)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()} == {i: (t, len(t)) for i, (_, _, t) in want.items()}


def test_near_duplicates_against_brute_force(stages):
    _, before, after = stages[2]
    rows = sorted(before.collect(), key=lambda r: r["doc_id"])
    want = {rows[i]["doc_id"] for i, _, _, kept in brute_near([r["text"] for r in rows], 5) if kept}
    assert {r["doc_id"] for r in after.collect()} == want


def test_leaks_against_brute_force(stages, spark, sf_small):
    _, before, after = stages[3]
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    leaking = {r["doc_id"] for r in before.collect() if any(x in " ".join(r["text"].split()) for x in items)}
    assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()} == leaking


def test_mixing_takes_all_that_is_left(stages):
    _, before, after = stages[4]
    assert rows_of(after, "doc_id") == rows_of(before, "doc_id")


def test_run_equals_its_stages(stages, spark, sf_small):
    assert rows_of(P.run(spark, sf_small)) == rows_of(stages[-1][2])


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_run(spark, sf_small, name):
    assert QUERIES[name](spark, sf_small).count() >= 0


def test_rows_that_share_an_id_are_judged_one_by_one(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    kept = {r["doc_id"] for r in P.quality_stage(spark, docs, sf_small).collect()}
    good = docs.where(docs.doc_id.isin(sorted(kept)[:5])).collect()
    bad = [r for r in docs.collect() if r["doc_id"] not in kept][:5]
    item = spark.read.parquet(f"{sf_small}/benchmark.parquet").first()["text"]
    same = lambda rows, i, text=None: [(*(i if c == "doc_id" else text if text and c == "text" else r[c] for c in docs.columns),) for r in rows]
    for i in (None, 10**9):
        mixed = docs.where("doc_id < 0 OR doc_id > 10").unionByName(spark.createDataFrame(same(good + bad, i), docs.schema))
        ours = P.quality_stage(spark, mixed, sf_small).where("doc_id IS NULL" if i is None else f"doc_id = {i}")
        assert sorted(r["text"] for r in ours.collect()) == sorted(r["text"] for r in good)
        leaky = spark.createDataFrame(same(good, i) + same(good[:1], i, item), docs.schema)
        assert sorted(r["text"] for r in P.decontamination_stage(spark, leaky, sf_small).collect()) == sorted(r["text"] for r in good)


WIDE = "doc_id long, text string, lang string, source string, n_chars long, __k1 int, __k2 int, __id int, __leak int, n_lines int, n_dropped int, k2 int, component int, kept string"


@pytest.fixture(scope="module")
def odd(spark, sf_small):
    """Rows with nulls in every column, empty and repeated texts, repeated rows and ids, and columns with the operators' own names."""
    good = [r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").where("n_chars > 400").orderBy("doc_id").limit(6).collect()]
    extra = tuple(range(777, 777 + 8)) + ("mine",)
    rows = [(i, t, "en", "s", len(t), *extra) for i, t in enumerate(good)] + [(0, good[0], "en", "s", len(good[0]), *extra)] * 2
    rows += [(100, None, None, None, None, *([None] * 9)), (None, good[1], "en", None, None, *extra), (None, None, None, None, None, *([None] * 9)), (101, "", "en", "s", 0, *extra), (101, "", "en", "s", 0, *extra), (5, " \n ", "de", "t", 3, *extra)]
    rows += [(200 + i, f"shared line of twelve\nown words of number {i} here\n", "en", "s", 50, *extra) for i in range(12)]
    return spark.createDataFrame(rows, WIDE)


@pytest.mark.parametrize(("name", "stage"), P.STAGES, ids=[n for n, _ in P.STAGES])
def test_stages_on_odd_rows_and_clashing_columns(odd, spark, sf_small, name, stage):
    out = stage(spark, odd, sf_small)
    got = out.collect()
    if name == "source mixing":
        assert len(got) == odd.count() and all(r["taken"] == 0 and r["first_position"] is None for r in got if r["size"] == 0)
        return
    assert out.columns == odd.columns
    before = [tuple(r) for r in odd.collect()]
    for r in got:
        if r["lang"] is not None:
            assert (r["__k1"], r["__id"], r["__leak"], r["n_lines"], r["n_dropped"], r["k2"], r["kept"]) == (777, 779, 780, 781, 782, 783, "mine")
    if name == "line dedup":
        assert len(got) == len(before) and all(r["text"] == f"own words of number {r['doc_id'] - 200} here\n" and r["n_chars"] == len(r["text"]) for r in got if (r["doc_id"] or 0) >= 200)
        assert sum(r["text"] is None for r in got) == 2 and sum(r["text"] == "" for r in got) == 2
    else:
        assert all(tuple(r) in before for r in got)
        if name == "near dedup":
            # Repeated rows of the id that stays, rows without an id, and texts without words.
            assert sorted(((r["doc_id"] is None), r["doc_id"]) for r in got if r["doc_id"] in (0, 100, 101, None)) == [(False, 0)] * 3 + [(False, 100)] + [(False, 101)] * 2 + [(True, None)] * 2
        elif name == "benchmark decontamination":
            assert sum(not (r["text"] or "").strip() for r in got) == 5


@pytest.mark.parametrize(("name", "stage"), P.STAGES, ids=[n for n, _ in P.STAGES])
def test_stages_on_an_empty_table(odd, spark, sf_small, name, stage):
    assert stage(spark, odd.limit(0), sf_small).count() == 0


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from alphaspark.llm.common import checkpoint_root

    def session(master):
        conf = SimpleNamespace(get=lambda *a: None)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    assert checkpoint_root(session("local[4]")).startswith("file://") and checkpoint_root(session("local")) and checkpoint_root(session("local[*, 3]"))
    for master in ("yarn", "spark://host:7077", "k8s://https://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            checkpoint_root(session(master))
