"""The store's versions and months, files in other encodings, and whole runs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from alphaspark import cli
from alphaspark.sources import column_maps, files
from alphaspark.warehouse import Store, runs
from alphaspark.warehouse.store import has_limit


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def bars(spark, rows):
    return spark.createDataFrame([(dt.date.fromisoformat(d), s, float(c)) for d, s, c in rows], "date date, symbol string, close double")


def closes(store, name="daily_ohlcv"):
    return sorted((str(r["date"]), r["symbol"], r["close"]) for r in store.table(name).collect())


def test_gbk_that_begins_long_after_the_header(spark, tmp_path):
    rows = [f"a{i},plain" for i in range(400)] + ["b,中文", 'c,"x, y"']
    (tmp_path / "late.csv").write_bytes("\n".join(["code,name", *rows]).encode("gbk"))
    got = {r["code"]: r["name"] for r in files.read_source_csv(spark, str(tmp_path / "late.csv")).collect()}
    assert len(got) == 402 and got["b"] == "中文" and got["c"] == "x, y"
    (tmp_path / "utf8.csv").write_text("name,code,more\n名,d,1\n", encoding="utf-8")
    both = {r["code"]: (r["name"], r["more"]) for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert both["b"] == ("中文", None) and both["d"] == ("名", "1") and len(both) == 403
    (tmp_path / "neither.csv").write_bytes(b"code,name\ne,\xff\xff\n")
    with pytest.raises(Exception, match="decode"):
        files.read_source_csv(spark, str(tmp_path / "neither.csv")).collect()


@pytest.mark.parametrize(("columns", "source"), [("ts_code,close", "tushare"), ("日期,收盘", "akshare"), ("code,date,money", "joinquant"), ("symbol,date", "default"), ("x,y", "default"), ("trade_date,open,high,low,close,volume,amount", "tushare")])
def test_sources_by_their_names(columns, source):
    assert column_maps.detect(columns.split(",")) == source


def test_an_upsert_rewrites_only_the_months_it_touches(store):
    store.upsert("daily_ohlcv", bars(store.spark, [(f"2024-{m:02d}-10", s, m) for m in range(1, 13) for s in "ab"]))
    before = store._parts("daily_ohlcv")["parts"]
    assert store.upsert("daily_ohlcv", bars(store.spark, [("2024-03-10", "a", 99), ("2024-03-11", "a", 98), ("2024-03-11", "a", 97)])) == 2
    after = store._parts("daily_ohlcv")["parts"]
    assert [p for p in after if after[p] != before.get(p)] == ["2024-03"] and len(after) == 12
    got = closes(store)
    assert len(got) == 25 and ("2024-03-10", "a", 99.0) in got and ("2024-03-11", "a", 98.0) in got and ("2024-03-10", "b", 3.0) in got
    assert store.get_ohlcv(start="2024-03-11", end="2024-04-30").count() == 3
    assert len(store.months("daily_ohlcv", "2024-03-11", "2024-04-30").inputFiles()) < len(store.table("daily_ohlcv").inputFiles())
    assert store.vacuum("daily_ohlcv") == 0 and closes(store) == got
    store.upsert("daily_ohlcv", bars(store.spark, [(f"2024-{m:02d}-10", s, 0) for m in range(1, 13) for s in "ab"]))
    assert store.vacuum("daily_ohlcv") == 2 and len(closes(store)) == 25


def test_appending_reads_nothing_and_reruns_agree(store):
    twice = [("2024-01-02", "a", 1), ("2024-01-02", "a", 2), (("2024-02-02"), "b", 3)]
    assert store.insert("daily_ohlcv", bars(store.spark, twice)) == 2 and closes(store)[0][2] == 2.0
    first = store._parts("daily_ohlcv")["parts"]
    assert store.insert("daily_ohlcv", bars(store.spark, [("2024-02-02", "b", 5), ("2024-02-03", "b", 4)])) == 1
    parts = store._parts("daily_ohlcv")["parts"]
    assert parts["2024-01"] == first["2024-01"] and parts["2024-02"][0] == first["2024-02"][0] and len(parts["2024-02"]) == 2
    assert closes(store)[1:] == [("2024-02-02", "b", 3.0), ("2024-02-03", "b", 4.0)]
    store.insert("daily_ohlcv", store.spark.createDataFrame([(None, "c", 1.0)], "date date, symbol string, close double"))
    assert store.table("daily_ohlcv").where("date IS NULL").count() == 1


def test_many_small_folders_come_together(store, monkeypatch):
    monkeypatch.setattr("alphaspark.warehouse.store.MOST_FOLDERS", 3)
    for i in range(6):
        store.log_update("t", "ok", i)
    assert store.table("meta_update_log").count() == 6 and len(store._parts("meta_update_log")["parts"]["all"]) <= 3
    assert sorted(r["row_count"] for r in store.history(3).collect()) == [3, 4, 5]


def test_statements(store):
    store.write("t", store.spark.createDataFrame([(1, "a")], "k int, limit_kind string"))
    seen = store.table("t")
    store.execute("INSERT INTO t VALUES (2, 'b')")
    store.execute("insert into table `t` (limit_kind) SELECT 'c'")
    assert seen.count() == 1 and sorted(r["limit_kind"] for r in store.table("t").collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        store.execute("INSERT INTO t (k) VALUES (1, 'x')")
    store.execute("INSERT OVERWRITE t SELECT * FROM t WHERE k = 2")
    assert store.table("t").collect() == [(2, "b")]
    store.write("many", store.spark.range(50).withColumn("limit_kind", F.lit("x")))
    assert store.query("SELECT limit_kind FROM many", limit=5).count() == 5
    assert store.query("SELECT * FROM many LIMIT 7", limit=5).count() == 7


@pytest.mark.parametrize(("sql", "found"), [("SELECT 1 LIMIT 5", True), ("SELECT limit_kind FROM t", False), ("SELECT 'limit 5' FROM t -- limit 3", False), ("SELECT * FROM (SELECT 1 LIMIT 3) t", False), ("SELECT * FROM t limit all", True), ("SELECT a FROM t /* limit 1 */ WHERE limit > 3", False)])
def test_limits(sql, found):
    assert has_limit(sql) is found


def test_a_write_that_was_overtaken_raises(store, monkeypatch):
    store.write("t", store.spark.range(3))
    add = store._add

    def slow(name, version, df, label=""):
        monkeypatch.setattr(store, "_add", add)
        Store(store.spark, store.root).write("t", store.spark.range(5))
        return add(name, version, df, label)

    monkeypatch.setattr(store, "_add", slow)
    with pytest.raises(RuntimeError, match="changed"):
        store.append("t", store.spark.range(9))
    assert store.table("t").count() == 5


def test_runs(store, tmp_path, capsys):
    own = files.synthetic_bars(store.spark, 3, "2024-01-01", "2024-02-29")
    done = runs.initialise(store, "full", "src", "2024-01-01", "2024-02-29", own)
    assert list(done) == ["calendar", "ohlcv", "etl", "app", "validate"] and not any(v.startswith("failed") for v in done.values())
    again = runs.initialise(store, "ods", "src", "2024-01-01", "2024-02-29", own)
    assert set(again.values()) == {"there already"}
    assert runs.initialise(store, "ohlcv", "src", force=True)["ohlcv"].startswith("failed")
    assert runs.initialise(store, "validate", skip_validation=True) == {"validate": "skipped"}
    with pytest.raises(ValueError):
        runs.initialise(store, "some")
    more = files.synthetic_bars(store.spark, 3, "2024-01-01", "2024-03-08")
    rows = store.table("ods_daily_ohlcv").count()
    assert runs.update(store, "src", more, "2024-03-06", 8, dry_run=True) == {"calendar": "6 new days", "ohlcv": "12 new bars"}
    assert store.table("ods_daily_ohlcv").count() == rows
    assert runs.update(store, "src", more, "2024-03-06", 8)["etl"] and store.table("dwd_daily_ohlcv").count() == rows + 12
    status = {r["table_name"]: (str(r["last_date"]), r["status"]) for r in runs.health(store, "2024-03-08").collect()}
    assert status["dwd_daily_ohlcv"] == ("2024-03-06", "stale")
    own.write.parquet(str(tmp_path / "parquet"))
    run = lambda *a: cli.main(["--store", f"file://{tmp_path}/w", *a], store.spark)
    assert run("init-data", "ods", "--bars", str(tmp_path / "parquet"), "--start", "2024-01-01", "--end", "2024-02-29") == 0
    assert run("update", "--bars", str(tmp_path / "parquet"), "--today", "2024-02-29", "--dry-run") == 0 and run("update", "--check") == 0
    assert run("init-data", "ohlcv", "--force") == 1


def test_commands_of_several_factors(spark, tmp_path, capsys):
    run = lambda *a: cli.main(["--store", f"file://{tmp_path}/w", *a], spark)
    files.synthetic_bars(spark, 8, "2024-01-01", "2024-03-01").write.parquet(str(tmp_path / "p"))
    run("import-parquet", str(tmp_path / "p"))
    (tmp_path / "f.txt").write_text("# some\nMean($close, 5)\nNope($close)\n\nRef($close, 1) / $close\n")
    assert run("factor-batch", str(tmp_path / "f.txt"), "--output", str(tmp_path / "batch")) == 0
    assert {r["name"] for r in spark.read.parquet(str(tmp_path / "batch")).select("name").distinct().collect()} == {"Mean_close_5", "Ref_close_1_close"}
    assert run("backtest-run", "alpha014", "alpha018", "nope", "--output", str(tmp_path / "bt")) == 1
    assert spark.read.parquet(str(tmp_path / "bt/alpha018/layered")).count() > 20 and capsys.readouterr().out.count('"ic_mean"') == 2
    assert run("report", "alpha014", "alpha018", str(tmp_path / "r.html")) == 0 and (tmp_path / "r.html").read_text().count("<h1>") == 2
