from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from alphaspark import calendar_tools, cli
from alphaspark.config import PipelineConfig, load_config
from alphaspark.sources import column_maps, files
from alphaspark.streaming.bars import event_bars, event_stream, upsert_bars
from alphaspark.warehouse import Store
from alphaspark.warehouse import transforms as T
from alphaspark.warehouse.schema import TABLES, data_dictionary

CSV = "date,symbol,open,high,low,close,volume,amount\n2024-01-02,000001,1,2,0.5,1.5,100,150\n2024-01-03,000001,1.5,2,1,1.8,200,\n2024-01-02,000002,x,2,0.5,1.5,100,150\n"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "bars.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_round_trip(store, csv, tmp_path):
    assert store.import_csv(csv, "daily_ohlcv") == 3
    assert store.import_csv(csv, "daily_ohlcv") == 0  # the same keys
    assert store.import_csv(csv, "daily_ohlcv", "replace") == 3
    with pytest.raises(ValueError):
        store.import_csv(csv, "daily_ohlcv", "fail")
    with pytest.raises(ValueError):
        store.import_csv(csv, "daily_ohlcv", "maybe")
    assert store.fetchone("SELECT open FROM daily_ohlcv WHERE symbol = '000002'") == (None,)
    assert store.get_ohlcv(["000001"], ["close"], "2024-01-03").collect() == [(dt.date(2024, 1, 3), "000001", 1.8)]
    store.export_csv("SELECT symbol, close FROM daily_ohlcv ORDER BY close", str(tmp_path / "out"), delimiter=";")
    assert store.spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "out")).count() == 3
    store.export_parquet("daily_ohlcv", str(tmp_path / "outp"))
    assert store.import_parquet(str(tmp_path / "outp"), "copy") == 3


def test_free_tables_append(store, csv):
    assert store.import_csv(csv, "mine") == 3 and store.import_csv(csv, "mine") == 3 and store.table("mine").count() == 6


def test_empty_and_broken_csv(store, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert store.import_csv(str(tmp_path / "empty.csv"), "daily_ohlcv") == 0
    (tmp_path / "bad.csv").write_text("date,symbol,close\ninvalid,a,1\n2024-01-02,b,2\n")
    assert store.import_csv(str(tmp_path / "bad.csv"), "daily_ohlcv") == 2
    assert store.table("daily_ohlcv").where("date IS NULL").count() == 1
    assert store.validate()["null_keys"] == {"date": 1, "symbol": 0}


@pytest.mark.parametrize(
    ("header", "row", "source"),
    [("trade_date,ts_code,open,vol", "20240102,600000.SH,1,5", "tushare"), ("日期,股票代码,开盘,成交量", "2024/1/2,sh600000,1,5", "akshare"), ("date,code,open,volume", "2024-01-02,600000.XSHG,1,5", "joinquant"), ("date,symbol,open,volume", "2024-01-02 00:00:00,SH.600000,1,5", "default")],
)
@pytest.mark.parametrize("encoding", ["utf-8", "gbk"])
def test_sources(store, tmp_path, header, row, source, encoding):
    (tmp_path / "s.csv").write_bytes(f"{header}\n{row}\n,,,\n".encode(encoding))
    df = files.read_source_csv(store.spark, str(tmp_path / "s.csv"))
    assert column_maps.detect(df.columns) == source
    assert [tuple(r) for r in column_maps.normalise(df).collect()] == [(dt.date(2024, 1, 2), "600000", 1.0, 5.0)]
    assert store.import_source_csv(str(tmp_path / "s.csv")) == 1


def test_folders(store, tmp_path):
    for i, folder in enumerate(("in", "in/deep")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / f"{i}.csv").write_text(CSV.replace("0000", f"1{i}00"))
    assert files.read_folder(store.spark, str(tmp_path / "in")).count() == 3
    assert store.import_folder(str(tmp_path / "in"), "daily_ohlcv", recursive=True) == 6


def test_upsert_and_insert(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string, w int")
    old, new = frame([(1, "a", 1), (2, "b", 2)]), frame([(2, "B", 20), (3, "C", 30)])
    assert sorted(map(tuple, T.upsert(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "B", 20), (3, "C", 30)]
    assert sorted(map(tuple, T.upsert(old, new, ["k"], keep=["w"]).collect())) == [(1, "a", 1), (2, "B", 2), (3, "C", 30)]
    assert sorted(map(tuple, T.upsert(old, new.drop("w"), ["k"]).collect())) == [(1, "a", 1), (2, "B", None), (3, "C", None)]
    assert [r["k"] for r in T.insert_missing(old, new, ["k"]).collect()] == [3]
    assert sorted(map(tuple, T.latest(old.union(frame([(1, "z", 9)])), ["k"], "w").collect())) == [(1, "z", 9), (2, "b", 2)]


def test_layers_end_to_end(store):
    spark = store.spark
    days = calendar_tools.calendar(spark, "2024-01-01", "2024-03-31", ["2024-01-01"])
    assert store.import_ods("src", "calendars", days) == 91
    store.import_ods("src", "instruments", spark.createDataFrame([("688001", "A", "SH", "tech", dt.date(2020, 1, 1), None), ("000001", "B", "SZ", "bank", dt.date(2010, 1, 1), dt.date(2024, 2, 1))], "symbol string, name string, market string, industry string, list_date date, delist_date date"))
    store.import_ods("src", "index_components", spark.createDataFrame([("IDX", "688001", dt.date(2024, 1, 1), 0.6), ("IDX", "000001", dt.date(2024, 1, 1), 0.4)], "index_code string, symbol string, in_date date, weight double"))
    bars = files.synthetic_bars(spark, 3, "2024-01-01", "2024-03-31")
    store.import_ods("src", "daily_ohlcv", bars)
    assert set(store.run_etl("src").values()) == {"ok"} and store.run_etl("src", ["nope"])["nope"].startswith("failed")
    assert store.table("dwd_daily_ohlcv").count() == bars.count()
    assert {r["symbol"]: (r["board_type"], r["status"]) for r in store.get_instruments(table="dwd_instruments").collect()} == {"688001": ("STAR", "ACTIVE"), "000001": ("MAIN", "DELISTED")}
    assert [r["symbol"] for r in store.get_index_members("IDX").collect()] == ["688001", "000001"]
    store.import_ods("src", "index_components", spark.createDataFrame([("IDX", "688002", dt.date(2024, 2, 1), 1.0)], "index_code string, symbol string, in_date date, weight double"))
    store.write("ods_index_components", store.table("ods_index_components").where("symbol = '688002'"))
    store.run_etl("src", ["index_components"])
    assert [r["symbol"] for r in store.get_index_members("IDX").collect()] == ["688002"] and store.table("dwd_index_components").count() == 3
    store.roll_up()
    store.roll_up(monthly=False, start="2024-02-01")
    assert store.table("app_monthly_stats").count() == 9 and store.table("app_yearly_stats").count() == 3
    first = store.table("app_monthly_stats").where("symbol = '000001' AND month = 2").first()
    own = bars.where("symbol = '000001' AND month(date) = 2").orderBy("date").collect()
    assert (first["open"], first["close"], first["volume"]) == (own[0]["open"], own[-1]["close"], sum(r["volume"] for r in own))
    assert {r["rule"]: r["passed"] for r in store.validate_all("2024-03-30").collect()} == {"trading_day_on_weekend": True, "list_date_range": True, "price_order": True, "negative_size": True, "recency": True}
    assert store.table("meta_validation_log").count() == 5
    store.update_params("dwd_daily_ohlcv")
    assert store.table_freshness("2024-04-03").first()["status"] == "stale"
    assert store.get_trading_days("2024-01-01", "2024-01-07", "dwd_calendars").count() == 4
    assert store.get_ods("src", "daily_ohlcv").count() == bars.count()


def test_catalog_and_meta(store):
    store.create("daily_ohlcv", "instruments")
    assert store.list_tables() == ["daily_ohlcv", "instruments"] and store.show_schema("daily_ohlcv")["date"] == "date"
    store.insert("instruments", store.spark.createDataFrame([("a", "A")], "symbol string, name string"))
    store.copy("instruments", "again")
    store.truncate("instruments")
    assert store.table("instruments").count() == 0 and store.table("again").count() == 1 and store.vacuum("instruments") >= 2
    assert store.drop("again") and "again" not in store.list_tables()
    with pytest.raises(KeyError):
        store.table("again")
    store.register_source("b", 2)
    store.register_source("a", 1, config={"x": 1})
    store.register_source("c", 0, is_active=False)
    assert store.primary_source() == "a" and [r["name"] for r in store.active_sources().collect()] == ["a", "b"]
    for i in range(3):
        store.log_update("t", "ok", i)
    assert store.history(2).count() == 2
    assert store.query("SELECT 1 AS x", limit=5).collect()[0]["x"] == 1 and store.info().count() >= 2
    assert data_dictionary("daily_ohlcv")["key"] == ["date", "symbol"] and set(data_dictionary()) == set(TABLES)


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (4.0, "b"), (None, None)], "x double, s string")
    got = {r["column"]: r for r in T.describe(df).collect()}
    assert (got["x"]["count"], got["x"]["q50"], got["x"]["nunique"], got["s"]["nunique"], got["s"]["mean"]) == (3, 2.0, 3, 2, None)
    assert T.column_stats(df, "x").first()["avg"] == pytest.approx(7 / 3)
    assert [r["id"] for r in T.next_ids(df, ["x"], 10).collect()] == [11, 12, 13, 14]


def test_calendars(spark):
    parts = {r["date"]: r for r in calendar_tools.calendar_parts(calendar_tools.trading_days(spark, "2024-12-23", "2025-01-03", ["2024-12-25"])).collect()}
    assert len(parts) == 9 and parts[dt.date(2024, 12, 31)]["is_year_end"] and parts[dt.date(2024, 12, 27)]["is_week_end"] and parts[dt.date(2024, 12, 30)]["week"] == 1
    assert [str(r["date"]) for r in calendar_tools.days_after(spark, "2024-01-05", "2024-01-09").collect()] == ["2024-01-08", "2024-01-09"]
    assert calendar_tools.days_after(spark, "2024-01-05", "2024-01-02").count() == 0


def test_streaming_bars(spark, sf_small, tmp_path):
    import shutil

    folder = tmp_path / "events"
    folder.mkdir()
    shutil.copy(f"{sf_small}/events.parquet", folder / "events.parquet")
    bars = event_bars(event_stream(spark, str(folder)))
    store = Store(spark, f"file://{tmp_path}/s")
    want = event_bars(spark.read.parquet(str(folder)))
    store.write("event_bars", want.limit(0))
    upsert_bars(bars, lambda: store.table("event_bars"), lambda df: store.write("event_bars", df), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, store.table("event_bars").collect())) == sorted(map(tuple, want.collect()))


def test_config(tmp_path, monkeypatch):
    assert load_config().backtest.n_quantiles == 5
    pytest.importorskip("yaml")
    config = PipelineConfig()
    config.backtest.n_quantiles = 7
    config.to_yaml(str(tmp_path / "c.yaml"))
    monkeypatch.setenv("ALPHASPARK_CONFIG", str(tmp_path / "c.yaml"))
    assert load_config().backtest.n_quantiles == 7
    with pytest.raises(ValueError):
        PipelineConfig.from_dict({"data": {"nope": 1}})


def test_cli(spark, tmp_path, csv, capsys):
    run = lambda *a: cli.main(["--store", f"file://{tmp_path}/w", *a], spark)
    assert run("import-csv", csv) == 0
    for command in (["tables"], ["info"], ["schema", "daily_ohlcv"], ["query", "SELECT count(*) AS n FROM daily_ohlcv"], ["stats"], ["preview", csv], ["factors"], ["factor-doc", "alpha014"], ["factor-run", "alpha013"], ["expr", "Mean($close, 2)"], ["expr", "Mean($close, 2)", "--explain"], ["validate"], ["etl", "x"], ["vacuum"], ["copy-table", "daily_ohlcv", "c"], ["drop", "c"]):
        assert run(*command) == 0
    assert run("export", "daily_ohlcv", str(tmp_path / "o.json")) == 0 and spark.read.json(str(tmp_path / "o.json")).count() == 3
    files.synthetic_bars(spark, 8, "2024-01-01", "2024-03-01").write.parquet(str(tmp_path / "p"))
    assert run("import-parquet", str(tmp_path / "p"), "--if-exists", "replace") == 0
    capsys.readouterr()
    assert run("ic", "alpha014") == 0 and '"n_days"' in capsys.readouterr().out
    assert run("layered", "alpha014", "--quantiles", "3") == 0 and run("report", "alpha014", str(tmp_path / "r.html")) == 0
    assert (tmp_path / "r.html").exists()


def test_pushdown(spark, sf_small):
    from alphaspark.sources.bars import bars

    plan = bars(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan.split("ReadSchema")[1] and plan.count("Exchange") == 1
    files_df = files.load_panel(spark.read.parquet(f"{sf_small}/orders.parquet").select(F.to_date("o_orderdate").alias("date"), F.col("o_custkey").alias("symbol")), [5])
    assert "EqualTo(o_custkey,5)" in files_df._jdf.queryExecution().executedPlan().toString()


def test_markets():
    from alphaspark.markets import IndexCode, Market, full_code

    assert full_code(IndexCode.CSI300) == "000300.SH" and Market("SSE") is Market.SSE
