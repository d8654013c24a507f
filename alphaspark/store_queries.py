"""Registered queries that go through files, the store and the classes of the public API, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import calendar_tools
from .analysis import FactorReport, ICAnalysis, daily_ic, forward_returns
from .analysis.ic import moving_ic
from .factors import FACTORS
from .factors.registry import FactorABC, FactorRegistry, compute, register_factor
from .functions import rolling
from .functions.axes import AXES, Axes
from .plans import ExprEngine
from .sources import column_maps, files
from .sources.bars import bars
from .streaming.bars import event_bars, event_stream, upsert_bars
from .warehouse import Store
from .warehouse import transforms as T
from .workspace import work_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_store(spark: SparkSession) -> Store:
    return Store(spark, work_folder(spark))


def single(c: str) -> Column:
    """As other queries have floats: in single precision."""
    return F.col(c).cast("float").cast("double").alias(c)


PRICES = ("open", "high", "low", "close", "volume", "amount")


def named_bars(spark: SparkSession, sf_dir: str, every: str = "month") -> DataFrame:
    """Bars whose symbols are six digits."""
    return bars(spark, sf_dir, every).withColumn("symbol", F.lpad(F.col("symbol").cast("string"), 6, "0"))


_NAMED = "n AS (SELECT * REPLACE (lpad(symbol::VARCHAR, 6, '0') AS symbol) FROM bars)"
_SINGLE = ", ".join(f"{c}::FLOAT::DOUBLE AS {c}" for c in PRICES)


def shown(df: DataFrame) -> DataFrame:
    return df.select("date", "symbol", *[single(c) for c in PRICES])


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day"), "o_orderpriority")


_ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS day, o_orderpriority FROM orders"


# Files


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, folder = orders(spark, sf_dir), f"{work_folder(spark)}/csv"
    files.write_csv(own, folder, delimiter=";")
    return files.read_csv(spark, folder, own.schema, sep=";")


def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_folder(spark)}/parquet"
    files.query_to_file(orders(spark, sf_dir), f"{folder}/a.parquet")
    return files.read_folder(spark, folder, "parquet", recursive=True)


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, path = orders(spark, sf_dir), f"{work_folder(spark)}/a.json"
    files.query_to_file(own, path)
    return spark.read.schema(own.schema).json(path)


def csv_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of columns in a folder and one below it, all read as text."""
    folder = work_folder(spark)
    own = orders(spark, sf_dir)
    files.write_csv(own.where("o_orderkey % 2 = 0"), f"{folder}/even")
    files.write_csv(own.where("o_orderkey % 2 = 1"), f"{folder}/even/odd")
    return files.read_folder(spark, f"{folder}/even", recursive=True).select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), F.col("o_totalprice").cast("double"), F.col("day").cast("date"), "o_orderpriority")


def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as a data provider names them, dates without dashes and symbols with their exchange, to our columns."""
    folder = f"{work_folder(spark)}/bars"
    own = named_bars(spark, sf_dir).select(F.date_format("date", "yyyyMMdd").alias("trade_date"), F.concat("symbol", F.lit(".SH")).alias("ts_code"), "open", "high", "low", "close", F.col("volume").alias("vol"), "amount")
    files.write_csv(own, folder)
    return shown(column_maps.normalise(files.read_source_csv(spark, folder)))


def source_csv_gbk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names with characters of GBK in rows far from the first, written byte by byte."""
    folder = f"{work_folder(spark)}/gbk"
    own = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("c"), F.when(F.col("c_custkey") % 100 == 99, "中文").otherwise("")).alias("name"))

    # One file: its lines in order, as bytes.
    text = F.concat(F.lit("code,name\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "name"))), lambda r: F.concat(r["c_custkey"].cast("string"), F.lit(","), r["name"])), "\n"))

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t.encode("gbk") for t in batch.column(0).to_pylist()], pa.binary())], ["value"])

    own.agg(text.alias("text")).mapInArrow(encoded, "value binary").select(F.col("value").cast("string")).coalesce(1).write.text(folder)
    return files.read_source_csv(spark, folder).select(F.col("code").cast("long").alias("code"), "name")


def panel_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(files.load_panel(named_bars(spark, sf_dir), ["000001", "000007", "000031"], "1994-01-01", "1996-06-30"))


def parsed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in four spellings and symbols in five, of which one of each can't be read."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    spelt = F.when(k % 5 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 5 == 1, F.date_format(day, "yyyyMMdd")).when(k % 5 == 2, F.date_format(day, "yyyy/M/d")).when(k % 5 == 3, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("soon"))
    code = F.lpad((F.col("o_custkey") % 1000000).cast("string"), 6, "0")
    symbol = F.when(k % 4 == 0, F.concat(code, F.lit(".SH"))).when(k % 4 == 1, F.concat(F.lit("SZ."), code)).when(k % 4 == 2, F.concat(F.lit("sh"), code)).otherwise(F.concat(code, F.lit(".XSHE")))
    return table(spark, sf_dir, "orders").select("o_orderkey", column_maps.parse_date(spelt).alias("day"), column_maps.bare_symbol(symbol).alias("symbol"))


# The store


def store_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files into a known table twice, of which the second time adds nothing, and a range of it."""
    store, folder = new_store(spark), f"{work_folder(spark)}/bars"
    files.write_csv(named_bars(spark, sf_dir), folder)
    store.import_csv(folder, "daily_ohlcv")
    store.import_csv(folder, "daily_ohlcv")
    return shown(store.get_ohlcv(start="1994-01-01", end="1996-12-31"))


def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of all months, then other bars of 1995: only that year's months are written anew."""
    store, own = new_store(spark), named_bars(spark, sf_dir)
    store.upsert("daily_ohlcv", own)
    store.upsert("daily_ohlcv", own.where("year(date) = 1995 AND symbol < '000050'").withColumn("close", F.col("close") + 1))
    return shown(store.table("daily_ohlcv"))


def store_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet files over what is there, some rows twice."""
    store, folder = new_store(spark), f"{work_folder(spark)}/p"
    own = named_bars(spark, sf_dir)
    own.where("year(date) >= 1996").union(own.where("year(date) = 1997")).write.parquet(folder)
    store.upsert("daily_ohlcv", own.where("year(date) < 1996"))
    store.import_parquet(folder, "daily_ohlcv", "replace")
    return shown(store.table("daily_ohlcv"))


def store_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT into a table, a query with parameters, and a column whose name holds the word limit."""
    store = new_store(spark)
    store.write("flows", table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").alias("limit_price"), F.year("o_orderdate").alias("y")))
    store.execute("INSERT INTO flows (limit_price, o_custkey) SELECT 1.0D, o_custkey FROM flows WHERE y = 1995")
    return store.query("SELECT o_custkey, count(*) AS n, count(y) AS years, round(sum(limit_price), 2) AS total FROM flows WHERE o_custkey % :m = 0 GROUP BY o_custkey", {"m": 3}, limit=10**9)


def store_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_store(spark)
    store.write("a", table(spark, sf_dir, "nation"))
    store.copy("a", "b")
    store.truncate("a")
    store.write("c", table(spark, sf_dir, "region"))
    store.drop("c")
    store.insert("instruments", table(spark, sf_dir, "supplier").select(F.col("s_name").alias("symbol"), F.col("s_name").alias("name")))
    return store.info().select("table", "layer", F.col("n_columns").cast("long").alias("n_columns"), "n_rows")


#: Store by application and tables: several queries look at one.
_LOADED: dict[tuple[str, str], Store] = {}


def loaded(spark: SparkSession, sf_dir: str) -> Store:
    """A store whose ODS tables are filled from two sources, and their DWD tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LOADED:
        _LOADED[key] = _load(spark, sf_dir)
    return _LOADED[key]


def _load(spark: SparkSession, sf_dir: str) -> Store:
    store, own = new_store(spark), named_bars(spark, sf_dir)
    flag = F.when(F.substring("symbol", 6, 1) == "7", "1").otherwise("2")
    store.import_ods("src", "daily_ohlcv", own.withColumn("adjust_flag", flag))
    store.import_ods("other", "daily_ohlcv", own.where("symbol < '000010'").withColumn("close", F.lit(0.0)))
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    store.import_ods("src", "calendars", days.withColumn("is_trading_day", F.dayofmonth("date") % 2 == 0))
    store.run_etl("src", ["calendars", "daily_ohlcv"])
    return store


def etl_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the source's bars with the flag of adjusted ones reach the DWD table."""
    own = loaded(spark, sf_dir).table("dwd_daily_ohlcv")
    return own.select("date", "symbol", *[single(c) for c in (*PRICES, "factor", "raw_close")])


def ods_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir).get_ods("other", "daily_ohlcv").select("source", "date", "symbol", "adjust_flag", single("close"), single("volume"))


def trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir).get_trading_days("1994-03-01", "1996-09-30", "dwd_calendars")


def validate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir).validate_all("1996-01-01")


def table_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = loaded(spark, sf_dir)
    for name in ("dwd_daily_ohlcv", "dwd_calendars"):
        store.update_params(name)
    return store.table("meta_table_params").select("table_name", "start_date", "end_date", "row_count").join(store.table_freshness("1998-12-01"), ["table_name", "end_date"])


def roll_up_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of the DWD bars, and again those from 1995 on over them."""
    store = loaded(spark, sf_dir)
    store.roll_up(monthly=False)
    store.roll_up(monthly=False, start="1995-01-01")
    own = store.table("app_yearly_stats")
    return own.select("symbol", F.col("year").cast("long").alias("year"), "first_date", "last_date", *[single(c) for c in ("open", "close", "high", "low", "volume")])


def index_components_etl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of two deliveries: the second's are current, others stay as former ones."""
    part = table(spark, sf_dir, "part")
    own = part.select(F.col("p_brand").alias("index_code"), F.col("p_name").alias("symbol"), F.col("p_partkey"), F.lit("2024-01-01").cast("date").alias("in_date"), F.col("p_retailprice").alias("weight"))
    own = own.groupBy("index_code", "symbol", "in_date").agg(F.max("weight").alias("weight"), F.max("p_partkey").alias("k"))
    empty = spark.createDataFrame([], "index_code string, symbol string, in_date date, out_date date, weight double, is_current boolean")
    first = T.to_index_components(empty, own.where("k % 3 != 0"))
    return T.to_index_components(first, own.where("k % 3 != 1").withColumn("weight", F.col("weight") + 1)).select("index_code", "symbol", F.round("weight", 4).alias("weight"), "is_current")


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    listed, gone = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("s_suppkey") % 40).cast("int") * 100), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") % 17).cast("int") * 100)
    return s.select(F.col("s_suppkey").alias("symbol"), F.when(F.col("s_nationkey") % 2 == 0, "SH").otherwise("SZ").alias("market"), F.when(F.col("s_suppkey") % 7 != 0, listed).alias("list_date"), F.when(F.col("s_suppkey") % 3 == 0, gone).alias("delist_date"))


_INSTRUMENTS = (
    "i AS (SELECT s_suppkey AS symbol, CASE WHEN s_nationkey % 2 = 0 THEN 'SH' ELSE 'SZ' END AS market, CASE WHEN s_suppkey % 7 != 0 THEN DATE '1990-01-01' + CAST(s_suppkey % 40 AS INTEGER) * 100 END AS list_date, "
    "CASE WHEN s_suppkey % 3 = 0 THEN DATE '1995-01-01' + CAST(s_suppkey % 17 AS INTEGER) * 100 END AS delist_date FROM supplier)"
)


def active_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.active(instruments(spark, sf_dir), "1996-06-30")


def listed_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.listed_through(instruments(spark, sf_dir), "SH", "1995-06-30", "1996-12-31")


def null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.null_keys(instruments(spark, sf_dir), ["symbol", "list_date", "delist_date"])


def storage_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What validate() says of a table with repeated and missing keys, one row."""
    store, own = new_store(spark), instruments(spark, sf_dir)
    store.write("instruments", own.union(own.where("symbol % 10 = 0")).withColumn("symbol", F.when(F.col("symbol") % 11 != 0, F.col("symbol").cast("string"))))
    found = store.validate("instruments", ("symbol", "name"))
    return spark.createDataFrame([(found["ok"], ",".join(found["missing_columns"]), found["null_keys"]["symbol"], found["duplicate_keys"])], "ok boolean, missing string, null_symbols long, duplicate_keys long")


def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.next_ids(table(spark, sf_dir, "nation").select("n_name", "n_regionkey"), ["n_regionkey", "n_name"], 100).select(F.col("id").cast("long").alias("id"), "n_name")


def calendar_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar_tools.calendar(spark, "2023-12-01", "2024-12-31", ["2024-01-01", "2024-05-01", "2024-10-02"])


def calendar_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar_tools.days_after(spark, "2024-03-15", "2024-06-30", ["2024-05-01"])


def synthetic_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up walks; no SQL has Spark's hashes, so rows are held against the calendar alone."""
    return files.synthetic_bars(spark, 20, "2024-01-01", "2024-03-31").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max(F.col("high") < F.col("low")).alias("crossed"))


def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, its bars put over a table of the store by micro-batches."""
    store = new_store(spark)
    store.write("event_bars", event_bars(table(spark, sf_dir, "events")).limit(0))
    stream = event_bars(event_stream(spark, sf_dir, "events.parquet"))
    upsert_bars(stream, lambda: store.table("event_bars"), lambda df: store.write("event_bars", df), f"{work_folder(spark)}/stream").awaitTermination()
    return store.table("event_bars").select(F.to_date("ts").alias("date"), "symbol", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "volume")


# Expressions, factors and analysis


def value_of(df: DataFrame, column: str = "factor") -> DataFrame:
    return df.select("date", "symbol", F.col(column).cast("float").cast("double").alias("value"))


def expr_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of dates, with what windows and exponential means need from before it."""
    return value_of(ExprEngine(spark, gappy(spark, sf_dir)).factor("Mean($close, 5) + EMA($close, 5) * 2", "1995-01-01", "1996-12-31", lookback=True, ordered=False))


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of symbols that don't trade in every month."""
    return bars(spark, sf_dir).withColumn("volume", F.when((F.col("symbol") * 7 + F.month("date") * 5 + F.year("date")) % (2 + F.col("symbol") % 9) != 0, F.col("volume")).otherwise(0.0))


def expr_pool_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "supplier").createOrReplaceTempView("alphaspark_suppliers")
    return value_of(ExprEngine(spark, bars(spark, sf_dir)).factor("Mean($close, 3)", universe="SELECT s_suppkey FROM alphaspark_suppliers WHERE s_acctbal > 0", ordered=False))


def expr_pool_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "supplier").where("s_nationkey < 9").select("s_suppkey")
    return value_of(ExprEngine(spark, bars(spark, sf_dir)).factor("Delta($close, 1)", universe=pool, ordered=False))


class Spread(FactorABC):
    """HIGH over LOW by the mean of three rows, for products, covariances and sequences too."""

    name, dependencies, max_window = "spread", ("high", "low", "close", "volume"), 6

    def compute(self) -> Column:
        c, v = F.col("close"), F.col("volume")
        growth = self.PROD(F.col("high") / F.col("low"), 3)
        weights = F.aggregate(self.SEQUENCE(3), F.lit(0.0), lambda s, a: s + a)
        return self.COVIANCE(c, v, 6) / weights + growth + self.MEAN(c, 3)


def factor_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_of(Spread().run(bars(spark, sf_dir)).values, "spread")


def factor_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function registered as a factor, computed beside a known one."""
    own = FactorRegistry()
    own.register(FACTORS.get("alpha014"))

    @register_factor(name="range_share", needs=("high", "low", "close"), registry=own)
    def range_share(axes: Axes = AXES) -> Column:
        """(high - low) / close"""
        return F.try_divide(F.col("high") - F.col("low"), F.col("close"))

    df = compute(bars(spark, sf_dir), "alpha014", "range_share", registry=own)
    return df.select("date", "symbol", single("alpha014"), single("range_share"))


def factors_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas known by number alone are missing everywhere."""
    names = [n for n in FACTORS.list(False)]
    df = compute(bars(spark, sf_dir), *names)
    there = sum((F.col(n).isNotNull().cast("long") for n in names), F.lit(0))
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(there).alias("values")).withColumn("formulas", F.lit(len(names)).cast("long"))


def rolling_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of one's own over each window's values: the middle between the extremes of six closes."""
    v = rolling.values(F.col("close"), 6)
    return value_of(bars(spark, sf_dir).select("date", "symbol", rolling.full((F.array_max(v) + F.array_min(v)) / 2, 6, AXES).alias("factor")))


def momentum(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = bars(spark, sf_dir)
    return compute(own, "alpha014"), forward_returns(own, (1,)).select("date", "symbol", "ret_1")


def ic_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor, ret = momentum(spark, sf_dir)
    ic = daily_ic(factor.withColumnRenamed("alpha014", "factor").join(ret.withColumnRenamed("ret_1", "ret"), ["date", "symbol"]))
    return moving_ic(ic, 20).select("date", F.round("ic", 6).alias("ic"), F.round("ic_mean", 6).alias("ic_mean"))


def ic_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ICAnalysis(*momentum(spark, sf_dir)).summary()
    return s.select(*[F.round(c, 6).alias(c) for c in ("ic_mean", "ic_std", "ic_ir", "ic_positive_ratio", "t_stat")], F.col("n_days").cast("long").alias("n_days"))


def factor_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's mean return of each quantile, and whether its page holds the charts."""
    own = bars(spark, sf_dir)
    report = FactorReport(own, compute(own, "alpha014"), "alpha014", (1,))
    r, page = report.run(), report.to_html()
    return spark.createDataFrame([(q, round(float(v), 6), page.count("<svg")) for q, v in r["quantile_means"]], "quantile string, mean double, charts long")


def _oracles(q) -> dict[str, str]:
    """SQL by the building blocks of queries.py."""
    month = q.bars_sql("month")
    named = f"WITH {month}, {_NAMED}"
    gaps = f"WITH {month}, g AS (SELECT * FROM bars WHERE (symbol * 7 + month(date) * 5 + year(date)) % (2 + symbol % 9) != 0)"
    values, _ = q.ewm_sql("close", 1 / 3)
    src = f"{named}, src AS (SELECT * FROM n WHERE substr(symbol, 6, 1) != '7'), cal AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"
    w, full = q.w, q.full
    return {
        "csv_round_trip": _ORDERS,
        "parquet_round_trip": _ORDERS,
        "json_round_trip": _ORDERS,
        "csv_folder": _ORDERS,
        "source_csv": f"{named} SELECT date, symbol, {_SINGLE} FROM n",
        "source_csv_gbk": "SELECT c_custkey AS code, 'c' || CASE WHEN c_custkey % 100 = 99 THEN '中文' ELSE '' END AS name FROM customer",
        "panel_load": f"{named} SELECT date, symbol, {_SINGLE} FROM n WHERE symbol IN ('000001', '000007', '000031') AND date BETWEEN DATE '1994-01-01' AND DATE '1996-06-30'",
        "parsed_names": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 != 4 THEN CAST(o_orderdate AS DATE) END AS day, lpad((o_custkey % 1000000)::VARCHAR, 6, '0') AS symbol FROM orders",
        "store_import": f"{named} SELECT date, symbol, {_SINGLE} FROM n WHERE date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'",
        "store_upsert": f"{named}, u AS (SELECT * REPLACE (CASE WHEN year(date) = 1995 AND symbol < '000050' THEN close + 1 ELSE close END AS close) FROM n) SELECT date, symbol, {_SINGLE} FROM u",
        "store_replace": f"{named} SELECT date, symbol, {_SINGLE} FROM n WHERE year(date) >= 1996",
        "store_sql": "WITH f AS (SELECT o_custkey, o_totalprice AS p, year(o_orderdate) AS y FROM orders), g AS (SELECT * FROM f UNION ALL SELECT o_custkey, 1.0, NULL FROM f WHERE y = 1995) SELECT o_custkey, count(*) AS n, count(y) AS years, round(sum(p), 2) AS total FROM g WHERE o_custkey % 3 = 0 GROUP BY o_custkey",
        "store_catalog": "SELECT 'a' AS \"table\", 'user' AS layer, 3::BIGINT AS n_columns, 0::BIGINT AS n_rows UNION ALL SELECT 'b', 'user', 3, count(*) FROM nation UNION ALL SELECT 'instruments', 'simple', 6, count(DISTINCT s_name) FROM supplier",
        "etl_ohlcv": f"{src} SELECT date, symbol, {_SINGLE}, 1.0::DOUBLE AS factor, close::FLOAT::DOUBLE AS raw_close FROM src",
        "ods_scan": f"{named} SELECT 'other' AS source, date, symbol, '2' AS adjust_flag, 0.0::DOUBLE AS close, volume::FLOAT::DOUBLE AS volume FROM n WHERE symbol < '000010'",
        "trading_days": f"{src} SELECT date FROM cal WHERE day(date) % 2 = 0 AND date BETWEEN DATE '1994-03-01' AND DATE '1996-09-30'",
        "validate_all": f"{src}, v AS (SELECT 'dwd_calendars' AS table_name, 'trading_day_on_weekend' AS rule, count(*) AS failed FROM cal WHERE day(date) % 2 = 0 AND isodow(date) >= 6 UNION ALL SELECT 'dwd_instruments', 'list_date_range', 0 UNION ALL SELECT 'dwd_daily_ohlcv', 'price_order', count(*) FROM src WHERE high < low OR high < close OR low > open UNION ALL SELECT 'dwd_daily_ohlcv', 'negative_size', count(*) FROM src WHERE volume < 0 OR amount < 0 UNION ALL SELECT 'dwd_daily_ohlcv', 'recency', (max(date) < DATE '1995-12-31')::INT FROM src) SELECT table_name, rule, failed::BIGINT AS failed, failed = 0 AS passed FROM v",
        "table_params": f"{src}, v AS (SELECT 'dwd_daily_ohlcv' AS table_name, min(date) AS start_date, max(date) AS end_date, count(*) AS row_count FROM src UNION ALL SELECT 'dwd_calendars', min(date), max(date), count(*) FROM cal) SELECT *, CASE WHEN date_diff('day', end_date, DATE '1998-12-01') <= 1 THEN 'fresh' WHEN date_diff('day', end_date, DATE '1998-12-01') <= 7 THEN 'stale' ELSE 'outdated' END AS status FROM v",
        "roll_up_store": f"{src} SELECT symbol, year(date) AS year, min(date) AS first_date, max(date) AS last_date, arg_min(open, date)::FLOAT::DOUBLE AS open, arg_max(close, date)::FLOAT::DOUBLE AS close, max(high)::FLOAT::DOUBLE AS high, min(low)::FLOAT::DOUBLE AS low, sum(volume)::FLOAT::DOUBLE AS volume FROM src GROUP BY ALL",
        "index_components_etl": "WITH o AS (SELECT p_brand AS index_code, p_name AS symbol, max(p_retailprice) AS weight, max(p_partkey) AS k FROM part GROUP BY ALL) SELECT index_code, symbol, round(CASE WHEN k % 3 != 1 THEN weight + 1 ELSE weight END, 4) AS weight, k % 3 != 1 AS is_current FROM o",
        "active_instruments": f"WITH {_INSTRUMENTS} SELECT * FROM i WHERE list_date <= DATE '1996-06-30' AND (delist_date IS NULL OR delist_date >= DATE '1996-06-30')",
        "listed_instruments": f"WITH {_INSTRUMENTS} SELECT * FROM i WHERE market = 'SH' AND (list_date IS NULL OR list_date <= DATE '1995-06-30') AND (delist_date IS NULL OR delist_date >= DATE '1996-12-31')",
        "null_keys": f"WITH {_INSTRUMENTS} SELECT count(*) - count(symbol) AS symbol, count(*) - count(list_date) AS list_date, count(*) - count(delist_date) AS delist_date FROM i",
        "storage_validate": f"WITH {_INSTRUMENTS}, u AS (SELECT CASE WHEN symbol % 11 != 0 THEN symbol END AS s FROM i UNION ALL SELECT CASE WHEN symbol % 11 != 0 THEN symbol END FROM i WHERE symbol % 10 = 0), d AS (SELECT s FROM u GROUP BY s HAVING count(*) > 1) SELECT false AS ok, 'name' AS missing, (SELECT count(*) - count(s) FROM u) AS null_symbols, (SELECT count(*) FROM d) AS duplicate_keys",
        "surrogate_ids": "SELECT 100 + row_number() OVER (ORDER BY n_regionkey, n_name) AS id, n_name FROM nation",
        "calendar_generator": "SELECT CAST(d AS DATE) AS date, isodow(d) < 6 AND CAST(d AS DATE) NOT IN (DATE '2024-01-01', DATE '2024-05-01', DATE '2024-10-02') AS is_trading_day FROM generate_series(TIMESTAMP '2023-12-01', TIMESTAMP '2024-12-31', INTERVAL 1 DAY) t(d)",
        "calendar_increment": "SELECT CAST(d AS DATE) AS date FROM generate_series(TIMESTAMP '2024-03-16', TIMESTAMP '2024-06-30', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6 AND CAST(d AS DATE) != DATE '2024-05-01'",
        "synthetic_bars": "SELECT lpad(i::VARCHAR, 6, '0') AS symbol, count(*) AS n, min(CAST(d AS DATE)) AS first_date, max(CAST(d AS DATE)) AS last_date, false AS crossed FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-31', INTERVAL 1 DAY) t(d), range(1, 21) r(i) WHERE isodow(d) < 6 GROUP BY i",
        "stream_bars": q.ORACLES["event_bars"],
        "expr_lookback": f"{gaps}, l AS (SELECT *, {values} AS l, avg(close) {w(5)} AS m FROM g), e AS (SELECT *, list_reduce(list_prepend(0, l), lambda s, v: s * (2.0 / 3) + v) / ((1 - pow(2.0 / 3, len(l))) * 3) AS e FROM l) SELECT date, symbol, (m + e * 2)::FLOAT::DOUBLE AS value FROM e WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'",
        "expr_pool_query": f"WITH {month}, m AS (SELECT * FROM bars WHERE symbol IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) SELECT date, symbol, (avg(close) {w(3)})::FLOAT::DOUBLE AS value FROM m",
        "expr_pool_frame": f"WITH {month}, m AS (SELECT *, {q.d('close', 1)} AS v FROM bars WHERE symbol IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 9)) SELECT date, symbol, v::FLOAT::DOUBLE AS value FROM m WHERE v IS NOT NULL",
        "factor_class": f"WITH {month} SELECT date, symbol, ({full(f'covar_samp(close, volume) {w(6)}', 6)} / 6 + {full(f'product(high / low) {w(3)}', 3)} + {full(f'avg(close) {w(3)}', 3)})::FLOAT::DOUBLE AS value FROM bars",
        "factor_registered": f"WITH {month} SELECT date, symbol, ({q.d('close', 5)})::FLOAT::DOUBLE AS alpha014, ((high - low) / nullif(close, 0))::FLOAT::DOUBLE AS range_share FROM bars",
        "factors_declared": f"WITH {month} SELECT symbol, count(*) AS n, 0::BIGINT AS \"values\", 163::BIGINT AS formulas FROM bars GROUP BY symbol",
        "rolling_apply": f"WITH {month} SELECT date, symbol, ({full(f'(max(close) {w(6)} + min(close) {w(6)}) / 2', 6)})::FLOAT::DOUBLE AS value FROM bars",
        "ic_moving": f"{q._IC} SELECT date, round(ic, 6) AS ic, round(avg(ic) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS ic_mean FROM ic",
        "ic_analysis": q.ORACLES["ic_summary"],
        "factor_report": f"{q._LAYERS}, m AS (" + " UNION ALL ".join(f"SELECT 'Q{i}' AS quantile, avg(Q{i}) AS mean FROM qr" for i in range(1, 6)) + ") SELECT quantile, round(mean, 6) AS mean, 4::BIGINT AS charts FROM m",
    }


def register(queries: dict[str, Callable[[SparkSession, str], DataFrame]], oracles: dict[str, str], blocks) -> None:
    """Adds these queries and their SQL, written with the building blocks of a module such as queries.py."""
    own = _oracles(blocks)
    for name, sql in own.items():
        queries[name], oracles[name] = globals()[name], sql
