"""Command line: data, factor, backtest, report and warehouse commands over a store."""

from __future__ import annotations

import argparse
import json
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .analysis import FactorReport, ICAnalysis, LayeredBacktest, forward_returns
from .analysis.report import reports_html
from .config import load_config
from .factors import FACTORS
from .factors.registry import compute
from .plans import ExprEngine
from .sources import column_maps, files
from .sources.files import query_to_file, synthetic_bars
from .warehouse import Store, runs
from .warehouse import transforms as T


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="alphaspark")
    p.add_argument("--store", default="warehouse", help="folder of the warehouse")
    p.add_argument("--table", default="daily_ohlcv")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple, **options) -> argparse.ArgumentParser:
        own = sub.add_parser(name, **options)
        for names, kw in arguments:
            own.add_argument(*names, **kw)
        return own

    a = lambda *names, **kw: (names, kw)
    path, dates = a("path"), (a("--start"), a("--end"))
    source, bars = a("--source", default="file"), a("--bars", help="Parquet or CSV folder of bars, as the source delivers them")
    command("init", a("--demo", action="store_true", help="with made-up bars"))
    command("init-data", a("mode", nargs="?", default="full", choices=list(runs.MODES)), source, bars, a("--start", default="2005-01-01"), a("--end"), a("--force", action="store_true"), a("--skip-validation", action="store_true"))
    steps = [a(f"--{s}", action="append_const", dest="steps", const=s) for s in ("calendar", "ohlcv", "etl", "validate")]
    command("update", source, bars, *steps, a("--days", type=int, default=5), a("--today"), a("--dry-run", action="store_true"), a("--check", action="store_true", help="only tell the tables' health"))
    command("tables")
    command("info")
    command("schema", a("name"))
    command("import-csv", path, a("--source"), a("--if-exists", default="append"))
    command("import-parquet", path, a("--if-exists", default="append"))
    command("import-dir", path, a("--pattern"), a("--recursive", action="store_true"), a("--kind", default="csv"))
    command("preview", path)
    command("query", a("sql"), a("--limit", type=int, default=20), a("--output"))
    command("export", a("query"), path)
    command("stats", a("name", nargs="?"))
    command("instruments", a("--market"), a("--active"), *dates)
    command("calendar", a("start"), a("end"))
    command("drop", a("name"))
    command("copy-table", a("name"), a("to"))
    command("vacuum")
    command("shell")
    command("etl", a("source"))
    command("validate")
    command("factors", a("--all", action="store_true"))
    command("factor-doc", a("name"))
    command("factor-run", a("names", nargs="+"), a("--output"), *dates)
    command("factor-batch", path, a("--output", default="results"), a("--mode", default="sql"), *dates)
    command("expr", a("expression"), a("--explain", action="store_true"), a("--mode", default="sql"), a("--universe"), a("--lookback", action="store_true"), a("--output"), *dates)
    command("ic", a("name"), a("--period", type=int), a("--method"), *dates)
    command("layered", a("name"), a("--period", type=int), a("--quantiles", type=int), *dates)
    command("backtest-run", a("names", nargs="+"), a("--output", default="backtest_results"), a("--period", type=int), a("--quantiles", type=int), a("--method"), *dates)
    command("report", a("names", nargs="+"), path, *dates)
    return p


def show(df: DataFrame, n: int = 20) -> None:
    df.show(n, truncate=False)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build_parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("alphaspark").getOrCreate()
    store, config = Store(spark, args.store), load_config()

    def panel() -> DataFrame:
        return files.load_panel(store.table(args.table), None, getattr(args, "start", None), getattr(args, "end", None))

    def factor(name: str) -> DataFrame:
        return compute(panel(), name).where(F.col(name).isNotNull())

    def joined(name: str, period: int) -> DataFrame:
        bars = forward_returns(panel(), (period,)).select("date", "symbol", F.col(f"ret_{period}").alias("ret"))
        return factor(name).withColumnRenamed(name, "factor").join(bars, ["date", "symbol"])

    def delivered() -> DataFrame | None:
        if not args.bars:
            return None
        return spark.read.parquet(args.bars) if "parquet" in args.bars.lower() else column_maps.normalise(files.read_source_csv(spark, args.bars))

    c = args.command
    if c == "init":
        store.create()
        if args.demo:
            print(store.insert("daily_ohlcv", synthetic_bars(spark), "replace"), "rows")
    elif c == "init-data":
        done = runs.initialise(store, args.mode, args.source, args.start, args.end, delivered(), args.force, args.skip_validation)
        print(json.dumps(done, indent=1))
        return int(any(v.startswith("failed") for v in done.values()))
    elif c == "update":
        if args.check:
            show(runs.health(store, args.today), 100)
        else:
            done = runs.update(store, args.source, delivered(), args.today, args.days, tuple(args.steps or ("calendar", "ohlcv", "etl", "validate")), args.dry_run)
            print(json.dumps(done, indent=1))
            return int(any(v.startswith("failed") for v in done.values()))
    elif c == "tables":
        print("\n".join(store.list_tables()))
    elif c == "info":
        show(store.info(), 100)
    elif c == "schema":
        print(json.dumps(store.show_schema(args.name), indent=1))
    elif c == "import-csv":
        print(store.import_source_csv(args.path, args.source, args.table) if args.source else store.import_csv(args.path, args.table, args.if_exists), "rows")
    elif c == "import-parquet":
        print(store.import_parquet(args.path, args.table, args.if_exists), "rows")
    elif c == "import-dir":
        print(store.import_folder(args.path, args.table, args.kind, args.pattern, args.recursive), "rows")
    elif c == "preview":
        show(files.preview(files.read_source_csv(spark, args.path)))
    elif c == "query":
        df = store.query(args.sql, limit=args.limit)
        query_to_file(df, args.output) if args.output else show(df, args.limit)
    elif c == "export":
        query_to_file(store.resolve(args.query), args.path)
    elif c == "stats":
        df = store.table(args.name or args.table)
        show(T.describe(df), 100)
    elif c == "instruments":
        df = store.get_instruments(args.market, args.start, args.end)
        show(T.active(df, args.active) if args.active else df)
    elif c == "calendar":
        show(store.get_trading_days(args.start, args.end), 400)
    elif c == "drop":
        print("dropped" if store.drop(args.name) else "no such table")
    elif c == "copy-table":
        store.copy(args.name, args.to)
    elif c == "vacuum":
        print(store.vacuum(), "versions dropped")
    elif c == "shell":
        for line in sys.stdin:
            if line.strip() in ("exit", "quit"):
                break
            if line.strip():
                try:
                    show(store.query(line, limit=20))
                except Exception as e:  # a wrong query shouldn't end the shell
                    print(e, file=sys.stderr)
    elif c == "etl":
        print(json.dumps(store.run_etl(args.source), indent=1))
    elif c == "validate":
        show(store.validate_all())
    elif c == "factors":
        print("\n".join(FACTORS.list(None if args.all else True)))
    elif c == "factor-doc":
        print(json.dumps(FACTORS.info(args.name), indent=1))
    elif c == "factor-run":
        df = compute(panel(), *args.names)
        query_to_file(df, args.output) if args.output else show(df.orderBy("date", "symbol"))
    elif c == "expr":
        engine = ExprEngine(spark, store.table(args.table), mode=args.mode, universe=args.universe, instruments=store.table("instruments"))
        if args.explain:
            print(engine.explain(args.expression, args.start, args.end))
        else:
            df = engine.factor(args.expression, args.start, args.end, lookback=args.lookback)
            query_to_file(df, args.output) if args.output else show(df)
    elif c == "ic":
        own = joined(args.name, args.period or config.backtest.periods[0])
        result = ICAnalysis(own.select("date", "symbol", "factor"), own.select("date", "symbol", "ret")).run(args.method or config.backtest.method)
        print(json.dumps(result.row(), indent=1))
    elif c == "layered":
        print(json.dumps(LayeredBacktest(joined(args.name, args.period or config.backtest.periods[0]), args.quantiles or config.backtest.n_quantiles).stats_row(), indent=1))
    elif c == "factor-batch":
        engine, good = ExprEngine(spark, store.table(args.table), mode=args.mode), {}
        for line in spark.read.text(args.path).toLocalIterator():
            text = line["value"].strip()
            if text and not text.startswith("#"):
                try:
                    engine.compile(text)
                    good[text] = re.sub(r"\W+", "_", text).strip("_")[:60] or "factor"
                    print(text, "ok")
                except (SyntaxError, ValueError) as e:  # the others are computed all the same
                    print(text, e, file=sys.stderr)
        names = {f"{n}_{i}" if n in list(good.values())[:i] else n: text for i, (text, n) in enumerate(good.items())}
        if names:
            engine.batch(names, args.start, args.end).write.mode("overwrite").partitionBy("name").parquet(args.output)
        print(len(names), "factors in", args.output)
    elif c == "backtest-run":
        period, failed = args.period or config.backtest.periods[0], 0
        for name in args.names:
            try:
                own = joined(name, period)
                ic = ICAnalysis(own.select("date", "symbol", "factor"), own.select("date", "symbol", "ret")).run(args.method or config.backtest.method)
                layers = LayeredBacktest(own, args.quantiles or config.backtest.n_quantiles)
                for what, df in (("values", own.select("date", "symbol", "factor")), ("ic", ic.ic_series), ("layered", layers.quantile_returns().orderBy("date"))):
                    files.write_parquet(df, f"{args.output}/{name}/{what}")
                print(json.dumps({"factor": name, **ic.row(), **layers.stats_row()}))
            except Exception as e:  # one factor's failure doesn't stop the others
                failed += 1
                print(name, "failed:", e, file=sys.stderr)
        return int(failed > 0)
    elif c == "report":
        reports_html([FactorReport(panel(), factor(n), n, config.backtest.periods, config.backtest.n_quantiles) for n in args.names], args.path)
        print(args.path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
