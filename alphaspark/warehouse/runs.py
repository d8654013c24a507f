"""Whole runs over a store: its first filling, daily updates and a look at its health."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import calendar_tools
from . import transforms as T
from .schema import TABLES
from .store import Store

#: Steps of each mode, in order.
MODES: dict[str, tuple[str, ...]] = {
    "full": ("calendar", "ohlcv", "etl", "app", "validate"),
    "ods": ("calendar", "ohlcv"),
    "calendar": ("calendar",),
    "ohlcv": ("ohlcv",),
    "etl": ("etl",),
    "app": ("app",),
    "validate": ("validate",),
}


def _done(store: Store, step: str) -> bool:
    tables = {"calendar": ["ods_calendars"], "ohlcv": ["ods_daily_ohlcv"], "etl": ["dwd_daily_ohlcv"], "app": ["app_monthly_stats", "app_yearly_stats"]}.get(step, [])
    return bool(tables) and all(store.exists(t) and store.table(t).head(1) for t in tables)


def initialise(store: Store, mode: str = "full", source: str = "file", start: str = "2005-01-01", end: str | None = None, bars: DataFrame | None = None, force: bool = False, skip_validation: bool = False) -> dict[str, str]:
    """What became of each step of ``mode``.  Steps whose tables have rows are left out unless ``force``; ``bars`` are what the
    source delivers.  A step that fails is told and ends the run."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    end = end or date.today().isoformat()
    out: dict[str, str] = {}
    for step in MODES[mode]:
        if step == "validate" and skip_validation:
            out[step] = "skipped"
        elif not force and step != "validate" and _done(store, step):
            out[step] = "there already"
        else:
            try:
                out[step] = _step(store, step, source, start, end, bars)
            except Exception as e:  # told in the result; the steps after it need it
                out[step] = f"failed: {e}"
                break
    store.log_update("init", "failed" if any(v.startswith("failed") for v in out.values()) else "ok", 0, mode)
    return out


def _step(store: Store, step: str, source: str, start: str, end: str, bars: DataFrame | None) -> str:
    if step == "calendar":
        return f"{store.import_ods(source, 'calendars', calendar_tools.calendar(store.spark, start, end))} rows"
    if step == "ohlcv":
        if bars is None:
            raise ValueError("no bars given")
        own = bars.where((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") <= F.lit(end).cast("date")))
        return f"{store.import_ods(source, 'daily_ohlcv', own)} rows"
    if step == "etl":
        there = [t for t in ("calendars", "instruments", "index_components", "daily_ohlcv") if store.exists(f"ods_{t}")]
        found = store.run_etl(source, there)
        if any(v != "ok" for v in found.values()):
            raise RuntimeError("; ".join(f"{t}: {v}" for t, v in found.items() if v != "ok"))
        return ", ".join(found)
    if step == "app":
        store.roll_up()
        store.roll_up(monthly=False)
        return "months and years"
    failed = [f"{r['table_name']}.{r['rule']}" for r in store.validate_all(end).collect() if not r["passed"]]
    return f"{len(failed)} rules broken: {', '.join(failed)}" if failed else "all rules hold"


def update(store: Store, source: str = "file", bars: DataFrame | None = None, today: str | None = None, days: int = 5, steps: tuple[str, ...] = ("calendar", "ohlcv", "etl", "validate"), dry_run: bool = False) -> dict[str, str]:
    """The last ``days`` days of bars and the calendar up to ``today``; a dry run tells how many rows are new and writes nothing."""
    today = today or date.today().isoformat()
    since = (date.fromisoformat(today) - timedelta(days=days)).isoformat()
    out: dict[str, str] = {}
    if "calendar" in steps:
        last = store.table("ods_calendars").where(F.col("source") == source).agg(F.max("date")).first()[0]
        new = calendar_tools.calendar(store.spark, last.isoformat() if last else since, max(today, last.isoformat() if last else today))
        new = new.where(F.col("date") > F.lit(last)) if last else new
        out["calendar"] = f"{new.count()} new days" if dry_run else f"{store.import_ods(source, 'calendars', new)} rows"
    if "ohlcv" in steps and bars is not None:
        own = bars.where((F.col("date") > F.lit(since).cast("date")) & (F.col("date") <= F.lit(today).cast("date")))
        have = store.months("ods_daily_ohlcv", since, today).where(F.col("source") == source)
        out["ohlcv"] = f"{T.insert_missing(have, own, ['date', 'symbol']).count()} new bars" if dry_run else f"{store.import_ods(source, 'daily_ohlcv', own)} rows"
    for step in ("etl", "validate"):
        if step in steps and not dry_run:
            try:
                out[step] = _step(store, step, source, since, today, bars)
            except Exception as e:  # told in the result
                out[step] = f"failed: {e}"
    if not dry_run:
        store.log_update("update", "failed" if any(v.startswith("failed") for v in out.values()) else "ok", 0, f"last {days} days")
    return out


def health(store: Store, today: str | None = None) -> DataFrame:
    """(table_name, n_rows, last_date, status) of the tables that have dates."""
    today = today or date.today().isoformat()
    rows = None
    for name in store.list_tables():
        if name in TABLES and "date" in TABLES[name].schema().names:
            last = F.max("date")
            own = store.table(name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), last.alias("last_date"), T.freshness(last, F.lit(today).cast("date")).alias("status"))
            rows = own if rows is None else rows.unionByName(own)
    return store.spark.createDataFrame([], "table_name string, n_rows long, last_date date, status string") if rows is None else rows
