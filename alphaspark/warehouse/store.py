"""The warehouse: Parquet tables below one folder, each write a new version that is then made current."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import column_maps, files
from . import transforms as T
from .schema import TABLES, Table, data_dictionary

IF_EXISTS = ("append", "replace", "fail")
#: The file that makes a version whole, the name of a table's only part, the column that months are written by, and how many
#: folders a part may have.
PARTS, ALL, PART, MOST_FOLDERS = "_parts", "all", "__part", 50
_INSERT = re.compile(r"\s*insert\s+(?P<kind>into|overwrite)\s+(?:table\s+)?(?P<table>`[^`]+`|\w+)\s*(?:\((?!\s*(?:select|with|values)\b)(?P<columns>[^()]*)\)\s*)?(?P<rows>.+)", re.I | re.S)
_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
_LIMIT = re.compile(r"\blimit\s*(?:all\b|\d|[:?(])", re.I)


def has_limit(sql: str) -> bool:
    """Whether the query itself ends in a LIMIT: not a part of it in brackets, a name, a text or a remark."""
    bare, depth, outside = _QUOTED.sub(" ", sql), 0, []
    for c in bare:
        depth -= c == ")"
        outside.append(c if depth <= 0 else " ")
        depth += c == "("
    return _LIMIT.search("".join(outside)) is not None


def monthly(name: str) -> bool:
    return name in TABLES and "date" in TABLES[name].key


def month_of() -> Column:
    return F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("none"))


def schema_of(parts: dict) -> StructType:
    return StructType.fromJson(json.loads(parts["schema"]))


def merged_schema(old: StructType, new: StructType) -> StructType:
    have = {f.name.lower() for f in old.fields}
    return StructType([*old.fields, *(f for f in new.fields if f.name.lower() not in have)])


class Store:
    """``root`` is any path that Spark writes to.  Tables keyed by date are cut by month, others are one part.

    ``<root>/<table>/v_<time>_<id>`` is a version: folders of rows, one a part, and last a file that lists the folders of
    every part, its own and those it takes over.  The newest version with that file is the table, so a reader never sees half a
    write and a failed one changes nothing.  Appending adds folders, an upsert rewrites the months it touches, and
    nothing else is read or written.  One writer a table: a write that finds a newer version than it began with raises.
    ``vacuum`` drops folders that no part lists.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # Catalog

    def _versions(self, name: str) -> list[str]:
        folder = self._path(f"{self.root}/{name}")
        if not self._fs.exists(folder):
            return []
        found = [s.getPath() for s in self._fs.listStatus(folder) if s.getPath().getName().startswith("v_")]
        return sorted(p.getName() for p in found if self._fs.exists(self._path(p, PARTS)))

    def _parts(self, name: str, version: str | None = None) -> dict:
        """Of the newest or a given version: {"schema": ..., "parts": {part: [folders below the table]}}."""
        version = version or next(iter(self._versions(name)[-1:]), None)
        if version is None:
            return {"schema": None, "parts": {}}
        stream = self._fs.open(self._path(f"{self.root}/{name}/{version}/{PARTS}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, name: str, version: str, schema: StructType, parts: dict[str, list[str]], after: str | None) -> None:
        if next(iter(self._versions(name)[-1:]), None) != after:
            raise RuntimeError(f"table {name} was changed during a write")
        done = self._path(f"{self.root}/{name}/{version}/{PARTS}")
        draft = self._path(f"{self.root}/{name}/{version}/{PARTS}.draft")
        stream = self._fs.create(draft, True)
        stream.write(json.dumps({"schema": schema.json(), "parts": parts}).encode())
        stream.close()
        if not self._fs.rename(draft, done):
            raise RuntimeError(f"version {version} of table {name} couldn't be made current")

    def _add(self, name: str, version: str, df: DataFrame, label: str = "") -> dict[str, list[str]]:
        """Writes rows into folders of a version, and returns them by part: the one evaluation of ``df``."""
        folder = f"{version}/rows{label}"
        target = f"{self.root}/{name}/{folder}"
        if not monthly(name):
            df.write.parquet(target)
            return {ALL: [folder]}
        # Rows of a month come together before they are written.
        df.withColumn(PART, month_of()).repartition(PART).write.partitionBy(PART).parquet(target)
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(target)) if s.isDirectory()]
        return {f.split("=", 1)[1]: [f"{folder}/{f}"] for f in sorted(found)}

    def _hold(self, name: str, version: str, df: DataFrame) -> tuple[DataFrame, set[str]]:
        """Rows that come in, written once, so that their source is read once; and the parts that they touch."""
        target = f"{self.root}/{name}/{version}/incoming"
        df.write.parquet(target)
        held = self.spark.read.schema(df.schema).parquet(target)
        return held, {r[0] for r in held.select(month_of()).distinct().collect()} if monthly(name) else {ALL}

    def _let_go(self, name: str, version: str, whole: bool) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}/{version}" + ("" if whole else "/incoming")), True)

    def _read(self, name: str, schema: StructType, parts: dict[str, list[str]]) -> DataFrame:
        paths = [f"{self.root}/{name}/{f}" for p in sorted(parts) for f in parts[p]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _new_version() -> str:
        return f"v_{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}_{uuid.uuid4().hex[:8]}"

    def list_tables(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory()) if self._versions(n))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def table(self, name: str) -> DataFrame:
        """A table's rows; a known table that was never written is empty."""
        now = self._parts(name)
        if now["schema"]:
            return self._read(name, schema_of(now), now["parts"])
        if name in TABLES:
            return self.spark.createDataFrame([], TABLES[name].schema())
        raise KeyError(f"no table {name}")

    def months(self, name: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """A table's rows of the months that a range of dates touches: the others aren't listed, let alone read."""
        now = self._parts(name)
        if not now["schema"] or not monthly(name):
            return self.table(name)
        chosen = {p: f for p, f in now["parts"].items() if (start is None or p >= start[:7]) and (end is None or p <= end[:7])}
        return self._read(name, schema_of(now), chosen)

    def show_schema(self, name: str) -> dict[str, str]:
        return dict(self.table(name).dtypes)

    def info(self) -> DataFrame:
        """(table, layer, n_columns, n_rows) of every table."""
        rows = [(n, TABLES[n].layer if n in TABLES else "user", len(self.table(n).columns), self.table(n).count()) for n in self.list_tables()]
        return self.spark.createDataFrame(rows, "table string, layer string, n_columns int, n_rows long")

    def write(self, name: str, df: DataFrame) -> None:
        """Replaces the table by ``df``, which may be made from it."""
        after, version = next(iter(self._versions(name)[-1:]), None), self._new_version()
        self._commit(name, version, df.schema, self._add(name, version, df), after)

    def append(self, name: str, df: DataFrame) -> int:
        """Adds rows by name in folders of their own; what is there isn't read.  Columns that the table lacks are added to it.
        The number of rows.  Many small folders of a table without months are written anew as one."""
        after, version, now = next(iter(self._versions(name)[-1:]), None), self._new_version(), self._parts(name)
        schema = merged_schema(schema_of(now), df.schema) if now["schema"] else df.schema
        there = {c.lower() for c in df.columns}
        df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name.lower() in there else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        added = self._add(name, version, df)
        parts = {p: now["parts"].get(p, []) + added.get(p, []) for p in [*now["parts"], *added]}
        if any(len(folders) > MOST_FOLDERS for folders in parts.values()):
            many = {p: folders for p, folders in parts.items() if len(folders) > MOST_FOLDERS}
            parts |= self._add(name, version, self._read(name, schema, many), "-together")
        self._commit(name, version, schema, parts, after)
        return self._read(name, schema, added).count()

    def create(self, *names: str) -> None:
        for n in names or tuple(TABLES):
            if not self.exists(n):
                self.write(n, self.table(n))

    def drop(self, name: str) -> bool:
        return self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def truncate(self, name: str) -> None:
        self.write(name, self.table(name).limit(0))

    def copy(self, name: str, to: str) -> None:
        self.write(to, self.table(name))

    def vacuum(self, *names: str) -> int:
        """Drops versions that aren't current, and unfinished ones; no reader or writer may be at work.  Their number."""
        gone = 0
        for n in names or tuple(self.list_tables()):
            used = {f for folders in self._parts(n)["parts"].values() for f in folders}
            now = self._versions(n)[-1:]
            for s in self._fs.listStatus(self._path(f"{self.root}/{n}")):
                version = s.getPath().getName()
                if version not in now and not any(f.startswith(f"{version}/") for f in used):
                    gone += self._fs.delete(s.getPath(), True)
        return gone

    # Reading

    def register_views(self) -> None:
        for n in self.list_tables():
            self.table(n).createOrReplaceTempView(n)

    def query(self, sql: str, args: dict | None = None, limit: int | None = None) -> DataFrame:
        """Spark SQL over the tables; ``limit`` adds one where the query itself has none."""
        self.register_views()
        df = self.spark.sql(sql, args=args)
        return df if limit is None or has_limit(sql) else df.limit(int(limit))

    def execute(self, sql: str, args: dict | None = None) -> None:
        """A statement.  INSERT INTO or OVERWRITE of one of the tables, by place or by names in brackets, is a write of the store:
        a new version, never files in the current one."""
        insert = _INSERT.match(sql)
        if insert is None or insert["table"].strip("`") not in self.list_tables():
            self.query(sql, args).collect()
            return
        name = insert["table"].strip("`")
        schema = self.table(name).schema
        names = [c.strip().strip("`") for c in insert["columns"].split(",")] if insert["columns"] else schema.names
        rows = self.query(insert["rows"], args)
        if len(rows.columns) != len(names) or not {c.lower() for c in names} <= {c.lower() for c in schema.names}:
            raise ValueError(f"INSERT of {len(rows.columns)} values into {', '.join(names)} of {name}")
        rows = rows.toDF(*names)
        there = {c.lower() for c in names}
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name.lower() in there else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        if insert["kind"].lower() == "overwrite":
            self.write(name, rows)
        else:
            self.append(name, rows)

    def fetchone(self, sql: str, args: dict | None = None) -> tuple | None:
        row = self.query(sql, args).first()
        return tuple(row) if row is not None else None

    def resolve(self, query_or_table: str) -> DataFrame:
        return self.table(query_or_table) if query_or_table in self.list_tables() else self.query(query_or_table)

    def get_ohlcv(self, symbols: list[str] | None = None, fields: Sequence[str] | None = None, start: str | None = None, end: str | None = None, table: str = "daily_ohlcv") -> DataFrame:
        df = files.load_panel(self.months(table, start, end), symbols, start, end)
        keys = ["date", "symbol"]
        return (df.select(*keys, *[f for f in fields if f not in keys]) if fields else df).orderBy(*keys)

    def get_ods(self, source: str, table_type: str) -> DataFrame:
        df = self.table(f"ods_{table_type}").where(F.col("source") == source)
        return df.orderBy("date") if "date" in df.columns else df

    def get_instruments(self, market: str | None = None, start: str | None = None, end: str | None = None, table: str = "instruments") -> DataFrame:
        return T.listed_through(self.table(table), market, start, end).orderBy("symbol")

    def get_trading_days(self, start: str, end: str, table: str = "calendars") -> DataFrame:
        return files.load_panel(self.table(table), None, start, end).where("is_trading_day").select("date").orderBy("date")

    def get_index_members(self, index_code: str) -> DataFrame:
        return T.index_members(self.table("dwd_index_components"), self.table("dwd_instruments"), index_code)

    # Importing and exporting

    def insert(self, name: str, df: DataFrame, if_exists: str = "append") -> int:
        """Rows added by name.  append: to known tables only rows with new keys; replace: nothing else is left;
        fail: raises where the table has rows."""
        if if_exists not in IF_EXISTS:
            raise ValueError(f"if_exists must be one of {IF_EXISTS}, not {if_exists!r}")
        known: Table | None = TABLES.get(name)
        if known:
            there = set(df.columns)
            df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in there else F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema().fields])
        if if_exists == "fail" and self.exists(name) and self.table(name).head(1):
            raise ValueError(f"table {name} has rows")
        keyed = known is not None and set(known.key) <= there
        if if_exists == "replace" or not self.exists(name):
            self.write(name, T.one_a_key(df, known.key) if keyed else df)
            return self.table(name).count()
        if not known:
            return self.append(name, df)
        version = self._new_version()
        new, parts = self._hold(name, version, df)
        added = self.append(name, T.insert_missing(self._touched(name, parts), T.one_a_key(new, known.key) if keyed else new, known.key))
        self._let_go(name, version, whole=True)
        return added

    def _touched(self, name: str, parts: set[str]) -> DataFrame:
        """The current rows of some parts."""
        now = self._parts(name)
        schema = schema_of(now) if now["schema"] else TABLES[name].schema()
        return self._read(name, schema, {p: f for p, f in now["parts"].items() if p in parts})

    def import_csv(self, path: str, table: str, if_exists: str = "append", columns_map: dict[str, str] | None = None, parse_dates: Sequence[str] = ("date",), **options) -> int:
        """Rows of CSV files; none of an empty one.  Dates that can't be read are null."""
        df = files.read_csv(self.spark, path, columns_map=columns_map, inferSchema=table not in TABLES, **options)
        if not df.columns:
            return 0
        df = df.withColumns({c: column_maps.parse_date(F.col(c)) for c in parse_dates if c in df.columns})
        if table in TABLES:
            df = df.withColumns({f.name: F.col(f.name).try_cast(f.dataType) for f in TABLES[table].schema().fields if f.name in df.columns})
        return self.insert(table, df, if_exists)

    def import_source_csv(self, path: str, source: str | None = None, table: str = "daily_ohlcv") -> int:
        df = files.read_source_csv(self.spark, path)
        return self.insert(table, column_maps.normalise(df, source)) if df.columns else 0

    def import_folder(self, folder: str, table: str, kind: str = "csv", pattern: str | None = None, recursive: bool = False, if_exists: str = "append") -> int:
        df = files.read_folder(self.spark, folder, kind, pattern, recursive)
        if not df.columns:
            return 0
        return self.insert(table, column_maps.normalise(df) if kind == "csv" and table == "daily_ohlcv" else df, if_exists)

    def import_parquet(self, path: str, table: str, if_exists: str = "append") -> int:
        return self.insert(table, self.spark.read.parquet(path), if_exists)

    def import_excel(self, path: str, table: str, sheet_name: str | int = 0, if_exists: str = "append") -> int:
        return self.insert(table, files.read_excel(self.spark, path, sheet_name), if_exists)

    def export_csv(self, query_or_table: str, path: str, header: bool = True, delimiter: str = ",") -> None:
        files.write_csv(self.resolve(query_or_table), path, header, delimiter, single=True)

    def export_parquet(self, query_or_table: str, path: str) -> None:
        files.write_parquet(self.resolve(query_or_table), path)

    # Layers

    def upsert(self, name: str, new: DataFrame, keep: Sequence[str] = ()) -> int:
        """``new`` over the rows with its keys; of rows with one key in it the greatest stands.  Only the months it touches are read
        and written anew.  The number of rows that came in."""
        key, after, version, now = TABLES[name].key, next(iter(self._versions(name)[-1:]), None), self._new_version(), self._parts(name)
        schema = schema_of(now) if now["schema"] else TABLES[name].schema()
        rows, parts = self._hold(name, version, T.one_a_key(new, key))
        written = self._add(name, version, T.upsert(self._touched(name, parts), rows, key, keep))
        self._commit(name, version, schema, {**now["parts"], **written}, after)
        count = rows.count()
        self._let_go(name, version, whole=False)
        return count

    def import_ods(self, source: str, table_type: str, df: DataFrame) -> int:
        """Raw rows of a source, over older ones with the same key; missing numbers of bars are 0, the flag "2"."""
        name = f"ods_{table_type}"
        schema = TABLES[name].schema()
        has = lambda f: F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        stamp = {"source": F.lit(source), "fetched_at": F.current_timestamp()}
        out = df.select(*[(stamp.get(f.name, has(f))).alias(f.name) for f in schema.fields])
        if table_type == "daily_ohlcv":
            out = out.na.fill(0.0).na.fill({"adjust_flag": T.ADJUSTED})
        added = self.upsert(name, out)
        now = self.spark.createDataFrame([(source, table_type, name)], "source string, table_type string, table_name string").withColumn("created_at", F.current_timestamp())
        self.upsert("meta_ods_tables", now, keep=["created_at"])
        return added

    def run_etl(self, source: str, tables: Sequence[str] = ("calendars", "instruments", "index_components", "daily_ohlcv")) -> dict[str, str]:
        """ODS to DWD, table by table; what failed is told in the result."""
        keep = {"instruments": ["list_date", "market", "board_type"], "daily_ohlcv": ["factor", "raw_close"]}
        make = {"calendars": T.to_calendars, "instruments": T.to_instruments, "daily_ohlcv": T.to_ohlcv}
        done = {}
        for t in tables:
            try:
                ods = self.table(f"ods_{t}").where(F.col("source") == source)
                if t == "index_components":
                    self.write("dwd_index_components", T.to_index_components(self.table("dwd_index_components"), ods))
                else:
                    self.upsert(f"dwd_{t}", make[t](ods), keep.get(t, ()))
                done[t] = "ok"
            except Exception as e:  # one table's failure is reported and doesn't stop the others
                done[t] = f"failed: {e}"
        return done

    def roll_up(self, monthly: bool = True, start: str | None = None, end: str | None = None) -> None:
        self.upsert("app_monthly_stats" if monthly else "app_yearly_stats", T.roll_up(self.table("dwd_daily_ohlcv"), monthly=monthly, start=start, end=end))

    def validate_all(self, today: str | None = None) -> DataFrame:
        """(table_name, rule, failed, passed), added to the log: one pass a table."""
        today = today or f"{datetime.now(timezone.utc):%Y-%m-%d}"
        found = None
        for t in sorted({t for t, _ in T.RULES.values()}):
            own = T.check_rules(self.table(t), {n: c for n, (of, c) in T.RULES.items() if of == t})
            if t == "dwd_daily_ohlcv":
                own = own.unionByName(T.recency(self.table(t), today))
            own = own.withColumn("table_name", F.lit(t))
            found = own if found is None else found.unionByName(own)
        log = found.select(F.expr("uuid()").alias("id"), "table_name", "rule", "failed", "passed", F.lit("").alias("details"), F.current_timestamp().alias("checked_at"))
        self.append("meta_validation_log", log)
        return found.select("table_name", "rule", "failed", "passed")

    def validate(self, table: str = "daily_ohlcv", required: Sequence[str] = ("date", "symbol", "close")) -> dict:
        """Missing columns, null and repeated keys of a table."""
        df = self.table(table)
        missing = [c for c in required if c not in df.columns]
        key = [c for c in (TABLES[table].key if table in TABLES else ("date", "symbol")) if c in df.columns]
        nulls = {k: v or 0 for k, v in T.null_keys(df, key).first().asDict().items()} if key else {}
        repeated = T.duplicate_keys(df, key).count() if key else 0
        return {"ok": not missing and not any(nulls.values()) and not repeated, "missing_columns": missing, "null_keys": nulls, "duplicate_keys": repeated}

    # Meta

    def register_source(self, name: str, priority: int = 100, is_active: bool = True, config: dict | None = None) -> None:
        self.upsert("meta_data_sources", self.spark.createDataFrame([(name, priority, is_active, json.dumps(config or {}))], TABLES["meta_data_sources"].schema()))

    def active_sources(self) -> DataFrame:
        return self.table("meta_data_sources").where("is_active").orderBy("priority", "name")

    def primary_source(self) -> str | None:
        row = self.active_sources().limit(1).first()
        return row["name"] if row else None

    def update_params(self, name: str) -> None:
        row = self.table(name).agg(F.lit(name).alias("table_name"), F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("row_count"), F.current_timestamp().alias("updated_at"))
        self.upsert("meta_table_params", row)

    def table_freshness(self, today: str) -> DataFrame:
        return self.table("meta_table_params").select("table_name", "end_date", T.freshness(F.col("end_date"), F.lit(today).cast("date")).alias("status"))

    def log_update(self, name: str, status: str, rows: int = 0, message: str = "") -> None:
        row = self.spark.range(1).select(F.expr("uuid()").alias("id"), F.lit(name).alias("table_name"), F.lit(status).alias("status"), F.lit(rows).cast("long").alias("row_count"), F.lit(message).alias("message"), F.current_timestamp().alias("started_at"), F.current_timestamp().alias("finished_at"))
        self.append("meta_update_log", row)

    def history(self, n: int = 10) -> DataFrame:
        return self.table("meta_update_log").orderBy(F.col("started_at").desc()).limit(n)

    def data_dictionary(self, name: str | None = None) -> dict:
        return data_dictionary(name)
