from __future__ import annotations

import __spark_entry__ as entry
import pytest

from alphaspark import queries as library


def test_entry(spark, sf_small):
    assert entry.entry(spark).columns == ["date", "ic", "n"]


def test_every_query_has_sql():
    assert set(library.QUERIES) == set(library.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["bars_monthly", "ic_momentum", "layered_returns", "turnover", "alpha016", "alpha023", "expr_alpha001", "expr_universe", "monthly_stats", "upsert_dedup", "ts_skew", "ts_quantile", "event_bars", "xs_decile"])
def test_against_duckdb(spark, sf_small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("lineitem", "orders", "supplier", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    df = library.QUERIES[name](spark, sf_small)
    got = con.sql(library.ORACLES[name])
    order = [got.columns.index(c) for c in df.columns]
    shown = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else str(v)[:19]
    assert sorted(repr([shown(v) for v in r]) for r in df.collect()) == sorted(repr([shown(r[i]) for i in order]) for r in got.fetchall())
