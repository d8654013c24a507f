from __future__ import annotations

import datetime as dt

from alphaspark.llm.url_filter import filter_urls, rule_intervals, url_host, url_segment
from pyspark.sql import functions as F

from .helpers import rows_of

CHANGES = "rule string, day string, action string, kind string, category string"


def captures(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, fetched_on string").withColumn("fetched_on", F.col("fetched_on").cast("date"))


def changes(spark, rows):
    return spark.createDataFrame(rows, CHANGES)


RULES = [
    ("bad.com", "2024-01-10", "add", "block", "spam"),
    ("bad.com", "2024-02-10", "remove", "block", "spam"),
    ("bad.com", "2024-03-10", "add", "block", "malware"),
    ("ok.bad.com", "2024-01-01", "add", "allow", "fine"),
    ("news.com/ads", "2024-01-01", "add", "block", "ads"),
    ("Same.com", "2024-01-05", "add", "block", "spam"),
    ("same.com", "2024-01-05", "remove", "block", "spam"),
    (None, "2024-01-05", "add", "block", "spam"),
    ("late.com", None, "add", "block", "spam"),
]


def test_each_capture_sees_the_list_of_its_day(spark):
    rows = [
        (1, "http://bad.com/x", "2024-01-09"), (2, "http://bad.com/x", "2024-01-10"), (3, "https://USER@www.BAD.com.:8080/x?q", "2024-02-09"), (4, "http://bad.com", "2024-02-10"),
        (5, "http://a.b.bad.com/", "2024-05-01"), (6, "http://ok.bad.com/", "2024-05-01"), (7, "http://news.com/ads/1", "2024-05-01"), (8, "http://news.com/world/ads", "2024-05-01"),
        (9, "http://notbad.com/", "2024-05-01"), (10, None, "2024-05-01"), (11, "http://bad.com/", None), (12, "no url", "2024-05-01"), (13, "http://same.com/", "2024-05-01"), (14, "http://late.com/", "2024-05-01"),
    ]
    got = {r["page_id"]: (r["rule"], r["category"], r["blocked"]) for r in filter_urls(captures(spark, rows), changes(spark, RULES)).collect()}
    none = (None, None, False)
    assert got == {
        1: none, 2: ("bad.com", "spam", True), 3: ("bad.com", "spam", True), 4: none, 5: ("bad.com", "malware", True), 6: ("ok.bad.com", "fine", False),
        7: ("news.com/ads", "ads", True), 8: none, 9: none, 10: none, 11: none, 12: none, 13: none, 14: none,
    }


def test_brute_force_over_days(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=7 * i) for i in range(14)]
    rows = [(i, "http://www.bad.com/", str(day)) for i, day in enumerate(days)]
    got = {r["page_id"]: r["blocked"] for r in filter_urls(captures(spark, rows), changes(spark, RULES)).collect()}
    inside = lambda d: dt.date(2024, 1, 10) <= d < dt.date(2024, 2, 10) or d >= dt.date(2024, 3, 10)
    assert got == {i: inside(day) for i, day in enumerate(days)}


def test_repeated_rows_clashing_columns_and_empty_tables(spark):
    rows = [(1, "http://bad.com/", "2024-05-01")] * 3
    df = captures(spark, rows).withColumn("host", F.lit("mine")).withColumn("spans", F.lit(1)).withColumn("kind", F.lit("k"))
    out = filter_urls(df, changes(spark, RULES))
    assert out.count() == 3 and {(r["host"], r["kind"], r["spans"], r["blocked"]) for r in out.collect()} == {("bad.com", "k", 1, True)}
    assert filter_urls(captures(spark, []), changes(spark, RULES)).count() == 0
    assert rows_of(filter_urls(captures(spark, rows[:1]), changes(spark, [])), "blocked") == [(False,)]
    assert rule_intervals(changes(spark, [])).count() == 0


def test_long_url_and_parts(spark):
    url = "http://" + "a." * 30 + "bad.com/" + "x" * 100_000
    assert filter_urls(captures(spark, [(1, url, "2024-05-01")]), changes(spark, RULES)).first()["blocked"]
    df = spark.createDataFrame([("ftp://h.x/a/b",), ("http://h.x",), ("",), (None,), ("http://h.x?q=/a",)], "u string")
    assert [tuple(r) for r in df.select(url_host(F.col("u")), url_segment(F.col("u"))).collect()] == [("h.x", "a"), ("h.x", ""), ("", ""), ("", ""), ("h.x", "")]


def test_entries_of_one_rule_are_listed_one_by_one(spark):
    rules = [
        ("two.com", "2024-01-01", "add", "block", "malware"), ("two.com", "2024-01-01", "add", "block", "adult"), ("two.com", "2024-02-01", "remove", "block", "adult"),
        ("swap.com", "2024-01-01", "add", "block", "adult"), ("swap.com", "2024-02-01", "remove", "block", "adult"), ("swap.com", "2024-02-01", "add", "block", "malware"),
        ("both.com", "2024-01-01", "add", "allow", "fine"), ("both.com", "2024-02-01", "add", "block", None), ("both.com", "2024-03-01", "remove", "block", None),
    ]
    hosts, days = ("two.com", "swap.com", "both.com"), ("2024-01-15", "2024-02-15", "2024-03-15")
    rows = [(3 * i + j, f"http://{h}/", d) for i, h in enumerate(hosts) for j, d in enumerate(days)]
    got = {r["page_id"]: (r["category"], r["blocked"]) for r in filter_urls(captures(spark, rows), changes(spark, rules)).collect()}
    assert [got[k] for k in range(9)] == [("adult,malware", True), ("malware", True), ("malware", True), ("adult", True), ("malware", True), ("malware", True), ("fine", False), (None, True), ("fine", False)]
