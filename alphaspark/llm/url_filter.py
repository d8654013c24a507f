"""URL filters: a dated rule list joined to captures as of their fetch day.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)"
FIRST_SEGMENT = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*/([^/?#]+)"


def url_host(url: Column) -> Column:
    """Host in lower case, without user, port and final dots; empty where there is none."""
    host = F.regexp_replace(F.regexp_extract(url, AUTHORITY, 1), r"^.*@", "")
    return F.coalesce(F.lower(F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"\.+$", "")), F.lit(""))


def url_segment(url: Column) -> Column:
    """First segment of the path; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, FIRST_SEGMENT, 1), F.lit(""))


def rule_intervals(changes: DataFrame) -> DataFrame:
    """(rule, day, action, kind, category) -> one row (rule, spans) per rule; spans: [since, until) of each time one of its
    entries (rule, kind, category) was listed, in order, until null while it still is.

    Of several changes of one entry on one day one counts, "remove" before "add"; so an entry has a row a day at
    most, and its window is bounded by the calendar.  Rows without rule or day, and entries that were only ever
    removed, list nothing; a null kind or category is a value of its own.
    """
    entry = ["rule", "kind", "category"]
    daily = (
        changes.where("rule IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
        .groupBy(F.lower("rule").alias("rule"), "kind", "category", F.col("day").cast("date").alias("day"))
        .agg(F.max("action").alias("action"))
    )
    spans = daily.withColumn("until", F.lead("day").over(Window.partitionBy(*entry).orderBy("day"))).where("action = 'add'")
    return spans.groupBy("rule").agg(F.sort_array(F.collect_list(F.struct(F.col("day").alias("since"), "until", "kind", "category"))).alias("spans"))


def filter_urls(captures: DataFrame, changes: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """``captures`` with columns host, rule, category, blocked, by the list as it stood on the fetch day.

    A rule is a host, or a host and the first path segment ("a.example/en"); it holds for the host and all below
    it.  Of the rules active on the day, the longest decides; blocked if one of its entries active on the day is of kind "block"
    ("allow" exempts).  category: that of the entries that decide, several in order with commas between.

    Captures are reduced to their sites (host, segment) with partial sums before any shuffle; the few suffixes of
    each site meet the rules' spans by an equi-join, and each capture then looks up the spans of its site, as of
    its day.  Only the last join moves captures, by site; it is a plain outer join, whose hot sites Spark's
    skew join splits.  A null url or fetch day, or a url without host, matches no rule: not blocked.  Empty
    tables give no rows, or unblocked ones.  Repeated captures are kept.
    """
    taken = [c for c in captures.columns if c not in ("host", "rule", "category", "blocked")]
    sited = captures.select(*taken).withColumns({"host": url_host(F.col(url)), "__seg": url_segment(F.col(url))})
    sites = sited.select("host", "__seg").where("host != ''").distinct()
    labels = F.split("host", r"\.")
    below = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(below, lambda h: F.concat(h, F.lit("/"), F.lower("__seg")))
    names = F.array_distinct(F.concat(below, F.when(F.col("__seg") != "", paths).otherwise(F.array().cast("array<string>"))))
    # Staged, so that the last join stands on plain exchanges, whose hot sites Spark can split.
    found = staged(
        sites.select("host", "__seg", F.explode(names).alias("rule"))
        .join(rule_intervals(changes), "rule")
        .groupBy("host", "__seg")
        .agg(F.sort_array(F.collect_list(F.struct((-F.length("rule")).alias("order"), "rule", "spans"))).alias("__rules"))
        .withColumnsRenamed({"host": "__host", "__seg": "__seg2"}),
        "sites",
    )
    day = F.col(fetched).cast("date")
    active = lambda r: F.filter(r["spans"], lambda s: (s["since"] <= day) & (s["until"].isNull() | (day < s["until"])))
    hits = F.transform(F.col("__rules"), lambda r: F.struct(r["rule"].alias("rule"), active(r).alias("entries")))
    verdict = F.try_element_at(F.filter(hits, lambda h: F.size(h["entries"]) > 0), F.lit(1))
    blocks = lambda e: F.coalesce(e["kind"] == "block", F.lit(False))
    blocked = F.coalesce(F.exists("__v.entries", blocks), F.lit(False))
    deciding = F.transform(F.filter("__v.entries", lambda e: blocks(e) == blocked), lambda e: e["category"])
    categories = F.filter(F.array_sort(F.array_distinct(deciding)), lambda c: c.isNotNull())
    category = F.when(F.size(categories) > 0, F.array_join(categories, ","))
    return (
        sited.join(found, (F.col("host") == F.col("__host")) & (F.col("__seg") == F.col("__seg2")), "left")
        .withColumn("__v", verdict)
        .select(*taken, "host", F.col("__v.rule").alias("rule"), category.alias("category"), blocked.alias("blocked"))
    )
