"""The registered queries of the ten operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_leaks
from .html_extract import extract_pages
from .license_scan import scan_licenses
from .line_dedup import line_dedup
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .quality import score_quality
from .substring_dedup import substring_dedup
from .telephony import record_texts
from .url_filter import filter_urls, url_host, url_segment


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_changes(captures: DataFrame) -> DataFrame:
    """A dated rule list made from the hosts and first segments of the captures themselves, since the tables hold
    none: a rule for two thirds of the hosts and for a quarter of the (host, segment) pairs, each added, most
    removed later and some added again, on days that its md5 gives."""
    sites = captures.select(url_host(F.col("url")).alias("host"), url_segment(F.col("url")).alias("seg")).where("host != ''").distinct()
    digit = lambda at, n: F.conv(F.substring("__md5", at, n), 16, 10).cast("int")
    names = (
        sites.select(F.col("host").alias("rule"), F.lit(3).alias("of")).distinct()
        .union(sites.where("seg != ''").select(F.concat("host", F.lit("/"), F.lower("seg")).alias("rule"), F.lit(4).alias("of")).distinct())
        .withColumn("__md5", F.md5(F.col("rule").cast("binary")))
        .withColumns({"a": digit(1, 4), "b": digit(5, 4), "c": digit(9, 4), "d": digit(13, 4)})
        .where("(of = 3 AND a % 3 < 2) OR (of = 4 AND a % 4 = 0)")
    )
    start = F.lit("2024-01-01").cast("date")
    step = lambda action, days: F.struct(F.lit(action).alias("action"), F.date_add(start, days.cast("int")).alias("day"))
    first, gone, back = F.col("b") % 200, F.col("b") % 200 + 20 + F.col("c") % 100, F.col("b") % 200 + 130 + F.col("d") % 60
    steps = F.filter(
        F.array(step("add", first), F.when(F.col("c") % 5 != 0, step("remove", gone)), F.when((F.col("c") % 5 != 0) & (F.col("d") % 2 == 0), step("add", back))),
        lambda s: s.isNotNull(),
    )
    kind = F.when((F.col("of") == 4) & (F.col("d") % 3 == 0), "allow").otherwise("block")
    category = F.element_at(F.array(*map(F.lit, ("adult", "malware", "spam"))), F.col("c") % 3 + 1)
    return names.select("rule", kind.alias("kind"), category.alias("category"), F.explode(steps).alias("s")).select("rule", "s.action", "s.day", "kind", "category")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    days = F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), days))
    return filter_urls(captures, url_changes(captures)).select("page_id", "url", "host", F.col("fetched_on").cast("string").alias("fetched_on"), "rule", "category", "blocked")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"), threshold=0.3)


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the PCM at 16 kHz as a zstandard frame: raw it would be four to eight times the texts."""
    return record_texts(table(spark, sf_dir, "documents"), keep_pcm="zstd")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    first = F.round(F.try_element_at("positions", F.lit(1)), 6).alias("first_position")
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", F.size("positions").cast("long").alias("n_copies"), first)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_benchmark_decontamination,
        op3_minhash_near_dedup,
        op4_quality_classifier,
        op5_license_scans,
        op6_html_extraction,
        op7_telephony_audio,
        op8_source_mixing,
        op9_substring_dedup,
        op10_line_dedup,
    )
}
