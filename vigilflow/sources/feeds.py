"""Feed readers: RSS and Atom files as news rows, behind a registry of kinds; one source's failure leaves the others.

There is no network here: paths are files that Spark reads. A downloader is a reader of another kind,
registered by name; what it raises is caught for its source alone. Reads are lazy, so what breaks only when a file is
opened (a truncated or missing file) is passed over by the reader itself, and shows as a source without rows (counts()).
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilflow.functions import editorial as ed
from vigilflow.functions import text as tx

log = logging.getLogger(__name__)
NEWS = "fingerprint string, title string, source string, url string, published_at timestamp, raw_content string"


TOLERANT = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}


@dataclass(frozen=True)
class SourceConfig:
    """A source's name, the kind of its reader and where it is."""

    name: str
    kind: str
    path: str


READERS: dict[str, Callable[[SparkSession, SourceConfig, str], DataFrame]] = {}


def reader(kind: str):
    """Register a reader: (spark, config, now) -> news rows."""

    def register(function):
        READERS[kind] = function
        return function

    return register


def build(configs: Iterable[SourceConfig]) -> list[tuple[SourceConfig, Callable]]:
    """Each config with its reader; an unknown kind is an error."""
    out = []
    for c in configs:
        if c.kind not in READERS:
            raise ValueError(f"unknown source kind {c.kind!r} of {c.name!r}")
        out.append((c, READERS[c.kind]))
    return out


def _rows(entries: DataFrame, config: SourceConfig, title: Column, url: Column, body: Column, times: list[Column], now: str) -> DataFrame:
    rows = entries.select(
        F.trim(title).alias("title"), F.lit(config.name).alias("source"), F.trim(url).alias("url"),
        ed.entry_time(*times, now=F.to_timestamp(F.lit(now))).alias("published_at"), tx.strip_html(F.coalesce(body, F.lit(""))).alias("raw_content"),
    )
    rows = rows.filter((F.length("title") > 0) & (F.length("url") > 0))
    return rows.withColumn("fingerprint", tx.url_fingerprint(F.col("url"), F.col("title"))).select("fingerprint", "title", "source", "url", "published_at", "raw_content")


@reader("rss")
def read_rss(spark: SparkSession, config: SourceConfig, now: str) -> DataFrame:
    """Items of RSS files; those without title or link are dropped."""
    schema = "title string, link string, summary string, description string, pubDate string, updated string, created string"
    items = spark.read.options(**TOLERANT).format("xml").option("rowTag", "item").schema(schema).load(config.path)
    return _rows(items, config, F.col("title"), F.col("link"), F.coalesce("summary", "description"), [F.col("pubDate"), F.col("updated"), F.col("created")], now)


@reader("atom")
def read_atom(spark: SparkSession, config: SourceConfig, now: str) -> DataFrame:
    schema = "title string, link struct<_href:string>, summary string, content string, published string, updated string"
    items = spark.read.options(**TOLERANT).format("xml").option("rowTag", "entry").schema(schema).load(config.path)
    return _rows(items, config, F.col("title"), F.col("link._href"), F.coalesce("summary", "content"), [F.col("published"), F.col("updated")], now)


@reader("parquet")
def read_parquet(spark: SparkSession, config: SourceConfig, now: str) -> DataFrame:
    return spark.read.options(**TOLERANT).schema(NEWS).parquet(config.path).select("fingerprint", "title", F.lit(config.name).alias("source"), "url", "published_at", "raw_content")


def fetch_all(spark: SparkSession, configs: Iterable[SourceConfig], now: str) -> tuple[DataFrame, list[str]]:
    """All sources' rows as one table, and the names of those that couldn't be read."""
    parts, failed = [], []
    for config, read in build(configs):
        try:
            parts.append(read(spark, config, now))
        except Exception:
            log.warning("source %s can't be read", config.name, exc_info=True)
            failed.append(config.name)
    empty = spark.createDataFrame([], NEWS)
    return reduce(DataFrame.unionByName, parts, empty), failed


def counts(rows: DataFrame, configs: Iterable[SourceConfig]) -> DataFrame:
    """(source, n): how many rows each configured source gave, 0 for one that failed or was silent."""
    names = rows.sparkSession.createDataFrame([(c.name,) for c in configs], "source string")
    return names.join(rows.groupBy("source").agg(F.count("*").alias("n")), "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))
