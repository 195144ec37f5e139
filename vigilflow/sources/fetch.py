"""Feeds as a Spark data source: one partition a source, fetched and parsed on executors, batch and stream alike.

    register(spark, fetch)
    raw = spark.read.format("feeds").option("sources", sources(configs)).load()
    news, status = news_rows(raw, now), statuses(raw)

fetch gives a source's bytes for its path or address; what it raises, and what can't be parsed, becomes that source's status row
(source, ok, error, n) and leaves the others alone. A source gives all its entries or, if it breaks, none. What was
fetched should be written once before it is read twice, as news and as statuses: each read fetches anew.

A stream asks every source once a batch; its offsets are times, so they grow over restarts. A batch that is run again fetches
again: what comes twice has the same fingerprints.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from vigilflow.functions import editorial as ed
from vigilflow.functions import text as tx
from vigilflow.sources.feeds import SourceConfig
from vigilflow.session import show_workers

RAW = "source string, ok boolean, error string, n int, place int, title string, url string, body string, times array<string>"
#: Elements of an entry, by what they tell; the first that has a text counts.
BODIES = ("summary", "description", "content", "encoded")
TIMES = ("pubDate", "published", "updated", "created", "date")


def read_bytes(path: str) -> bytes:
    """A file on any file system that pyarrow knows, by its address or absolute path."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as stream:
        return stream.read()


def entries(data: bytes) -> list[tuple[str, str, str, list[str]]]:
    """(title, url, body, times) of each item or entry of an RSS or Atom document."""
    found = []
    name = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    for entry in ElementTree.fromstring(data).iter():
        if name(entry) not in ("item", "entry"):
            continue
        parts: dict[str, str] = {}
        for part in entry:
            text = "".join(part.itertext()).strip() or (part.get("href", "") if name(part) == "link" else "")
            if text and (name(part) != "link" or part.get("rel", "alternate") == "alternate"):
                parts.setdefault(name(part), text)
        found.append((parts.get("title", ""), parts.get("link", ""), next((parts[b] for b in BODIES if b in parts), ""), [parts[t] for t in TIMES if t in parts]))
    return found


class Source(InputPartition):
    def __init__(self, name: str, path: str):
        self.name, self.path = name, path


def _read(source: Source, fetch: Callable[[str], bytes]) -> Iterator[tuple]:
    try:
        found, error = entries(fetch(source.path)), None
    except Exception as raised:
        found, error = [], f"{type(raised).__name__}: {raised}"[:500]
    yield (source.name, error is None, error, len(found), None, None, None, None, None)
    for i, (title, url, body, times) in enumerate(found):
        yield (source.name, None, None, None, i, title, url, body, times)


def _listed(options: dict) -> list[Source]:
    return [Source(name, path) for name, path in json.loads(options["sources"])]


def feeds_format(fetch: Callable[[str], bytes] = read_bytes) -> type[DataSource]:
    """The data source "feeds" of a way to fetch; fetch must be picklable, as executors call it."""

    class Batch(DataSourceReader):
        def __init__(self, options: dict):
            self.listed = _listed(options)

        def partitions(self) -> list[InputPartition]:
            return self.listed

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return _read(partition, fetch)

    class Stream(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.listed, self.wait, self.last = _listed(options), int(float(options.get("seconds", 0)) * 1000), 0

        def initialOffset(self) -> dict:
            return {"at": 0}

        def latestOffset(self) -> dict:
            """Now, or the last time as long as seconds haven't gone by since."""
            now = time.time_ns() // 1_000_000
            if now - self.last >= max(1, self.wait):
                self.last = now
            return {"at": self.last}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return self.listed

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return _read(partition, fetch)

    class Feeds(DataSource):
        @classmethod
        def name(cls) -> str:
            return "feeds"

        def schema(self) -> str:
            return RAW

        def reader(self, schema) -> DataSourceReader:
            return Batch(self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Stream(self.options)

    return Feeds


def register(spark: SparkSession, fetch: Callable[[str], bytes] = read_bytes) -> None:
    """Make the format "feeds" known to a session."""
    show_workers(spark)
    spark.dataSource.register(feeds_format(fetch))


def sources(configs: Iterable[SourceConfig]) -> str:
    """The option of the same name."""
    return json.dumps([[c.name, c.path] for c in configs])


def news_rows(raw: DataFrame, now: str) -> DataFrame:
    """News rows of what was fetched; entries without title or link are dropped. doc_id is their place: sources by name, entries as they come."""
    times = [F.get("times", F.lit(i)) for i in range(len(TIMES))]
    title, url = F.trim("title"), F.trim("url")
    place: Column = F.struct("source", "place")
    rows = raw.filter("ok is null").select(
        place.alias("doc_id"), title.alias("title"), "source", url.alias("url"), ed.entry_time(*times, now=F.to_timestamp(F.lit(now))).alias("published_at"), tx.strip_html(F.coalesce("body", F.lit(""))).alias("raw_content")
    )
    rows = rows.filter((F.length("title") > 0) & (F.length("url") > 0)).withColumn("fingerprint", tx.url_fingerprint(F.col("url"), F.col("title")))
    return rows.select("doc_id", "fingerprint", "title", "source", "url", "published_at", "raw_content")


def statuses(raw: DataFrame) -> DataFrame:
    """(source, ok, error, n): a row for each source."""
    return raw.filter("ok is not null").select("source", "ok", "error", "n")


def silent(status: DataFrame) -> DataFrame:
    """Sources that gave nothing, with their errors, if any."""
    return status.filter("n = 0").select("source", "error")
