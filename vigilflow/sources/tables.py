"""Tables that are replaced as a whole or appended to: versions, JSON snapshots, JSON-lines logs."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import TypeVar
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilflow.sources.commits import Commits

log = logging.getLogger(__name__)
Store = TypeVar("Store")

ITEM = (
    "fingerprint string, title string, source string, url string, published_at timestamp, raw_content string, threat_score double, tags array<string>, fetched_at timestamp, language string, "
    "original_language string, category string, category_confidence double, affected_platforms array<string>, audience_targets array<string>, audience_relevance_score double, "
    "actionability_level string, actionability_score double, source_tier string, source_credibility_score double, corroborating_sources array<string>"
)
DEFAULTS = {
    "threat_score": 0.0, "language": "unknown", "original_language": "unknown", "category": "other", "category_confidence": 0.0, "audience_relevance_score": 0.0,
    "actionability_level": "informational", "actionability_score": 0.0, "source_tier": "unverified", "source_credibility_score": 0.0,
}


class VersionedTable:
    """One table that is replaced as a whole; readers take its last version. Of two writers of a version the second has a Conflict."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self._commits = Commits(spark, path, keep)

    def versions(self) -> list[int]:
        return self._commits.numbers()

    def read(self, schema: str) -> DataFrame:
        """The last version; an empty table where there is none."""
        return self._commits.read(self._commits.last(), "rows", schema)

    def replace(self, rows: DataFrame) -> int:
        base = self._commits.last()
        return self._commits.commit(base, {"rows": self._commits.stage(rows, "rows")})["number"]


def with_defaults(items: DataFrame) -> DataFrame:
    """Missing fields of older snapshots get their defaults, the old code of Ukrainian the new one."""
    fixed = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()}
    fixed |= {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("tags", "affected_platforms", "audience_targets", "corroborating_sources")}
    rows = items.withColumns(fixed)
    return rows.withColumns({c: F.when(F.col(c) == "uk", "ua").otherwise(F.col(c)) for c in ("language", "original_language")})


#: Where a line or file that doesn't parse is kept.
BROKEN = "_broken"


def _parsed(text: Column, schema: str) -> Column:
    """A JSON object by a schema; BROKEN holds the text of one that doesn't fit it."""
    return F.from_json(text, f"{schema}, {BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})


def parse_log(lines: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of lines of JSON: every line that isn't blank is in one of them. rejects has the other columns and the line."""
    text = F.col(column)
    read = lines.filter(F.trim(text) != "").withColumn("_row", _parsed(text, schema))
    broken = F.col("_row").isNull() | F.col(f"_row.{BROKEN}").isNotNull() | ~F.startswith(F.ltrim(text), F.lit("{"))
    names = T.StructType.fromDDL(schema).names
    return read.filter(~broken).select(*[F.col(f"_row.{c}").alias(c) for c in names]), read.filter(broken).drop("_row").withColumnRenamed(column, "line")


def split_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of the files of a JSON-lines log; rejects (file, line)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_log(lines, schema)


def split_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of {"items": [...]} files, read through an explicit schema with defaults for what is missing.

    rejects (file, reason, n): a file that isn't such an object (broken, 1), and items without a fingerprint (no fingerprint, n).
    """
    schema = f"items array<struct<{', '.join(x.replace(' ', ':', 1) for x in ITEM.split(', '))}>>"
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), _parsed(F.col("value"), schema).alias("whole"))
    broken = F.col("whole").isNull() | F.col(f"whole.{BROKEN}").isNotNull() | F.col("whole.items").isNull()
    items = files.filter(~broken).select("file", F.explode("whole.items").alias("i"))
    nameless = items.filter("i.fingerprint is null").groupBy("file").agg(F.count("*").alias("n")).select("file", F.lit("no fingerprint").alias("reason"), "n")
    rejects = files.filter(broken).select("file", F.lit("broken").alias("reason"), F.lit(1).cast("long").alias("n")).unionByName(nameless)
    return with_defaults(items.select("i.*").filter("fingerprint is not null")), rejects


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The items of split_snapshot()."""
    return split_snapshot(spark, path)[0]


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of split_log()."""
    return split_log(spark, path, schema)[0]


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def post_keys(keys: DataFrame) -> DataFrame:
    """fingerprint and locale of cache keys: no locale is en, the old code uk is ua."""
    parts = F.split("key", ":")
    locale = F.coalesce(F.get(parts, F.lit(1)), F.lit("en"))
    return keys.select("key", F.get(parts, F.lit(0)).alias("fingerprint"), F.when(locale == "uk", "ua").otherwise(locale).alias("locale"))


def pending(names: DataFrame, applied: DataFrame) -> DataFrame:
    """Migrations that aren't applied yet, in order of their names."""
    return names.join(applied, "name", "left_anti").orderBy("name")


def backends(kind: str, primary: Store, secondary: Callable[[], Store]) -> list[Store]:
    """The stores that a setting asks for, the primary first: json for it alone, dual for both.

    A secondary that can't be set up, and a setting of another name, leave the primary alone and are logged.
    """
    if kind == "dual":
        try:
            return [primary, secondary()]
        except Exception:
            log.warning("the second store can't be set up; the first serves alone", exc_info=True)
    elif kind != "json":
        log.warning("unknown kind of store %r; the first serves alone", kind)
    return [primary]


def jdbc_options(url: str, table: str, split: tuple[str, int, int] | None = None, parts: int = 8, fetch: int = 1000) -> dict[str, str]:
    """Options of spark.read.format("jdbc") for a PostgreSQL URL in any of its usual forms.

    Name and password leave the URL. split is an integer column and its bounds; rows outside them are read too.
    """
    at = urlsplit(url)
    if at.scheme.split("+")[0] not in ("postgres", "postgresql") or not at.hostname:
        raise ValueError("not the URL of a PostgreSQL database")
    host = at.hostname + (f":{at.port}" if at.port else "")
    options = {"url": f"jdbc:postgresql://{host}{at.path}" + (f"?{at.query}" if at.query else ""), "dbtable": table, "fetchsize": str(fetch)}
    options |= {name: unquote(value) for name, value in (("user", at.username), ("password", at.password)) if value}
    if split:
        column, low, high = split
        options |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return options
