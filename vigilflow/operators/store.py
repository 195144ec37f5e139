"""Keyed stores as tables: merges, retention, deletes, differences and fall-back reads.

Parquet tables have no MERGE or DELETE, so each is a rewrite: a join or a grouped merge whose result replaces
the table. Keys shuffle once; rows are merged map-side first where they are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that the newest row decides in the database merge, nulls included.
LATEST = (
    "title", "raw_content", "language", "original_language", "category", "category_confidence", "affected_platforms", "audience_targets", "audience_relevance_score", "actionability_level", "source_tier", "fetched_at",
)
#: Columns that never fall, and columns that only grow; all others stay as first stored.
GREATEST = ("threat_score", "actionability_score", "source_credibility_score")
UNION = ("tags", "corroborating_sources")
#: Columns that posts take from their items.
FROM_ITEMS = ("published_at", "category", "actionability_level")


def fresh(fetched: DataFrame, known: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Rows whose key isn't known yet; rows that repeat a new key all stay."""
    return fetched.join(known.select(key).distinct(), key, "left_anti")


def merge_file(old: DataFrame, new: DataFrame, key: str = "fingerprint", order: str = "doc_id") -> DataFrame:
    """The file store's upsert: an existing row keeps all but its score (the greatest) and tags (the union).

    New rows count in order; the first of a key is inserted, the others merge into it. is_new marks inserts.
    """
    rest = [c for c in old.columns if c not in (key, "threat_score", "tags")]
    first = F.struct(F.col("_age"), F.col(order).alias("_order"), *rest)
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    merged = both.groupBy(key).agg(
        F.min(first).alias("_first"), F.max("threat_score").alias("threat_score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags")
    )
    return merged.select(key, *[F.col(f"_first.{c}").alias(c) for c in rest], "threat_score", "tags", (F.col("_first._age") == 1).alias("is_new"))


def premerged(rows: DataFrame, key: str = "fingerprint", order: str = "doc_id") -> DataFrame:
    """One row a key, its last by order: what one statement may hold."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col(order)).alias("_r")).select(key, "_r.*")


def merge_database(old: DataFrame, new: DataFrame, key: str = "fingerprint") -> DataFrame:
    """The database's upsert: greatest scores, union of list columns, newest classification, the rest as first stored."""
    n = new.select(F.col(key), F.lit(True).alias("n_"), *[F.col(c).alias(f"n_{c}") for c in new.columns if c != key])
    both = old.withColumn("o_", F.lit(True)).join(n, key, "full_outer")
    out = [F.col(key)]
    for c in old.columns:
        if c == key:
            continue
        mine, theirs = F.col(c), F.col(f"n_{c}")
        if c in GREATEST:
            out.append(F.greatest(mine, theirs).alias(c))
        elif c in UNION:
            out.append(F.array_sort(F.array_union(F.coalesce(mine, F.array().cast("array<string>")), F.coalesce(theirs, F.array().cast("array<string>")))).alias(c))
        elif c in LATEST:
            out.append(F.when(F.col("n_"), theirs).otherwise(mine).alias(c))
        else:
            out.append(F.when(F.col("o_"), mine).otherwise(theirs).alias(c))
    return both.select(*out)


def newest(rows: DataFrame, n: int, time: str = "published_at", tie: str = "fingerprint") -> DataFrame:
    return rows.orderBy(F.col(time).desc_nulls_last(), tie).limit(n)


def without_keys(rows: DataFrame, keys: DataFrame, key: str = "fingerprint") -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def only_keys(rows: DataFrame, keys: DataFrame, key: str = "fingerprint") -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Each key with the side that holds it: left, right or both."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")
    return a.join(b, keys, "full_outer").select(*keys, side.alias("side"))


def _same(a: Column, b: Column, kind: str) -> Column:
    if kind == "double":
        return F.coalesce(F.abs(a - b) <= 1e-9, a.isNull() & b.isNull())
    if kind.startswith("array"):
        return F.array_sort(a).eqNullSafe(F.array_sort(b))
    return a.eqNullSafe(b)


def field_difference(left: DataFrame, right: DataFrame, keys: list[str], ignored: tuple[str, ...] = ("fetched_at",)) -> DataFrame:
    """(keys, field): fields of common rows that differ; doubles within 1e-9 are equal, lists as sets in order."""
    kinds = dict(left.dtypes)
    fields = [c for c in left.columns if c in right.columns and c not in keys and c not in ignored]
    r = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in fields])
    differing = F.filter(F.array(*[F.when(~_same(F.col(c), F.col(f"r_{c}"), kinds[c]), c) for c in fields]), lambda x: x.isNotNull())
    return left.join(r, keys).select(*keys, F.explode(differing).alias("field"))


def read_through(primary: DataFrame, secondary: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Rows of the primary, and those of the secondary that it lacks."""
    return primary.unionByName(secondary.join(primary.select(key).distinct(), key, "left_anti"))


def denormalized(posts: DataFrame, items: DataFrame) -> DataFrame:
    """Posts with three columns of their items, null where there is none."""
    return posts.join(items.select("fingerprint", "published_at", "category", "actionability_level"), "fingerprint", "left")


def merge_posts(old: DataFrame, new: DataFrame, now: Column, keys: tuple[str, ...] = ("fingerprint", "locale")) -> DataFrame:
    """The posts' upsert: the newest row of a key wins, and is marked as updated at now; others keep their time. One row a key in new."""
    rest = [c for c in old.columns if c not in (*keys, "updated_at")]
    n = new.select(*keys, F.lit(True).alias("n_"), *[F.col(c).alias(f"n_{c}") for c in rest])
    both = old.join(n, list(keys), "full_outer")
    return both.select(*keys, *[F.when(F.col("n_"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in rest], F.when(F.col("n_"), now).otherwise(F.col("updated_at")).alias("updated_at"))


def backfilled(posts: DataFrame, items: DataFrame) -> DataFrame:
    """Posts with the columns of their items where any of them is distinct from it, and whether that was so; posts without an item stay."""
    theirs = items.select("fingerprint", F.lit(True).alias("i_"), *[F.col(c).alias(f"i_{c}") for c in FROM_ITEMS])
    differs = F.lit(False)
    for c in FROM_ITEMS:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"i_{c}"))
    rows = posts.join(theirs, "fingerprint", "left").withColumn("updated", F.coalesce("i_", F.lit(False)) & differs)
    taken = {c: F.when(F.col("updated"), F.col(f"i_{c}")).otherwise(F.col(c)) for c in FROM_ITEMS}
    return rows.withColumns(taken).select(*posts.columns, "updated")


def backfill(old: DataFrame, rows: DataFrame, valid: Column, keys: tuple[str, ...], order: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to merge, report): the first limit rows in order, less malformed ones. The report tells read, skipped, known and new rows.

    Nothing is written: what merges the rows may be left out, which makes it a dry run.
    """
    read = rows.orderBy(order).limit(limit) if limit else rows
    known = old.select(*keys, F.lit(True).alias("known_")).distinct()
    marked = read.withColumn("valid_", F.coalesce(valid, F.lit(False))).join(known, list(keys), "left")
    ok = F.col("valid_")
    report = marked.agg(F.count("*").alias("read"), F.count_if(~ok).alias("skipped"), F.count_if(ok & F.col("known_").isNotNull()).alias("known"), F.count_if(ok & F.col("known_").isNull()).alias("new"))
    return marked.filter(ok).select(*rows.columns), report
