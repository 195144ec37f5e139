"""Queries of keyed stores: merges, retention, deletes, differences and fall-back reads over seeded stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilflow.operators import feed, health, store
from vigilflow.plans import seeded
from vigilflow.plans.common import news, with_sql
from vigilflow.plans.seeded import ITEMS_SQL
from vigilflow.registry import query
from vigilflow.session import table
from vigilflow.sources import tables
from vigilflow.sources.news import NEWS_SQL

KEPT = ("fingerprint", "doc_id", "title", "language", "category", "threat_score", "tags", "actionability_level", "actionability_score", "source_credibility_score", "source_tier", "affected_platforms", "audience_targets", "published_at")


def _old(spark, sf_dir):
    """Two thirds of the items are stored already."""
    return seeded.items(spark, sf_dir).filter("doc_id % 3 <> 0").select(*KEPT)


def _new(spark, sf_dir):
    """Half of the items come again, with other scores, tags and classes."""
    d = F.col("doc_id")
    rows = seeded.items(spark, sf_dir).filter(d % 2 == 0).select(*KEPT)
    return rows.withColumns({"threat_score": (d * 13 % 101).cast("double"), "tags": F.array(F.concat(F.lit("t"), (d % 4).cast("string")), F.lit("new")), "category": F.lit("scam"), "actionability_score": d % 83 / 83.0})


STORES_SQL = f"""{ITEMS_SQL},
old AS (SELECT {', '.join(KEPT)} FROM items WHERE doc_id % 3 <> 0),
fresh AS (SELECT {', '.join(KEPT)} REPLACE (CAST(doc_id * 13 % 101 AS DOUBLE) AS threat_score, ['t' || (doc_id % 4), 'new'] AS tags, 'scam' AS category, doc_id % 83 / 83.0::DOUBLE AS actionability_score) FROM items WHERE doc_id % 2 = 0)""".replace(f"SELECT {', '.join(KEPT)} REPLACE", "SELECT * REPLACE")
_TAGS = "array_to_string(list_sort(list_distinct(list_concat(coalesce(o.tags, []), coalesce(n.tags, [])))), '|') AS tags"
def tags():
    return F.array_join("tags", "|").alias("tags")



@query("new_items_antijoin", with_sql(STORES_SQL, "SELECT fingerprint, doc_id FROM fresh WHERE fingerprint NOT IN (SELECT fingerprint FROM old)"))
def new_items_antijoin(spark, sf_dir):
    return store.fresh(_new(spark, sf_dir), _old(spark, sf_dir)).select("fingerprint", "doc_id")


@query("upsert_merge_file", with_sql(STORES_SQL, f"SELECT fingerprint, coalesce(o.category, n.category) AS category, greatest(o.threat_score, n.threat_score) AS threat_score, {_TAGS}, o.fingerprint IS NULL AS is_new FROM old o FULL JOIN fresh n USING (fingerprint)"))
def upsert_merge_file(spark, sf_dir):
    return store.merge_file(_old(spark, sf_dir), _new(spark, sf_dir)).select("fingerprint", "category", "threat_score", tags(), "is_new")


def _d():
    return F.col("doc_id")


def _wide(rows, again: bool):
    """SEEDED: the other columns of the database's items; those that come again have other values, and nulls among them."""
    shift = 1 if again else 0
    return rows.withColumns({
        "url": F.lit("https://news.test/"), "source": F.lit(f"source {shift}"), "raw_content": F.concat(F.lit(f"body {shift} of "), _d().cast("string")), "original_language": F.when(_d() % 5 == shift, F.lit(None)).otherwise(f"l{shift}"),
        "category_confidence": (_d() % 7 + shift) / 8.0, "audience_relevance_score": F.when(_d() % 9 == shift, F.lit(None)).otherwise((_d() % 11 + shift) / 12.0),
        "fetched_at": F.to_timestamp(F.lit(f"2024-01-0{shift + 1}")), "corroborating_sources": F.array(F.concat(F.lit("s"), (_d() % 3 + shift).cast("string")), F.lit("s9")),
    })


def _wide_sql(again: bool) -> str:
    shift = 1 if again else 0
    return f"""'https://news.test/' AS url, 'source {shift}' AS source, 'body {shift} of ' || doc_id AS raw_content, CASE WHEN doc_id % 5 = {shift} THEN NULL ELSE 'l{shift}' END AS original_language, (doc_id % 7 + {shift}) / 8.0::DOUBLE AS category_confidence,
  CASE WHEN doc_id % 9 = {shift} THEN NULL ELSE (doc_id % 11 + {shift}) / 12.0::DOUBLE END AS audience_relevance_score, TIMESTAMP '2024-01-0{shift + 1}' AS fetched_at, ['s' || (doc_id % 3 + {shift}), 's9'] AS corroborating_sources"""


_LATEST_SQL = ", ".join(f"CASE WHEN n.fingerprint IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in store.LATEST if c not in ("affected_platforms", "audience_targets"))
_KEEP_SQL = ", ".join(f"CASE WHEN o.fingerprint IS NOT NULL THEN o.{c} ELSE n.{c} END AS {c}" for c in ("source", "url", "published_at"))
_GREATEST_SQL = ", ".join(f"greatest(o.{c}, n.{c}) AS {c}" for c in store.GREATEST)


def _union_sql(c: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_concat(coalesce(o.{c}, []), coalesce(n.{c}, [])))), '|') AS {c}"


@query("upsert_merge_db", with_sql(STORES_SQL, f""", o AS (SELECT {', '.join(KEPT)}, {_wide_sql(False)} FROM old), n AS (SELECT {', '.join(KEPT)}, {_wide_sql(True)} FROM fresh)
  SELECT coalesce(o.fingerprint, n.fingerprint) AS fingerprint, {_LATEST_SQL}, {_KEEP_SQL}, {_GREATEST_SQL}, {_union_sql('tags')}, {_union_sql('corroborating_sources')},
    array_to_string(CASE WHEN n.fingerprint IS NOT NULL THEN n.affected_platforms ELSE o.affected_platforms END, '|') AS affected_platforms, array_to_string(CASE WHEN n.fingerprint IS NOT NULL THEN n.audience_targets ELSE o.audience_targets END, '|') AS audience_targets
  FROM o FULL JOIN n ON o.fingerprint = n.fingerprint"""))
def upsert_merge_db(spark, sf_dir):
    """All columns of the database's upsert, each by its rule."""
    rows = store.merge_database(_wide(_old(spark, sf_dir), False), _wide(_new(spark, sf_dir), True)).drop("doc_id")
    return rows.withColumns({c: F.array_join(c, "|") for c in ("tags", "corroborating_sources", "affected_platforms", "audience_targets")})


_NOW = "2024-02-01 00:00:00"


def _again(spark, sf_dir):
    """SEEDED: posts of even ids come again, those of doc_id mod 6 = 0 in a locale that is new."""
    rows = seeded.posts(spark, sf_dir).filter(_d() % 2 == 0).select("fingerprint", "doc_id", "locale", F.concat(F.lit("Again: "), F.col("title")).alias("title"), "threat_level")
    return rows.withColumn("locale", F.when(_d() % 6 == 0, F.concat(F.lit("x"), F.col("locale"))).otherwise(F.col("locale")))


_AGAIN_SQL = "again AS (SELECT fingerprint, doc_id, CASE WHEN doc_id % 6 = 0 THEN 'x' || locale ELSE locale END AS locale, 'Again: ' || title AS title, threat_level FROM posts WHERE doc_id % 2 = 0)"


@query("upsert_posts", with_sql(ITEMS_SQL, f""", {_AGAIN_SQL}, u AS (SELECT fingerprint, locale, title, threat_level, TIMESTAMP '{_NOW}' AS updated_at, 1 AS age FROM again
  UNION ALL SELECT fingerprint, locale, title, threat_level, TIMESTAMP '2024-01-15', 0 FROM posts) SELECT fingerprint, locale, arg_max(title, age) AS title, arg_max(threat_level, age) AS threat_level, max(updated_at) AS updated_at FROM u GROUP BY 1, 2"""))
def upsert_posts(spark, sf_dir):
    """Posts by fingerprint and locale: the newest wins and is marked as updated."""
    old = seeded.posts(spark, sf_dir).select("fingerprint", "locale", "title", "threat_level").withColumn("updated_at", F.to_timestamp(F.lit("2024-01-15")))
    return store.merge_posts(old, _again(spark, sf_dir), F.to_timestamp(F.lit(_NOW)))


@query("posts_diff", with_sql(ITEMS_SQL, f""", {_AGAIN_SQL} SELECT fingerprint, locale, CASE WHEN p.title IS NULL THEN 'right' WHEN a.title IS NULL THEN 'left' WHEN p.title <> a.title OR p.threat_level <> a.threat_level THEN 'differs' ELSE 'both' END AS side FROM posts p FULL JOIN again a USING (fingerprint, locale)"""))
def posts_diff(spark, sf_dir):
    """Two post stores compared by both keys, and by their fields where both hold a post."""
    left, right, keys = seeded.posts(spark, sf_dir).select("fingerprint", "locale", "title", "threat_level"), _again(spark, sf_dir).drop("doc_id"), ["fingerprint", "locale"]
    differing = store.field_difference(left, right, keys).select(*keys, F.lit(True).alias("_d")).distinct()
    return store.key_difference(left, right, keys).join(differing, keys, "left").select(*keys, F.when(F.col("_d"), "differs").otherwise(F.col("side")).alias("side"))


def _denormal(spark, sf_dir):
    """SEEDED: posts whose copies of their items' columns are right, old (doc_id mod 3 = 1) or missing (doc_id mod 3 = 2)."""
    rows = store.denormalized(seeded.posts(spark, sf_dir).select("fingerprint", "doc_id", "locale"), seeded.items(spark, sf_dir))
    return rows.withColumns({"category": F.when(_d() % 3 == 1, "old").when(_d() % 3 == 0, F.col("category")), "published_at": F.when(_d() % 3 != 2, F.col("published_at"))})


_DENORMAL_SQL = "de AS (SELECT p.fingerprint, p.doc_id, p.locale, CASE WHEN p.doc_id % 3 = 1 THEN 'old' WHEN p.doc_id % 3 = 0 THEN i.category END AS category, CASE WHEN p.doc_id % 3 <> 2 THEN i.published_at END AS published_at, i.actionability_level FROM posts p JOIN items i USING (fingerprint))"


@query("backfill_posts", with_sql(ITEMS_SQL, f""", {_DENORMAL_SQL} SELECT d.fingerprint, d.locale, coalesce(i.category, d.category) AS category, CASE WHEN i.fingerprint IS NULL THEN d.published_at ELSE i.published_at END AS published_at,
  i.fingerprint IS NOT NULL AND (d.category IS DISTINCT FROM i.category OR d.published_at IS DISTINCT FROM i.published_at) AS updated FROM de d LEFT JOIN (SELECT * FROM items WHERE doc_id % 7 <> 0) i USING (fingerprint)"""))
def backfill_posts(spark, sf_dir):
    """Posts take their items' columns where any is distinct; pruned items leave them as they are."""
    return store.backfilled(_denormal(spark, sf_dir), seeded.items(spark, sf_dir).filter(_d() % 7 != 0)).select("fingerprint", "locale", "category", "published_at", "updated")


@query("latest_of_locale", with_sql(ITEMS_SQL, f", {_DENORMAL_SQL} SELECT fingerprint, published_at FROM de WHERE locale = 'ua' ORDER BY published_at DESC NULLS LAST, fingerprint LIMIT 15"))
def latest_of_locale(spark, sf_dir):
    return feed.latest_of_locale(_denormal(spark, sf_dir), "ua").select("fingerprint", "published_at")


@query("backfill_items", with_sql(STORES_SQL, ", r AS (SELECT *, doc_id % 8 <> 0 AS ok, fingerprint IN (SELECT fingerprint FROM old) AS known FROM fresh ORDER BY fingerprint LIMIT 150) SELECT count(*) AS read, count(*) FILTER (WHERE NOT ok) AS skipped, count(*) FILTER (WHERE ok AND known) AS known, count(*) FILTER (WHERE ok AND NOT known) AS new FROM r"))
def backfill_items(spark, sf_dir):
    """A dry run over the first 150 rows (the limit is the feature), a row of doc_id mod 8 = 0 having no title."""
    rows = _new(spark, sf_dir).withColumn("title", F.when(_d() % 8 != 0, F.col("title")))
    return store.backfill(_old(spark, sf_dir), rows, F.col("title").isNotNull(), ("fingerprint",), "fingerprint", limit=150)[1]


@query("post_keys", "SELECT event_id, 'f' || event_id AS fingerprint, CASE event_id % 4 WHEN 2 THEN 'ua' WHEN 1 THEN 'ua' ELSE 'en' END AS locale FROM events")
def post_keys(spark, sf_dir):
    """Cache keys: bare, with a locale, with the old code of Ukrainian."""
    end = F.element_at(F.array(*[F.lit(x) for x in ("", ":uk", ":ua", ":en")]), (F.col("event_id") % 4 + 1).cast("int"))
    keys = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("f"), F.col("event_id").cast("string"), end).alias("key"))
    return tables.post_keys(keys).select(F.regexp_extract("fingerprint", "[0-9]+", 0).cast("long").alias("event_id"), "fingerprint", "locale")


@query("row_codec", with_sql(ITEMS_SQL, "SELECT fingerprint, coalesce(CASE WHEN doc_id % 4 = 0 THEN 'ua' WHEN doc_id % 4 = 1 THEN 'en' END, 'unknown') AS language, CASE WHEN doc_id % 2 = 0 THEN category ELSE 'other' END AS category, CASE WHEN doc_id % 3 = 0 THEN threat_score ELSE 0.0 END AS threat_score, 0 AS n_sources FROM items"))
def row_codec(spark, sf_dir):
    """Stored rows with missing fields and an old language code get their defaults."""
    rows = seeded.items(spark, sf_dir).withColumns({
        "language": F.when(_d() % 4 == 0, "uk").when(_d() % 4 == 1, "en"), "category": F.when(_d() % 2 == 0, F.col("category")), "threat_score": F.when(_d() % 3 == 0, F.col("threat_score")), "original_language": F.lit(None).cast("string"),
        "category_confidence": F.lit(None).cast("double"), "audience_relevance_score": F.lit(None).cast("double"), "corroborating_sources": F.lit(None).cast("array<string>"),
    })
    return tables.with_defaults(rows).select("fingerprint", "language", "category", "threat_score", F.size("corroborating_sources").alias("n_sources"))


@query("pending_migrations", "SELECT DISTINCT p_type AS name FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size = 1)")
def pending_migrations(spark, sf_dir):
    """Names without those that were applied (here: types of parts without those of size 1)."""
    part = table(spark, sf_dir, "part")
    return tables.pending(part.select(F.col("p_type").alias("name")).distinct(), part.filter("p_size = 1").select(F.col("p_type").alias("name")).distinct())


@query("store_sizes", with_sql(ITEMS_SQL, "SELECT 'items' AS store, count(*) AS n FROM items UNION ALL SELECT 'posts', count(*) FROM posts UNION ALL SELECT 'ledger', count(*) FROM ledger"))
def store_sizes(spark, sf_dir):
    parts = [f(spark, sf_dir).agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n") for name, f in (("items", seeded.items), ("posts", seeded.posts), ("ledger", seeded.ledger))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("token_usage", "SELECT 'input_tokens' AS name, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem UNION ALL SELECT 'requests', count(*) FROM orders")
def token_usage(spark, sf_dir):
    """Counters of several calls' usage, added up by name."""
    used = table(spark, sf_dir, "lineitem").select(F.lit("input_tokens").alias("name"), F.col("l_quantity").cast("long").alias("value"))
    return health.merged_counters(used, table(spark, sf_dir, "orders").select(F.lit("requests").alias("name"), F.lit(1).cast("long").alias("value")))


@query("batch_premerge", with_sql(NEWS_SQL, "SELECT fingerprint, max(doc_id) AS doc_id, arg_max(title, doc_id) AS title FROM news GROUP BY 1"))
def batch_premerge(spark, sf_dir):
    return store.premerged(news(spark, sf_dir).select("fingerprint", "doc_id", "title")).select("fingerprint", "doc_id", "title")


@query("retention_topn", with_sql(ITEMS_SQL, "SELECT fingerprint, published_at FROM items ORDER BY published_at DESC, fingerprint LIMIT 200"))
def retention_topn(spark, sf_dir):
    return store.newest(seeded.items(spark, sf_dir), 200).select("fingerprint", "published_at")


@query("keep_newest", with_sql(ITEMS_SQL, "SELECT p.fingerprint, p.locale FROM posts p WHERE p.fingerprint IN (SELECT fingerprint FROM items ORDER BY published_at DESC, fingerprint LIMIT 100)"))
def keep_newest(spark, sf_dir):
    """The posts of the newest 100 items; all others go."""
    return store.only_keys(seeded.posts(spark, sf_dir), store.newest(seeded.items(spark, sf_dir), 100)).select("fingerprint", "locale")


@query("delete_keys", with_sql(ITEMS_SQL, "SELECT fingerprint, locale FROM posts WHERE fingerprint NOT IN (SELECT fingerprint FROM items WHERE doc_id % 10 = 4)"))
def delete_keys(spark, sf_dir):
    return store.without_keys(seeded.posts(spark, sf_dir), seeded.items(spark, sf_dir).filter("doc_id % 10 = 4")).select("fingerprint", "locale")


@query("store_diff_keys", with_sql(STORES_SQL, "SELECT fingerprint, CASE WHEN o.doc_id IS NULL THEN 'right' WHEN n.doc_id IS NULL THEN 'left' ELSE 'both' END AS side FROM old o FULL JOIN fresh n USING (fingerprint)"))
def store_diff_keys(spark, sf_dir):
    return store.key_difference(_old(spark, sf_dir), _new(spark, sf_dir), ["fingerprint"])


@query("store_diff_fields", with_sql(STORES_SQL, """SELECT fingerprint, unnest(list_filter([CASE WHEN abs(o.threat_score - n.threat_score) > 1e-9 THEN 'threat_score' END, CASE WHEN list_sort(o.tags) <> list_sort(n.tags) THEN 'tags' END, CASE WHEN o.category <> n.category THEN 'category' END,
  CASE WHEN abs(o.actionability_score - n.actionability_score) > 1e-9 THEN 'actionability_score' END], lambda x: x IS NOT NULL)) AS field FROM old o JOIN fresh n USING (fingerprint)"""))
def store_diff_fields(spark, sf_dir):
    return store.field_difference(_old(spark, sf_dir), _new(spark, sf_dir), ["fingerprint"])


@query("dual_read", with_sql(STORES_SQL, "SELECT fingerprint, category FROM old UNION ALL SELECT fingerprint, category FROM fresh WHERE fingerprint NOT IN (SELECT fingerprint FROM old)"))
def dual_read(spark, sf_dir):
    return store.read_through(_old(spark, sf_dir), _new(spark, sf_dir)).select("fingerprint", "category")


@query("denormalize_posts", with_sql(ITEMS_SQL, "SELECT p.fingerprint, p.locale, i.published_at, i.category, i.actionability_level FROM posts p LEFT JOIN (SELECT * FROM items WHERE doc_id % 9 <> 0) i USING (fingerprint)"))
def denormalize_posts(spark, sf_dir):
    """Items that were pruned leave nulls."""
    return store.denormalized(seeded.posts(spark, sf_dir), seeded.items(spark, sf_dir).filter("doc_id % 9 <> 0")).select("fingerprint", "locale", "published_at", "category", "actionability_level")


@query("segment_diff", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'left' ELSE 'both' END AS side FROM customer")
def segment_diff(spark, sf_dir):
    """Key difference on a table of many rows: accounts against those up to 5000."""
    c = table(spark, sf_dir, "customer")
    return store.key_difference(c.select("c_custkey"), c.filter("c_acctbal <= 5000").select("c_custkey"), ["c_custkey"])
