"""Items, posts and a ledger for stores and feeds: SEEDED from the documents by functions of doc_id, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilflow.functions import vocab
from vigilflow.functions.text import literal_array
from vigilflow.plans.common import news, one_per_fingerprint
from vigilflow.session import once
from vigilflow.sources.news import NEWS_SQL, array_sql

CATEGORIES = (*vocab.CATEGORIES, "other")
LEVELS = ("urgent_action", "recommended_action", "informational")
TIERS = ("trusted", "verified", "unverified")
THREAT = ("Critical", "High", "Medium", "Low")
PLATFORMS = tuple(vocab.PLATFORMS)
AUDIENCES = tuple(vocab.AUDIENCES)
UA_TITLES = ("Нова загроза для банків", "A headline that nobody translated")


@once
def items(spark, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    pick = lambda values, i: F.element_at(literal_array(values), (i % len(values) + 1).cast("int"))
    rows = one_per_fingerprint(news(spark, sf_dir))
    return rows.select(
        "fingerprint", "doc_id", "title", "source", "published_at", "raw_content",
        F.when(d % 11 == 0, "ua").when(d % 13 == 0, F.lit(None)).otherwise("en").alias("language"),
        (d * 7 % 101).cast("double").alias("threat_score"), pick(CATEGORIES, d).alias("category"), pick(LEVELS, d).alias("actionability_level"),
        (d % 97 / 97.0).alias("actionability_score"), (d % 89 / 89.0).alias("source_credibility_score"), pick(TIERS, F.floor(d / 2)).alias("source_tier"),
        F.array_sort(F.array_distinct(F.array(pick(PLATFORMS, d), pick(PLATFORMS, d * 5 + 1)))).alias("affected_platforms"), F.array(pick(AUDIENCES, d)).alias("audience_targets"),
        F.array(F.concat(F.lit("t"), (d % 5).cast("string"))).alias("tags"),
    )


@once
def posts(spark, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = items(spark, sf_dir).withColumn("locale", F.explode(F.array(F.lit("en"), F.lit("ua")))).filter(F.when(F.col("locale") == "en", d % 3 != 0).otherwise(d % 4 == 0))
    pick = lambda values, i: F.element_at(literal_array(values), (i % len(values) + 1).cast("int"))
    title = F.when(F.col("locale") == "en", F.col("title")).otherwise(pick(UA_TITLES, F.floor(d / 4)))
    summary = F.when(F.col("locale") == "en", F.concat(F.lit("Summary <"), F.col("doc_id").cast("string"), F.lit("> of CVE-2024-12345 & more"))).otherwise("Короткий опис події")
    return rows.select(
        "fingerprint", "doc_id", "locale", title.alias("title"), summary.alias("short_summary"), pick(THREAT, d).alias("threat_level"),
        F.when(d % 2 == 0, F.array(F.lit("Update now"), F.lit("Reset passwords"))).otherwise(F.array().cast("array<string>")).alias("what_to_do"), F.when(d % 5 == 0, "llm").otherwise("rule_based").alias("generated_by"),
    )


@once
def ledger(spark, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).filter("doc_id % 7 = 0").select("fingerprint", "locale")


def _pick(values, i: str) -> str:
    return f"{array_sql(values)}[({i}) % {len(values)} + 1]"


ITEMS_SQL = f"""{NEWS_SQL},
items AS (SELECT fingerprint, doc_id, title, source, published_at, raw_content, CASE WHEN doc_id % 11 = 0 THEN 'ua' WHEN doc_id % 13 = 0 THEN NULL ELSE 'en' END AS language,
  CAST(doc_id * 7 % 101 AS DOUBLE) AS threat_score, {_pick(CATEGORIES, 'doc_id')} AS category, {_pick(LEVELS, 'doc_id')} AS actionability_level,
  doc_id % 97 / 97.0::DOUBLE AS actionability_score, doc_id % 89 / 89.0::DOUBLE AS source_credibility_score, {_pick(TIERS, 'doc_id // 2')} AS source_tier,
  list_sort(list_distinct([{_pick(PLATFORMS, 'doc_id')}, {_pick(PLATFORMS, 'doc_id * 5 + 1')}])) AS affected_platforms, [{_pick(AUDIENCES, 'doc_id')}] AS audience_targets, ['t' || (doc_id % 5)] AS tags
  FROM news WHERE doc_id IN (SELECT min(doc_id) FROM news GROUP BY fingerprint)),
posts AS (SELECT fingerprint, doc_id, locale, CASE WHEN locale = 'en' THEN title ELSE {_pick(UA_TITLES, 'doc_id // 4')} END AS title,
  CASE WHEN locale = 'en' THEN 'Summary <' || doc_id || '> of CVE-2024-12345 & more' ELSE 'Короткий опис події' END AS short_summary, {_pick(THREAT, 'doc_id')} AS threat_level,
  CASE WHEN doc_id % 2 = 0 THEN ['Update now', 'Reset passwords'] ELSE [] END AS what_to_do, CASE WHEN doc_id % 5 = 0 THEN 'llm' ELSE 'rule_based' END AS generated_by
  FROM items, (VALUES ('en'), ('ua')) l(locale) WHERE CASE WHEN locale = 'en' THEN doc_id % 3 <> 0 ELSE doc_id % 4 = 0 END),
ledger AS (SELECT fingerprint, locale FROM posts WHERE doc_id % 7 = 0)"""
