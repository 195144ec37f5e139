"""Queries over news rows: text functions, relevance, classification, corroboration, scores and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilflow.functions import editorial as ed
from vigilflow.functions import lexicon as lx
from vigilflow.functions import text as tx
from vigilflow.functions import vocab
from vigilflow.operators import enrich, store
from vigilflow.plans.common import CLASSIFIED_SQL, RELEVANCE_SQL, SCORED_SQL, SIGNALS_SQL, STORIES_SQL, TEXT_SQL, clean_sql, cycle_sql, news, with_sql
from vigilflow.registry import query
from vigilflow.session import spread, table, written
from vigilflow.sources import tables
from vigilflow.streaming import cycle
from vigilflow.sources.news import NEWS_SQL, NOW, hits_sql, language_sql, title_tokens_sql, tokens_sql


def joined(c: str):
    return F.array_join(F.array_sort(c), "|").alias(c)


@query("fingerprint", with_sql(NEWS_SQL, "SELECT doc_id, fingerprint FROM news"))
def fingerprint(spark, sf_dir):
    return news(spark, sf_dir).select("doc_id", "fingerprint")


@query("strip_html", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages")
def strip_html(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages")).select("page_id", tx.strip_html(F.col("html")).alias("body"))


@query("tokens", f"SELECT doc_id, CAST(len({tokens_sql('text')}) AS BIGINT) AS n_tokens, list_aggregate(list_sort({tokens_sql('text')}), 'string_agg', ' ') AS tokens FROM documents")
def tokens(spark, sf_dir):
    toks = tx.tokens(F.col("text"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.size(toks).cast("long").alias("n_tokens"), F.array_join(F.array_sort(toks), " ").alias("tokens"))


@query("title_tokens", with_sql(NEWS_SQL, f"SELECT doc_id, list_aggregate(list_sort({title_tokens_sql('title')}), 'string_agg', ' ') AS tokens FROM news"))
def title_tokens(spark, sf_dir):
    return news(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(tx.title_tokens(F.col("title"))), " ").alias("tokens"))


@query("normalize_news", with_sql(NEWS_SQL, f"SELECT doc_id, title, raw_content, language, language AS original_language FROM (SELECT * REPLACE ({language_sql('(title || chr(10) || raw_content)')} AS language) FROM {clean_sql('news')})"))
def normalize_news(spark, sf_dir):
    """Title and body as the cycle cleans them, and the language that is then found."""
    return tx.normalized_news(news(spark, sf_dir)).select("doc_id", "title", "raw_content", "language", "original_language")


@query("detect_language", with_sql(NEWS_SQL, f"SELECT doc_id, {language_sql('title')} AS title_language, language FROM news"))
def detect_language(spark, sf_dir):
    return news(spark, sf_dir).select("doc_id", tx.detect_language(F.col("title")).alias("title_language"), "language")


@query("keyword_hits", with_sql(TEXT_SQL, "SELECT doc_id, " + ", ".join(f"CAST({hits_sql(getattr(vocab, n.upper()))} AS BIGINT) AS {n}" for n in ("strong", "medium", "weak", "negative")) + " FROM news_t"))
def keyword_hits(spark, sf_dir):
    rows = enrich.with_text(news(spark, sf_dir), enrich.FOR_RELEVANCE)
    return rows.select("doc_id", *[lx.count(F.col("hits"), keys).cast("long").alias(n) for n, keys in zip(("strong", "medium", "weak", "negative"), enrich.RELEVANCE, strict=True)])


def _relevance(spark, sf_dir):
    rows = enrich.with_text(news(spark, sf_dir), enrich.FOR_RELEVANCE)
    return rows.withColumn("score", enrich.relevance_score(F.col("hits")))


@query("relevance_score", with_sql(TEXT_SQL, f"SELECT doc_id, {RELEVANCE_SQL} AS score FROM news_t"))
def relevance_score(spark, sf_dir):
    return _relevance(spark, sf_dir).select("doc_id", "score")


@query("relevance_filter", with_sql(TEXT_SQL, f"SELECT doc_id, title FROM news_t WHERE language <> 'other' AND {RELEVANCE_SQL} >= 3"))
def relevance_filter(spark, sf_dir):
    return enrich.relevant(news(spark, sf_dir), enrich.FOR_RELEVANCE).select("doc_id", "title")


DECIDED_SQL = f"""{TEXT_SQL},
rel AS (SELECT *, {RELEVANCE_SQL} AS score, CASE WHEN doc_id % 5 = 0 THEN doc_id % 2 = 0 END AS cached FROM news_t),
decided AS (SELECT *, CASE WHEN language = 'other' THEN 'language' WHEN score < 1 THEN 'rules-reject' WHEN score >= 5 THEN 'rules-accept' WHEN cached IS NOT NULL THEN 'ai-cached' ELSE 'ai-disabled' END AS path FROM rel),
verdict AS (SELECT *, CASE path WHEN 'rules-accept' THEN true WHEN 'ai-cached' THEN cached WHEN 'ai-disabled' THEN score >= 3 ELSE false END AS is_relevant FROM decided)"""


def _decided(spark, sf_dir):
    """The verdict cache is seeded: one for every fifth row."""
    cached = F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") % 2 == 0)
    rows = _relevance(spark, sf_dir).withColumn("cached", cached)
    rows = rows.withColumn("path", enrich.decision(F.col("language"), F.col("score"), F.col("cached")))
    return rows.withColumn("is_relevant", enrich.accepted(F.col("path"), F.col("score"), F.col("cached")))


@query("relevance_decision", with_sql(DECIDED_SQL, "SELECT doc_id, path, score, is_relevant FROM verdict"))
def relevance_decision(spark, sf_dir):
    return _decided(spark, sf_dir).select("doc_id", "path", "score", "is_relevant")


@query("filter_stats", with_sql(DECIDED_SQL, "SELECT path, is_relevant, count(*) AS n FROM verdict GROUP BY ALL"))
def filter_stats(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy("path", "is_relevant").agg(F.count("*").alias("n"))


@query("classify_category", with_sql(CLASSIFIED_SQL, "SELECT doc_id, category, round(category_confidence, 6) AS category_confidence FROM classified"))
def classify_category(spark, sf_dir):
    rows = enrich.with_text(news(spark, sf_dir), enrich.FOR_CATEGORY).withColumn("c", enrich.category(F.col("hits")))
    return rows.select("doc_id", "c.category", F.round("c.category_confidence", 6).alias("category_confidence"))


@query("extract_platforms", with_sql(CLASSIFIED_SQL, "SELECT doc_id, array_to_string(affected_platforms, '|') AS affected_platforms FROM classified"))
def extract_platforms(spark, sf_dir):
    return enrich.with_text(news(spark, sf_dir), enrich.FOR_PLATFORMS).select("doc_id", F.array_join(enrich.platforms(F.col("hits")), "|").alias("affected_platforms"))


@query("classify_audience", with_sql(CLASSIFIED_SQL, "SELECT doc_id, array_to_string(audience_targets, '|') AS audience_targets, round(audience_relevance_score, 6) AS audience_relevance_score FROM classified"))
def classify_audience(spark, sf_dir):
    return enrich.classified(news(spark, sf_dir)).select("doc_id", joined("audience_targets"), F.round("audience_relevance_score", 6).alias("audience_relevance_score"))


@query("actionability", with_sql(CLASSIFIED_SQL, "SELECT doc_id, actionability_level, round(actionability_score, 6) AS actionability_score FROM classified"))
def actionability(spark, sf_dir):
    return enrich.classified(news(spark, sf_dir)).select("doc_id", "actionability_level", F.round("actionability_score", 6).alias("actionability_score"))


@query("cross_source_bonus", with_sql(f"{NEWS_SQL}, {STORIES_SQL}", "SELECT n.doc_id, count(w.other) AS n_sources, CASE WHEN count(w.other) > 0 THEN round(20.0 * (1.0 - exp(-0.6::DOUBLE * count(w.other))), 6) ELSE 0.0 END AS bonus FROM news n LEFT JOIN wide w USING (doc_id) GROUP BY 1"))
def cross_source_bonus(spark, sf_dir):
    rows = enrich.corroboration(news(spark, sf_dir))
    return rows.select("doc_id", "n_sources", F.round(enrich.bonus(F.col("n_sources")), 6).alias("bonus"))


@query("corroboration", with_sql(f"{NEWS_SQL}, {STORIES_SQL}", "SELECT n.doc_id, coalesce(string_agg(t.other, '|' ORDER BY t.first, t.other), '') AS corroborating_sources FROM news n LEFT JOIN trusted t USING (doc_id) GROUP BY 1"))
def corroboration(spark, sf_dir):
    return enrich.corroboration(news(spark, sf_dir)).select("doc_id", F.array_join("corroborating_sources", "|").alias("corroborating_sources"))


@query("credibility", with_sql(SCORED_SQL, "SELECT doc_id, source_tier, round(source_credibility_score, 6) AS source_credibility_score FROM scored"))
def credibility(spark, sf_dir):
    return enrich.scored(news(spark, sf_dir), NOW).select("doc_id", "source_tier", F.round("source_credibility_score", 6).alias("source_credibility_score"))


@query("threat_score", with_sql(SCORED_SQL, "SELECT doc_id, round(threat_score, 6) AS threat_score FROM scored"))
def threat_score(spark, sf_dir):
    return enrich.scored(news(spark, sf_dir), NOW).select("doc_id", F.round("threat_score", 6).alias("threat_score"))


@query("signals", with_sql(CLASSIFIED_SQL, f"SELECT doc_id, {SIGNALS_SQL} FROM classified"))
def signals(spark, sf_dir):
    return enrich.signals(enrich.classified(news(spark, sf_dir))).select("doc_id", *enrich.SIGNALS)


_IMPACT = ", ".join(f"CASE WHEN {f} THEN '{label}' END" for f, label in vocab.IMPACT_EN)


@query("potential_impact", with_sql(CLASSIFIED_SQL, f"SELECT doc_id, array_to_string(list_filter([{_IMPACT}], lambda x: x IS NOT NULL)[1:3], '|') AS impact FROM (SELECT doc_id, {SIGNALS_SQL} FROM classified)"))
def potential_impact(spark, sf_dir):
    return enrich.signals(enrich.classified(news(spark, sf_dir))).select("doc_id", F.array_join(enrich.potential_impact(), "|").alias("impact"))


def _label_sql(labels: dict, names: str) -> str:
    keys, values = list(labels), list(labels.values())
    from vigilflow.sources.news import array_sql

    return f"list_filter(list_transform({names}, lambda p: {array_sql(values)}[list_position({array_sql(keys)}, p)]), lambda x: x IS NOT NULL)[1]"


@query(
    "who_should_care",
    with_sql(
        CLASSIFIED_SQL,
        f"""SELECT doc_id, coalesce({_label_sql(vocab.PLATFORM_LABELS_EN, 'list_transform(affected_platforms, lambda p: lower(p))')}, {_label_sql(vocab.AUDIENCE_LABELS_EN, 'audience_targets')},
    CASE WHEN enterprise_risk THEN 'Enterprise IT teams' WHEN consumer_risk THEN 'Everyday internet users' ELSE 'Cybersecurity professionals' END) AS label
  FROM (SELECT *, {SIGNALS_SQL} FROM classified)""",
    ),
)
def who_should_care(spark, sf_dir):
    return enrich.signals(enrich.classified(news(spark, sf_dir))).select("doc_id", enrich.who_should_care().alias("label"))


FEED_WORDS = lx.lexicon(*enrich.RELEVANCE, *enrich.CATEGORIES.values())


@query("feed_by_category", with_sql(CLASSIFIED_SQL, f"SELECT doc_id, title, category, published_at FROM classified WHERE language <> 'other' AND {RELEVANCE_SQL} >= 3 ORDER BY published_at DESC, doc_id LIMIT 50"))
def feed_by_category(spark, sf_dir):
    """Flagship: the newest relevant stories with their categories."""
    rows = enrich.relevant(news(spark, sf_dir), FEED_WORDS).withColumn("c", enrich.category(F.col("hits")))
    return rows.select("doc_id", "title", "c.category", "published_at").orderBy(F.desc("published_at"), "doc_id").limit(50)


_KNOWN_SQL = "SELECT fingerprint FROM fetched WHERE doc_id % 4 = 1"
CYCLE_SQL = cycle_sql(_KNOWN_SQL)


def _stored(rows):
    """SEEDED: a store that knows the fingerprints of the rows of doc_id mod 4 = 1, by the smallest id of each."""
    d = F.col("doc_id")
    known = rows.filter("doc_id % 4 = 1").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.min_by("title", "doc_id").alias("title"))
    return known.select("fingerprint", "doc_id", "title", F.lit("other").alias("category"), F.lit("unverified").alias("source_tier"), (d * 7 % 101).cast("double").alias("threat_score"), F.array(F.lit("stored")).alias("tags"))


def _cycle(spark, sf_dir):
    """(stored rows, scored new rows): anti-join, normalise, filter, then classify, corroborate and score what is left."""
    rows = news(spark, sf_dir)
    known = _stored(rows)
    return known, cycle.enriched(store.fresh(rows, known), NOW, lambda kept: written(kept, "cycle"))


@query("ingest_cycle", with_sql(CYCLE_SQL, "SELECT doc_id, fingerprint, title, category, source_tier, actionability_level, round(source_credibility_score, 6) AS source_credibility_score, round(threat_score, 6) AS threat_score FROM scored"))
def ingest_cycle(spark, sf_dir):
    """The new rows of one cycle, in the order of its stages; rows that repeat a new fingerprint all stay."""
    _, rows = _cycle(spark, sf_dir)
    return rows.select("doc_id", "fingerprint", "title", "category", "source_tier", "actionability_level", F.round("source_credibility_score", 6).alias("source_credibility_score"), F.round("threat_score", 6).alias("threat_score"))


@query("ingest_cycle_store", with_sql(CYCLE_SQL, """
  SELECT fingerprint, arg_min(title, doc_id) AS title, arg_min(category, doc_id) AS category, arg_min(source_tier, doc_id) AS source_tier, round(max(threat_score), 6) AS threat_score, is_new
  FROM (SELECT fingerprint, doc_id, title, category, source_tier, threat_score, true AS is_new FROM scored
    UNION ALL SELECT fingerprint, doc_id, title, 'other', 'unverified', CAST(doc_id * 7 % 101 AS DOUBLE), false FROM fetched f WHERE doc_id % 4 = 1 AND doc_id = (SELECT min(doc_id) FROM fetched g WHERE g.fingerprint = f.fingerprint AND g.doc_id % 4 = 1)) GROUP BY fingerprint, is_new"""))
def ingest_cycle_store(spark, sf_dir):
    """The store after the cycle: its rows and the new ones, merged."""
    known, rows = _cycle(spark, sf_dir)
    merged = store.merge_file(known, rows.select("fingerprint", "doc_id", "title", "category", "source_tier", "threat_score", "tags"))
    return merged.select("fingerprint", "title", "category", "source_tier", F.round("threat_score", 6).alias("threat_score"), "is_new")


_PUBLIC_SQL = """fingerprint, title, source, url, strftime(published_at, '%Y-%m-%dT%H:%M:%S+00:00') AS published_at, raw_content, round(threat_score, 3) AS threat_score, language, language AS original_language, category,
  round(category_confidence, 3) AS category_confidence, array_to_string(affected_platforms, '|') AS affected_platforms, array_to_string(audience_targets, '|') AS audience_targets, round(audience_relevance_score, 3) AS audience_relevance_score,
  actionability_level, round(actionability_score, 3) AS actionability_score, source_tier, round(source_credibility_score, 3) AS source_credibility_score, array_to_string(corroborating_sources, '|') AS corroborating_sources"""
_LISTS = ("affected_platforms", "audience_targets", "corroborating_sources")


def _of_cycle(spark, sf_dir):
    """The cycle's rows, one a fingerprint, as the store takes them in: all columns of an item."""
    known, rows = _cycle(spark, sf_dir)
    return store.merge_file(rows.limit(0).select("doc_id", *cycle.COLUMNS), rows).drop("is_new")


_STORED_SQL = f"""{CYCLE_SQL},
stored AS (SELECT * REPLACE (max(threat_score) OVER (PARTITION BY fingerprint) AS threat_score), list_sort(list_distinct(list(category) OVER (PARTITION BY fingerprint))) AS tags FROM scored QUALIFY doc_id = min(doc_id) OVER (PARTITION BY fingerprint))"""


@query("cycle_public_items", with_sql(_STORED_SQL, f"SELECT {_PUBLIC_SQL} FROM stored"))
def cycle_public_items(spark, sf_dir):
    """All 18 public fields of the items that a cycle stores."""
    rows = _of_cycle(spark, sf_dir).select("fingerprint", *ed.public())
    return rows.withColumns({c: F.array_join(c, "|") for c in _LISTS})


@query("cycle_stored_json", with_sql(_STORED_SQL, f"SELECT {_PUBLIC_SQL}, CAST(extract('day' FROM TIMESTAMP '{NOW}') AS INTEGER) AS fetched_day, array_to_string(tags, '|') AS tags FROM stored"))
def cycle_stored_json(spark, sf_dir):
    """Items of a cycle as JSON text and back through the schema of the store: all 21 fields."""
    items = _of_cycle(spark, sf_dir).select(F.to_json(F.struct(*cycle.COLUMNS)).alias("value"))
    rows, _ = tables.parse_log(items, tables.ITEM)
    rows = tables.with_defaults(rows).select("fingerprint", *ed.public(), F.dayofmonth("fetched_at").alias("fetched_day"), F.array_join("tags", "|").alias("tags"))
    return rows.withColumns({c: F.array_join(c, "|") for c in _LISTS})
