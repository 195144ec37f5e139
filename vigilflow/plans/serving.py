"""Queries of feeds, facets, publishing, rendering and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilflow.operators import enrich, feed, health, render
from vigilflow.functions import text as tx
from vigilflow.plans import seeded
from vigilflow.plans.common import CLASSIFIED_SQL, SCORED_SQL, SIGNALS_SQL, clean_sql, news, with_sql
from vigilflow.plans.seeded import ITEMS_SQL
from vigilflow.registry import query
from vigilflow.session import spread, table, written_text
from vigilflow.sources import tables
from vigilflow.sources.news import NEWS_SQL, NOW, array_sql, quoted

LEVEL_SQL = "CASE {} WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"
_CYR, _LAT = "length(regexp_replace({0}, '[^\\x{{0400}}-\\x{{04FF}}]', '', 'g'))", "length(regexp_replace({0}, '[^A-Za-z\\x{{00C0}}-\\x{{024F}}]', '', 'g'))"


def wrong_script_sql(text: str, locale: str) -> str:
    c, l = _CYR.format(text), _LAT.format(text)
    return f"({c} + {l} >= 4 AND CASE {locale} WHEN 'ua' THEN {c} WHEN 'en' THEN {l} END / ({c} + {l}) < 0.30)"


GATE = {"en": "coalesce(nullif(language, ''), 'en') = 'en'", "ua": "coalesce(nullif(language, ''), 'en') IN ('en', 'ua')"}


def _feed_sql(locale: str) -> str:
    return with_sql(ITEMS_SQL, f"""SELECT fingerprint, post_title, threat_level, published_at FROM (
  SELECT i.*, p.title AS post_title, p.threat_level FROM items i JOIN posts p ON i.fingerprint = p.fingerprint AND p.locale = '{locale}' WHERE {GATE[locale]}
  ORDER BY published_at DESC, fingerprint LIMIT 30) WHERE NOT {wrong_script_sql('post_title', f"'{locale}'")}""")


@query("feed_posts_en", _feed_sql("en"))
def feed_posts_en(spark, sf_dir):
    return feed.feed(seeded.items(spark, sf_dir), seeded.posts(spark, sf_dir), "en").select("fingerprint", "post_title", "threat_level", "published_at")


@query("feed_posts_ua", _feed_sql("ua"))
def feed_posts_ua(spark, sf_dir):
    return feed.feed(seeded.items(spark, sf_dir), seeded.posts(spark, sf_dir), "ua").select("fingerprint", "post_title", "threat_level", "published_at")


@query("trending_posts", with_sql(ITEMS_SQL, f"""SELECT pool.fingerprint, p.threat_level, actionability_score FROM (
  SELECT * FROM items WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND {GATE['en']} ORDER BY threat_score DESC, actionability_score DESC, published_at DESC, fingerprint LIMIT 30) pool
  JOIN posts p ON p.fingerprint = pool.fingerprint AND p.locale = 'en' ORDER BY {LEVEL_SQL.format('p.threat_level')} DESC, actionability_score DESC, published_at DESC, pool.fingerprint LIMIT 5"""))
def trending_posts(spark, sf_dir):
    return feed.trending(seeded.items(spark, sf_dir), seeded.posts(spark, sf_dir), "en", NOW).select("fingerprint", "threat_level", "actionability_score")


@query("latest_posts", with_sql(ITEMS_SQL, "SELECT fingerprint, title, published_at FROM items ORDER BY published_at DESC, fingerprint LIMIT 15"))
def latest_posts(spark, sf_dir):
    return seeded.items(spark, sf_dir).orderBy(F.desc("published_at"), "fingerprint").limit(15).select("fingerprint", "title", "published_at")


@query("post_by_id", with_sql(ITEMS_SQL, "SELECT fingerprint, title FROM items WHERE fingerprint = substr(sha256('https://news.test/42'), 1, 16)"))
def post_by_id(spark, sf_dir):
    key = F.substring(F.sha2(F.lit("https://news.test/42").cast("binary"), 256), 1, 16)
    return seeded.items(spark, sf_dir).filter(F.col("fingerprint") == key).select("fingerprint", "title")


@query("feed_health", with_sql(ITEMS_SQL, f"""SELECT count(*) AS total, max(published_at) AS newest, max(CASE WHEN actionability_level = 'urgent_action' THEN published_at END) AS newest_urgent,
  date_diff('second', max(published_at), TIMESTAMP '{NOW}') // 60 AS minutes_since, date_diff('second', max(CASE WHEN actionability_level = 'urgent_action' THEN published_at END), TIMESTAMP '{NOW}') // 60 AS minutes_since_urgent FROM items"""))
def feed_health(spark, sf_dir):
    return feed.health(seeded.items(spark, sf_dir), NOW)


CHOSEN = feed.FilterState(threat_levels=("Critical", "High"), platforms=("Windows", "Android", "Cisco"), query="chrome")


def _covered(spark, sf_dir):
    return feed.covered(seeded.items(spark, sf_dir), seeded.posts(spark, sf_dir), "en")


@query("facet_filter", with_sql(ITEMS_SQL, """SELECT i.fingerprint, i.category FROM items i JOIN posts p ON i.fingerprint = p.fingerprint AND p.locale = 'en'
  WHERE p.threat_level IN ('Critical', 'High') AND list_has_any(affected_platforms, ['Windows', 'Android', 'Cisco']) AND contains(lower(p.title), 'chrome')"""))
def facet_filter(spark, sf_dir):
    return _covered(spark, sf_dir).filter(CHOSEN.predicate()).select("fingerprint", "category")


SEARCH = feed.FilterState(query=" Along the Quay case-0\nSummary ")


@query("facet_search", with_sql(ITEMS_SQL, "SELECT i.fingerprint, p.short_summary FROM items i JOIN posts p ON i.fingerprint = p.fingerprint AND p.locale = 'en' WHERE contains(lower(p.title || chr(10) || p.short_summary), 'along the quay case-0' || chr(10) || 'summary')"))
def facet_search(spark, sf_dir):
    """A search that reaches from the title into the summary."""
    return _covered(spark, sf_dir).filter(SEARCH.predicate()).select("fingerprint", "short_summary")


@query("facet_values", with_sql(ITEMS_SQL, "SELECT DISTINCT 'category' AS facet, category AS value FROM items UNION SELECT 'platform', unnest(affected_platforms) FROM items UNION SELECT 'audience', unnest(audience_targets) FROM items"))
def facet_values(spark, sf_dir):
    return feed.facets(seeded.items(spark, sf_dir))


@query("active_threats", with_sql(ITEMS_SQL, "SELECT count(*) AS n FROM items WHERE actionability_level <> 'informational'"))
def active_threats(spark, sf_dir):
    return seeded.items(spark, sf_dir).agg(F.count_if(F.col("actionability_level") != "informational").alias("n"))


@query("related_posts", with_sql(ITEMS_SQL, """, pool AS (SELECT * FROM items ORDER BY published_at DESC, fingerprint LIMIT 20), s AS (
  SELECT a.fingerprint, b.fingerprint AS o_fingerprint, b.published_at, (CASE WHEN a.category = b.category THEN 3 ELSE 0 END) + least(2, len(list_intersect(a.affected_platforms, b.affected_platforms))) + least(2, len(list_intersect(a.audience_targets, b.audience_targets))) AS score
  FROM pool a, pool b WHERE a.fingerprint <> b.fingerprint)
  SELECT fingerprint, o_fingerprint, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY score DESC, published_at DESC, o_fingerprint) AS rank FROM s WHERE score > 0) WHERE rank <= 4"""))
def related_posts(spark, sf_dir):
    """The pool is a page of the newest 20, as a detail page asks for."""
    pool = seeded.items(spark, sf_dir).orderBy(F.desc("published_at"), "fingerprint").limit(20)
    return feed.related(pool)


@query("related_store", with_sql(ITEMS_SQL, """, s AS (
  SELECT a.fingerprint, b.fingerprint AS o_fingerprint, b.published_at, (CASE WHEN a.category = b.category THEN 3 ELSE 0 END) + least(2, len(list_intersect(a.affected_platforms, b.affected_platforms))) + least(2, len(list_intersect(a.audience_targets, b.audience_targets))) AS score
  FROM items a, items b WHERE a.fingerprint <> b.fingerprint)
  SELECT fingerprint, o_fingerprint, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY score DESC, published_at DESC, o_fingerprint) AS rank FROM s WHERE score > 0) WHERE rank <= 4"""))
def related_store(spark, sf_dir):
    """Every item of the store with its most alike ones."""
    return feed.related(seeded.items(spark, sf_dir))


@query("danger_top5", with_sql(ITEMS_SQL, f"SELECT i.fingerprint, p.threat_level FROM items i JOIN posts p ON i.fingerprint = p.fingerprint AND p.locale = 'en' ORDER BY {LEVEL_SQL.format('p.threat_level')} DESC, actionability_score DESC, published_at DESC, i.fingerprint LIMIT 5"))
def danger_top5(spark, sf_dir):
    return feed.danger(_covered(spark, sf_dir)).select("fingerprint", "threat_level")


_GAPS = """, gaps AS (SELECT i.fingerprint, i.published_at, l.locale FROM items i, (VALUES ('en'), ('ua')) l(locale) WHERE (l.locale = 'ua' OR i.language IS DISTINCT FROM 'ua')
  AND NOT EXISTS (SELECT 1 FROM posts p WHERE p.fingerprint = i.fingerprint AND p.locale = l.locale))"""


@query("missing_manifest", with_sql(ITEMS_SQL, _GAPS + " SELECT fingerprint, locale FROM gaps"))
def missing_manifest(spark, sf_dir):
    return feed.missing_manifest(seeded.items(spark, sf_dir), seeded.posts(spark, sf_dir)).select("fingerprint", "locale")


@query("generate_manifest", with_sql(ITEMS_SQL, _GAPS + " SELECT fingerprint, locale FROM gaps WHERE fingerprint IN (SELECT fingerprint FROM (SELECT DISTINCT fingerprint, published_at FROM gaps ORDER BY published_at DESC, fingerprint LIMIT 10))"))
def generate_manifest(spark, sf_dir):
    return feed.missing_manifest(seeded.items(spark, sf_dir), seeded.posts(spark, sf_dir), most_items=10).select("fingerprint", "locale")


OUTCOMES_SQL = f"""{ITEMS_SQL},
outcomes AS (SELECT i.fingerprint, i.published_at, l.locale, CASE WHEN g.fingerprint IS NOT NULL THEN 'already' WHEN p.title IS NULL THEN 'uncached'
  WHEN NOT ({LEVEL_SQL.format('p.threat_level')} >= 3 OR i.actionability_level = 'urgent_action') THEN 'filtered'
  WHEN trim(p.title) = '' OR {wrong_script_sql('p.title', 'l.locale')} OR {wrong_script_sql('p.short_summary', 'l.locale')} THEN 'invalid' ELSE 'sent' END AS outcome
  FROM items i CROSS JOIN (VALUES ('en'), ('ua')) l(locale) LEFT JOIN ledger g ON g.fingerprint = i.fingerprint AND g.locale = l.locale LEFT JOIN posts p ON p.fingerprint = i.fingerprint AND p.locale = l.locale
  WHERE i.source_tier IN ('trusted', 'verified') AND CASE WHEN l.locale = 'en' THEN {GATE['en']} ELSE {GATE['ua']} END)"""


def _outcomes(spark, sf_dir):
    return feed.publish_outcomes(seeded.items(spark, sf_dir), seeded.posts(spark, sf_dir), seeded.ledger(spark, sf_dir))


def _script_reason_sql(what: str) -> str:
    return f"'{what} in wrong script for ' || chr(39) || locale || chr(39)"


@query("quality_problem", with_sql(ITEMS_SQL, f"""SELECT fingerprint, locale, CASE WHEN t IS NULL THEN 'no ' || chr(39) || locale || chr(39) || ' translation' WHEN trim(t) = '' THEN 'empty title' WHEN {wrong_script_sql('trim(t)', 'locale')} THEN {_script_reason_sql('title')}
  WHEN trim(s) <> '' AND {wrong_script_sql('trim(s)', 'locale')} THEN {_script_reason_sql('summary')} END AS reason FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE title END AS t, CASE WHEN doc_id % 7 = 0 THEN 'Зовсім інша мова тут' ELSE short_summary END AS s FROM posts)"""))
def quality_problem(spark, sf_dir):
    """Why posts may not be sent; some lack a translation, a title or the right script."""
    d = F.col("doc_id") % 5
    title, summary = F.when(d == 0, F.lit(None)).when(d == 1, "  ").otherwise(F.col("title")), F.when(F.col("doc_id") % 7 == 0, "Зовсім інша мова тут").otherwise(F.col("short_summary"))
    return seeded.posts(spark, sf_dir).select("fingerprint", "locale", feed.quality_problem(title, summary, F.col("locale")).alias("reason"))


def _preset_sql(name: str, state: feed.FilterState) -> str:
    tests = [f"{c} IN ({', '.join(map(quoted, v))})" for c, v in (("p.threat_level", state.threat_levels), ("category", state.categories)) if v]
    tests += [f"list_has_any({c}, {array_sql(v)})" for c, v in (("affected_platforms", state.platforms), ("audience_targets", state.audiences)) if v]
    return f"SELECT '{name}' AS preset, count(*) AS n FROM items i JOIN posts p ON i.fingerprint = p.fingerprint AND p.locale = 'en' WHERE {' AND '.join(tests) or 'true'}"


@query("preset_counts", with_sql(ITEMS_SQL, " UNION ALL ".join(_preset_sql(n, s) for n, s in feed.PRESETS.items())))
def preset_counts(spark, sf_dir):
    return feed.preset_counts(_covered(spark, sf_dir))


@query("top_threats", with_sql(ITEMS_SQL, "SELECT fingerprint, threat_score FROM items ORDER BY threat_score DESC, fingerprint LIMIT 10"))
def top_threats(spark, sf_dir):
    return feed.top_threats(seeded.items(spark, sf_dir)).select("fingerprint", "threat_score")


_CHIPS = ", ".join(f"CASE WHEN {c} THEN '{c}' END" for c in feed.CHIP_ORDER)


@query("signal_chips", with_sql(CLASSIFIED_SQL, f"SELECT doc_id, array_to_string(list_filter([{_CHIPS}], lambda x: x IS NOT NULL)[1:3], '|') AS chips FROM (SELECT doc_id, {SIGNALS_SQL} FROM classified)"))
def signal_chips(spark, sf_dir):
    return enrich.signals(enrich.classified(news(spark, sf_dir))).select("doc_id", F.array_join(feed.chips(), "|").alias("chips"))


@query("relative_time", """SELECT event_id, CASE WHEN m IS NULL THEN '—' WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN (m // 60) || 'h' ELSE (m // 1440) || 'd' END AS since
  FROM (SELECT event_id, CASE WHEN event_id % 10 <> 9 THEN greatest(0, (epoch_us(TIMESTAMP '2024-01-02') - epoch_us(CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-02' - to_minutes(CAST(event_id % 2000 AS INTEGER)) ELSE ts END)) // 60000000) END AS m FROM events)""")
def relative_time(spark, sf_dir):
    """Times against one day; some are still to come, some are missing."""
    e, now = F.col("event_id"), F.to_timestamp(F.lit("2024-01-02"))
    then = F.when(e % 10 != 9, F.when(e % 3 == 0, now - F.make_dt_interval(F.lit(0), F.lit(0), (e % 2000).cast("int"))).otherwise(F.col("ts")))
    return table(spark, sf_dir, "events").select("event_id", feed.relative_time(then, now).alias("since"))


@query("publish_counts", with_sql(OUTCOMES_SQL, "SELECT locale, outcome, count(*) AS n FROM outcomes GROUP BY 1, 2"))
def publish_counts(spark, sf_dir):
    return _outcomes(spark, sf_dir).groupBy("locale", "outcome").agg(F.count("*").alias("n"))


@query("publish_selection", with_sql(OUTCOMES_SQL, "SELECT locale, fingerprint, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY locale ORDER BY published_at DESC, fingerprint) AS place FROM outcomes WHERE outcome = 'sent') WHERE place <= 5"))
def publish_selection(spark, sf_dir):
    return feed.publish_selection(_outcomes(spark, sf_dir)).select("locale", "fingerprint", "place")


_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_BODY = "regexp_replace(" + _ESC + r", '\b([Cc][Vv][Ee]-[0-9]{{4}}-[0-9]{{4,7}})\b', '<a href=" + '"https://nvd.nist.gov/vuln/detail/\\1">\\1</a>' + "', 'g')"


@query("telegram_message", with_sql(ITEMS_SQL, f"""SELECT fingerprint, locale, concat_ws(chr(10), CASE threat_level WHEN 'Critical' THEN '🔴' WHEN 'High' THEN '🟠' WHEN 'Medium' THEN '🟡' ELSE '🟢' END || ' <b>' || {_BODY.format('trim(title)')} || '</b>',
  '', {_BODY.format('short_summary')}, '', CASE WHEN len(what_to_do) > 0 THEN '✅ ' || what_to_do[1] END,
  '🔗 <a href="https://news.example/' || locale || '/threat/' || fingerprint || '">' || CASE WHEN locale = 'ua' THEN 'Читати більше' ELSE 'Read more' END || '</a>') AS message FROM posts"""))
def telegram_message(spark, sf_dir):
    return seeded.posts(spark, sf_dir).select("fingerprint", "locale", feed.telegram_message().alias("message"))


@query("provenance", with_sql(ITEMS_SQL, "SELECT generated_by, count(*) AS n FROM posts GROUP BY 1"))
def provenance(spark, sf_dir):
    return seeded.posts(spark, sf_dir).groupBy("generated_by").agg(F.count("*").alias("n"))


@query("cache_coverage", with_sql(ITEMS_SQL, "SELECT i.fingerprint, bool_and(p.fingerprint IS NOT NULL) AS complete FROM items i JOIN (VALUES ('en'), ('ua')) l(locale) ON l.locale = 'ua' OR i.language IS DISTINCT FROM 'ua' LEFT JOIN posts p ON p.fingerprint = i.fingerprint AND p.locale = l.locale GROUP BY 1"))
def cache_coverage(spark, sf_dir):
    wanted = seeded.items(spark, sf_dir).select("fingerprint", F.explode(feed.required_locales(F.col("language"))).alias("locale"))
    have = seeded.posts(spark, sf_dir).select("fingerprint", "locale", F.lit(True).alias("have"))
    return wanted.join(have, ["fingerprint", "locale"], "left").groupBy("fingerprint").agg(F.every(F.coalesce("have", F.lit(False))).alias("complete"))


@query("translations", with_sql(ITEMS_SQL, "SELECT i.fingerprint, string_agg(p.locale || '=' || p.title, '|' ORDER BY p.locale) AS translations, max(i.category) AS category FROM items i JOIN posts p USING (fingerprint) GROUP BY 1"))
def translations(spark, sf_dir):
    """Items with their posts as one map by locale, joined to text here."""
    by_locale = seeded.posts(spark, sf_dir).groupBy("fingerprint").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("locale", "title")))).alias("m"))
    text = F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.element_at("m", k))), "|")
    return seeded.items(spark, sf_dir).join(by_locale, "fingerprint").select("fingerprint", text.alias("translations"), "category")


@query("wrong_script", f"SELECT doc_id, {wrong_script_sql('text', chr(39) + 'en' + chr(39))} AS not_en, {wrong_script_sql('text', chr(39) + 'ua' + chr(39))} AS not_ua FROM documents")
def wrong_script(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", tx.wrong_script(F.col("text"), F.lit("en")).alias("not_en"), tx.wrong_script(F.col("text"), F.lit("ua")).alias("not_ua"))


_URGENCY = "CASE WHEN actionability_level = 'urgent_action' THEN {} WHEN actionability_level = 'recommended_action' THEN {} ELSE {} END"


@query("threat_level", with_sql(ITEMS_SQL, "SELECT fingerprint, " + _URGENCY.format("CASE WHEN threat_score >= 50 THEN 'Critical' ELSE 'High' END", "CASE WHEN threat_score >= 50 THEN 'High' ELSE 'Medium' END", "CASE WHEN threat_score >= 30 THEN 'Medium' ELSE 'Low' END") + " AS level, " + _URGENCY.format("'urgent'", "'soon'", "CASE WHEN threat_score >= 50 THEN 'soon' ELSE 'fyi' END") + " AS urgency FROM items"))
def threat_level(spark, sf_dir):
    level, score = F.col("actionability_level"), F.col("threat_score")
    return seeded.items(spark, sf_dir).select("fingerprint", render.threat_level(level, score).alias("level"), render.urgency(level, score).alias("urgency"))


@query("emotional_weight", with_sql(ITEMS_SQL, "SELECT fingerprint, round(greatest(0.0, least(1.0, actionability_score * 0.6::DOUBLE + least(threat_score / 100.0, 1.0) * 0.3::DOUBLE + source_credibility_score * 0.1::DOUBLE)), 6) AS weight FROM items"))
def emotional_weight(spark, sf_dir):
    return seeded.items(spark, sf_dir).select("fingerprint", F.round(render.emotional_weight(F.col("actionability_score"), F.col("threat_score"), F.col("source_credibility_score")), 6).alias("weight"))


_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"


@query("reading_time", f"SELECT doc_id, CAST(greatest(15, least(45, {_WORDS} // 3)) AS INTEGER) AS seconds, CAST(greatest(5, round_even({_WORDS} / 3.0::DOUBLE / 5, 0) * 5) AS INTEGER) AS card_seconds FROM documents")
def reading_time(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", render.reading_seconds(F.col("text")).alias("seconds"), render.card_seconds(F.col("text")).alias("card_seconds"))


POOL = ["Update the app", "Change the password", "Enable two-factor login", "Check bank statements", "Report the message"]


@query("pick_rotation", with_sql(ITEMS_SQL, f"SELECT fingerprint, array_to_string(list_concat({array_sql(POOL)}, {array_sql(POOL)})[o + 1 : o + 3], '|') AS picked FROM (SELECT fingerprint, (('0x' || substr(fingerprint, 1, 8))::BIGINT + 2654435769) % 5 AS o FROM items)"))
def pick_rotation(spark, sf_dir):
    return seeded.items(spark, sf_dir).select("fingerprint", F.array_join(render.rotation(POOL, F.col("fingerprint"), 3, salt=1), "|").alias("picked"))


_FACTS = f"""[CASE WHEN regexp_matches(txt, '\\b(actively\\s+exploited|in\\s+the\\s+wild|under\\s+(active\\s+)?attack)\\b') OR actionability_level = 'urgent_action' THEN 'Actively exploited'
  WHEN regexp_matches(txt, '\\b(patch|fix|update)\\s+(is\\s+)?(available|released|now\\s+available|out)\\b') THEN 'Patch available' END,
  CASE len(affected_platforms) WHEN 0 THEN NULL WHEN 1 THEN 'Affects ' || affected_platforms[1] WHEN 2 THEN 'Affects ' || affected_platforms[1] || ' & ' || affected_platforms[2] ELSE 'Multi-platform' END,
  CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in render.FACT_LABELS.items())} END, CASE WHEN source_tier = 'trusted' AND source_credibility_score >= 0.85 THEN source END]"""


@query("quick_facts", with_sql(SCORED_SQL, f"SELECT doc_id, array_to_string(list_filter({_FACTS}, lambda x: x IS NOT NULL), '|') AS facts FROM scored"))
def quick_facts(spark, sf_dir):
    return enrich.scored(news(spark, sf_dir), NOW).select("doc_id", F.array_join(render.quick_facts(), "|").alias("facts"))


@query("extract_references", with_sql(NEWS_SQL, r"""SELECT doc_id, array_to_string(list_concat(list_transform(u(regexp_extract_all(raw_content, '\bCVE-(\d{4}-\d{4,7})\b', 1)), lambda x: 'cve:CVE-' || x),
  list_transform(u(regexp_extract_all(raw_content, '\bCERT-UA#(\d+)\b', 1)), lambda x: 'cert:CERT-UA#' || x), list_transform(u(regexp_extract_all(raw_content, '\bAA\d{2}-\d{2,3}[A-Za-z]?\b')), lambda x: 'advisory:CISA ' || x),
  list_transform(u(regexp_extract_all(raw_content, '\bADV\d{6}\b')), lambda x: 'vendor:' || x)), '|') AS refs FROM news""".replace("u(", "list_sort(list_distinct(").replace(", 1)), l", ", 1))), l").replace("')), lambda", "'))), lambda")))
def extract_references(spark, sf_dir):
    refs = F.transform(render.references(F.col("raw_content")), lambda r: F.concat(r["type"], F.lit(":"), r["label"]))
    kinds = tx.let(refs, lambda own: F.concat(*[_of_kind(own, k) for k in ("cve:", "cert:", "advisory:", "vendor:")]))
    return news(spark, sf_dir).select("doc_id", F.array_join(kinds, "|").alias("refs"))


def _of_kind(refs, kind: str):
    return F.array_sort(F.filter(refs, lambda r: F.startswith(r, F.lit(kind))))


@query("why_trending", with_sql(SCORED_SQL, f"""SELECT doc_id, CASE WHEN active_exploitation THEN 'active_exploitation' WHEN actionability_level = 'urgent_action' AND threat_score >= 50 THEN 'critical' WHEN actionability_level = 'urgent_action' THEN 'urgent'
  WHEN len(corroborating_sources) > 0 THEN 'corroborated' WHEN affects_email_accounts THEN 'email_accounts' WHEN credential_theft_risk THEN 'credentials' END AS reason FROM (SELECT *, {SIGNALS_SQL} FROM scored)"""))
def why_trending(spark, sf_dir):
    rows = enrich.signals(enrich.scored(news(spark, sf_dir), NOW)).withColumn("threat_level", render.threat_level(F.col("actionability_level"), F.col("threat_score")))
    return rows.select("doc_id", feed.why_trending().alias("reason"))


_CYCLE_SQL = """, fetched AS (SELECT source, published_at, doc_id % 3 <> 0 AS relevant, doc_id % 89 / 89.0::DOUBLE AS credibility, doc_id % 4 AS cycle FROM news),
configured AS (SELECT DISTINCT source FROM news UNION SELECT 'silent.example'), part AS (
SELECT c.source, y.cycle, count(f.source) AS total_fetched, count(*) FILTER (WHERE relevant) AS total_relevant, max(published_at) AS last_published_at, coalesce(sum(credibility) FILTER (WHERE relevant AND credibility > 0), 0.0) AS cred_sum, count(*) FILTER (WHERE relevant AND credibility > 0) AS cred_n
FROM configured c CROSS JOIN (VALUES (0), (1), (2), (3)) y(cycle) LEFT JOIN fetched f ON f.source = c.source AND f.cycle = y.cycle GROUP BY 1, 2)"""


@query("source_health", with_sql(NEWS_SQL, _CYCLE_SQL + """ SELECT source, count(*) AS cycles_seen, count(*) FILTER (WHERE total_fetched = 0) AS cycles_empty, CAST(sum(total_fetched) AS BIGINT) AS total_fetched, CAST(sum(total_relevant) AS BIGINT) AS total_relevant, max(last_published_at) AS last_published_at,
  round(sum(total_relevant) / nullif(sum(total_fetched), 0), 3) AS relevance_rate, round(sum(cred_sum) / nullif(sum(cred_n), 0), 3) AS avg_credibility, round(count(*) FILTER (WHERE total_fetched = 0) / count(*), 3) AS empty_rate FROM part GROUP BY 1"""))
def source_health(spark, sf_dir):
    """Four cycles, each a part by doc_id, merged as they come; one configured source stays silent."""
    rows = news(spark, sf_dir).select("source", "published_at", (F.col("doc_id") % 3 != 0).alias("relevant"), (F.col("doc_id") % 89 / 89.0).alias("credibility"), (F.col("doc_id") % 4).alias("cycle"))
    configured = rows.select("source").distinct().unionByName(spark.createDataFrame([("silent.example",)], "source string"))
    parts = [health.cycle(rows.filter(F.col("cycle") == i), configured) for i in range(4)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return health.with_rates(health.merged(whole)).drop("cred_sum", "cred_n")


@query("event_rates", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(ts) AS newest, round(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) / count(*), 3) AS high_rate FROM events GROUP BY 1")
def event_rates(spark, sf_dir):
    high = F.sum(F.when(F.col("value") > 50, 1).otherwise(0))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("ts").alias("newest"), health.rate(high, F.count("*")).alias("high_rate"))


_MESSAGES = ("empty title", "AI cliché detected: 'x'", "duplicate entries in what_to_do", "summary echoes title verbatim", "near-copy of the body", "something new")


@query("quality_counters", f"""WITH m AS (SELECT lower({array_sql(_MESSAGES)}[doc_id * doc_id % 6 + 1]) AS m FROM documents)
  SELECT 'ai_validation_rejects' AS name, count(*) AS value FROM m UNION ALL SELECT * FROM (SELECT CASE WHEN m LIKE 'near-copy%' THEN 'plagiarism_rejects' WHEN m LIKE 'ai clich%' THEN 'cliche_rejects' WHEN m LIKE 'empty%' THEN 'empty_field_rejects'
    WHEN m LIKE 'duplicate entries%' THEN 'dup_rec_rejects' WHEN m LIKE 'summary echoes title%' THEN 'title_echo_rejects' END AS name, count(*) AS value FROM m GROUP BY 1) WHERE name IS NOT NULL""")
def quality_counters(spark, sf_dir):
    return health.rejection_counters(_messages(spark, sf_dir))


def _messages(spark, sf_dir):
    d = F.col("doc_id")
    return spread(table(spark, sf_dir, "documents")).select(F.element_at(tx.literal_array(_MESSAGES), (d * d % 6 + 1).cast("int")).alias("message"))


@query("top_failures", f"SELECT message, count(*) AS n FROM (SELECT {array_sql(_MESSAGES)}[doc_id * doc_id % 6 + 1] AS message FROM documents) GROUP BY 1 ORDER BY n DESC, message LIMIT 3")
def top_failures(spark, sf_dir):
    return health.top_messages(_messages(spark, sf_dir), 3)


_REASONS_SQL = "SELECT doc_id, 'post opens with ' || lower(regexp_extract(text, '[A-Za-z]+')) AS message FROM documents WHERE text IS NOT NULL"


def _reasons(spark, sf_dir):
    """Messages of very many kinds: the first word of each document."""
    first = F.lower(F.regexp_extract("text", "[A-Za-z]+", 0))
    return spread(table(spark, sf_dir, "documents")).filter("text is not null").select("doc_id", F.concat(F.lit("post opens with "), first).alias("message"))


def _heavy_sql(rows: str, k: int) -> str:
    """Of (message, n): the k most frequent, less the next one."""
    return f"(SELECT message, n - cut AS n, cut FROM (SELECT *, row_number() OVER (ORDER BY n DESC, encode(message)) AS place, coalesce(nth_value(n, {k + 1}) OVER (ORDER BY n DESC, encode(message) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS cut FROM {rows}) WHERE place <= {k} AND n > cut)"


_PARTS_SQL = " UNION ALL ".join(f"SELECT {p} AS part, * FROM {_heavy_sql(f'(SELECT message, count(*) AS n FROM reasons WHERE doc_id % 3 = {p} GROUP BY 1)', 20)}" for p in range(3))


@query("heavy_failures", f"""WITH reasons AS ({_REASONS_SQL}), parts AS ({_PARTS_SQL}), lost AS (SELECT coalesce(sum(cut), 0) AS before FROM (SELECT part, max(cut) AS cut FROM parts GROUP BY part)),
  merged AS (SELECT message, sum(n) AS n FROM parts GROUP BY 1) SELECT message, CAST(n AS BIGINT) AS n, CAST(before + cut AS BIGINT) AS lost FROM {_heavy_sql('merged', 20)}, lost""")
def heavy_failures(spark, sf_dir):
    """Frequent messages of three parts, each kept as a summary of 20 rows, merged."""
    rows = _reasons(spark, sf_dir)
    parts = [health.heavy(rows.filter(F.col("doc_id") % 3 == p), 20).withColumn("part", F.lit(p)) for p in range(3)]
    return health.heavy_merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), 20)


@query("log_rejects", """SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'broken' WHEN o_orderkey % 11 = 0 THEN 'wrong type' ELSE 'row' END AS kind, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN o_custkey ELSE 0 END) AS BIGINT) AS customers FROM orders GROUP BY 1""")
def log_rejects(spark, sf_dir):
    """Orders as lines of a log, some of them cut or of a wrong type: written to files, read back as rows and rejects."""
    key = F.col("o_orderkey")
    line = F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus"))
    lines = table(spark, sf_dir, "orders").select(F.when(key % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 3)).when(key % 11 == 0, F.replace(line, F.lit('"o_custkey":'), F.lit('"o_custkey":"x'))).otherwise(line).alias("value"))
    lines = lines.select(F.regexp_replace("value", r'("o_custkey":"x[0-9]+)', '$1"').alias("value"))
    rows, rejects = tables.split_log(spark, written_text(lines, "log"), "o_orderkey long, o_custkey long, o_orderstatus string")
    whole = rows.agg(F.lit("row").alias("kind"), F.count("*").alias("n"), F.coalesce(F.sum("o_custkey"), F.lit(0)).alias("customers"))
    kinds = rejects.groupBy(F.when(F.endswith("line", F.lit("}")), "wrong type").otherwise("broken").alias("kind")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("customers"))
    return whole.unionByName(kinds)


@query("cycle_counters", with_sql(SCORED_SQL, "SELECT count(*) AS fetched, count(*) FILTER (WHERE category <> 'other') AS categorized, count(*) FILTER (WHERE len(audience_targets) > 0) AS audience_tagged, count(*) FILTER (WHERE actionability_level <> 'informational') AS actionable, count(*) FILTER (WHERE source_tier = 'trusted') AS trusted FROM scored"))
def cycle_counters(spark, sf_dir):
    rows = enrich.scored(news(spark, sf_dir), NOW)
    n = lambda test, name: F.count_if(test).alias(name)
    return rows.agg(F.count("*").alias("fetched"), n(F.col("category") != "other", "categorized"), n(F.size("audience_targets") > 0, "audience_tagged"), n(F.col("actionability_level") != "informational", "actionable"), n(F.col("source_tier") == "trusted", "trusted"))


_SH = r"list_distinct(list_transform(range(1, len({0}) - 3), lambda i: array_to_string({0}[i : i + 4], ' ')))"


@query("near_copy", f"""WITH t AS (SELECT d.doc_id, {_SH.format('a')} AS x, {_SH.format('b')} AS y FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+(?:-[\\p{{L}}\\p{{N}}]+)*') AS a, regexp_extract_all(lower(substr(text, 1, 400)), '[\\p{{L}}\\p{{N}}]+(?:-[\\p{{L}}\\p{{N}}]+)*') AS b FROM documents) d)
  SELECT doc_id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE round(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 6) END AS ratio FROM t""")
def near_copy(spark, sf_dir):
    """How near the first 400 characters (a summary that copies) come to the whole."""
    rows = render.with_tokens(spread(table(spark, sf_dir, "documents")), head=F.substring("text", 1, 400), whole=F.col("text"))
    return rows.select("doc_id", F.round(render.near_copy(F.col("head"), F.col("whole")), 6).alias("ratio"))


@query("clean_body", with_sql(NEWS_SQL, f"SELECT doc_id, raw_content AS body FROM {clean_sql('news')}"))
def clean_body(spark, sf_dir):
    return news(spark, sf_dir).select("doc_id", tx.clean_body(tx.safe_text(F.col("raw_content"))).alias("body"))
