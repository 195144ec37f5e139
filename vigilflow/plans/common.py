"""What the queries of one data folder share, and the same steps as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilflow.functions import vocab
from vigilflow.operators import enrich
from vigilflow.session import once, spread, table
from vigilflow.sources import news as nw
from vigilflow.sources.news import NEWS_SQL, NOW, any_sql, array_sql, hits_sql, language_sql, quoted, title_tokens_sql, tokens_sql


@once
def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.news_from_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def one_per_fingerprint(rows: DataFrame) -> DataFrame:
    """The row of the smallest doc_id of each fingerprint: what a store keeps of its first sight. One shuffle; rows that can't be the first stay behind (a group limit)."""
    order = Window.partitionBy("fingerprint").orderBy("doc_id")
    return rows.withColumn("_first", F.row_number().over(order)).filter("_first = 1").drop("_first")


def _map_sql(pairs: dict, key: str, default: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v) if isinstance(v, str) else v}" for k, v in pairs.items()) + f" ELSE {default} END"


def _platform_sql() -> str:
    import re

    out = []
    for name, aliases in vocab.PLATFORMS.items():
        words = "|".join(re.escape(a).replace("\\ ", " ") for a in aliases if " " not in a)
        tests = [f"contains(txt, {quoted(a)})" for a in aliases if " " in a]
        if words:
            tests.append(f"regexp_matches(txt, '(^|[^\\p{{L}}\\p{{N}}_])({words})($|[^\\p{{L}}\\p{{N}}_])')")
        out.append(f"CASE WHEN {' OR '.join(tests)} THEN {quoted(name)} END")
    return f"list_sort(list_filter([{', '.join(out)}], lambda x: x IS NOT NULL))"


def _audience_sql(name: str, profile: dict) -> str:
    overlap = f"1.5 * len(list_filter(affected_platforms, lambda p: list_contains({array_sql(profile['platforms'])}, p)))" if profile["platforms"] else "0"
    label = f"CASE WHEN category IN ({', '.join(map(quoted, profile['categories']))}) THEN 1.5 ELSE 0 END" if profile["categories"] else "0"
    raw = f"CAST({hits_sql(profile['keywords'])} + {overlap} + {label} AS DOUBLE)"
    return f"{{'score': {raw} / ({raw} + 2.0), 'name': {quoted(name)}}}"


def _capped(terms) -> str:
    return f"least(2, {hits_sql(terms)})"


TEXT_SQL = f"{NEWS_SQL},\nnews_t AS (SELECT *, lower(title || chr(10) || raw_content) AS txt, {tokens_sql('(title || chr(10) || raw_content)')} AS toks FROM news)"
RELEVANCE_SQL = f"CAST(3 * {hits_sql(vocab.STRONG)} + 2 * {hits_sql(vocab.MEDIUM)} + {hits_sql(vocab.WEAK)} - 2 * {hits_sql(vocab.NEGATIVE)} AS BIGINT)"
_HITS = ", ".join(f"{{'hits': {hits_sql(terms)}, 'o': {-i}, 'name': {quoted(name)}}}" for i, (name, terms) in enumerate(vocab.CATEGORIES.items()))
#: From news_t on.
CLASSES_SQL = f"""
cat0 AS (SELECT *, list_sort([{_HITS}], 'DESC') AS cats FROM news_t),
cat AS (SELECT * EXCLUDE (cats), CASE WHEN cats[1].hits > 0 THEN cats[1].name ELSE 'other' END AS category,
  CASE WHEN cats[1].hits > 0 THEN cats[1].hits / CAST(list_sum(list_transform(cats, lambda c: c.hits)) AS DOUBLE) ELSE 0.0 END AS category_confidence,
  {_platform_sql()} AS affected_platforms FROM cat0),
aud AS (SELECT *, [{', '.join(_audience_sql(n, p) for n, p in vocab.AUDIENCES.items())}] AS aud FROM cat),
aud2 AS (SELECT * EXCLUDE (aud), list_sort(list_transform(list_filter(aud, lambda a: a.score >= 0.33), lambda a: a.name)) AS audience_targets,
  coalesce(list_max(list_transform(list_filter(aud, lambda a: a.score >= 0.33), lambda a: a.score)), 0.0) AS audience_relevance_score,
  greatest(0.0, least(1.0, ({_capped(vocab.URGENT)} * 4.0 + {_capped(vocab.RECOMMENDED)} * 1.5 - {_capped(vocab.INFORMATIONAL)} * 1.0 + CAST({_map_sql(vocab.CATEGORY_BIAS, 'category', '0.0')} AS DOUBLE) + 1.5) / 7.0)) AS actionability_score
  FROM aud),
classified AS (SELECT *, CASE WHEN actionability_score >= 0.7 THEN 'urgent_action' WHEN actionability_score >= 0.4 THEN 'recommended_action' ELSE 'informational' END AS actionability_level FROM aud2)"""

CLASSIFIED_SQL = f"{TEXT_SQL},{CLASSES_SQL}"
_TRUSTED = [n for n, (_, t) in vocab.SOURCES.items() if t == "trusted"]


def pairs_sql(least: float, trusted: bool) -> str:
    """All pairs of rows, compared directly."""
    gate = f"AND b.source IN ({', '.join(map(quoted, _TRUSTED))})" if trusted else ""
    return f"""SELECT a.doc_id, b.source AS other, min(b.doc_id) AS first FROM tt a JOIN tt b ON a.source <> b.source {gate}
  AND len(list_intersect(a.tk, b.tk)) >= 2 AND len(list_intersect(a.tk, b.tk)) / CAST(len(list_distinct(list_concat(a.tk, b.tk))) AS DOUBLE) >= {least} GROUP BY 1, 2"""


STORIES_SQL = f"""tt AS (SELECT doc_id, source, {title_tokens_sql('title')} AS tk FROM news),
wide AS ({pairs_sql(0.2, False)}),
trusted AS ({pairs_sql(0.25, True)})"""
_SEVERITY = " + ".join(f"CASE WHEN contains(txt, {quoted(p)}) THEN {float(w)} ELSE 0.0 END" for p, w in vocab.SEVERITY.items())
_TERMS = [t for t in enrich.ALL_TERMS if not (t.endswith("*") and " " not in t and "-" not in t)]
SCORES_SQL = f"""{STORIES_SQL},
scored0 AS (
  SELECT c.*, coalesce(w.n, 0) AS n_sources, coalesce(t.sources, []) AS corroborating_sources,
    greatest(0.0, least(1.0, CAST({_map_sql({k: float(v[0]) for k, v in vocab.SOURCES.items()}, 'c.source', '0.35')} AS DOUBLE)
      - least(0.30::DOUBLE, len(list_filter({array_sql(vocab.SENSATIONAL)}, lambda k: contains(txt, k))) * 0.10::DOUBLE) + least(0.15::DOUBLE, len(coalesce(t.sources, [])) * 0.05::DOUBLE))) AS source_credibility_score
  FROM classified c LEFT JOIN (SELECT doc_id, count(*) AS n FROM wide GROUP BY 1) w USING (doc_id)
  LEFT JOIN (SELECT doc_id, list(other ORDER BY first, other) AS sources FROM trusted GROUP BY 1) t USING (doc_id)),
scored AS (SELECT *, CASE WHEN source_credibility_score >= 0.70 THEN 'trusted' WHEN source_credibility_score >= 0.40 THEN 'verified' ELSE 'unverified' END AS source_tier,
  greatest(0.0, least(100.0, (15.0 * ln(1.0 + {hits_sql(_TERMS)}) + CAST({_SEVERITY} AS DOUBLE) * 4.0)
    * greatest(pow(0.5::DOUBLE, greatest(0.0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(published_at)) / 3.6e9 / 12.0), 0.2)
    + CASE WHEN n_sources > 0 THEN 20.0 * (1.0 - exp(-0.6::DOUBLE * n_sources)) ELSE 0.0 END)) AS threat_score FROM scored0)"""

SCORED_SQL = f"{CLASSIFIED_SQL},\n{SCORES_SQL}"


def _clean_sql() -> str:
    """Normalisation of a body: NFC, white space, feed junk, the cut near 3000 characters. (The seeded texts hold no HTML entities.)"""
    space = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    text = f"trim(regexp_replace(regexp_replace(nfc_normalize(raw_content), '[\\x00-\\x08\\x0E-\\x1F\\x7F-\\x9F]', ' ', 'g'), '{space}', ' ', 'g'))"
    for pattern in vocab.JUNK:
        # RE2 bounds words by ASCII letters: the Ukrainian patterns get bounds of their own.
        own = pattern if pattern.isascii() or "©" in pattern else r"(^|[^\p{L}\p{N}_])" + pattern.removeprefix(r"\b").replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\b", r"($|[^\p{L}\p{N}_])")
        text = f"regexp_replace({text}, {quoted('(?m)' + own)}, '{' ' if own == pattern else chr(92) + '1 '}', 'gi')"
    return f"trim(regexp_replace({text}, '{space}', ' ', 'g'))"


def clean_sql(table: str) -> str:
    """The rows of a table with cleaned bodies."""
    return f"""(SELECT * EXCLUDE (cut) REPLACE (CASE WHEN length(raw_content) <= 3000 THEN raw_content WHEN cut > 2250 THEN substr(raw_content, 1, cut + 1) ELSE substr(raw_content, 1, 3000) END AS raw_content)
  FROM (SELECT *, CASE WHEN contains(substr(raw_content, 1, 3000), '. ') THEN length(regexp_extract(substr(raw_content, 1, 3000), '(?s)^(.*)\\. ', 1)) ELSE -1 END AS cut FROM (SELECT * REPLACE ({_clean_sql()} AS raw_content) FROM {table})))"""


def cycle_sql(known: str) -> str:
    """The ingest cycle up to scored rows: rows that the store lacks, normalised, relevant, scored as one batch. known: a select of stored fingerprints."""
    fetched = NEWS_SQL.replace("news AS (", "fetched AS (", 1)
    return f"""{fetched},
fresh AS (SELECT * REPLACE ({language_sql("(title || chr(10) || raw_content)")} AS language) FROM {clean_sql(f"(SELECT * FROM fetched WHERE fingerprint NOT IN ({known}))")}),
fresh_t AS (SELECT *, lower(title || chr(10) || raw_content) AS txt, {tokens_sql("(title || chr(10) || raw_content)")} AS toks FROM fresh),
news_t AS MATERIALIZED (SELECT * FROM fresh_t WHERE language <> 'other' AND {RELEVANCE_SQL} >= 3),
news AS (SELECT * FROM news_t),{CLASSES_SQL},
{SCORES_SQL}"""


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(txt, {quoted(w)})" for w in words) + ")"


def _overlap(column: str, *names: str) -> str:
    return f"list_has_any({column}, {array_sql(names)})"


_LOWER_PLATFORMS = "list_transform(affected_platforms, lambda p: lower(p))"
_MONEY = r"regexp_matches(txt, '(^|[^\p{L}\p{N}_])(bank(ing)?|fraud|fraudulent|payment card|crypto(currenc(y|ies))?|wallet)($|[^\p{L}\p{N}_])')"
SIGNALS_SQL = f"""
  actionability_level = 'urgent_action' OR {any_sql(vocab.PHRASES_ACTIVE_EXPLOIT)} AS active_exploitation,
  category IN ('phishing', 'breach', 'data leak') OR {_has('credential')} OR ({_has('password')} AND category IN ('phishing', 'scam', 'breach')) AS credential_theft_risk,
  category = 'scam' OR {any_sql(vocab.PHRASES_FINANCIAL)} OR ({_MONEY} AND category IN ('scam', 'malware', 'phishing', 'breach')) OR {_overlap('audience_targets', 'crypto_users')} AS financial_risk,
  {_overlap('audience_targets', 'sysadmins', 'enterprise')} OR {any_sql(vocab.PHRASES_ENTERPRISE)} OR {_overlap(_LOWER_PLATFORMS, 'vmware', 'kubernetes')} AS enterprise_risk,
  {_overlap('audience_targets', 'normal_users', 'mobile_users', 'crypto_users')} OR category IN ('phishing', 'scam', 'social engineering', 'spyware') AS consumer_risk,
  actionability_level = 'urgent_action' OR {any_sql(vocab.PHRASES_ACTIVE_EXPLOIT)} AS requires_immediate_action,
  {any_sql(vocab.PHRASES_EMAIL)} OR {_overlap(_LOWER_PLATFORMS, 'microsoft 365', 'outlook', 'gmail')} AS affects_email_accounts,
  {any_sql(vocab.PHRASES_SESSION)} OR ({_has('mfa')} AND {_has('bypass')}) AS steals_sessions,
  category IN ('breach', 'data leak') OR {any_sql(vocab.PHRASES_DATA_EXPOSURE)} AS data_exposure_risk,
  category IN ('malware', 'ransomware', 'spyware', 'botnet') OR {any_sql(vocab.PHRASES_MALWARE_DELIVERY)} AS malware_delivery"""


def with_sql(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"
