"""News rows from the documents table.

The documents hold no security vocabulary, so headlines and body tails are SEEDED here: openly synthetic,
chosen by plain functions of doc_id, so that every class of the vocabularies occurs. The same adapter is
written as SQL (NEWS_SQL) for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilflow.functions import text as tx
from vigilflow.functions import vocab

NOW = "2024-02-01 00:00:00"

HEADLINES = (
    "Ransomware crew LockBit locks files of two regional clinics",
    "Zero-day bug in Chrome abused by exploit sellers, fix pending",
    "Harbour town plants four hundred lime trees along the quay",
    "Зловмисники розсилають фішингові листи клієнтам банків",
    "Tooling startup closes Series B funding round of $40M",
    "Top 10 webinar platforms compared for small offices",
    "Months after ransomware breach a grocer raises $9M to rebuild",
    "iPhone owners targeted by zero-click exploit tied to Pegasus",
    "Remote code execution flaw lets pods escape Kubernetes and Docker",
    "Oracle customer files exposed in breach at a Fortune 500 supplier",
    "Phishing kit for Microsoft 365 copies session tokens and mailbox rules",
    "Banking trojan for Android empties crypto wallet apps",
    "Researchers discovered weak spot in encryption of old radios",
    "Cisco and Fortinet patched gateways, admins should restart them",
    "Gift card scam spreads over Telegram and WhatsApp groups",
    "Утром открыли новую выставку картин в музее",
    "Botnet floods online banking portals with ddos traffic",
    "Poisoned npm package hides infostealer and loader",
    "Shocking truth about passwords, click here for the bombshell",
    "Data leak: exposed database held passwords of Gmail users",
    "Шахраї виманили гроші через підроблений застосунок пошти",
    "Minister visits wind turbine plant and renewable energy fair",
    "Advisory: VMware ESXi hosts actively exploited since Monday",
    "Stalkerware hidden in the app store sold as spyware kit",
)
TAILS = (
    "Patch immediately: the flaw CVE-2024-12345 is actively exploited in the wild. See CERT-UA#8421.",
    "A patch is available and users should update. Details in CVE-2024-12345 and CVE-2023-99881.",
    "Researchers found a proof of concept; according to a report there is no attack.",
    "Enable 2FA immediately and change password immediately, credentials stolen in bulk.",
    "Nothing else is known at this time.",
    "Subscribe to our newsletter for more. All rights reserved.",
    "Active Directory and exchange server admins should reset passwords. CISA AA24-131A, ADV200001.",
    "Millions of users affected; workaround available for Windows and Linux.",
)
SOURCE_NAMES = (*vocab.SOURCES, "Unknown Blog")


def news_from_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, title, source, url, published_at, raw_content, language."""
    d = F.col("doc_id")
    pick = lambda values, i: F.element_at(tx.literal_array(values), (i % len(values) + 1).cast("int"))
    number = F.coalesce(F.regexp_extract(F.col("source"), "^src([0-9]+)$", 1).try_cast("long"), F.lit(len(SOURCE_NAMES) - 1))
    key = F.when(d % 10 == 3, d - 1).otherwise(d)
    title = F.concat(pick(HEADLINES, d), F.lit(" case-"), F.floor(d / 240).cast("string"))
    rows = docs.select(
        "doc_id",
        title.alias("title"),
        pick(SOURCE_NAMES, number).alias("source"),
        F.concat(F.lit("https://news.test/"), key.cast("string")).alias("url"),
        (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_interval(hours=(d * 37 % 744).cast("int"))).alias("published_at"),
        F.concat(F.col("text"), F.lit(" "), pick(TAILS, F.floor(d / 7))).alias("raw_content"),
    )
    return rows.withColumn("fingerprint", tx.url_fingerprint(F.col("url"), F.col("title"))).withColumn("language", tx.detect_language(F.concat_ws("\n", "title", "raw_content")))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def array_sql(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def language_sql(t: str) -> str:
    cyr, lat = f"length(regexp_replace({t}, '[^\\x{{0400}}-\\x{{04FF}}]', '', 'g'))", f"length(regexp_replace({t}, '[^A-Za-z]', '', 'g'))"
    return f"CASE WHEN {cyr} + {lat} < 4 THEN 'unknown' WHEN {cyr} / ({cyr} + {lat}) < 0.3 THEN 'en' WHEN regexp_matches({t}, '[їєґіЇЄҐІ]') THEN 'ua' ELSE 'other' END"


def tokens_sql(t: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+(?:-[\\p{{L}}\\p{{N}}]+)*'))"


def title_tokens_sql(t: str) -> str:
    return f"list_filter({tokens_sql(t)}, lambda t: length(t) > 2 AND NOT list_contains({array_sql(vocab.STOPWORDS)}, t))"


def hits_sql(terms, text: str = "txt", toks: str = "toks") -> str:
    whole, phrases, stems = tx.term_classes(terms)
    parts = [f"len(list_filter({array_sql(whole)}, lambda k: list_contains({toks}, k)))" if whole else "0", f"len(list_filter({array_sql(phrases)}, lambda k: contains({text}, k)))" if phrases else "0"]
    if stems:
        parts.append(f"len(list_filter({array_sql(stems)}, lambda k: len(list_filter({toks}, lambda t: starts_with(t, k))) > 0))")
    return "(" + " + ".join(parts) + ")"


def any_sql(phrases, text: str = "txt") -> str:
    return f"(len(list_filter({array_sql(phrases)}, lambda k: contains({text}, k))) > 0)"


NEWS_SQL = f"""
news AS (
  SELECT *, substr(sha256(lower(trim(url))), 1, 16) AS fingerprint, {language_sql("(title || chr(10) || raw_content)")} AS language FROM (
    SELECT doc_id, {array_sql(HEADLINES)}[doc_id % {len(HEADLINES)} + 1] || ' case-' || (doc_id // 240) AS title,
      {array_sql(SOURCE_NAMES)}[coalesce(TRY_CAST(nullif(regexp_extract(source, '^src([0-9]+)$', 1), '') AS BIGINT), {len(SOURCE_NAMES) - 1}) % {len(SOURCE_NAMES)} + 1] AS source,
      'https://news.test/' || (CASE WHEN doc_id % 10 = 3 THEN doc_id - 1 ELSE doc_id END) AS url,
      TIMESTAMP '2024-01-01' + to_hours(doc_id * 37 % 744) AS published_at,
      text || ' ' || {array_sql(TAILS)}[doc_id // 7 % {len(TAILS)} + 1] AS raw_content
    FROM documents)
)"""
