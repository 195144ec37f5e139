"""Rule-based rendering and checks of posts: references, levels, weights, rotations, facts, clean-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilflow.functions import editorial as ed
from vigilflow.functions import text as tx

# Labels of quick facts.
FACT_LABELS = {
    "phishing": "Phishing campaign", "ransomware": "Ransomware", "vulnerability": "Vulnerability", "exploit": "Active exploit", "zero-day": "Zero-day", "breach": "Data breach",
    "data leak": "Data leak", "malware": "Malware", "spyware": "Spyware", "scam": "Scam", "botnet": "Botnet", "social engineering": "Social engineering",
}


# What a failed check says; counters go by how it begins.
REASONS = {
    "empty": "empty {}",
    "empty_list": "empty {} list",
    "language": "{} is not in target language ",
    "level": "hallucinated threat_level: ",
    "echo": "summary echoes title verbatim",
    "duplicates": "duplicate entries in {}",
    "cliche": "AI cliché detected: ",
    "russism": "Russism stem in UA output: ",
    "foreign": "Foreign-script character in UA output: ",
    "fluff": "editorial fluff persisted in {}",
    "copy": "{} reads as a near-copy of source",
}


def references(text: Column) -> Column:
    """array<struct<type, label, url>> of the advisory ids in a text, in order of kind, each label once."""
    text = F.coalesce(text, F.lit(""))
    all_of = lambda pattern, group: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    ref = lambda kind, label, url: F.struct(F.lit(kind).alias("type"), label.alias("label"), url.alias("url"))
    cve = F.transform(all_of(r"(?=[Cc][Vv][Ee]-\d)\b...-(\d{4}-\d{4,7})\b", 1), lambda x: ref("cve", F.concat(F.lit("CVE-"), x), F.concat(F.lit("https://nvd.nist.gov/vuln/detail/CVE-"), x)))
    cert = F.transform(all_of(r"(?=[Cc][Ee][Rr][Tt]-[Uu][Aa]#)\b.{7}#(\d+)\b", 1), lambda x: ref("cert", F.concat(F.lit("CERT-UA#"), x), F.concat(F.lit("https://cert.gov.ua/article/"), x)))
    cisa = F.transform(all_of(r"(?=AA\d)\b(AA\d{2}-\d{2,3}[A-Za-z]?)\b", 1), lambda x: ref("advisory", F.concat(F.lit("CISA "), x), F.concat(F.lit("https://www.cisa.gov/news-events/cybersecurity-advisories/"), F.lower(x))))
    msrc = F.transform(all_of(r"(?=[Aa][Dd][Vv]\d)\b(...\d{6})\b", 1), lambda x: ref("vendor", F.upper(x), F.concat(F.lit("https://msrc.microsoft.com/update-guide/vulnerability/"), F.upper(x))))
    return merge_references(F.concat(cve, cert, cisa, msrc))


def merge_references(refs: Column) -> Column:
    """The first of each (type, lower-case label), in order."""
    key = lambda r: F.concat(r["type"], F.lit("|"), F.lower(r["label"]))
    first = lambda p: F.filter(p["refs"], lambda r, i: F.array_position(p["keys"], key(r)) == i + 1)
    return tx.let(refs, lambda own: tx.let(F.struct(own.alias("refs"), F.transform(own, key).alias("keys")), first))


def drop_source_refs(refs: Column, source_url: Column) -> Column:
    """References to the source's own host go; www. doesn't count."""
    host = lambda u: F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit(""))), r"^www\.", "")
    own = host(source_url)
    return F.filter(refs, lambda r: (own == "") | (host(r["url"]) != own))


def threat_level(level: Column, score: Column) -> Column:
    return (
        F.when(level == "urgent_action", F.when(score >= 50, "Critical").otherwise("High"))
        .when(level == "recommended_action", F.when(score >= 50, "High").otherwise("Medium"))
        .otherwise(F.when(score >= 30, "Medium").otherwise("Low"))
    )


def urgency(level: Column, score: Column) -> Column:
    return F.when(level == "urgent_action", "urgent").when((level == "recommended_action") | (score >= 50), "soon").otherwise("fyi")


def emotional_weight(action: Column, score: Column, trust: Column) -> Column:
    weight = action * 0.6 + F.least(score / 100.0, F.lit(1.0)) * 0.3 + trust * 0.1
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))


def words(text: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, r"(?U)\s+")))


def reading_seconds(text: Column) -> Column:
    """A third of a second a word, in whole seconds, 15 to 45."""
    return F.greatest(F.lit(15), F.least(F.lit(45), F.floor(words(text) / 3))).cast("int")


def card_seconds(text: Column) -> Column:
    """To the nearest five seconds, halves to even, five at least."""
    return F.greatest(F.lit(5), (F.bround(words(text) / 3.0 / 5, 0) * 5).cast("int"))


def rotation(pool: list[str], fingerprint: Column, n: int, salt: int = 0) -> Column:
    """n of a pool from where the fingerprint points; the whole pool if it has no more."""
    if len(pool) <= n:
        return tx.literal_array(pool)
    seed = F.conv(F.substring(fingerprint, 1, 8), 16, 10).cast("long") + F.lit(salt * 0x9E3779B9)
    return F.slice(tx.literal_array(pool + pool), (seed % len(pool) + 1).cast("int"), n)


def quick_facts() -> Column:
    """Up to four: exploited or patched, platforms, category, a source of high trust."""
    txt, names = F.col("txt"), F.col("affected_platforms")
    hot = txt.rlike(r"(?U)\b(actively\s+exploited|in\s+the\s+wild|under\s+(active\s+)?attack)\b") | (F.col("actionability_level") == "urgent_action")
    patched = txt.rlike(r"(?U)\b(patch|fix|update)\s+(is\s+)?(available|released|now\s+available|out)\b")
    table = F.create_map(*[F.lit(x) for pair in FACT_LABELS.items() for x in pair])
    where = F.when(F.size(names) == 1, F.concat(F.lit("Affects "), F.get(names, F.lit(0)))).when(F.size(names) == 2, F.concat(F.lit("Affects "), F.get(names, F.lit(0)), F.lit(" & "), F.get(names, F.lit(1)))).when(F.size(names) > 2, "Multi-platform")
    facts = F.array(
        F.when(hot, "Actively exploited").when(patched, "Patch available"), where, F.when(F.col("category") != "other", table[F.col("category")]),
        F.when((F.col("source_tier") == "trusted") & (F.col("source_credibility_score") >= 0.85), F.col("source")),
    )
    return F.slice(F.array_distinct(F.filter(facts, lambda x: x.isNotNull())), 1, 4)


def clamped(rows: DataFrame) -> DataFrame:
    """Posts of a provider within the bounds of a card: trimmed texts, a title of 160 characters, lists without blanks of
    3, 2 and 5 entries, a weight of 0 to 1, 10 to 120 seconds."""
    full = lambda c: F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumns({
        "title": F.substring(F.trim("title"), 1, 160), **{c: F.trim(F.coalesce(c, F.lit(""))) for c in ("short_summary", "why_it_matters", "detail_body")},
        "affected_users": full("affected_users"), "what_to_do": F.slice(full("what_to_do"), 1, 3), "what_not_to_do": F.slice(full("what_not_to_do"), 1, 2), "quick_facts": F.slice(full("quick_facts"), 1, 5),
        "emotional_weight": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("emotional_weight"))),
        "reading_time_seconds": F.greatest(F.lit(10), F.least(F.lit(120), F.col("reading_time_seconds").cast("int"))),
    })


def platform_list(names: Column) -> Column:
    """A, A and B, or A, B and C."""
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(1))), ", ")
    return F.when(F.size(names) == 0, "").when(F.size(names) == 1, F.get(names, F.lit(0))).otherwise(F.concat(head, F.lit(" and "), F.element_at(names, -1)))


def has_duplicates(items: Column) -> Column:
    norm = F.transform(items, lambda x: F.regexp_replace(F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), "[.!?…]+$", ""))
    full = F.filter(norm, lambda x: x != "")
    return F.size(full) != F.size(F.array_distinct(full))


def near_copy(candidate_tokens: Column, source_tokens: Column, n: int = 5) -> Column:
    """Jaccard similarity of the word shingles of two token lists; these must be columns, as each word is read n times."""
    return tx.jaccard(tx.word_shingles(candidate_tokens, n), tx.word_shingles(source_tokens, n))


def with_tokens(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds the tokens of texts, in order and with repeats, behind a fence that keeps them evaluated once a row."""
    toks = {name: F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(tx.TOKEN), F.lit(0)) for name, text in columns.items()}
    made = rows.withColumn("_toks", F.explode(F.array(F.struct(*[t.alias(name) for name, t in toks.items()]))))
    return made.withColumns({name: F.col(f"_toks.{name}") for name in toks}).drop("_toks")


def failure_reason(language: Column) -> Column:
    """The first check that a post fails, else null; cheap checks first.

    Rows need title, short_summary, why_it_matters, detail_body, threat_level, the lists affected_users, what_to_do and
    what_not_to_do, source_title, and the tokens (with_tokens) summary_tokens, why_tokens, source_tokens.
    """
    norm = lambda c: F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), "[.!?…]+$", "")
    full = lambda c: F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    title, summary, why = F.trim("title"), F.trim("short_summary"), F.trim("why_it_matters")
    do, avoid, users = full("what_to_do"), full("what_not_to_do"), full("affected_users")
    own, said = norm(F.col("source_title")), norm(summary)
    echo = (F.length("source_title") >= 30) & (own != "") & F.contains(said, own) & (F.length(said) <= F.length(own) + 25)
    blob = F.lower(F.concat_ws(" ", title, summary, why, F.array_join(do, " "), F.array_join(avoid, " "), F.array_join(users, " ")))
    fluffy = lambda c: F.when(language == "ua", ed.contains_fluff(c, "ua")).when(language == "en", ed.contains_fluff(c, "en")).otherwise(False)
    copied = lambda c: near_copy(F.col(c), F.col("source_tokens")) >= 0.25
    in_ua = language == "ua"
    says = lambda reason, field="": F.lit(REASONS[reason].format(field))
    return F.coalesce(
        F.when(title == "", says("empty", "title")), F.when(summary == "", says("empty", "short_summary")), F.when(why == "", says("empty", "why_it_matters")),
        F.when(tx.wrong_script(title, language), F.concat(says("language", "title"), quoted(language), F.lit(": "), quoted(F.substring(title, 1, 80)))),
        F.when(tx.wrong_script(summary, language), F.concat(says("language", "short_summary"), quoted(language))),
        F.when(~F.trim("threat_level").isin("Critical", "High", "Medium", "Low"), F.concat(says("level"), quoted(F.trim("threat_level")))),
        F.when(F.size(do) == 0, says("empty_list", "what_to_do")), F.when(F.size(users) == 0, says("empty_list", "affected_users")), F.when(echo, says("echo")),
        F.when(has_duplicates(do), says("duplicates", "what_to_do")), F.when(has_duplicates(avoid), says("duplicates", "what_not_to_do")),
        F.concat(says("cliche"), quoted(ed.cliche(blob))),
        F.when(in_ua, F.concat(says("russism"), quoted(ed.russism(blob)))), F.when(in_ua, F.concat(says("foreign"), quoted(ed.foreign_character(blob)))),
        *[F.when(fluffy(F.col(c)), says("fluff", c)) for c in ("short_summary", "why_it_matters", "detail_body")],
        F.when(copied("summary_tokens"), says("copy", "short_summary")), F.when(copied("why_tokens"), says("copy", "why_it_matters")),
    )
