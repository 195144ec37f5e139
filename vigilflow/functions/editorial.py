"""Editorial clean-ups and small row functions of feeds, as Column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilflow.functions import editorial_vocab as ev
from vigilflow.functions.text import literal_array, trim_at_word

CYRILLIC = "А-Яа-яЁёЇїІіЄєҐґ"
TEMPLATES = (("en", "default", "general"), ("en", "phishing", "normal_users"), ("en", "ransomware", "general"), ("en", "vulnerability", "developers"), ("en", "exploit", "sysadmins"), ("ua", "default", "general"), ("ua", "phishing", "normal_users"))


def sentences(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+(?=[A-ZА-ЯЇІЄҐ])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n{2,}"), lambda p: F.trim(p)), lambda p: p != "")


def _any(patterns) -> str:
    return "(?iuU)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def strip_fluff(text: Column, language: str = "en") -> Column:
    """Sentences without content go; the rest is joined by single blanks."""
    pattern = _any(ev.FLUFF_UA if language == "ua" else ev.FLUFF_EN)
    return F.array_join(F.filter(sentences(text), lambda s: ~F.rlike(s, F.lit(pattern))), " ")


def contains_fluff(text: Column, language: str = "en") -> Column:
    return F.rlike(text, F.lit(_any(ev.FLUFF_UA if language == "ua" else ev.FLUFF_EN)))


def strip_generic(items: Column, language: str = "en") -> Column:
    pattern = _any(ev.ADVICE_UA if language == "ua" else ev.ADVICE_EN)
    return F.filter(items, lambda s: ~F.rlike(s, F.lit(pattern)))


def content_words(text: Column, language: str = "en") -> Column:
    stop = literal_array(ev.PARAGRAPH_STOPWORDS_UA if language == "ua" else ev.PARAGRAPH_STOPWORDS_EN)
    toks = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return F.filter(toks, lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def distinct_paragraphs(body: Column, against: list[Column], language: str = "en", most: float = 0.55) -> Column:
    """Paragraphs that say again what any of the other texts says go."""
    def repeats(p: Column) -> Column:
        mine, test = content_words(p, language), F.lit(False)
        for other in against:
            theirs = content_words(other, language)
            ratio = F.size(F.array_intersect(mine, theirs)) / F.size(F.array_union(mine, theirs))
            test = test | F.coalesce((F.size(mine) > 0) & (F.size(theirs) > 0) & (ratio >= most), F.lit(False))
        return test

    return F.array_join(F.filter(paragraphs(body), lambda p: ~repeats(p)), "\n\n")


def refined(rows: DataFrame, language: str = "en") -> DataFrame:
    """Posts as an editor leaves them: sentences without content go, then advice that fits everything, then paragraphs of
    the detail that say again what title, summary or reason say. Paragraphs stay apart."""
    detail = F.array_join(F.filter(F.transform(paragraphs(F.col("detail_body")), lambda p: strip_fluff(p, language)), lambda p: F.trim(p) != ""), "\n\n")
    rows = rows.withColumns({
        "short_summary": strip_fluff(F.col("short_summary"), language), "why_it_matters": strip_fluff(F.col("why_it_matters"), language), "detail_body": detail,
        "what_to_do": strip_generic(F.col("what_to_do"), language), "what_not_to_do": strip_generic(F.col("what_not_to_do"), language),
    })
    return rows.withColumn("detail_body", distinct_paragraphs(F.col("detail_body"), [F.col("title"), F.col("short_summary"), F.col("why_it_matters")], language))


def lead(body: Column, most: int = 220) -> Column:
    """The first sentence of a body that is no byline, with the second where it is under 100 characters; cut at a word."""
    parts = F.filter(F.split(F.trim(body), r"(?U)(?<=[.!?])\s+"), lambda s: s != "")
    starts = F.transform(parts, lambda s: ~s.rlike(ev.BYLINE))
    at = F.array_position(starts, F.lit(True)).cast("int")

    def cut(rest: Column) -> Column:
        one = F.trim(F.get(rest, F.lit(0)))
        both = F.when((F.length(one) < 100) & (F.size(rest) > 1), F.trim(F.concat(one, F.lit(" "), F.trim(F.get(rest, F.lit(1)))))).otherwise(one)
        return F.concat(trim_at_word(both, most), F.when(F.length(both) > most, "…").otherwise(""))

    return F.when((F.size(parts) == 0) | (at == 0), "").otherwise(cut(F.slice(parts, at, F.greatest(F.size(parts), F.lit(1)))))


def pick_audience(targets: Column, preferred: str | None = None) -> Column:
    """The preferred audience where it is among the targets, else the first of them, else general."""
    first = F.coalesce(F.get(targets, F.lit(0)), F.lit("general"))
    return first if preferred is None else F.when(F.array_contains(targets, preferred), preferred).otherwise(first)


def first_of(needles, text: Column) -> Column:
    """The first of the needles that the text holds, else null."""
    return F.get(F.filter(literal_array(needles), lambda n: F.contains(text, n)), F.lit(0))


def cliche(text: Column) -> Column:
    return first_of((*ev.CLICHES_EN, *ev.CLICHES_UA), F.lower(text))


def russism(text: Column) -> Column:
    return first_of(ev.RUSSISMS, F.lower(text))


def foreign_character(text: Column) -> Column:
    """The first character of a script that Ukrainian text doesn't use, else null."""
    allowed = "\\x{0000}-\\x{007F}\\x{00A0}-\\x{024F}\\x{0300}-\\x{036F}\\x{0400}-\\x{04FF}\\x{2000}-\\x{20CF}\\x{2190}-\\x{22FF}\\x{2500}-\\x{257F}\\x{2600}-\\x{27BF}"
    return F.nullif(F.regexp_extract(text, f"([^{allowed}])", 1), F.lit(""))


def ukrainian(text: Column) -> Column:
    """Each Cyrillic word by the longest glossary stem that it begins with; the first letter keeps its case. One Arrow function."""
    stems = {k: v for k, v in ev.GLOSSARY.items() if k.isalpha()}

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        import re

        # One alternation, the longest stem first, at the beginning of a word.
        pattern = re.compile(f"(?<![{CYRILLIC}])(?:{'|'.join(sorted(stems, key=len, reverse=True))})", re.IGNORECASE)

        def one(m: re.Match) -> str:
            new = stems[m[0].lower()]
            return new[:1].upper() + new[1:] if m[0][0].isupper() else new

        return pa.array([None if t is None else pattern.sub(one, t) for t in texts.to_pylist()], pa.string())

    return of(text)


def shouty_title(title: Column) -> Column:
    """A title of mostly capitals gets words with one capital; acronyms and words with digits stay."""
    letters, upper = F.length(F.regexp_replace(title, r"\P{L}", "")), F.length(F.regexp_replace(title, r"\P{Lu}", ""))
    kept = literal_array(ev.ACRONYMS)
    words = F.filter(F.split(title, r"(?U)\s+"), lambda w: w != "")
    fixed = F.transform(words, lambda w: F.when(w.rlike("[0-9]") | F.array_contains(kept, w) | (w != F.upper(w)) | ~w.rlike(r"\p{L}"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000)))))
    return F.when((letters < 8) | (upper / letters < 0.7), title).otherwise(F.array_join(fixed, " "))


def post_title(title: Column) -> Column:
    whole = shouty_title(F.trim(title))
    return F.concat(trim_at_word(whole, 120), F.when(F.length(whole) > 120, "…").otherwise(""))


def source_excerpt(text: Column, limit: int = ev.PROMPT_BODY, ends: tuple[str, ...] = ev.PROMPT_ENDS, blank: str = r"(?U)\s") -> Column:
    """A body of at most limit characters: cut at the last paragraph that ends in its last 30 %, else after the last sentence there
    (marks in the order of ends), else at the limit; what is blank before a cut goes, and cut bodies say so."""
    head, least = F.substring(text, 1, limit), int(limit * 0.7)
    tail = F.substring(text, least + 1, limit - least)

    def last(mark: str) -> Column:
        """Characters of the body before the last of these marks in the tail; null without one."""
        behind = F.instr(F.reverse(tail), mark[::-1])
        return F.when(behind > 0, F.lit(limit) - behind - len(mark) + 1)

    trimmed = lambda c: F.regexp_replace(c, rf"{blank}+\z", "")
    paragraph, sentence = last("\n\n"), F.coalesce(*[last(mark) for mark in ends])
    cut = F.when(paragraph.isNotNull(), F.concat(trimmed(F.substring(head, F.lit(1), paragraph)), F.lit(f"\n\n{ev.PROMPT_CUT}")))
    cut = cut.when(sentence.isNotNull(), F.concat(F.substring(head, F.lit(1), sentence + 1), F.lit(f" {ev.PROMPT_CUT}")))
    return F.when(F.length(text) > limit, cut.otherwise(F.concat(trimmed(head), F.lit(f"… {ev.PROMPT_CUT}")))).otherwise(text)


def verified_ids(refs: Column) -> Column:
    """References whose label names an id that their url doesn't hold go."""
    ids = lambda r: F.regexp_extract_all(F.upper(r["label"]), F.lit(r"\b(CVE-\d{4}-\d{4,7}|ADV\d{6}|AA\d{2}-\d{2,3}[A-Z]?|CERT-UA#\d+|KB\d{6,})\b"), F.lit(1))
    return F.filter(refs, lambda r: F.forall(ids(r), lambda i: F.contains(F.upper(r["url"]), F.regexp_replace(i, "^CERT-UA#", ""))))


def proxied(url: Column, proxy: str, hosts=ev.PROXIED_HOSTS) -> Column:
    """Urls of listed hosts, encoded, behind the proxy."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return F.when(host.isin(*hosts) & F.lit(bool(proxy)), F.concat(F.lit(proxy), F.replace(F.url_encode(url), F.lit("+"), F.lit("%20")))).otherwise(url)


def entry_time(*columns: Column, now: Column) -> Column:
    """The first time that can be read, as UTC, else now."""
    formats = ("d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    plain = [F.regexp_replace(F.replace(c, F.lit(" GMT"), F.lit(" +0000")), "^[A-Za-z]{3}, ", "") for c in columns]
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for c in plain for f in formats], now)


def iso_time(ts: Column) -> Column:
    """2024-01-31T00:00:00+00:00, with microseconds where there are any."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(base, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def public() -> list[Column]:
    """The 18 fields of an item that others see: scores of three digits, times as text."""
    short = ("threat_score", "category_confidence", "audience_relevance_score", "actionability_score", "source_credibility_score")
    names = (
        "title", "source", "url", "published_at", "raw_content", "threat_score", "language", "original_language", "category", "category_confidence", "affected_platforms", "audience_targets",
        "audience_relevance_score", "actionability_level", "actionability_score", "source_tier", "source_credibility_score", "corroborating_sources",
    )
    return [iso_time(F.col(c)).alias(c) if c == "published_at" else F.round(c, 3).alias(c) if c in short else F.col(c) for c in names]


def target_fingerprint(text: Column) -> Column:
    """The last fingerprint of 16 hex digits in an id or a link, else null."""
    return F.try_element_at(F.regexp_extract_all(F.trim(text), F.lit(r"\b([0-9a-f]{16})\b"), F.lit(1)), F.lit(-1))


def valid_feedback() -> Column:
    signals = ("useful", "not_useful", "unclear", "wrong", "outdated")
    return F.length("id").between(1, 64) & F.col("locale").isin("en", "ua") & F.col("signal").isin(*signals)


def resolve_language(override: Column, forced: Column, own: Column) -> Column:
    """The first of the three that is a feed language, else en."""
    return F.coalesce(*[F.when(c.isin("en", "ua"), c) for c in (override, forced, own)], F.lit("en"))


def json_object(text: Column) -> Column:
    """From the first brace to the last: the object that free text is wrapped around."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def isolated_json(text: Column) -> Column:
    """The first whole object in free text: from its brace to the one that closes it; braces in strings don't count. Null without one."""
    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        import re

        piece = re.compile(r'"(?:\\.|[^"\\])*"|[{}]', re.DOTALL)

        def one(value: str | None) -> str | None:
            start, depth = (value or "").find("{"), 0
            for m in piece.finditer(value, start) if start >= 0 else ():
                depth += {"{": 1, "}": -1}.get(m[0], 0)
                if depth == 0:
                    return value[start : m.end()]
            return None

        return pa.array([one(t) for t in texts.to_pylist()], pa.string())

    return of(text)


def with_template(rows: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Adds template: the most specific of (language, category, audience) down to the English default.

    The registry is a fixed list, so it is a literal array and no join.
    """
    every = literal_array("|".join(t) for t in templates)
    key = lambda *parts: F.concat_ws("|", *parts)
    lang, cat, aud, default, general = F.col("language"), F.col("category"), F.col("audience"), F.lit("default"), F.lit("general")
    chain = F.array(key(lang, cat, aud), key(lang, cat, general), key(lang, default, aud), key(lang, default, general), F.lit("en|default|general"))
    return rows.withColumn("template", F.get(F.filter(chain, lambda k: F.array_contains(every, k)), F.lit(0)))
