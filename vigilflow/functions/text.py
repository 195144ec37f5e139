"""Text functions as Column expressions; all but safe_text stay in the JVM."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilflow.functions import vocab
from vigilflow.session import show_workers

TOKEN = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
MAX_BODY = 3000
SEPARATOR = "\x1f"


def literal_array(values) -> Column:
    """A constant array of strings. It is split from one literal, which the optimizer folds: a literal for each value takes longer to plan than to run."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    if any(SEPARATOR in v for v in values):
        return F.array(*[F.lit(v) for v in values])
    return F.split(F.lit(SEPARATOR.join(values)), SEPARATOR)


def strip_html(text: Column) -> Column:
    """Tags to spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens: letters and digits, parts joined by hyphens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def title_tokens(title: Column) -> Column:
    """Tokens of three letters or more that aren't stop words."""
    stop = literal_array(vocab.STOPWORDS)
    return F.filter(tokens(title), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def term_classes(terms) -> tuple[list[str], list[str], list[str]]:
    """Terms as (whole tokens, phrases, stems)."""
    stems = [t[:-1] for t in terms if t.endswith("*") and len(t) > 1]
    rest = [t for t in terms if not t.endswith("*")]
    phrases = [t for t in rest if " " in t or "-" in t]
    return [t for t in rest if t not in phrases], phrases, stems


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, wherever the optimizer puts the whole."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def detect_language(text: Column) -> Column:
    """en, ua, other (Cyrillic without Ukrainian letters) or unknown (under four letters). Only texts with Cyrillic letters are counted out."""
    def decide(t: Column) -> Column:
        counts = F.struct(_count(t, r"[^Ѐ-ӿ]+").alias("cyrillic"), _count(t, "[^A-Za-z]+").alias("latin"))
        share = let(counts, lambda c: F.when(c["cyrillic"] + c["latin"] < 4, "unknown").when(c["cyrillic"] / (c["cyrillic"] + c["latin"]) < 0.3, "en").when(t.rlike("[їєґіЇЄҐІ]"), "ua").otherwise("other"))
        return F.when(t.rlike("[Ѐ-ӿ]"), share).when(t.rlike("(?:[A-Za-z][^A-Za-z]*+){4}"), "en").otherwise("unknown")

    return let(F.coalesce(text, F.lit("")), decide)


def wrong_script(text: Column, language: Column) -> Column:
    """Four letters or more, under 30 % of them in the language's script."""
    text = F.coalesce(text, F.lit(""))
    cyrillic, latin = _count(text, r"[^Ѐ-ӿ]+"), _count(text, r"[^A-Za-zÀ-ɏ]+")
    total = cyrillic + latin
    share = F.when(language == "ua", cyrillic).when(language == "en", latin) / total
    return F.coalesce((total >= 4) & (share < 0.30), F.lit(False))


def clean_body(text: Column) -> Column:
    """Feed junk out, white space collapsed, cut near 3000 characters at a sentence where one ends past 2250."""
    for pattern in vocab.JUNK:
        text = F.regexp_replace(text, "(?imduU)" + pattern, " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")
    head = F.substring(text, 1, MAX_BODY)
    cut = F.length(F.regexp_extract(head, r"(?s)^(.*)\. ", 1))
    at = F.when(F.contains(head, F.lit(". ")), cut).otherwise(-1)
    return F.when(F.length(text) <= MAX_BODY, text).when(at > MAX_BODY * 0.75, F.substring(text, F.lit(1), at + 1)).otherwise(head)


def _safe(value: str | None) -> str:
    import html
    import re
    import unicodedata

    value = html.unescape(unicodedata.normalize("NFC", value or ""))
    if not value.isprintable():
        value = re.sub("[\x00-\x1f\x7f-\x9f]", " ", re.sub("[\ud800-\udfff]", "", value))
    return re.sub(r"\s+", " ", value).strip()


def safe_text(text: Column) -> Column:
    """NFC, HTML entities, control characters to blanks, white space collapsed. Spark has no NFC: one Arrow function."""
    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([_safe(v) for v in texts.to_pylist()], pa.string())

    return of(text)


def fold(text: str) -> str:
    """Letters as patterns that don't mind the case take them: also the long s, the Kelvin sign and the i without a dot."""
    return text.casefold().replace("ı", "i")


def may_hold(folded: str, needs: tuple[str, ...]) -> bool:
    """Whether a folded text has the words of any of the needs of a junk pattern."""
    return any(all(word in folded for word in n.split("&")) for n in needs)


def safe_body(text: Column) -> Column:
    """clean_body() of safe_text(), in one Arrow function: a junk pattern is tried only on texts that hold a word that it needs."""
    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        import re

        rules = [(needs, re.compile(pattern, re.IGNORECASE | re.MULTILINE)) for needs, pattern in zip(vocab.JUNK_NEEDS, vocab.JUNK, strict=True)]

        def one(value: str | None) -> str:
            body = _safe(value)
            folded = fold(body)
            for needs, pattern in rules:
                if may_hold(folded, needs):
                    body = pattern.sub(" ", body)
            body = re.sub(r"\s+", " ", body).strip()
            if len(body) <= MAX_BODY:
                return body
            head = body[:MAX_BODY]
            at = head.rfind(". ")
            return head[: at + 1] if at > MAX_BODY * 0.75 else head

        return pa.array([one(v) for v in texts.to_pylist()], pa.string())

    return of(text)


def normalized_news(news: DataFrame) -> DataFrame:
    """Rows with title and body cleaned, and the language of both; original_language where it isn't known yet."""
    show_workers(news.sparkSession)
    rows = news.withColumns({"title": safe_text(F.col("title")), "raw_content": safe_body(F.col("raw_content"))})
    rows = rows.withColumn("language", detect_language(F.concat_ws("\n", "title", "raw_content")))
    if "original_language" in news.columns:
        known = F.nullif(F.nullif(F.col("original_language"), F.lit("")), F.lit("unknown"))
        return rows.withColumn("original_language", F.coalesce(known, F.col("language")))
    return rows.withColumn("original_language", F.col("language"))


def trim_at_word(text: Column, limit: int) -> Column:
    """At most limit characters, cut at a blank past 60 % of it; trailing ,.:;- go."""
    head = F.substring(text, 1, limit)
    at = F.length(F.regexp_extract(head, "(?s)^(.*) ", 1))
    cut = F.when(F.contains(head, F.lit(" ")) & (at >= limit * 0.6), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.regexp_replace(cut, "[,.:;-]+$", ""))


def url_fingerprint(url: Column, title: Column) -> Column:
    chosen = F.when(F.length(url) > 0, url).otherwise(title)
    clean = F.lower(F.regexp_replace(chosen, r"(?U)^\s+|\s+$", ""))
    return F.substring(F.sha2(clean.cast("binary"), 256), 1, 16)


def jaccard(a: Column, b: Column) -> Column:
    """Of two lists without repeats."""
    def of(p: Column) -> Column:
        n, m, both = F.size(p["a"]), F.size(p["b"]), F.size(F.array_intersect(p["a"], p["b"]))
        return F.when((n == 0) | (m == 0), 0.0).otherwise(both / (n + m - both))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def word_shingles(toks: Column, n: int = 5) -> Column:
    """Distinct runs of n tokens, in order, joined by blanks; none of fewer tokens."""
    runs = F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.array_join(F.slice(toks, i, n), " "))
    return F.when(F.size(toks) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))
