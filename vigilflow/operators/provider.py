"""Optional language-model hooks: a relevance classifier for the gray zone, a provider for posts. The default is none.

Both are plain callables over a batch of dictionaries, built once per task by a factory; they see only the rows
that the rules leave open. What a callable raises makes its batch fall back to the rules, never fail.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilflow.functions import editorial as ed
from vigilflow.operators import copy, enrich, render

#: A factory gives a callable: rows in, one verdict (or None) for each out.
Factory = Callable[[], Callable[[list[dict]], list]]


def with_verdicts(decided: DataFrame, factory: Factory | None = None) -> DataFrame:
    """Rows of enrich.decision() (path, score) with is_relevant; gray rows (ai-disabled) ask the classifier, if there is one.

    A verdict is True or False: path ai-accept or ai-reject; an error: ai-error and the rules' threshold.
    """
    if factory is None:
        return decided.withColumn("is_relevant", enrich.accepted(F.col("path"), F.col("score")))
    gray = decided.filter("path = 'ai-disabled'")
    rest = decided.filter("path <> 'ai-disabled'").withColumn("is_relevant", enrich.accepted(F.col("path"), F.col("score")))

    def ask(frames: Iterator):
        classify = factory()
        for frame in frames:
            rows = frame.to_dict("records")
            try:
                verdicts = classify(rows)
            except Exception:
                verdicts = [None] * len(rows)
            frame["path"] = ["ai-error" if v is None else "ai-accept" if v else "ai-reject" for v in verdicts]
            frame["is_relevant"] = [bool(s >= 3) if v is None else bool(v) for v, s in zip(verdicts, frame["score"], strict=True)]
            yield frame

    schema = gray.withColumn("is_relevant", F.lit(True)).schema
    return rest.unionByName(gray.mapInPandas(ask, schema))


#: What a provider may write of a post; the card gives what it leaves out.
TEXTS = ("title", "short_summary", "why_it_matters", "detail_body")
LISTS = ("affected_users", "what_to_do", "what_not_to_do", "quick_facts")
WRITTEN = (*TEXTS, *LISTS, "emotional_weight", "reading_time_seconds")
POST = ("fingerprint", "locale", "title", "short_summary", "why_it_matters", "generated_by")


def edited(written: DataFrame, language: str) -> DataFrame:
    """Posts of a provider as they are checked: Ukrainian words by the glossary, then without fluff and repeats."""
    if language == "ua":
        between = "\x1f"
        listed = lambda c: F.when(F.size(c) > 0, F.split(ed.ukrainian(F.array_join(c, between)), between)).otherwise(F.col(c))
        written = written.withColumns({c: ed.ukrainian(F.col(c)) for c in TEXTS} | {c: listed(c) for c in LISTS})
    return ed.refined(written, language)


def generate(items: DataFrame, cached: DataFrame, language: str = "en", provider: Factory | None = None, tables: copy.CopyTables | None = None) -> tuple[DataFrame, DataFrame]:
    """(posts, to_cache) of items in a language: cached ones as they are; else the provider's that pass the checks; else rule-based.

    Only the provider's are cached. It gives title, short_summary and why_it_matters for each row, or None, and any other
    of WRITTEN. What it gives is edited(), then checked, then brought within a card's bounds; what fails, or raises, is
    written by the rules.
    """
    have = cached.filter(F.col("locale") == language).select(*POST)
    missing = items.join(have.select("fingerprint"), "fingerprint", "left_anti")
    cards = copy.cards(missing, tables, language)
    plain = cards.select(*POST)
    if provider is None:
        return items.select("fingerprint").join(have, "fingerprint").unionByName(plain), plain.limit(0)

    def ask(frames: Iterator):
        write = provider()
        for frame in frames:
            try:
                texts = write(frame.to_dict("records"))
            except Exception:
                texts = [None] * len(frame)
            for name in WRITTEN:
                needed = name in ("title", "short_summary", "why_it_matters")
                frame[name] = [None if t is None else t.get(name, None if needed else old) for t, old in zip(texts, frame[name], strict=True)]
            yield frame[frame["title"].notna() & frame["short_summary"].notna() & frame["why_it_matters"].notna()]

    wide = cards.join(missing.select("fingerprint", F.col("title").alias("source_title"), F.col("raw_content").alias("source_body")), "fingerprint")
    wide = wide.withColumns({"detail_body": F.lit(""), "quick_facts": F.array().cast("array<string>")}).drop("references", "generated_by")
    written = edited(wide.mapInPandas(ask, wide.schema), language)
    written = render.with_tokens(written, summary_tokens=F.col("short_summary"), why_tokens=F.col("why_it_matters"), source_tokens=F.col("source_body"))
    good = render.clamped(written.withColumn("reason", render.failure_reason(F.col("locale"))).filter("reason is null")).withColumn("generated_by", F.lit("llm")).select(*POST)
    rest = plain.join(good.select("fingerprint"), "fingerprint", "left_anti")
    return items.select("fingerprint").join(have, "fingerprint").unionByName(good).unionByName(rest), good
