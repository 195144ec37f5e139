"""Briefs and lists of a card, put together from facts; no text of the source is read.

Category pools (what to do, what to avoid, why it matters, platform hints) are editorial copy and so a
parameter: CopyTables takes them as plain dictionaries or from a table of rows. Without them the general
actions serve.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilflow.functions import copy_vocab as cv
from vigilflow.functions.text import literal_array
from vigilflow.operators import render

WORDS = {
    "en": (cv.VERBS_EN, cv.URGENT_VERB_EN, cv.NOUNS_EN, cv.PLATFORM_PHRASE_EN, cv.AUDIENCE_PHRASES_EN, cv.AUDIENCE_NAMES_EN, cv.ACTIONS_EN, "and"),
    "ua": (cv.VERBS_UA, cv.URGENT_VERB_UA, cv.NOUNS_UA, cv.PLATFORM_PHRASE_UA, cv.AUDIENCE_PHRASES_UA, cv.AUDIENCE_NAMES_UA, cv.ACTIONS_UA, "та"),
}


@dataclass(frozen=True)
class CopyTables:
    """Pools by key: actions and avoids by category, why by 'category|bucket', hints by lower-case platform."""

    actions: dict[str, list[str]] = field(default_factory=dict)
    avoids: dict[str, list[str]] = field(default_factory=dict)
    why: dict[str, list[str]] = field(default_factory=lambda: {"default|fyi": [""]})
    hints: dict[str, list[str]] = field(default_factory=dict)

    @staticmethod
    def from_rows(rows: DataFrame, most: int = 10_000) -> CopyTables:
        """From a dimension table (kind, key, position, text): a few hundred lines of copy; a table above the bound is an error."""
        pools: dict[str, dict[str, list[str]]] = {"actions": {}, "avoids": {}, "why": {}, "hints": {}}
        lines = rows.orderBy("kind", "key", "position").limit(most + 1).collect()
        if len(lines) > most:
            raise ValueError(f"a copy table of more than {most} rows")
        for r in lines:
            pools[r["kind"]].setdefault(r["key"], []).append(r["text"])
        return CopyTables(**{k: v for k, v in pools.items() if v})


def _pools(table: dict[str, list[str]]) -> Column:
    if not table:
        return F.create_map().cast("map<string,array<string>>")
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), literal_array(v))])


def seed(fingerprint: Column) -> Column:
    return F.coalesce(F.conv(F.substring(fingerprint, 1, 8), 16, 10).cast("long"), F.lit(0))


def rotate(pool: Column, fingerprint: Column, n: int, salt: int = 0) -> Column:
    """n of a pool column from where the fingerprint points; the whole pool if it has no more."""
    start = ((seed(fingerprint) + F.lit(salt * 0x9E3779B9)) % F.greatest(F.size(pool), F.lit(1)) + 1).cast("int")
    return F.when(F.size(pool) <= n, pool).otherwise(F.slice(F.concat(pool, pool), start, n))


def _names(names: Column, conjunction: str) -> Column:
    return F.when(F.size(names) == 1, F.get(names, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(1))), ", "), F.lit(f" {conjunction} "), F.element_at(names, -1)))


def brief(language: str = "en") -> Column:
    """One sentence: source, verb, category, and platforms or audience."""
    verbs, urgent, nouns, platform, audiences, _, _, conjunction = WORDS[language]
    verb = F.when(F.col("actionability_level") == "urgent_action", urgent).otherwise(F.get(rotate(literal_array(verbs), F.col("fingerprint"), 1, salt=42), F.lit(0)))
    table = F.create_map(*[F.lit(x) for pair in nouns.items() for x in pair])
    head, tail = platform.split("{platforms}")
    targets = F.create_map(*[F.lit(x) for pair in audiences.items() for x in pair])
    names = F.col("affected_platforms")
    target = F.when(F.size(names) > 0, F.concat(F.lit(head), _names(names, conjunction), F.lit(tail))).otherwise(F.coalesce(F.try_element_at(targets, F.get("audience_targets", F.lit(0))), F.lit("")))
    return F.concat(F.col("source"), F.lit(" "), verb, F.lit(" "), F.coalesce(F.try_element_at(table, F.col("category")), F.lit(nouns["default"])), target, F.lit("."))


def affected_users(language: str = "en") -> Column:
    names, labels = F.col("affected_platforms"), WORDS[language][5]
    who = F.when(F.size(names) > 0, F.concat(F.when(F.size(names) <= 2, _names(names, "and")).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), F.size(names) - 1), ", "), F.lit(", and "), F.element_at(names, -1))), F.lit(cv.USERS_OF)))
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    told = F.transform("audience_targets", lambda a: F.coalesce(F.try_element_at(table, a), F.initcap(F.replace(a, F.lit("_"), F.lit(" ")))))
    every = F.array_distinct(F.concat(F.filter(F.array(who), lambda x: x.isNotNull()), told))
    return F.when(F.size(every) > 0, every).otherwise(F.array(F.lit(cv.ANYONE)))


def what_to_do(tables: CopyTables, language: str = "en", n: int = 3) -> Column:
    """n of the category's pool, a hint for the first known platform before them."""
    fp, hints = F.col("fingerprint"), _pools(tables.hints)
    pool = F.coalesce(F.try_element_at(_pools(tables.actions), F.col("category")), literal_array(WORDS[language][6]))
    actions = rotate(pool, fp, n)
    known = F.get(F.filter(F.transform("affected_platforms", lambda p: F.try_element_at(hints, F.lower(p))), lambda x: x.isNotNull()), F.lit(0))
    hint = F.get(rotate(known, fp, 1), F.lit(0))
    return F.when(hint.isNotNull() & ~F.array_contains(actions, hint), F.concat(F.array(hint), F.slice(actions, 1, n - 1))).otherwise(actions)


def what_not_to_do(tables: CopyTables, n: int = 2) -> Column:
    pool = F.coalesce(F.try_element_at(_pools(tables.avoids), F.col("category")), F.array().cast("array<string>"))
    return rotate(pool, F.col("fingerprint"), n, salt=1)


def why_it_matters(tables: CopyTables) -> Column:
    """The category's line for the urgency, else the default for it, else the default for fyi."""
    bucket = render.urgency(F.col("actionability_level"), F.col("threat_score"))
    why = _pools(tables.why)
    pool = F.coalesce(F.try_element_at(why, F.concat_ws("|", "category", bucket)), F.try_element_at(why, F.concat(F.lit("default|"), bucket)), F.try_element_at(why, F.lit("default|fyi")))
    return F.get(rotate(pool, F.col("fingerprint"), 1), F.lit(0))


def cards(items: DataFrame, tables: CopyTables | None = None, language: str = "en") -> DataFrame:
    """Rule-based posts of scored items: every field of a card."""
    tables = tables or CopyTables()
    level = render.threat_level(F.col("actionability_level"), F.col("threat_score"))
    return items.select(
        "fingerprint", F.lit(language).alias("locale"), F.col("title"), brief(language).alias("short_summary"), level.alias("threat_level"), why_it_matters(tables).alias("why_it_matters"),
        affected_users(language).alias("affected_users"), what_to_do(tables, language).alias("what_to_do"), what_not_to_do(tables).alias("what_not_to_do"),
        F.round(render.emotional_weight(F.col("actionability_score"), F.col("threat_score"), F.col("source_credibility_score")), 3).alias("emotional_weight"),
        render.reading_seconds(F.col("raw_content")).alias("reading_time_seconds"), render.references(F.col("raw_content")).alias("references"), F.lit("rule_based").alias("generated_by"),
    )


def with_context(posts: DataFrame, contexts: DataFrame) -> DataFrame:
    """Posts (category, locale) with context, a map of section to text from a table (category, locale, section, text); an empty map where there is none.

    The table is summed to one row a key first, so no post is repeated; Spark broadcasts it as far as it is small.
    """
    sections = contexts.groupBy("category", "locale").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "text")))).alias("context"))
    none = F.create_map().cast("map<string,string>")
    return posts.join(sections, ["category", "locale"], "left").withColumn("context", F.coalesce("context", none))
