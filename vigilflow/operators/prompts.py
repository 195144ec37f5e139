"""Prompts of a text provider: what it is told once for a language and template, and what it is told of each item.

Personas, style notes, rules and the language's directive are editorial copy and so a parameter, as pools are
(copy.CopyTables). The first prompt holds nothing of an item, so that a provider can keep it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilflow.functions import editorial as ed
from vigilflow.functions import editorial_vocab as ev


@dataclass(frozen=True)
class Persona:
    """The copy of a template: who writes, how, and what else to heed."""

    persona: str
    style_notes: str
    extra_guidance: str = ""


@dataclass(frozen=True)
class Rules:
    """The copy of a language: rules for every post, the directive on the language, the form of the answer, and the reminder behind a text in another one."""

    shared: str
    directive: str
    form: str
    reminder: str = ""


def system_prompt(template: str, persona: Persona, rules: Rules, language: str) -> str:
    """What a template and a language say; the same text for every item of both."""
    parts = [persona.persona, f"{ev.PROMPT_STYLE}{persona.style_notes}", f"{ev.PROMPT_GUIDANCE}{persona.extra_guidance}" if persona.extra_guidance else "", rules.shared, rules.directive]
    return "\n\n".join([p for p in parts if p] + ["\n".join((f"{ev.PROMPT_TEMPLATE}{template}", f"{ev.PROMPT_LANGUAGE}{language}", rules.form))])


def user_prompt(language: str, reminder: str = "") -> Column:
    """What is told of a scored item; rows need audience, the one of its template. A reminder follows texts in another language."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("—")
    labels = F.create_map(*[F.lit(x) for pair in ev.PROMPT_AUDIENCES.items() for x in pair])
    own = F.when(F.col("language").isin("en", "ua"), F.col("language")).otherwise("en")
    facts = {
        "source": F.format_string("%s (tier: %s, credibility: %.2f)", "source", "source_tier", "source_credibility_score"),
        "published": ed.iso_time(F.col("published_at")),
        "category": F.format_string("%s (confidence: %.2f)", "category", "category_confidence"),
        "platforms": listed("affected_platforms"), "audiences": listed("audience_targets"),
        "actionability": F.format_string("%s (%.2f)", "actionability_level", "actionability_score"),
        "threat_score": F.format_string("%.1f/100", "threat_score"), "detected_language": F.coalesce("language", F.lit("unknown")),
        "target_audience_label": F.coalesce(F.try_element_at(labels, F.col("audience")), F.replace("audience", F.lit("_"), F.lit(" "))),
    }
    told = [part for name, value in facts.items() for part in (F.lit(f"- {name}: "), value, F.lit("\n"))]
    article = [F.lit(ev.PROMPT_TITLE), F.col("title"), F.lit(ev.PROMPT_TEXT), ed.source_excerpt(F.col("raw_content")), F.lit("\n")]
    return F.concat(F.lit(ev.PROMPT_FACTS), *told, *article, F.when(own != language, reminder).otherwise(""), F.lit(ev.PROMPT_CLOSE))


def prompts(items: DataFrame, personas: dict[str, Persona], rules: Rules, language: str = "en", preferred: str | None = None) -> DataFrame:
    """(fingerprint, template, system, user) of scored items: the most specific template of those that there are, and both prompts."""
    rows = items.withColumn("audience", ed.pick_audience(F.col("audience_targets"), preferred))
    chosen = ed.with_template(rows.withColumn("_own", F.col("language")).withColumn("language", F.lit(language)), [tuple(t.split("|")) for t in personas]).withColumn("language", F.col("_own"))
    system = F.create_map(*[F.lit(x) for t, p in personas.items() for x in (t, system_prompt(t, p, rules, language))])
    return chosen.select("fingerprint", "template", F.try_element_at(system, F.col("template")).alias("system"), user_prompt(language, rules.reminder).alias("user"))
