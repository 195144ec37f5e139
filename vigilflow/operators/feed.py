"""Feeds over items and their rendered posts: gates, coverage, two-step rankings, facets, related items, publishing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilflow.functions import text as tx

LEVEL_WEIGHT = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}


def level_weight(level: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in LEVEL_WEIGHT.items() for x in pair])[level], F.lit(0))


def fits_locale(language: Column, locale: str) -> Column:
    known = F.coalesce(F.nullif(language, F.lit("")), F.lit("en"))
    return known == "en" if locale == "en" else known.isin("en", "ua")


def in_window(published_at: Column, now: str, locale: str | None = None, language: Column | None = None) -> Column:
    """At most 30 days old; 90 for Ukrainian."""
    days = F.lit(90 if locale in ("ua", "uk") else 30) if locale or language is None else F.when(language.isin("ua", "uk"), 90).otherwise(30)
    return published_at >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(days)


def covered(items: DataFrame, posts: DataFrame, locale: str) -> DataFrame:
    """Items with a post in the locale, and its title, summary and level."""
    own = posts.filter(F.col("locale") == locale).select("fingerprint", F.col("title").alias("post_title"), "short_summary", "threat_level")
    return items.join(own, "fingerprint")


def feed(items: DataFrame, posts: DataFrame, locale: str, limit: int = 30) -> DataFrame:
    """Newest covered items; the limit comes before the check that the post reads in the locale's script."""
    rows = covered(items.filter(fits_locale(F.col("language"), locale)), posts, locale)
    return rows.orderBy(F.desc("published_at"), "fingerprint").limit(limit).filter(~tx.wrong_script(F.col("post_title"), F.lit(locale)))


def trending(items: DataFrame, posts: DataFrame, locale: str, now: str, limit: int = 5) -> DataFrame:
    """A cut of candidates by score, then the most severe of those with a post."""
    rows = items.filter(in_window(F.col("published_at"), now, locale) & fits_locale(F.col("language"), locale))
    pool = rows.orderBy(F.desc("threat_score"), F.desc("actionability_score"), F.desc("published_at"), "fingerprint").limit(max(limit * 3, 30))
    return danger(covered(pool, posts, locale), limit)


def danger(rows: DataFrame, limit: int = 5) -> DataFrame:
    return rows.orderBy(level_weight(F.col("threat_level")).desc(), F.desc("actionability_score"), F.desc("published_at"), "fingerprint").limit(limit)


def health(items: DataFrame, now: str) -> DataFrame:
    urgent = F.when(F.col("actionability_level") == "urgent_action", F.col("published_at"))
    facts = items.agg(F.count("*").alias("total"), F.max("published_at").alias("newest"), F.max(urgent).alias("newest_urgent"))
    since = lambda c: F.floor((F.unix_seconds(F.to_timestamp(F.lit(now))) - F.unix_seconds(c)) / 60)
    return facts.withColumns({"minutes_since": since(F.col("newest")), "minutes_since_urgent": since(F.col("newest_urgent"))})


@dataclass(frozen=True)
class FilterState:
    """Any-of lists, an empty one meaning no constraint, and a query."""

    threat_levels: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    actionability: tuple[str, ...] = ()
    platforms: tuple[str, ...] = ()
    audiences: tuple[str, ...] = ()
    query: str = ""
    _columns: dict = field(default_factory=dict, repr=False, compare=False)

    def predicate(self) -> Column:
        test = F.lit(True)
        for column, values in (("threat_level", self.threat_levels), ("category", self.categories), ("actionability_level", self.actionability)):
            if values:
                test = test & F.col(column).isin(*values)
        for column, values in (("affected_platforms", self.platforms), ("audience_targets", self.audiences)):
            if values:
                test = test & F.arrays_overlap(column, tx.literal_array(values))
        if self.query.strip():
            # Title and summary as the reader sees them; a search may reach over the line end between them.
            test = test & F.contains(F.lower(F.concat(F.coalesce("post_title", F.lit("")), F.lit("\n"), F.coalesce("short_summary", F.lit("")))), F.lit(self.query.strip().lower()))
        return test

    def active(self) -> int:
        """How many filters are set."""
        lists = (self.threat_levels, self.categories, self.actionability, self.platforms, self.audiences)
        return sum(len(x) for x in lists) + bool(self.query.strip())


# Ready-made filters, each from an empty state.
PRESETS = {
    "most_relevant": FilterState(),
    "critical": FilterState(threat_levels=("Critical", "High")),
    "scams_phishing": FilterState(categories=("phishing", "scam", "social engineering")),
    "normal_users": FilterState(audiences=("normal_users", "mobile_users", "crypto_users")),
    "enterprise": FilterState(audiences=("enterprise", "sysadmins")),
    "mobile": FilterState(audiences=("mobile_users",), platforms=("Android", "iOS")),
    "account_security": FilterState(categories=("phishing", "breach", "data leak")),
}

# Signals as chips, the most telling first.
CHIP_ORDER = (
    "active_exploitation", "affects_email_accounts", "credential_theft_risk", "steals_sessions", "financial_risk", "data_exposure_risk", "malware_delivery", "enterprise_risk", "consumer_risk",
)


def preset_counts(rows: DataFrame) -> DataFrame:
    """(preset, n): how many rows each ready-made filter leaves; one pass over the rows."""
    counts = rows.agg(*[F.count_if(state.predicate()).alias(name) for name, state in PRESETS.items()])
    return counts.unpivot([], list(PRESETS), "preset", "n")


def chips(most: int = 3) -> Column:
    """The first signals that are on, in the order of the chips."""
    return F.slice(F.array_compact(F.array(*[F.when(F.col(name), name) for name in CHIP_ORDER])), 1, most)


def relative_time(then: Column, now: Column) -> Column:
    """just now, and then whole minutes, hours or days as 5m, 3h, 2d; a time to come is just now, none is a dash."""
    minutes = F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(then)) / 60_000_000)).cast("long")
    text = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return F.when(then.isNull(), "—").when(minutes < 1, "just now").when(minutes < 60, text(minutes, "m")).when(minutes < 1440, text(minutes / 60, "h")).otherwise(text(minutes / 1440, "d"))


def quality_problem(title: Column, summary: Column, locale: Column) -> Column:
    """Why a post may not be sent in a locale, else null. A null title means that there is no translation."""
    named = lambda text, after: F.concat(F.lit(text), F.lit("'"), locale, F.lit(f"'{after}"))
    head, body = F.trim(title), F.trim(F.coalesce(summary, F.lit("")))
    return (
        F.when(title.isNull(), named("no ", " translation"))
        .when(head == "", "empty title")
        .when(tx.wrong_script(head, locale), named("title in wrong script for ", ""))
        .when((body != "") & tx.wrong_script(body, locale), named("summary in wrong script for ", ""))
    )


def top_threats(items: DataFrame, n: int = 10) -> DataFrame:
    """The n items of the highest scores; equal scores by fingerprint."""
    return items.orderBy(F.desc("threat_score"), "fingerprint").limit(n)


def latest_of_locale(posts: DataFrame, locale: str, n: int = 15) -> DataFrame:
    """The newest posts of a locale by the time of their items; those without one come last."""
    return posts.filter(F.col("locale") == locale).orderBy(F.col("published_at").desc_nulls_last(), "fingerprint").limit(n)


def facets(rows: DataFrame) -> DataFrame:
    """(facet, value) of all values that occur; one pass over the rows, merged before the shuffle."""
    pair = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))
    every = F.concat(pair("category", F.array("category")), pair("platform", F.col("affected_platforms")), pair("audience", F.col("audience_targets")))
    return rows.select(F.explode(every).alias("f")).select("f.*").distinct()


def related(pool: DataFrame, most: int = 4) -> DataFrame:
    """Each item's most alike items of a pool: same category 3, shared platforms and audiences up to 2 each; equal scores newest first.

    The score depends on signatures alone (category, platforms, audiences), so signatures meet and items don't: each signature
    keeps its newest items, most + 1 of them, as an item isn't related to itself; the best of all signatures like one's own are
    ranked once a signature, and every item takes that list less itself. Work grows with items and with pairs of distinct
    signatures that share something. fingerprint is the pool's key.
    """
    lists = {c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))) for c in ("affected_platforms", "audience_targets")}
    signed = pool.select("fingerprint", "published_at", F.struct(F.col("category"), *[v.alias(c) for c, v in lists.items()]).alias("signature"))
    newest = Window.partitionBy("signature").orderBy(F.desc("published_at"), "fingerprint")
    heads = signed.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= most + 1).drop("place")
    tag = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(kind), v))
    keys = F.concat(tag("c:", F.array_compact(F.array("signature.category"))), tag("p:", F.col("signature.affected_platforms")), tag("a:", F.col("signature.audience_targets")))
    mine = signed.select("signature").distinct().withColumn("keys", keys).withColumn("key", F.explode("keys"))
    theirs = mine.select(F.col("signature").alias("other"), F.col("keys").alias("o_keys"), "key")
    share = lambda c: F.least(F.lit(2), F.size(F.array_intersect(f"signature.{c}", f"other.{c}")))
    score = F.when(F.col("signature.category") == F.col("other.category"), 3).otherwise(0) + share("affected_platforms") + share("audience_targets")
    alike = mine.join(theirs, "key").filter(F.get(F.array_intersect("keys", "o_keys"), F.lit(0)) == F.col("key")).select("signature", "other", score.alias("score"))
    best = Window.partitionBy("signature").orderBy(F.desc("score"), F.desc("published_at"), "fingerprint")
    found = alike.join(heads.withColumnRenamed("signature", "other"), "other").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most + 1)
    ranked = found.groupBy("signature").agg(F.array_sort(F.collect_list(F.struct("place", F.col("fingerprint").alias("o_fingerprint"), "score"))).alias("found"))
    others = F.slice(F.filter("found", lambda o: o["o_fingerprint"] != F.col("fingerprint")), 1, most)
    return signed.join(ranked, "signature").select("fingerprint", F.posexplode(others).alias("at", "o")).select("fingerprint", "o.o_fingerprint", "o.score", (F.col("at") + 1).alias("rank"))


def why_trending() -> Column:
    return (
        F.when(F.col("active_exploitation"), "active_exploitation")
        .when(F.col("threat_level") == "Critical", "critical")
        .when(F.col("actionability_level") == "urgent_action", "urgent")
        .when(F.size("corroborating_sources") > 0, "corroborated")
        .when(F.col("affects_email_accounts"), "email_accounts")
        .when(F.col("credential_theft_risk"), "credentials")
    )


def required_locales(language: Column) -> Column:
    return F.when(language == "ua", F.array(F.lit("ua"))).otherwise(F.array(F.lit("en"), F.lit("ua")))


def missing_manifest(items: DataFrame, posts: DataFrame, most_items: int | None = None) -> DataFrame:
    """(fingerprint, locale) that have no post yet; of the newest most_items items that lack any, all locales."""
    wanted = items.select("fingerprint", "published_at", F.explode(required_locales(F.col("language"))).alias("locale"))
    gaps = wanted.join(posts.select("fingerprint", "locale").distinct(), ["fingerprint", "locale"], "left_anti")
    if most_items is None:
        return gaps
    kept = gaps.select("fingerprint", "published_at").distinct().orderBy(F.desc("published_at"), "fingerprint").limit(most_items)
    return gaps.join(F.broadcast(kept.select("fingerprint")), "fingerprint", "left_semi")


def publish_outcomes(items: DataFrame, posts: DataFrame, ledger: DataFrame, locales: tuple[str, ...] = ("en", "ua"), tiers: tuple[str, ...] = ("trusted", "verified"), least_level: int = 3) -> DataFrame:
    """Each (item, locale) with its outcome: already, uncached, filtered, invalid or sent; the first test decides."""
    gated = items.filter(F.col("source_tier").isin(*tiers)).withColumn("locale", F.explode(tx.literal_array(locales)))
    known = F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("en"))
    gated = gated.filter(F.when(F.col("locale") == "en", known == "en").otherwise(known.isin("en", "ua")))
    p = posts.select("fingerprint", "locale", F.col("title").alias("post_title"), "threat_level", "short_summary")
    rows = gated.join(ledger.select("fingerprint", "locale").distinct().withColumn("_sent", F.lit(True)), ["fingerprint", "locale"], "left").join(p, ["fingerprint", "locale"], "left")
    bar = (level_weight(F.col("threat_level")) >= least_level) | (F.col("actionability_level") == "urgent_action")
    bad = (F.trim(F.coalesce("post_title", F.lit(""))) == "") | tx.wrong_script(F.col("post_title"), F.col("locale")) | tx.wrong_script(F.col("short_summary"), F.col("locale"))
    outcome = F.when(F.col("_sent"), "already").when(F.col("post_title").isNull(), "uncached").when(~bar, "filtered").when(bad, "invalid").otherwise("sent")
    return rows.withColumn("outcome", outcome)


def publish_selection(outcomes: DataFrame, per_channel: int = 5) -> DataFrame:
    """The first of each locale that may be sent, newest first: a top-k by locale."""
    order = Window.partitionBy("locale").orderBy(F.desc("published_at"), "fingerprint")
    return outcomes.filter("outcome = 'sent'").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_channel)


def telegram_message(base_url: str = "https://news.example") -> Column:
    """HTML of one post: level, title, summary (600 characters at most), first action and link."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = lambda c: F.regexp_replace(esc(c), r"\b([Cc][Vv][Ee]-[0-9]{4}-[0-9]{4,7})\b", '<a href="https://nvd.nist.gov/vuln/detail/$1">$1</a>')
    summary = F.trim("short_summary")
    summary = F.when(F.length(summary) > 600, F.concat(F.rtrim(F.substring(summary, 1, 599)), F.lit("…"))).otherwise(summary)
    emoji = F.when(F.col("threat_level") == "Critical", "🔴").when(F.col("threat_level") == "High", "🟠").when(F.col("threat_level") == "Medium", "🟡").when(F.col("threat_level") == "Low", "🟢").otherwise("⚪")
    more = F.when(F.col("locale") == "ua", "Читати більше").otherwise("Read more")
    link = F.concat(F.lit(f'🔗 <a href="{base_url.rstrip("/")}/'), F.col("locale"), F.lit("/threat/"), F.col("fingerprint"), F.lit('">'), more, F.lit("</a>"))
    action = F.when(F.size("what_to_do") > 0, F.concat(F.lit("✅ "), body(F.get("what_to_do", F.lit(0)))))
    return F.concat_ws("\n", F.concat(emoji, F.lit(" <b>"), body(F.trim("title")), F.lit("</b>")), F.when(summary != "", F.lit("")), F.when(summary != "", body(summary)), F.lit(""), action, link)
