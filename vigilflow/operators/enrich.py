"""Relevance, categories, platforms, audiences, actionability, credibility, signals and threat scores of news rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilflow.functions import lexicon as lx
from vigilflow.functions import text as tx
from vigilflow.functions import vocab
from vigilflow.session import show_workers, written

ALL_TERMS = tuple(dict.fromkeys((*vocab.STRONG, *vocab.MEDIUM, *vocab.WEAK)))
SIGNALS = (
    "active_exploitation", "credential_theft_risk", "financial_risk", "enterprise_risk", "consumer_risk",
    "requires_immediate_action", "affects_email_accounts", "steals_sessions", "data_exposure_risk", "malware_delivery",
)


RELEVANCE = (lx.keys(vocab.STRONG), lx.keys(vocab.MEDIUM), lx.keys(vocab.WEAK), lx.keys(vocab.NEGATIVE))
ACTIONS = (lx.keys(vocab.URGENT), lx.keys(vocab.RECOMMENDED), lx.keys(vocab.INFORMATIONAL))
CATEGORIES = {name: lx.keys(terms) for name, terms in vocab.CATEGORIES.items()}
PLATFORMS = {name: lx.aliases(terms) for name, terms in vocab.PLATFORMS.items()}
AUDIENCES = {name: lx.keys(profile["keywords"]) for name, profile in vocab.AUDIENCES.items()}
SEVERITY = {key: weight for phrase, weight in vocab.SEVERITY.items() for key in lx.phrases([phrase])}
SENSATIONAL = lx.phrases(vocab.SENSATIONAL)
SIGNAL_PHRASES = {name: lx.phrases(getattr(vocab, f"PHRASES_{name}")) for name in ("ACTIVE_EXPLOIT", "FINANCIAL", "ENTERPRISE", "EMAIL", "SESSION", "DATA_EXPOSURE", "MALWARE_DELIVERY")}
SIGNAL_WORDS = lx.phrases(("credential", "password", "mfa", "bypass"))

#: What each kind of question needs; a text is read for all that a query asks, at once.
FOR_RELEVANCE = lx.lexicon(*RELEVANCE)
FOR_CATEGORY = lx.lexicon(*CATEGORIES.values())
FOR_PLATFORMS = lx.lexicon(*PLATFORMS.values())
EVERYTHING = lx.lexicon(
    *RELEVANCE, *ACTIONS, *CATEGORIES.values(), *PLATFORMS.values(), *AUDIENCES.values(), SEVERITY, SENSATIONAL, *SIGNAL_PHRASES.values(), SIGNAL_WORDS
)


def with_text(news: DataFrame, words: lx.Lexicon = EVERYTHING) -> DataFrame:
    """Adds txt (lower-case title and body) and hits (the terms that it holds), once for all that follows.

    The generator around hits is a fence: a filter on what derives from them can't be pushed below and so
    put the reading of the text in place of each mention.
    """
    show_workers(news.sparkSession)
    rows = news.withColumn("txt", F.lower(F.concat_ws("\n", "title", "raw_content")))
    return rows.withColumn("hits", F.explode(F.array(words.hits(F.col("txt")))))


def relevance_score(hits: Column) -> Column:
    strong, medium, weak, negative = (lx.count(hits, keys) for keys in RELEVANCE)
    return (3 * strong + 2 * medium + weak - 2 * negative).cast("long")


def relevant(news: DataFrame, words: lx.Lexicon = EVERYTHING) -> DataFrame:
    """with_text() of the rows that the rules keep, and their relevance: a feed language and a score of 3 or more."""
    rows = with_text(news.filter("language <> 'other'"), words).withColumn("relevance", relevance_score(F.col("hits")))
    return rows.filter("relevance >= 3")


def decision(language: Column, score: Column, cached: Column | None = None) -> Column:
    """Which rule decides: language, rules-reject, rules-accept, ai-cached or ai-disabled."""
    gray = F.lit("ai-disabled") if cached is None else F.when(cached.isNotNull(), "ai-cached").otherwise("ai-disabled")
    return F.when(language == "other", "language").when(score < 1, "rules-reject").when(score >= 5, "rules-accept").otherwise(gray)


def accepted(path: Column, score: Column, cached: Column | None = None) -> Column:
    known = F.lit(False) if cached is None else F.coalesce(cached, F.lit(False))
    return F.when(path == "rules-accept", True).when(path == "ai-cached", known).when(path == "ai-disabled", score >= 3).otherwise(False)


def category(hits: Column) -> Column:
    """struct<category, confidence, total>: most hits, ties by priority."""
    rows = [F.struct(lx.count(hits, keys).alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, keys) in enumerate(CATEGORIES.items())]

    def decide(every: Column) -> Column:
        total = F.aggregate(every, F.lit(0), lambda a, r: a + r["hits"])
        best = F.array_max(every)
        return F.struct(F.when(total > 0, best["name"]).otherwise("other").alias("category"), F.when(total > 0, best["hits"] / total).otherwise(0.0).alias("category_confidence"))

    return tx.let(F.array(*rows), decide)


def platforms(hits: Column) -> Column:
    """Sorted names whose alias occurs: single words at word bounds, phrases anywhere."""
    return F.array_sort(F.array_compact(F.array(*[F.when(lx.any_of(hits, keys), name) for name, keys in PLATFORMS.items()])))


def audience_scores(hits: Column, names: Column, label: Column) -> Column:
    """array<struct<score, name>>: raw / (raw + 2) of keyword, platform and category matches."""
    out = []
    for name, profile in vocab.AUDIENCES.items():
        own = tx.literal_array(profile["platforms"]) if profile["platforms"] else F.array().cast("array<string>")
        raw = lx.count(hits, AUDIENCES[name]) + 1.5 * F.size(F.array_intersect(names, own)) + (1.5 * label.isin(*profile["categories"]).cast("int") if profile["categories"] else F.lit(0.0))
        out.append(F.struct((raw / (raw + 2)).alias("score"), F.lit(name).alias("name")))
    return F.array(*out)


def actionability_score(hits: Column, label: Column) -> Column:
    urgent, recommended, informational = (F.least(F.lit(2), lx.count(hits, keys)) for keys in ACTIONS)
    bias = F.create_map(*[F.lit(x) for pair in vocab.CATEGORY_BIAS.items() for x in pair])
    raw = urgent * 4.0 + recommended * 1.5 - informational * 1.0 + F.coalesce(bias[label], F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw + 1.5) / 7.0))


def action_level(score: Column) -> Column:
    return F.when(score >= 0.7, "urgent_action").when(score >= 0.4, "recommended_action").otherwise("informational")


def source_profiles(spark) -> DataFrame:
    """The profiled sources: a fixed table of a few rows."""
    return spark.createDataFrame([(name, float(base), tier) for name, (base, tier) in vocab.SOURCES.items()], "source string, base_score double, declared_tier string")


def with_profile(news: DataFrame) -> DataFrame:
    found = news.join(F.broadcast(source_profiles(news.sparkSession)), "source", "left")
    return found.withColumns({"base_score": F.coalesce("base_score", F.lit(0.35)), "declared_tier": F.coalesce("declared_tier", F.lit("unverified"))})


def credibility(base: Column, hits: Column, corroborating: Column) -> Column:
    penalty = F.least(F.lit(0.30), lx.count(hits, SENSATIONAL) * 0.10)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - penalty + F.least(F.lit(0.15), corroborating * 0.05)))


def tier(score: Column) -> Column:
    return F.when(score >= 0.70, "trusted").when(score >= 0.40, "verified").otherwise("unverified")


def classified(news: DataFrame) -> DataFrame:
    """Category, platforms, audiences and actionability of rows; with_text() where they lack its hits."""
    hits = F.col("hits")
    rows = (news if "hits" in news.columns else with_text(news)).withColumn("_c", category(hits)).select("*", "_c.*").drop("_c")
    rows = rows.withColumn("affected_platforms", platforms(hits)).withColumn("_a", audience_scores(hits, F.col("affected_platforms"), F.col("category")))
    fit = F.filter("_a", lambda a: a["score"] >= 0.33)
    rows = rows.withColumns({"audience_targets": F.array_sort(F.transform(fit, lambda a: a["name"])), "audience_relevance_score": F.when(F.size(fit) > 0, F.array_max("_a")["score"]).otherwise(0.0)})
    rows = rows.withColumn("actionability_score", actionability_score(hits, F.col("category")))
    return rows.withColumn("actionability_level", action_level(F.col("actionability_score"))).drop("_a")


def _alike(shared: Column, a: Column, b: Column, least: float, least_shared: int = 2) -> Column:
    """Whether sets of sizes a and b with so many common tokens are similar enough. More common tokens never make it false."""
    return (shared >= least_shared) & (shared / (a + b - shared) >= least)


def _shuffled(rows: DataFrame) -> DataFrame:
    """Rows that grow with the news, as the right side of a join by shuffle whatever Spark takes their size for: it goes by files and shuffles as they
    are packed, and lists of titles and sources unpack to a hundred times that, in the driver first where they are broadcast."""
    return rows.hint("merge")


def token_sets(told: DataFrame) -> DataFrame:
    """(toks, told, rare, core) of rows (toks, source, trusted, first): the distinct token sets of two tokens or more.

    told holds the sources that tell a set, with their first rows. rare is the set's token that the fewest sets have, core the
    others, those of the fewest sets first: one order for all.
    """
    sets = told.filter(F.size("toks") >= 2).groupBy("toks", "source", "trusted").agg(F.min("first").alias("first"))
    sets = sets.groupBy("toks").agg(F.collect_list(F.struct("first", F.col("source").alias("other"), "trusted")).alias("told"))
    each = sets.select("toks", "told", F.explode("toks").alias("tok"))
    often = each.groupBy("tok").agg(F.count("*").alias("n"))
    ranked = each.join(_shuffled(often), "tok").groupBy("toks").agg(F.any_value("told").alias("told"), F.array_sort(F.collect_list(F.struct("n", "tok"))).alias("ranked"))
    names = F.transform("ranked", lambda r: r["tok"])
    return ranked.select("toks", "told", names[0].alias("rare"), F.slice(names, F.lit(2), F.size(names)).alias("core"))


def core_pairs(sets: DataFrame, least: float, least_shared: int = 2) -> DataFrame:
    """(core, o_core, shared) of cores that are alike without their sets' rare tokens; each with itself where it is.

    A prefix filter: a core's partner has one of its first tokens (those of the fewest sets) among its own first ones, and a pair
    counts at its first common token alone.
    """
    cores = sets.select("core").distinct()
    size = F.size("core") + 1
    need = F.greatest(F.lit(least_shared), F.ceil(size * least - 1e-9))
    index = cores.select("core", F.explode(F.slice("core", F.lit(1), F.greatest(F.lit(0), size - need).cast("int"))).alias("tok"))
    both = index.join(_shuffled(index.withColumnRenamed("core", "o_core")), "tok").withColumn("_both", F.array_intersect("core", "o_core"))
    both = both.filter(F.get("_both", F.lit(0)) == F.col("tok")).withColumn("shared", F.size("_both"))
    return both.filter(_alike(F.col("shared"), size, F.size("o_core") + 1, least, least_shared)).select("core", "o_core", "shared")


def stories(news: DataFrame, wide: float = 0.2, narrow: float = 0.25) -> DataFrame:
    """(title, told): for each title the sources that tell its story, as array<struct<first, other, trusted_first>>.

    first is the first row by which a source tells a story of similarity wide, trusted_first the one of similarity
    narrow if the source is a trusted one.

    Titles don't meet, nor do all their token sets. Sets that differ in their rare token alone share a core, and where two cores are
    alike already all sets of the one are alike all of the other: each source's first row of a core stands for them. What
    cores leave open is a rare token of one set in the other: those pairs are found by that token, the one that the
    fewest sets have, and compared exactly. So a story in thousands of titles that differ in a number costs one pair of cores, and
    each of its titles as many comparisons as there are sets with its number. Distinct titles and their sets are written to the
    shared folder as the plan is made.
    """
    trusted = F.col("source").isin(*[name for name, (_, tier) in vocab.SOURCES.items() if tier == "trusted"])
    told = news.groupBy("title", "source", trusted.alias("trusted")).agg(F.min("doc_id").alias("first")).withColumn("toks", F.array_sort(tx.title_tokens(F.col("title"))))
    # Both are read several times below, and what news comes from may be dear.
    told = written(told, "stories-told")
    sets = written(token_sets(told), "stories-sets")
    firsts = lambda sure: (F.min("first").alias("first"), F.min(F.when(sure & F.col("trusted"), F.col("first"))).alias("trusted_first"))

    by_core = sets.select(F.col("core").alias("o_core"), F.inline("told")).groupBy("o_core", "other", "trusted").agg(F.min("first").alias("first"))
    sure = _alike(F.col("shared"), F.size("core") + 1, F.size("o_core") + 1, narrow)
    of_cores = core_pairs(sets, wide).join(_shuffled(by_core), "o_core").groupBy("core", "other").agg(*firsts(sure))

    here, there = sets.select("toks", "told", F.col("rare").alias("tok")), sets.select(F.col("toks").alias("o_toks"), F.col("told").alias("o_told"), F.explode("toks").alias("tok"))
    met = here.join(_shuffled(there), "tok").withColumn("shared", F.size(F.array_intersect("toks", "o_toks")))
    alike = lambda least: _alike(F.col("shared"), F.size("toks"), F.size("o_toks"), least)
    ways = F.array(F.struct("toks", F.col("o_told").alias("told")), F.struct(F.col("o_toks").alias("toks"), "told"))
    met = met.filter(alike(wide)).select(alike(narrow).alias("sure"), F.explode(ways).alias("way")).select("sure", "way.toks", F.inline("way.told"))
    of_sets = met.groupBy("toks", "other").agg(*firsts(F.col("sure")))

    every = of_sets.unionByName(sets.select("toks", "core").join(_shuffled(of_cores), "core").drop("core"))
    found = every.groupBy("toks", "other").agg(F.min("first").alias("first"), F.min("trusted_first").alias("trusted_first"))
    found = found.groupBy("toks").agg(F.collect_list(F.struct("first", "other", "trusted_first")).alias("told"))
    return told.select("title", "toks").distinct().join(_shuffled(found), "toks").select("title", "told")


def corroboration(news: DataFrame) -> DataFrame:
    """(doc_id, n_sources, corroborating_sources): how many other sources tell the same story, and the trusted ones, in order of their first row."""
    rest = F.filter(F.coalesce("told", F.array().cast("array<struct<first:bigint,other:string,trusted_first:bigint>>")), lambda s: s["other"] != F.col("source"))
    sure = F.transform(F.filter(rest, lambda s: s["trusted_first"].isNotNull()), lambda s: F.struct(s["trusted_first"].alias("first"), s["other"].alias("other")))
    own = news.select("doc_id", "title", "source").join(_shuffled(stories(news)), "title", "left")
    return own.select("doc_id", F.size(rest).cast("long").alias("n_sources"), F.transform(F.array_sort(sure), lambda s: s["other"]).alias("corroborating_sources"))


def keyword_component(hits: Column) -> Column:
    """15 ln(1 + hits) over all relevance terms; stems don't count here."""
    return 15.0 * F.log1p(lx.count(hits, lx.keys(t for t in ALL_TERMS if not (t.endswith("*") and " " not in t and "-" not in t))).cast("double"))


def severity_component(hits: Column) -> Column:
    total = F.lit(0.0)
    for key, weight in SEVERITY.items():
        total = total + F.when(F.array_contains(hits, key), float(weight)).otherwise(0.0)
    return total * 4.0


def recency(published_at: Column, now: Column, half_life: float = 12.0) -> Column:
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(published_at)) / 3.6e9)
    return F.greatest(F.pow(F.lit(0.5), age / max(half_life, 0.1)), F.lit(0.2))


def bonus(n: Column) -> Column:
    return F.when(n > 0, 20.0 * (1.0 - F.exp(-0.6 * n))).otherwise(0.0)


def scored(news: DataFrame, now: str, half_life: float = 12.0) -> DataFrame:
    """classified() with credibility, corroboration and threat_score. The rows of news are one batch: all of them count as told."""
    hits = F.col("hits")
    rows = with_profile(classified(news)).join(_shuffled(corroboration(news)), "doc_id")
    rows = rows.withColumn("source_credibility_score", credibility(F.col("base_score"), hits, F.size("corroborating_sources")))
    rows = rows.withColumn("source_tier", tier(F.col("source_credibility_score")))
    raw = (keyword_component(hits) + severity_component(hits)) * recency(F.col("published_at"), F.to_timestamp(F.lit(now)), half_life) + bonus(F.col("n_sources"))
    return rows.withColumn("threat_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))


def signals(rows: DataFrame) -> DataFrame:
    """Adds the ten boolean signals to classified rows."""
    txt, hits, label = F.col("txt"), F.col("hits"), F.col("category")
    has = lambda name: lx.any_of(hits, SIGNAL_PHRASES[name])
    on = lambda *names: F.arrays_overlap(F.transform("affected_platforms", F.lower), tx.literal_array(names))
    to = lambda *names: F.arrays_overlap("audience_targets", tx.literal_array(names))
    word = lambda w: F.array_contains(hits, lx.phrases([w])[0])
    urgent = F.col("actionability_level") == "urgent_action"
    active = urgent | has("ACTIVE_EXPLOIT")
    return rows.withColumns({
        "active_exploitation": active,
        "credential_theft_risk": label.isin("phishing", "breach", "data leak") | word("credential") | (word("password") & label.isin("phishing", "scam", "breach")),
        "financial_risk": (label == "scam") | has("FINANCIAL") | to("crypto_users") | (label.isin("scam", "malware", "phishing", "breach") & txt.rlike(vocab.MONEY)),
        "enterprise_risk": to("sysadmins", "enterprise") | has("ENTERPRISE") | on("vmware", "kubernetes", "exchange server", "active directory", "azure", "okta", "windows server"),
        "consumer_risk": to("normal_users", "mobile_users", "crypto_users") | label.isin("phishing", "scam", "social engineering", "spyware"),
        "requires_immediate_action": active,
        "affects_email_accounts": has("EMAIL") | on("microsoft 365", "m365", "outlook", "gmail", "exchange"),
        "steals_sessions": has("SESSION") | (word("mfa") & word("bypass")),
        "data_exposure_risk": label.isin("breach", "data leak") | has("DATA_EXPOSURE"),
        "malware_delivery": label.isin("malware", "ransomware", "spyware", "botnet") | has("MALWARE_DELIVERY"),
    })


def _first_label(names: Column, labels: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.get(F.filter(F.transform(names, lambda n: table[n]), lambda x: x.isNotNull()), F.lit(0))


def who_should_care(language: str = "en") -> Column:
    """First platform with a label, else first audience, else what the signals say."""
    ua = language == "ua"
    audiences = vocab.AUDIENCE_LABELS_UA if ua else vocab.AUDIENCE_LABELS_EN
    rest = F.when(F.col("enterprise_risk"), audiences["enterprise"]).when(F.col("consumer_risk"), audiences["normal_users"]).otherwise(vocab.ANYONE_UA if ua else vocab.ANYONE_EN)
    return F.coalesce(_first_label(F.transform("affected_platforms", F.lower), vocab.PLATFORM_LABELS_UA if ua else vocab.PLATFORM_LABELS_EN), _first_label(F.col("audience_targets"), audiences), rest)


def potential_impact(language: str = "en", limit: int = 3) -> Column:
    ladder = vocab.IMPACT_UA if language == "ua" else vocab.IMPACT_EN
    return F.slice(F.filter(F.array(*[F.when(F.col(flag), label) for flag, label in ladder]), lambda x: x.isNotNull()), 1, limit)
