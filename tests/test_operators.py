"""Single operators on literal rows: the scenarios that fix their semantics."""

import datetime as dt
import random
import re
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilflow.functions import editorial as ed
from vigilflow.functions import text as tx
from vigilflow.functions import vocab
from vigilflow.operators import copy, enrich, feed, health, render, store

NOW = "2026-05-11 12:00:00"


@pytest.fixture(scope="module")
def one(spark):
    """Evaluate columns on one row of named strings."""

    def run(column, **values):
        row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())) if values else spark.range(1)
        return row.select(column.alias("x")).first()["x"]

    return run


def items(spark, rows):
    """Rows (title, source, age in hours, body)."""
    now = dt.datetime(2026, 5, 11, 12)
    data = [(i, t, s, f"https://{s}.test/{i}", now - dt.timedelta(hours=h), b, "en", f"f{i}") for i, (t, s, h, b) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, title string, source string, url string, published_at timestamp, raw_content string, language string, fingerprint string")


def classify(spark, *titles):
    return [r for r in enrich.classified(items(spark, [(t, "x", 0, "") for t in titles])).orderBy("doc_id").collect()]


def test_vocabularies_are_whole():
    assert [len(x) for x in (vocab.STRONG, vocab.MEDIUM, vocab.WEAK, vocab.NEGATIVE)] == [133, 53, 17, 85]
    assert [len(x) for x in vocab.CATEGORIES.values()] == [6, 13, 8, 6, 9, 7, 9, 11, 4, 11, 14, 8]
    assert len(vocab.PLATFORMS) == 27 and len(vocab.SOURCES) == 19 and len(vocab.JUNK) == 26


@pytest.mark.parametrize("title, category", [
    ("Fresh ransomware strain is sold as malware", "ransomware"), ("Firefox zero-day vulnerability used in active exploitation", "zero-day"),
    ("Library extends its opening hours on Sundays", "other"), ("Шахраї запустили фішингову розсилку від імені пошти", "phishing"),
])
def test_category(spark, title, category):
    row = classify(spark, title)[0]
    assert row["category"] == category and (row["category_confidence"] > 0) == (category != "other")


@pytest.mark.parametrize("title, kept", [
    ("Volta Ltd closes a Series A funding round of $12M", False), ("Best 7 antivirus tools of the year", False), ("Hit by a ransomware breach, Volta Ltd raises $20M to rebuild security", True),
])
def test_relevance(spark, title, kept):
    rows = enrich.with_text(items(spark, [(title, "x", 0, "")]))
    assert (rows.select(enrich.relevance_score(F.col("hits"))).first()[0] >= 3) == kept


def test_platforms(spark):
    linux, apple = classify(spark, "Belinuxa Foods opens a plant", "Zero-click iOS exploit reaches iPhone and iPad owners")
    assert linux["affected_platforms"] == [] and apple["affected_platforms"] == ["iOS"]


def test_audience(spark):
    dev, corp = classify(spark, "Remote code execution in Kubernetes exploited by bots", "Breach at Oracle")
    assert {"developers", "sysadmins"} <= set(dev["audience_targets"])
    assert "enterprise" in corp["audience_targets"] and "normal_users" not in corp["audience_targets"]


def test_actionability(spark):
    urgent, soon, fyi = classify(spark, "Bank breach: change passwords and enable 2FA immediately", "Firefox vulnerability: patch available", "Researchers show a theoretical attack")
    assert urgent["actionability_level"] == "urgent_action" and urgent["actionability_score"] >= 0.7
    assert soon["actionability_level"] == "recommended_action" and 0.4 <= soon["actionability_score"] < 0.7
    assert fyi["actionability_level"] == "informational"


def test_scores_are_metamorphic(spark):
    title = "Botnet crew turns router zero-day on port operators"
    fresh, stale = (r["threat_score"] for r in enrich.scored(items(spark, [(title, "a", 0, ""), ("Cafe opens", "b", 0, ""), (title + " again and again but different words everywhere here", "a", 72, "")]), NOW).filter("doc_id <> 1").orderBy("doc_id").collect())
    assert fresh > stale
    crowd = enrich.scored(items(spark, [(title, s, 0, "") for s in ("BleepingComputer", "The Hacker News", "Some Blog")]), NOW).orderBy("doc_id").collect()
    assert crowd[0]["threat_score"] > fresh and all(0 <= r["threat_score"] <= 100 for r in crowd)
    assert crowd[2]["corroborating_sources"] == ["BleepingComputer", "The Hacker News"] and crowd[0]["corroborating_sources"] == ["The Hacker News"]
    assert crowd[2]["source_tier"] == "verified" and abs(crowd[2]["source_credibility_score"] - 0.45) < 1e-9


def test_signals(spark):
    mail, bank = enrich.signals(enrich.classified(items(spark, [("Phishing of Microsoft 365 users", "x", 0, ""), ("Phishing of bank customers", "x", 0, "")]))).orderBy("doc_id").collect()
    assert mail["affects_email_accounts"] and not bank["affects_email_accounts"] and bank["credential_theft_risk"] and bank["financial_risk"]


def test_cleaning(one):
    body = "Real news here.\nSubscribe to our newsletter for more\nTags: a, b\nMore news."
    assert one(tx.clean_body(F.col("t")), t=body) == "Real news here. More news."
    assert one(tx.clean_body(F.col("t")), t="Підпишіться на наш канал. Новина.") == ". Новина."
    long = "Word word. " * 400
    cut = one(tx.clean_body(F.col("t")), t=long)
    assert 2250 < len(cut) <= 3000 and cut.endswith(".")
    assert one(tx.safe_text(F.col("t")), t=" é &amp; \x07x\n y ") == "é & x y"


def test_junk_patterns_are_tried_where_they_may_match():
    """The words that a pattern needs never keep it from a text that it matches, whatever the case and its odd letters."""
    draw = random.Random(11)
    odd = {"s": "sSſ", "k": "kKK", "i": "iIı"}
    lines = (
        "Subscribe to us now", "Sign up for our newsletter", "Join our newsletter today", "Subscribe for more", "Share this article", "Share on Facebook", "Follow us on Twitter", "Read more about it", "Read also: x", "See related stories", "Continue reading", "Click here to read",
        "Related articles: one", "Advertisement", "Sponsored content", "Ad: buy", "© 2024 us", "Copyright 2024 us", "All rights reserved", "Tags: one, two", "Tag : one", "Categories: a", "Category: a", "Filed under: x", "Posted in news", "Leave a comment", "Comments are closed",
        "Image source: us", "Photo credit: me", "Підпишіться на нас", "Читайте також: це", "Пов'язані матеріали", "Поширити у Telegram",
    )
    matched = set()
    for needs, pattern in zip(vocab.JUNK_NEEDS, vocab.JUNK, strict=True):
        rule = re.compile(pattern, re.IGNORECASE | re.MULTILINE)
        for text in [line for line in lines for _ in range(30)]:
            spelt = "".join(draw.choice(odd.get(c.lower(), c.lower() + c.upper())) for c in text)
            if rule.search(spelt):
                matched.add(pattern)
                assert tx.may_hold(tx.fold(spelt), needs), (pattern, spelt)
    assert len(matched) >= 20


def test_language(one):
    for text, want in (("abc", "unknown"), ("plain english", "en"), ("привет друзья", "other"), ("їжак під ґанком", "ua")):
        assert one(tx.detect_language(F.col("t")), t=text) == want
    assert one(tx.wrong_script(F.col("t"), F.lit("ua")), t="English title") and not one(tx.wrong_script(F.col("t"), F.lit("ua")), t="Нова атака на Windows")


def test_references(one):
    refs = one(render.references(F.col("t")), t="CVE-2026-1234 and CVE-2026-5678. Also cve-2026-1234, AA24-131A, adv200001, CERT-UA#77")
    assert [(r["type"], r["label"]) for r in refs] == [("cve", "CVE-2026-1234"), ("cve", "CVE-2026-5678"), ("cert", "CERT-UA#77"), ("advisory", "CISA AA24-131A"), ("vendor", "ADV200001")]
    two = F.array(*[F.struct(F.lit("cve").alias("type"), F.lit(x).alias("label"), F.lit(u).alias("url")) for x, u in (("CVE-1", "https://www.a.test/CVE-1"), ("cve-1", "https://b.test/"), ("CVE-2026-9999", "https://c.test/"))])
    assert [r["url"] for r in one(render.merge_references(two))] == ["https://www.a.test/CVE-1", "https://c.test/"]
    assert [r["label"] for r in one(ed.verified_ids(two))] == ["CVE-1", "cve-1"]
    assert [r["label"] for r in one(render.drop_source_refs(two, F.lit("https://a.test/story")))] == ["cve-1", "CVE-2026-9999"]


def test_editorial(one):
    assert one(ed.strip_fluff(F.col("t")), t="Stay vigilant. Servers were hit. Remain vigilant!") == "Servers were hit."
    assert one(ed.shouty_title(F.col("t")), t="NEW RANSOMWARE HITS 3COM VPN USERS") == "New Ransomware Hits 3COM VPN Users"
    assert one(ed.source_excerpt(F.col("t")), t="a" * 1000 + ". " + "b" * 500) == "a" * 1000 + ". […truncated]"
    assert one(ed.foreign_character(F.col("t")), t="слово 漢字") == "漢" and one(ed.foreign_character(F.col("t")), t="слово") is None
    assert one(ed.distinct_paragraphs(F.col("b"), [F.col("s")]), b="hackers breached hospital systems\n\nanother thing entirely happened", s="hospital systems breached hackers") == "another thing entirely happened"
    assert one(ed.json_object(F.col("t")), t='so: {"a": {"b": 1}} done') == '{"a": {"b": 1}}'
    assert one(tx.trim_at_word(F.col("t"), 10), t="hello big, world") == "hello big"
    assert one(render.platform_list(F.col("p")), p=["A", "B", "C"]) == "A, B and C"
    stem, new = next((k, v) for k, v in ed.ev.GLOSSARY.items() if k.isalpha())
    assert one(ed.ukrainian(F.col("t")), t=f"x {stem.capitalize()} y") == f"x {new[0].upper() + new[1:]} y"
    assert one(render.has_duplicates(F.col("p")), p=["Update now.", "update  NOW"]) and not one(render.has_duplicates(F.col("p")), p=["a", "b", ""])


def test_merges(spark):
    schema = "fingerprint string, doc_id long, category string, threat_score double, tags array<string>"
    old = spark.createDataFrame([("a", 1, "x", 80.0, ["p"])], schema)
    new = spark.createDataFrame([("a", 2, "y", 20.0, ["q"]), ("b", 3, "z", 5.0, []), ("b", 4, "w", 9.0, ["r"])], schema)
    rows = {r["fingerprint"]: r for r in store.merge_file(old, new).collect()}
    assert (rows["a"]["threat_score"], rows["a"]["category"], rows["a"]["tags"], rows["a"]["is_new"]) == (80.0, "x", ["p", "q"], False)
    assert (rows["b"]["threat_score"], rows["b"]["category"], rows["b"]["tags"], rows["b"]["is_new"]) == (9.0, "z", ["r"], True)
    db = {r["fingerprint"]: r for r in store.merge_database(old, store.premerged(new)).collect()}
    assert (db["a"]["threat_score"], db["a"]["category"], db["a"]["tags"]) == (80.0, "y", ["p", "q"]) and db["b"]["category"] == "w"


def test_health(spark):
    rows = spark.createDataFrame([("CISA", dt.datetime(2026, 5, 1), True, 0.6), ("CISA", dt.datetime(2026, 5, 2), False, 0.0)], "source string, published_at timestamp, relevant boolean, credibility double")
    out = {r["source"]: r for r in health.with_rates(health.merged(health.cycle(rows, spark.createDataFrame([("CISA",), ("tsn.ua",)], "source string")))).collect()}
    assert out["CISA"]["relevance_rate"] == 0.5 and out["CISA"]["avg_credibility"] == 0.6 and out["tsn.ua"]["empty_rate"] == 1.0 and out["tsn.ua"]["relevance_rate"] is None


def test_validator_names_the_first_failure(spark):
    from vigilflow.functions import editorial_vocab as ev

    good = {"title": "Bank hit by ransomware", "short_summary": "Attackers locked servers of a bank", "why_it_matters": "Payments stop", "detail_body": "", "threat_level": "High", "affected_users": ["Clients"], "what_to_do": ["Call the bank"], "what_not_to_do": ["Pay"], "source_title": "x", "source_body": "nothing in common"}
    ua = {"title": "Банк зламано", "short_summary": "Сервери банку заблоковано", "why_it_matters": "Платежі зупинено"}
    cases = [
        ({}, "en", None), ({"title": " "}, "en", "empty title"), ({"title": "Банк зламано"}, "en", "title is not in target language 'en': 'Банк зламано'"), ({"threat_level": "Severe"}, "en", "hallucinated threat_level: 'Severe'"),
        ({"what_to_do": [" "]}, "en", "empty what_to_do list"), ({"affected_users": []}, "en", "empty affected_users list"), ({"what_not_to_do": ["Pay.", "pay"]}, "en", "duplicate entries in what_not_to_do"),
        ({"source_title": "A long enough headline of a story", "short_summary": "A long enough headline of a story!"}, "en", "summary echoes title verbatim"), ({"why_it_matters": ev.CLICHES_EN[0]}, "en", f"AI cliché detected: '{ev.CLICHES_EN[0]}'"),
        ({**ua, "why_it_matters": "слово 漢"}, "ua", "Foreign-script character in UA output: '漢'"), ({**ua, "why_it_matters": f"бо {ev.RUSSISMS[0]}"}, "ua", f"Russism stem in UA output: '{ev.RUSSISMS[0]}'"), (ua, "ua", None),
        ({"source_body": "Attackers locked servers of a bank"}, "en", "short_summary reads as a near-copy of source"),
    ]
    schema = "n int, language string, " + ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in good.items())
    rows = spark.createDataFrame([(i, lang, *{**good, **change}.values()) for i, (change, lang, _) in enumerate(cases)], schema)
    rows = render.with_tokens(rows, summary_tokens=F.col("short_summary"), why_tokens=F.col("why_it_matters"), source_tokens=F.col("source_body"))
    got = [r["reason"] for r in rows.select("n", render.failure_reason(F.col("language")).alias("reason")).orderBy("n").collect()]
    assert got == [want for _, _, want in cases]


def test_cards(spark):
    from vigilflow.operators import copy

    rows = enrich.scored(items(spark, [("Windows and Android hit by ransomware", "BleepingComputer", 1, "word " * 100)]), NOW).withColumn("fingerprint", F.lit("0000000a00000000"))
    tables = copy.CopyTables(actions={"ransomware": ["a", "b", "c", "d"]}, hints={"android": ["hint"]}, why={"default|fyi": ["why"]})
    card = copy.cards(rows, tables).first()
    assert card["short_summary"].startswith("BleepingComputer ") and card["short_summary"].endswith("Android and Windows.") and card["what_to_do"] == ["hint", "c", "d"]
    assert card["affected_users"][0] == "Android and Windows users" and card["why_it_matters"] == "why" and card["reading_time_seconds"] == 33


def test_filters():
    assert feed.FilterState().active() == 0 and feed.FilterState(categories=("scam",), query=" x ").active() == 2


def test_copy_tables_above_the_bound_raise(spark):
    rows = spark.createDataFrame([("why", "default|fyi", 1, "b"), ("why", "default|fyi", 0, "a"), ("actions", "scam", 0, "c")], "kind string, key string, position int, text string")
    whole = copy.CopyTables.from_rows(rows, most=3)
    assert whole.why == {"default|fyi": ["a", "b"]} and whole.actions == {"scam": ["c"]}
    with pytest.raises(ValueError):
        copy.CopyTables.from_rows(rows, most=2)


def test_lexicon_is_the_plain_definition(spark):
    """Whole tokens, stems, phrases and words, against the definition by token sets and searches."""
    import random
    import re

    from vigilflow.functions import lexicon as lx

    terms = ["ab", "ab-c", "b", "a b", "b*", "ab-*", "c a", "ba-b", "б*"]
    r = random.Random(8)
    texts = ["".join(r.choice("aabbc -_1.б") for _ in range(r.randrange(25))) for _ in range(400)] + ["", None]
    words = lx.lexicon(lx.keys(terms), lx.aliases(["ab", "a b", "b.c"]))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("hits", words.hits(F.col("t")))
    got = {x["i"]: x for x in rows.select("i", lx.count(F.col("hits"), lx.keys(terms)).alias("n"), lx.any_of(F.col("hits"), lx.aliases(["ab", "b.c"])).alias("any")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        toks = set(re.findall(r"[^\W_]+(?:-[^\W_]+)*", t))
        n = sum(any(x.startswith(k[:-1]) for x in toks) if k.endswith("*") else k in t if " " in k or "-" in k else k in toks for k in terms)
        assert (got[i]["n"], got[i]["any"]) == (n, bool(re.search(r"(?<!\w)(?:ab|b\.c)(?!\w)", t))), t


def brute_stories(rows, wide=0.2, narrow=0.25):
    """Each row's other sources of the same story by comparing all pairs; rows: (doc_id, source, tokens)."""
    trusted = {name for name, (_, tier) in vocab.SOURCES.items() if tier == "trusted"}
    out = {}
    for i, source, toks in rows:
        n, sure = {}, {}
        for j, other, o in rows:
            shared = len(toks & o)
            if other != source and shared >= 2 and shared / len(toks | o) >= wide:
                n[other] = 1
                if other in trusted and shared / len(toks | o) >= narrow:
                    sure[other] = min(sure.get(other, j), j)
        out[i] = (len(n), [s for _, s in sorted((j, s) for s, j in sure.items())])
    return out


def test_corroboration_against_all_pairs(spark):
    """Random titles of few words, families that differ in one word, sets inside others, titles of one word or none."""
    draw, names = random.Random(6), [*list(vocab.SOURCES)[:6], "Blog A", "Blog B"]
    words = [f"word{i}" for i in range(14)]
    families = [[f"fam{k}w{i}" for i in range(7)] for k in range(3)]
    rows = []
    for i in range(420):
        kind = i % 6
        toks = draw.sample(words, draw.randrange(0, 7)) if kind < 3 else [*draw.choice(families), f"case{draw.randrange(40)}"] if kind < 5 else [*draw.sample(draw.choice(families), draw.randrange(1, 6)), *draw.sample(words, draw.randrange(0, 3)), f"case{draw.randrange(40)}"]
        rows.append((i, draw.choice(names), frozenset(toks)))
    news = spark.createDataFrame([(i, s, " ".join(draw.sample(sorted(t), len(t)))) for i, s, t in rows], "doc_id long, source string, title string")
    got = {r["doc_id"]: (r["n_sources"], list(r["corroborating_sources"])) for r in enrich.corroboration(news).collect()}
    assert got == brute_stories(rows)


def test_a_story_in_many_titles_makes_no_pairs_of_titles(spark):
    """20,000 titles of four headlines that differ in one number: 16 pairs of cores, and for each title the sets with its number."""
    heads = ("bank loses files after ransomware attack", "phishing wave hits hospitals across region", "botnet spreads through old routers again", "zero-day flaw found inside mail gateway")
    n = 20_000
    news = spark.range(n).select(
        F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, list(vocab.SOURCES)[:8])), (F.floor(F.col("id") / 4) % 8 + 1).cast("int")).alias("source"),
        F.concat(F.element_at(F.array(*map(F.lit, heads)), (F.col("id") % 4 + 1).cast("int")), F.lit(" case"), F.floor(F.col("id") / 4).cast("string")).alias("title"),
    )
    told = news.select("source", F.lit(False).alias("trusted"), F.col("doc_id").alias("first"), F.array_sort(tx.title_tokens(F.col("title"))).alias("toks"))
    sets = enrich.token_sets(told)
    assert enrich.core_pairs(sets, 0.2).count() == 4 and sets.select("core").distinct().count() == 4
    met = sets.select(F.col("rare").alias("tok")).join(sets.select(F.explode("toks").alias("tok")), "tok").count()
    assert met == 4 * n
    assert {r["n_sources"] for r in enrich.corroboration(news).select("n_sources").distinct().collect()} == {7}


def test_stories_are_joined_by_shuffle(spark):
    """Titles, their sets and what comes of them grow with the news and pack so well that Spark takes them for small: none may be broadcast, only the table of sources is."""
    told = spark.range(400).selectExpr("array('bank', 'files', concat('case', id div 4)) as toks", "concat('s', id % 4) as source", "false as trusted", "id as first")
    news = items(spark, [(f"Bank loses files after ransomware attack case{i // 4}", s, i, "") for i, s in enumerate([*list(vocab.SOURCES)[:4]] * 20)])
    joins = {}
    for name, rows, n in (("sets", enrich.token_sets(told), 100), ("scored", enrich.scored(news, NOW), 80)):
        assert len(rows.collect()) == n
        joins[name] = set(re.findall(r"(\w+Join) \[(\w+)#", rows._jdf.queryExecution().executedPlan().toString()))
    assert joins["sets"] == {("SortMergeJoin", "tok")}
    assert ("BroadcastHashJoin", "source") in joins["scored"] and ("SortMergeJoin", "tok") in joins["scored"]
    assert {on for kind, on in joins["scored"] if kind != "SortMergeJoin"} == {"source"}


def test_related_of_a_large_pool_in_few_signatures(spark):
    """20,000 items of four signatures: each item gets the newest of its own one, and no pair of items is made."""
    pool = spark.range(20_000).select(
        F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("fingerprint"), F.when(F.col("id") % 4 > 0, "malware").otherwise("scam").alias("category"),
        F.when(F.col("id") % 4 == 1, F.array(F.lit("Windows"))).otherwise(F.array().cast("array<string>")).alias("affected_platforms"), F.array(F.when(F.col("id") % 4 == 2, "developers").otherwise("enterprise")).alias("audience_targets"),
        F.timestamp_seconds(F.col("id")).alias("published_at"),
    )
    got = {}
    for r in feed.related(pool).filter("fingerprint in ('f000001', 'f019997', 'f000000')").collect():
        got.setdefault(r["fingerprint"], []).append((r["rank"], r["o_fingerprint"], r["score"]))
    assert sorted(got["f000001"]) == [(1, "f019997", 5), (2, "f019993", 5), (3, "f019989", 5), (4, "f019985", 5)]
    assert sorted(got["f019997"]) == [(1, "f019993", 5), (2, "f019989", 5), (3, "f019985", 5), (4, "f019981", 5)]
    assert sorted(got["f000000"]) == [(1, "f019996", 4), (2, "f019992", 4), (3, "f019988", 4), (4, "f019984", 4)]


def test_summaries_of_messages_keep_what_is_frequent(spark):
    """Parts of skewed and even messages: bounded summaries merge, in any grouping, into one that holds each message above its share."""
    draw = random.Random(2)
    words = [f"m{int(draw.paretovariate(0.6))}" for _ in range(3000)] + [f"rare{i}" for i in range(2000)]
    draw.shuffle(words)
    true = {w: words.count(w) for w in set(words)}
    rows = spark.createDataFrame([(i % 5, w) for i, w in enumerate(words)], "part int, message string")
    k = 10
    one = [health.heavy(rows.filter(F.col("part") == p), k).withColumn("part", F.lit(p)) for p in range(5)]
    join = lambda parts: health.heavy_merged(reduce(DataFrame.unionByName, parts), k)
    for merged in (join(one), join([join(one[:2]).withColumn("part", F.lit(0)), join(one[2:]).withColumn("part", F.lit(1))]), health.heavy(rows, k)):
        got = {r["message"]: (r["n"], r["lost"]) for r in merged.collect()}
        assert len(got) <= k and all(lost <= len(words) / (k + 1) and true[m] - lost <= n <= true[m] for m, (n, lost) in got.items())
        assert {m for m, n in true.items() if n > len(words) / (k + 1)} <= set(got)
    assert health.heavy(rows.limit(0)).count() == 0 and health.heavy_merged(one[0].limit(0)).count() == 0
