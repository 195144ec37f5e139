"""The optional model hooks, with stubs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigilflow import registry
from vigilflow.functions import editorial as ed
from vigilflow.functions import editorial_vocab as ev
from vigilflow.operators import enrich, provider


def decided(spark):
    rows = [(1, "en", 7), (2, "en", 2), (3, "en", 4), (4, "other", 9), (5, "en", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, language string, score long")
    return frame.withColumn("path", enrich.decision(F.col("language"), F.col("score")))


def answers(frame):
    return {r["doc_id"]: (r["path"], r["is_relevant"]) for r in frame.collect()}


def test_classifier_sees_the_gray_zone_only(spark):
    assert answers(provider.with_verdicts(decided(spark))) == {1: ("rules-accept", True), 2: ("ai-disabled", False), 3: ("ai-disabled", True), 4: ("language", False), 5: ("rules-reject", False)}
    got = answers(provider.with_verdicts(decided(spark), lambda: lambda rows: [r["doc_id"] == 2 for r in rows]))
    assert got == {1: ("rules-accept", True), 2: ("ai-accept", True), 3: ("ai-reject", False), 4: ("language", False), 5: ("rules-reject", False)}

    def broken():
        def classify(rows):
            raise RuntimeError("down")

        return classify

    got = answers(provider.with_verdicts(decided(spark), broken))
    assert got[2] == ("ai-error", False) and got[3] == ("ai-error", True)


def test_generate(spark):
    rows = [(i, f"Ransomware story {i}", "BleepingComputer", f"https://a.test/{i}", dt.datetime(2024, 1, 1), "Hospitals were hit last night.", "en", f"{i:016x}") for i in range(3)]
    items = enrich.scored(spark.createDataFrame(rows, "doc_id long, title string, source string, url string, published_at timestamp, raw_content string, language string, fingerprint string"), "2024-01-02 00:00:00")
    cached = spark.createDataFrame([(f"{0:016x}", "en", "Cached", "s", "w", "llm"), (f"{1:016x}", "ua", "Інша", "s", "w", "llm")], "fingerprint string, locale string, title string, short_summary string, why_it_matters string, generated_by string")

    def model():
        return lambda batch: [{"title": "Written", "short_summary": "A hospital chain lost its servers", "why_it_matters": "Care is delayed"} if r["fingerprint"].endswith("1") else None for r in batch]

    plain, none = provider.generate(items, cached)
    assert {r["fingerprint"][-1]: r["generated_by"] for r in plain.collect()} == {"0": "llm", "1": "rule_based", "2": "rule_based"} and none.count() == 0
    posts, fresh = provider.generate(items, cached, provider=model)
    assert {r["fingerprint"][-1]: r["title"] for r in posts.collect()} == {"0": "Cached", "1": "Written", "2": "Ransomware story 2"} and [r["title"] for r in fresh.collect()] == ["Written"]


def test_generate_edits_before_it_checks(spark):
    rows = [(i, f"Ransomware story {i}", "BleepingComputer", f"https://a.test/{i}", dt.datetime(2024, 1, 1), "Hospitals were hit last night.", "en", f"{i:016x}") for i in range(3)]
    items = enrich.scored(spark.createDataFrame(rows, "doc_id long, title string, source string, url string, published_at timestamp, raw_content string, language string, fingerprint string"), "2024-01-02 00:00:00")
    cached = spark.createDataFrame([], "fingerprint string, locale string, title string, short_summary string, why_it_matters string, generated_by string")
    texts = {
        "0": {"title": "A" * 200, "short_summary": "Stay vigilant. A hospital chain lost its servers.", "why_it_matters": "Care is delayed"},
        "1": {"title": "Written", "short_summary": "Stay vigilant.", "why_it_matters": "Care is delayed"},
        "2": {"title": "Written", "short_summary": "A hospital chain lost its servers", "why_it_matters": "Care is delayed", "what_to_do": ["Unplug it", "Unplug it."]},
    }
    posts, fresh = provider.generate(items, cached, provider=lambda: lambda batch: [texts[r["fingerprint"][-1]] for r in batch])
    got = {r["fingerprint"][-1]: r for r in posts.collect()}
    # Fluff goes and the title is cut; nothing but fluff, or one advice twice, is no post.
    assert (got["0"]["title"], got["0"]["short_summary"]) == ("A" * 160, "A hospital chain lost its servers.")
    assert [got[k]["generated_by"] for k in "012"] == ["llm", "rule_based", "rule_based"] and fresh.count() == 1


def test_generate_in_ukrainian_uses_the_glossary(spark):
    stem, word = next((k, v) for k, v in ev.GLOSSARY.items() if k.isalpha())
    given = spark.createDataFrame(
        [("Лікарню зламано", f"Тут {stem} і далі", "", "", [stem, "Інше"], [], [], [])],
        "title string, short_summary string, why_it_matters string, detail_body string, affected_users array<string>, what_to_do array<string>, what_not_to_do array<string>, quick_facts array<string>",
    )
    row = provider.edited(given, "ua").first()
    assert row["short_summary"] == f"Тут {word} і далі" and row["affected_users"] == [word, "Інше"] and row["what_to_do"] == []


def test_source_body_is_cut_where_a_text_pauses(spark):
    texts = ["short", None, "a" * 1000 + "\n\n" + "b. " * 90, "a. " * 500, "a" * 1100 + "! " + "b" * 200, "é" * 1300, "a" * 1200]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, body string")
    got = {r["i"]: r["cut"] for r in frame.select("i", ed.source_excerpt(F.col("body")).alias("cut")).collect()}
    assert got == {
        0: "short", 1: None, 2: "a" * 1000 + "\n\n[…truncated]", 3: ("a. " * 400).rstrip() + " […truncated]", 4: "a" * 1100 + "! […truncated]", 5: "é" * 1200 + "… […truncated]", 6: "a" * 1200,
    }


def test_source_excerpt_matches_its_sql_at_line_ends(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    line = "w" * 1199
    texts = [line + "\n" + "b" * 90, line[1:] + "\n " + "b" * 90, line[1:] + " \n" + "b" * 90, line[1:] + "\u00a0 " + "b" * 90, line[1:] + "\t " + "b" * 90, "a" * 900 + "!\n" + "b" * 900, "a" * 900 + "?\n" + "b" * 900,
        "a" * 900 + ".\n" + "b" * 900, "a" * 900 + " \n\n\n" + "b" * 900, "a" * 900 + "\t\n\n" + "b" * 900, "a" * 838 + ". " + "b" * 900, "a" * 840 + ". " + "b" * 900, "a" * 1199 + ". b", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["excerpt"] for r in registry.QUERIES["source_excerpt"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.sql(registry.ORACLES["source_excerpt"]).fetchall())
    # A prompt loses all white space before a cut.
    cut = spark.createDataFrame([(texts[0],)], "t string").select(ed.source_excerpt(F.col("t"))).first()[0]
    assert cut == line + "… […truncated]"
