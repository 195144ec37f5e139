"""Readers, tables and the micro-batch cycle on files."""

import datetime as dt
import json
import os
import signal
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vigilflow.sources import feeds, fetch, tables
from vigilflow.sources.commits import Commits, Conflict
from vigilflow.sources.ledger import Ledger
from vigilflow.streaming import cycle

NOW = "2024-02-01 00:00:00"
RSS = """<rss><channel><item><title>Ransomware hits bank</title><link>https://a.test/1</link><description>&lt;p&gt;Exploited  &lt;b&gt;zero-day&lt;/b&gt;&lt;/p&gt;</description><pubDate>Wed, 31 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title>No link</title></item><item><link>https://a.test/2</link></item><item><title>Undated phishing</title><link>https://a.test/3</link></item></channel></rss>"""
ATOM = """<feed><entry><title>Malware in npm</title><link href="https://b.test/1"/><summary>Backdoor found</summary><updated>2024-01-30T08:00:00Z</updated></entry></feed>"""


@pytest.fixture
def configs(tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    return [feeds.SourceConfig("A", "rss", str(tmp_path / "a.xml")), feeds.SourceConfig("B", "atom", str(tmp_path / "b.xml")), feeds.SourceConfig("C", "parquet", str(tmp_path / "missing"))]


def test_feeds(spark, configs):
    rows, failed = feeds.fetch_all(spark, configs, NOW)
    got = {r["title"]: r for r in rows.collect()}
    assert failed == ["C"] and set(got) == {"Ransomware hits bank", "Undated phishing", "Malware in npm"}
    assert got["Ransomware hits bank"]["raw_content"] == "Exploited zero-day" and str(got["Ransomware hits bank"]["published_at"]) == "2024-01-31 10:00:00"
    assert str(got["Undated phishing"]["published_at"]) == NOW and str(got["Malware in npm"]["published_at"]) == "2024-01-30 08:00:00"
    with pytest.raises(ValueError):
        feeds.build([feeds.SourceConfig("X", "gopher", "")])


def test_a_source_that_breaks_when_read_leaves_the_others(spark, configs, tmp_path):
    """A damaged Parquet file passes the analysis of its plan and fails as a task: its source is empty, not the whole."""
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"PAR1 nothing of the kind PAR1")
    own = [*configs[:2], feeds.SourceConfig("D", "parquet", str(tmp_path / "broken"))]
    rows, failed = feeds.fetch_all(spark, own, NOW)
    assert failed == [] and {r["source"]: r["n"] for r in feeds.counts(rows, own).collect()} == {"A": 2, "B": 1, "D": 0}


def broken_sources(tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    (tmp_path / "cut.xml").write_text(RSS[: len(RSS) // 2])
    (tmp_path / "empty.xml").write_text("<rss><channel/></rss>")
    return [feeds.SourceConfig(n, "rss", str(tmp_path / f)) for n, f in (("A", "a.xml"), ("B", "b.xml"), ("Cut", "cut.xml"), ("Empty", "empty.xml"), ("Gone", "gone.xml"), ("Down", "boom"))]


def fetching():
    """A function of its own, so that it travels to executors by value."""

    def read(path):
        if path.endswith("boom"):
            raise TimeoutError("no answer")
        return fetch.read_bytes(path)

    return read


def test_feeds_as_a_data_source(spark, configs, tmp_path):
    """What breaks on an executor is its source's status row; the others give the rows that Spark's XML reader gives."""
    fetch.register(spark, fetching())
    own = broken_sources(tmp_path)
    raw = spark.read.format("feeds").option("sources", fetch.sources(own)).load()
    assert raw.rdd.getNumPartitions() == len(own)
    seen = {r["source"]: (r["ok"], (r["error"] or "").split(":")[0], r["n"]) for r in fetch.statuses(raw).collect()}
    assert seen == {"A": (True, "", 4), "B": (True, "", 1), "Cut": (False, "ParseError", 0), "Empty": (True, "", 0), "Gone": (False, "FileNotFoundError", 0), "Down": (False, "TimeoutError", 0)}
    assert {r["source"] for r in fetch.silent(fetch.statuses(raw)).collect()} == {"Cut", "Empty", "Gone", "Down"}
    news = fetch.news_rows(raw, NOW)
    want, _ = feeds.fetch_all(spark, configs[:2], NOW)
    assert sorted(map(tuple, news.drop("doc_id").collect())) == sorted(map(tuple, want.collect()))
    # Rows feed the cycle as they are.
    counts = cycle.run_cycle(news, Commits(spark, str(tmp_path / "store")), NOW, configured=[c.name for c in own])
    _, health = stored(spark, tmp_path / "store")
    assert counts["fetched"] == counts["new"] == 3 and {s for s, r in health.items() if r["cycles_empty"]} == {"Cut", "Empty", "Gone", "Down"}


def test_feeds_as_a_stream(spark, tmp_path):
    """Two runs of the stream from one checkpoint: each asks all sources once, and the second one's rows are known."""
    fetch.register(spark, fetching())
    own = broken_sources(tmp_path)
    for run in range(2):
        raw = spark.readStream.format("feeds").option("sources", fetch.sources(own)).load()
        cycle.start(raw, str(tmp_path / "store"), str(tmp_path / "checkpoint"), NOW, prepare=fetch.news_rows, configured=[c.name for c in own]).awaitTermination()
        items, health = stored(spark, tmp_path / "store")
        assert items.count() == 3 and health["A"]["total_fetched"] == 2 * (run + 1) and health["A"]["total_relevant"] == 2 and health["Gone"]["cycles_empty"] == run + 1


def test_entries_of_feeds():
    atom = b"""<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">One &amp; two</title><link rel="self" href="https://x.test/self"/><link href="https://x.test/1"/><content>Body</content><published>2024-01-01T00:00:00Z</published><updated>2024-01-02T00:00:00Z</updated></entry></feed>"""
    assert fetch.entries(atom) == [("One & two", "https://x.test/1", "Body", ["2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"])]
    assert fetch.entries(b"<rss><channel><item><title>t</title></item></channel></rss>") == [("t", "", "", [])]


def test_snapshot_log_and_keys(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"items": [{"fingerprint": "f1", "title": "t", "language": "uk"}, {"title": "without"}]}, indent=1))
    row = tables.read_snapshot(spark, str(tmp_path / "s.json")).collect()
    assert len(row) == 1 and row[0]["language"] == "ua" and row[0]["category"] == "other" and row[0]["tags"] == []
    (tmp_path / "bad.json").write_text("{broken")
    assert tables.read_snapshot(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "log.jsonl").write_text('{"fingerprint": "a", "locale": "en"}\nnot json\n{"fingerprint": "b", "locale": "ua"}\n')
    assert tables.read_log(spark, str(tmp_path / "log.jsonl"), "fingerprint string, locale string").count() == 2
    rows, rejects = tables.split_snapshot(spark, str(tmp_path / "*s*.json"))
    (tmp_path / "null.json").write_text('{"items": null}')
    assert rows.count() == 1 and [tuple(r)[1:] for r in rejects.collect()] == [("no fingerprint", 1)]
    assert [tuple(r)[1:] for r in tables.split_snapshot(spark, str(tmp_path / "[bn]*.json"))[1].collect()] == [("broken", 1)] * 2
    (tmp_path / "log.jsonl").write_text('{"fingerprint": "a", "locale": "en"}\nnot json\n\n  \n[1]\n"text"\n{"fingerprint": {"x": 1}}\n{"fingerprint": "b"}\n{"fingerprint": "c"\nnull\n')
    rows, rejects = tables.split_log(spark, str(tmp_path / "log.jsonl"), "fingerprint string, locale string, n int")
    lines = sorted(r["line"] for r in rejects.collect())
    assert rows.count() + len(lines) == 8 and '{"fingerprint": "c"' in lines and {r["fingerprint"] for r in rows.collect()} >= {"a", "b"} and all(r["file"].endswith("log.jsonl") for r in rejects.collect())
    keys = spark.createDataFrame([("a:uk",), ("b",), ("c:en",)], "key string")
    assert [tuple(r)[1:] for r in tables.post_keys(keys).orderBy("key").collect()] == [("a", "ua"), ("b", "en"), ("c", "en")]


def test_versions(spark, tmp_path):
    t = tables.VersionedTable(spark, str(tmp_path / "t"))
    assert t.read("x int").count() == 0
    for i in range(1, 4):
        t.replace(t.read("x int").union(spark.createDataFrame([(i,)], "x int")))
    assert t.versions() == [2, 3] and t.read("x int").count() == 3


def stored(spark, path):
    commits = Commits(spark, str(path))
    state = commits.last()
    return commits.read_keyed(state, "items", cycle.ITEM), {r["source"]: r for r in commits.read(state, "health", cycle.HEALTH).collect()}


def test_cycle_is_idempotent(spark, configs, tmp_path):
    """Readers feed the stream of cycles directly; another stream over the same files adds to health and nothing else."""
    rows, _ = feeds.fetch_all(spark, configs[:2], NOW)
    rows.write.parquet(str(tmp_path / "in"))
    for run in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        cycle.start(stream, str(tmp_path / "store"), str(tmp_path / f"checkpoint{run}"), NOW, configured=["A", "B", "Silent"]).awaitTermination()
    items, seen = stored(spark, tmp_path / "store")
    assert {r["title"]: r["category"] for r in items.collect()} == {"Ransomware hits bank": "zero-day", "Undated phishing": "phishing", "Malware in npm": "malware"}
    assert seen["A"]["cycles_seen"] == 2 and seen["A"]["total_fetched"] == 4 and seen["A"]["total_relevant"] == 2
    assert seen["Silent"]["cycles_seen"] == 2 and seen["Silent"]["cycles_empty"] == 2 and seen["Silent"]["total_fetched"] == 0


def test_items_are_stored_whole(spark, configs, tmp_path):
    """Every field of an item is there, so that what is stored can be rendered."""
    rows, _ = feeds.fetch_all(spark, configs[:2], NOW)
    counts = cycle.run_cycle(rows, Commits(spark, str(tmp_path / "store")), NOW)
    assert counts == {"fetched": 3, "relevant": 3, "new": 3, "categorized": 3, "audience_tagged": counts["audience_tagged"], "actionable": counts["actionable"], "trusted": 0}
    items, _ = stored(spark, tmp_path / "store")
    row = items.filter("title = 'Ransomware hits bank'").first()
    assert items.columns == cycle.COLUMNS and row["raw_content"] == "Exploited zero-day" and str(row["fetched_at"]) == NOW and row["original_language"] == "en" and row["corroborating_sources"] == []
    assert all(v is not None for v in row.asDict().values())


def test_a_batch_that_is_run_again_counts_once(spark, configs, tmp_path):
    rows, _ = feeds.fetch_all(spark, configs[:2], NOW)
    told = []
    for _ in range(2):
        counts = cycle.run_cycle(rows, Commits(spark, str(tmp_path / "store")), NOW, number=7, after=(lambda new: told.append(sorted(r["title"] for r in new.collect())),))
        assert counts["new"] == 3
    _, seen = stored(spark, tmp_path / "store")
    assert seen["A"]["cycles_seen"] == 1 and seen["A"]["total_fetched"] == 2 and seen["A"]["total_relevant"] == 2
    assert told == [sorted(["Ransomware hits bank", "Undated phishing", "Malware in npm"])]
    assert cycle.run_cycle(rows, Commits(spark, str(tmp_path / "store")), NOW, number=6)["fetched"] == 0


def repeated(spark):
    """A batch with a repeated fingerprint, a row that is known after it, and one that isn't relevant."""
    data = [
        ("f1", "Ransomware hits bank", "A", "https://a.test/1", dt.datetime(2024, 1, 31, 10), "Zero-day exploited in attacks."), ("f1", "Ransomware hits bank", "B", "https://a.test/1", dt.datetime(2024, 1, 31, 11), "Zero-day exploited in attacks."),
        ("f2", "Phishing wave", "A", "https://a.test/2", dt.datetime(2024, 1, 30), "Credentials stolen by malware."), ("f3", "Weather stays mild", "A", "https://a.test/3", dt.datetime(2024, 1, 30), "Sun."),
    ]
    return spark.createDataFrame(data, feeds.NEWS)


class Killed(BaseException):
    pass


def test_a_cycle_that_is_killed_anywhere_and_run_again(spark, tmp_path, monkeypatch):
    """Killed before or after any of its writes, then run again: items, health and what hooks saw are those of one clean run."""

    def run(path, stop=None, late=False):
        told, writes = [], [0]
        commits = Commits(spark, str(path))

        def stopping(name, act):
            def do(*args, **named):
                writes[0] += 1
                if writes[0] == stop and not late:
                    raise Killed(name)
                out = act(*args, **named)
                if writes[0] == stop:
                    raise Killed(name)
                return out

            return do

        for name in ("stage", "stage_keyed", "commit", "mark"):
            monkeypatch.setattr(commits, name, stopping(name, getattr(commits, name)))
        hook = lambda new: told.append(sorted(r["fingerprint"] for r in new.collect()))
        try:
            cycle.run_cycle(repeated(spark), commits, NOW, number=0, configured=["A", "B", "C"], after=(hook,))
        except Killed:
            pass
        return told, writes[0]

    def state(path):
        items, seen = stored(spark, path)
        return sorted(map(str, items.collect())), {k: tuple(v) for k, v in seen.items()}

    told, writes = run(tmp_path / "clean")
    want = state(tmp_path / "clean")
    assert told == [["f1", "f2"]] and len(want[0]) == 2 and writes == 7
    for late in (False, True):
        for stop in range(1, writes + 1):
            path = tmp_path / f"{late}{stop}"
            first, _ = run(path, stop, late)
            again, _ = run(path)
            assert state(path) == want, (stop, late)
            # At least once, and twice only where the process was lost before the hooks were noted as done.
            noted = stop == writes and late
            assert again == ([] if noted else told) and first == (told if stop == writes else []), (stop, late)


def test_of_two_writers_one_wins_and_the_other_goes_on_from_there(spark, tmp_path, monkeypatch):
    commits = Commits(spark, str(tmp_path / "c"))
    one, two = commits.last(), commits.last()
    commits.commit(one, facts={"by": 1})
    with pytest.raises(Conflict):
        commits.commit(two, facts={"by": 2})
    assert commits.last()["facts"] == {"by": 1}
    # A cycle that finds its number taken starts again on the other's state: both batches are in.
    rows = repeated(spark)
    slow, commit = Commits(spark, str(tmp_path / "store")), Commits.commit
    raced = []

    def late(self, *args, **named):
        if self is slow and not raced:
            raced.append(cycle.run_cycle(rows.filter("fingerprint = 'f2'"), Commits(spark, str(tmp_path / "store")), NOW, number=0, stream="other"))
        return commit(self, *args, **named)

    monkeypatch.setattr(Commits, "commit", late)
    counts = cycle.run_cycle(rows, slow, NOW, number=0, stream="own")
    items, seen = stored(spark, tmp_path / "store")
    assert raced[0]["new"] == 1 and counts["new"] == 1 and counts["fetched"] == 4 and items.count() == 2
    assert seen["A"]["cycles_seen"] == 2 and seen["A"]["total_fetched"] == 4 and set(slow.last()["facts"]["streams"]) == {"own", "other"}


def test_a_cycle_writes_only_the_buckets_of_its_rows(spark, tmp_path):
    """Ten rows change ten buckets of 256 at most; the store is what a merge of all of it gives; retention drops the oldest."""
    commits = Commits(spark, str(tmp_path / "store"))
    day = dt.datetime(2024, 1, 1)
    many = spark.createDataFrame([(f"k{i}", f"Ransomware wave {i}", "A", f"https://a.test/{i}", day + dt.timedelta(minutes=i), "Malware spreads.") for i in range(300)], feeds.NEWS)
    cycle.run_cycle(many, commits, NOW, retention=1000)
    before = commits.last()["keyed"]["items"]
    few = spark.createDataFrame([(f"n{i}", f"Phishing wave {i}", "A", f"https://a.test/n{i}", day + dt.timedelta(days=1, minutes=i), "Malware spreads.") for i in range(10)], feeds.NEWS)
    assert cycle.run_cycle(few, commits, NOW, retention=1000)["new"] == 10
    after = commits.last()["keyed"]["items"]
    assert len(before) > 150 and sum(before.get(b) != f for b, f in after.items()) <= 10
    items, _ = stored(spark, tmp_path / "store")
    assert items.count() == 310
    last = spark.createDataFrame([("z", "Botnet found", "A", "https://a.test/z", day + dt.timedelta(days=2), "Malware spreads.")], feeds.NEWS)
    cycle.run_cycle(last, commits, NOW, retention=305)
    items, _ = stored(spark, tmp_path / "store")
    assert {r["fingerprint"] for r in items.collect()} == {"z", *(f"n{i}" for i in range(10)), *(f"k{i}" for i in range(6, 300))}
    assert cycle.run_cycle(last, commits, NOW, retention=305)["new"] == 0


def test_old_states_go_and_lost_writes_are_swept(spark, tmp_path):
    commits = Commits(spark, str(tmp_path / "c"), keep=2)
    for i in range(4):
        commits.commit(commits.last(), {"t": commits.stage(spark.range(i + 1), "t")})
    lost = commits.stage(spark.range(1), "lost")
    assert commits.numbers() == [3, 4] and len(commits.files.names("data")) == 3 and commits.read(commits.last(), "t", "id long").count() == 4
    assert commits.sweep(0) == 0 and commits.sweep(1 << 50) == 1 and not commits.files.exists(lost) and commits.read(commits.last(), "t", "id long").count() == 4


def test_nothing_stays_cached(spark, configs, tmp_path):
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    rows, _ = feeds.fetch_all(spark, configs[:2], NOW)
    for i in range(2):
        cycle.run_cycle(rows, Commits(spark, str(tmp_path / "store")), NOW, number=i)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_verdicts_are_asked_for_once(spark, tmp_path):
    """Gray rows ask the classifier; what it said is stored with the cycle, and a later cycle that sees the row again doesn't ask."""
    asked = tmp_path / "asked"
    asked.mkdir()

    def factory():
        def classify(rows):
            for r in rows:
                (asked / f"{r['fingerprint']}-{os.getpid()}-{len(list(asked.iterdir()))}").write_text("")
                if r["fingerprint"] == "g3":
                    raise OSError("no answer")
            return [r["fingerprint"] == "g1" for r in rows]

        return classify

    data = [(f, title, "A", f"https://a.test/{f}", dt.datetime(2024, 1, 31), body) for f, title, body in (
        ("g1", "Patch notes", "A vulnerability."), ("g2", "Release notes", "A vulnerability."), ("sure", "Ransomware gang exploits zero-day", "Malware, phishing and a data breach."), ("none", "Weather", "Sun."))]
    batch = spark.createDataFrame(data, feeds.NEWS).coalesce(1)
    commits = Commits(spark, str(tmp_path / "store"))
    rows = cycle.decided(cycle.in_order(batch))
    gray = {r["fingerprint"] for r in rows.filter("score >= 1 and score < 5").collect()}
    assert gray == {"g1", "g2"}
    cycle.run_cycle(batch, commits, NOW, number=0, classifier=factory)
    assert sorted(p.name.split("-")[0] for p in asked.iterdir()) == ["g1", "g2"]
    want = {"fetched": 4, "language_rejected": 0, "rules_rejected": 1, "rules_accepted": 1, "ai_cache_hits": 0, "ai_validated": 2, "ai_accepted": 1, "ai_rejected": 1, "ai_errors": 0}
    assert commits.last()["facts"]["streams"][""]["paths"] == want
    assert {r["fingerprint"] for r in stored(spark, tmp_path / "store")[0].collect()} == {"g1", "sure"}
    # g2 was rejected, so it is fetched again as a new row: its verdict is known.
    cycle.run_cycle(batch, commits, NOW, number=1, classifier=factory)
    assert len(list(asked.iterdir())) == 2
    facts = commits.last()["facts"]
    assert facts["streams"][""]["paths"] == {**want, "fetched": 2, "rules_accepted": 0, "ai_cache_hits": 1, "ai_validated": 1, "ai_accepted": 0} and facts["paths"]["ai_validated"] == 3
    # An error falls back to the rules and isn't stored.
    odd = spark.createDataFrame([("g3", "Notes", "A", "https://a.test/g3", dt.datetime(2024, 1, 31), "A vulnerability.")], feeds.NEWS)
    cycle.run_cycle(odd, commits, NOW, number=2, classifier=factory)
    assert commits.last()["facts"]["streams"][""]["paths"]["ai_errors"] == 1
    assert commits.read_keyed(commits.last(), "verdicts", cycle.VERDICTS).count() == 2


def test_now_is_asked_for_each_batch(spark, configs, tmp_path):
    rows, _ = feeds.fetch_all(spark, configs[:1], NOW)
    rows.write.parquet(str(tmp_path / "in"))
    asked = []
    cycle.start(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "checkpoint"), lambda: asked.append(1) or NOW).awaitTermination()
    assert asked


def test_what_isnt_relevant_doesnt_corroborate(spark):
    """Normalise, filter, then corroborate: a twin that the filter rejects lends no credibility, a relevant one does."""
    title = "Hospital systems hit by new wave in capital"
    def batch(body):
        data = [(0, "a", title, "Some Blog", "https://a.test/0", dt.datetime(2024, 1, 31), "Ransomware &amp; malware  found.\n Tags: x"), (1, "b", title, "BleepingComputer", "https://a.test/1", dt.datetime(2024, 1, 31), body)]
        return spark.createDataFrame(data, "doc_id long, fingerprint string, title string, source string, url string, published_at timestamp, raw_content string")

    alone = cycle.enriched(batch("Weather stays mild."), NOW).collect()
    both = {r["doc_id"]: r for r in cycle.enriched(batch("Ransomware and malware there too."), NOW).collect()}
    assert [r["doc_id"] for r in alone] == [0] and set(both) == {0, 1}
    assert both[0]["source_credibility_score"] > alone[0]["source_credibility_score"] and both[0]["threat_score"] > alone[0]["threat_score"]


def test_sinks(spark, tmp_path):
    rows, kept = spark.createDataFrame([("en", "f", "hi")], "locale string, fingerprint string, message string"), []
    assert not cycle.write_both(rows, lambda r: kept.append(r.count()), lambda r: 1 / 0) and kept == [1]
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert cycle.publish(rows, lambda *_: True, ledger.path)["sent"] == 1 and ledger.records().count() == 0
    assert cycle.publish(rows, lambda *_: False, ledger.path, dry_run=False) == {"sent": 0, "errors": 1, "closed": 0, "held": 0, "left": 0}
    assert cycle.publish(rows, lambda *_: True, ledger.path, dry_run=False)["sent"] == 1 and ledger.published().count() == 1
    assert cycle.publish(rows, lambda *_: True, ledger.path, dry_run=False) == {"sent": 0, "errors": 0, "closed": 0, "held": 1, "left": 0}
    assert [(r["attempt"], r["event"]) for r in ledger.records().orderBy("attempt", "event").collect()] == [(0, "claimed"), (0, "failed"), (1, "claimed"), (1, "sent")]


def test_publish_takes_the_first_of_an_order_and_tells_what_is_left(spark, tmp_path):
    rows, sent = spark.createDataFrame([("en", f"{i:03d}", f"m{i}") for i in range(9, -1, -1)], "locale string, fingerprint string, message string"), []
    assert cycle.publish(rows, lambda _, m: not sent.append(m), str(tmp_path / "ledger"), dry_run=False, most=3) == {"sent": 3, "errors": 0, "closed": 0, "held": 0, "left": 7}
    assert sent == ["m0", "m1", "m2"]


def test_publish_records_what_was_sent(spark, tmp_path):
    """An error leaves the other messages, a fatal one ends its channel, an interrupt holds back what may have gone out."""
    rows = spark.createDataFrame([(locale, f"f{i}", f"{locale}{i}") for locale in ("en", "ua") for i in range(4)], "locale string, fingerprint string, message string")

    def send(locale, message):
        if message == "en1":
            raise OSError("time-out")
        if message == "ua2":
            raise cycle.ChannelFatal("chat not found")
        return True

    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert cycle.publish(rows, send, ledger.path, dry_run=False) == {"sent": 5, "errors": 2, "closed": 1, "held": 0, "left": 0}
    assert sorted((r["locale"], r["fingerprint"]) for r in ledger.published().collect()) == [("en", "f0"), ("en", "f2"), ("en", "f3"), ("ua", "f0"), ("ua", "f1")]
    assert ledger.unsettled().count() == 0

    def stopped(locale, message):
        if message == "ua0":
            raise KeyboardInterrupt
        return True

    other = Ledger(spark, str(tmp_path / "other"))
    with pytest.raises(KeyboardInterrupt):
        cycle.publish(rows, stopped, other.path, dry_run=False)
    assert [tuple(r) for r in other.published().collect()] == [("f0", "en")] and [tuple(r) for r in other.unsettled().collect()] == [("f0", "ua", 0)]
    assert cycle.channel_fatal(401) and cycle.channel_fatal(400, "Bad Request: chat not found") and not cycle.channel_fatal(400, "message is too long") and not cycle.channel_fatal(500)


def test_of_two_publishers_one_sends(spark, tmp_path):
    ledger, other = Ledger(spark, str(tmp_path / "l")), Ledger(spark, str(tmp_path / "l"))
    claim = ledger.claim("f", "en")
    assert claim == ("f", "en", 0) and other.claim("f", "en") is None and other.claim("f", "ua") is not None
    assert ledger.settle(claim, False) and not ledger.settle(claim, True)
    assert other.claim("f", "en") == ("f", "en", 1) and ledger.claim("f", "en") is None
    assert sorted(tuple(r) for r in ledger.blocked().collect()) == [("f", "en"), ("f", "ua")]


def test_publish_that_is_killed_holds_back_what_may_have_gone_out(spark, tmp_path):
    """The process is killed (SIGKILL) while its third message goes out: three keys are held back, the rest is sent by the next run, none twice."""
    root, ledger, out = Path(__file__).resolve().parents[1], tmp_path / "ledger", tmp_path / "out"
    code = f"""import sys, time; sys.path.insert(0, {str(root)!r})
from vigilflow.session import local_session
from vigilflow.streaming import cycle
spark = local_session(1, memory="1g")
rows = spark.createDataFrame([("en", f"f{{i}}", f"m{{i}}") for i in range(5)], "locale string, fingerprint string, message string")
def send(locale, message):
    with open({str(out)!r}, "a") as f:
        f.write(message + "\\n")
    if message == "m2":
        time.sleep(600)
    return True
cycle.publish(rows, send, {str(ledger)!r}, dry_run=False)"""
    process = subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    try:
        for _ in range(600):
            if out.exists() and out.read_text().count("\n") == 3:
                break
            time.sleep(0.2)
    finally:
        os.killpg(process.pid, signal.SIGKILL)
        process.wait()
    assert out.read_text().split() == ["m0", "m1", "m2"]
    rows = spark.createDataFrame([("en", f"f{i}", f"m{i}") for i in range(5)], "locale string, fingerprint string, message string")
    sent = []
    assert cycle.publish(rows, lambda _, m: not sent.append(m), str(ledger), dry_run=False) == {"sent": 2, "errors": 0, "closed": 0, "held": 3, "left": 0}
    assert sent == ["m3", "m4"] and [tuple(r) for r in Ledger(spark, str(ledger)).unsettled().collect()] == [("f2", "en", 0)]


def test_workers_find_the_package_from_any_folder(tmp_path):
    root = Path(__file__).resolve().parents[1]
    code = f"""import sys; sys.path.insert(0, {str(root)!r})
import __spark_entry__ as engine
from vigilflow.session import local_session
print("rows", engine.queries()["keyword_hits"](local_session(2), "/root/testdata/sf0.001").count())"""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=120)
    assert "rows " in said.stdout, said.stderr[-2000:]


def test_second_store_is_optional():
    def broken():
        raise RuntimeError("no database")

    assert tables.backends("json", "a", broken) == ["a"] and tables.backends("dual", "a", lambda: "b") == ["a", "b"]
    assert tables.backends("dual", "a", broken) == ["a"] and tables.backends("other", "a", lambda: "b") == ["a"]


def test_jdbc_options():
    got = tables.jdbc_options("postgres://me:p%40ss@db.test:5432/news?sslmode=require", "items", ("id", 0, 99), parts=4)
    assert got == {
        "url": "jdbc:postgresql://db.test:5432/news?sslmode=require", "dbtable": "items", "fetchsize": "1000", "user": "me", "password": "p@ss",
        "partitionColumn": "id", "lowerBound": "0", "upperBound": "99", "numPartitions": "4",
    }
    assert tables.jdbc_options("postgresql+psycopg://db.test/news", "t")["url"] == "jdbc:postgresql://db.test/news"
    with pytest.raises(ValueError):
        tables.jdbc_options("mysql://db.test/news", "t")
