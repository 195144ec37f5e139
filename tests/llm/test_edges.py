"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for each operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilflow.llm import chat, decontaminate, language, licenses, mixing, near_dedup, pii, sharding, token_counts, topk

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
UNBROKEN = "ab" * 100_000
ROWS = [
    (None, None, None, None), (1, "", "en", "a"), (2, "!!! ---", "en", "a"), (3, "one two three", "en", "b"), (4, "One, two; THREE", "fr", "b"), (5, "exactly the same words in this text here", None, "a"),
    (5, "exactly the same words in this text here", None, "a"), (6, LONG, "en", None), (7, UNBROKEN, "de", "a"), (8, LONG + " and one more ending", "en", "b"), (9, "ünïcode ß 漢字 " * 50, "fr", "c"), (None, "text without an id, mail x@y.zz", "en", "c"),
]
CLASH = ("id", "node", "bands", "bucket", "label", "norm", "size", "target", "key", "cell", "range", "shard", "slot", "score", "held_out", "lang_pred", "taken", "finish", "total", "all", "n", "spans", "item_id")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "word1x1 word2x2 word3x3 word4x4 word5x5 word6x6 word7x7"), (4, "one two three"), (None, "exactly the same words in this text here")], "item_id long, text string")


def test_near_dedup(docs, empty):
    rows = near_dedup.classes(docs).collect()
    assert len(rows) == len(ROWS)
    of = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None}
    assert of == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 6, 9: 9}
    assert sorted(str(r["class_id"]) for r in rows if r["doc_id"] is None) == ["None", "None"]
    kept = near_dedup.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 3, 5, 6, 7, 9, None, None]
    assert near_dedup.classes(empty).count() == 0 and near_dedup.representatives(empty).count() == 0


def test_decontaminate(docs, empty, items):
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items).collect()}
    assert (5, None) in found and (3, 4) in found and (4, 4) in found and (6, 3) in found and (8, 3) in found
    assert {d for d, _ in found} == {3, 4, 5, 6, 8}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 7, 9, None, None]
    assert decontaminate.matches(empty, items).count() == 0
    assert decontaminate.matches(docs, items.limit(0)).count() == 0 and decontaminate.clean(docs, items.limit(0)).count() == len(ROWS)


def test_windows_of_a_long_text_are_fingerprinted_in_runs(monkeypatch):
    """Fingerprints are those of each window alone, whatever the run; memory of a text of two million shingles stays bounded."""
    import tracemalloc

    draw = np.random.default_rng(2)
    hashes = draw.integers(0, 1 << 63, 4000).astype(np.uint64)
    starts = np.unique(draw.integers(0, 3900, 900))
    alone = np.concatenate([decontaminate.simhash(hashes[s : s + 60], np.zeros(1, np.int64), 60) for s in starts])
    monkeypatch.setattr(decontaminate, "RUN", 128)
    assert (decontaminate.simhash(hashes, starts, 60) == alone).all() and len(decontaminate.simhash(hashes, starts[:0], 60)) == 0
    monkeypatch.undo()
    long = draw.integers(0, 1 << 63, 2_000_000).astype(np.uint64)
    tracemalloc.start()
    assert len(decontaminate.simhash(long, np.arange(0, 2_000_000 - 60), 60)) == 2_000_000 - 60
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6


def test_decontaminate_blocks_agree(docs, items):
    one = {tuple(r) for r in decontaminate.matches(docs, items).collect()}
    assert {tuple(r) for r in decontaminate.matches(docs, items, block_items=1).collect()} == one
    assert decontaminate.clean(docs, items, block_items=1).count() == decontaminate.clean(docs, items).count()


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"]
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.filter("text is null or text = ''").count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_sharding(docs, empty):
    rows = sharding.shard(docs, shards=4).collect()
    assert len(rows) == len(ROWS) and {r["law"] for r in rows} == {"bytes"}
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {r["size"] for r in rows if r["text_crc32"] == 0} == {8}
    out = sharding.sharded(docs, shards=4)
    assert out.count() == len(ROWS) and set(docs.columns) <= set(out.columns)
    assert sharding.shard(empty).count() == 0 and sharding.sharded(empty).count() == 0


def test_language(docs, empty):
    model = language.fit(docs)
    rows = language.predict(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2)} == {"und"}
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {True}
    kept = language.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3
    assert language.fit(empty) is None and language.predict(empty, None).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}


def test_pii(docs, empty):
    rows = pii.digests(pii.find(docs)).collect()
    assert len(rows) == len(ROWS) and sum(r["n_email"] for r in rows) == 1
    assert pii.find(empty).count() == 0


def test_token_counts(docs, empty):
    rows = token_counts.count(docs, fields=("text", "source")).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert sum(r["section_tokens"]) == r["n_tokens"] == sum(r["field_tokens"])
    assert token_counts.count(empty).count() == 0


def test_licenses(docs, empty):
    assert licenses.scan(docs).count() == 0 and licenses.scan(empty).count() == 0
    assert licenses.scan(docs, templates=(("X", "exactly the same words in this text"), ("Y", ""))).count() == 2


def test_chat(spark):
    rows = [(None, None, None, None), (1, 0, None, "a"), (1, 0, "user", "b"), (1, None, "assistant", None), (1, 1, "assistant", "<|im_end|>\\"), (1, 1, "assistant", "<|im_end|>\\"), (2, 0, "a\nb", "é漢" * 1000)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    out = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(turns)).collect()}
    assert out[1]["n_turns"] == 5 and out[1]["loss_chars"] == 22 and out[None]["n_turns"] == 1 and out[2]["loss_chars"] == 0
    assert chat.digests(chat.format_conversations(turns.limit(0))).count() == 0


def test_topk(spark):
    rows = [(0, [1.0, 0.0]), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [float("inf"), 0.0]), (None, [0.5, 0.5]), (4, [1.0]), (200, []), (5, [-1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit(1))
    got = [tuple(r) for r in topk.search(vectors).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 32768), (0, 2, 2, 32768), (0, 3, 2, 32768), (0, 4, None, 32768), (0, 5, 5, -65536)]
    assert topk.search(vectors.limit(0)).count() == 0
    assert [tuple(r) for r in topk.search(vectors, block_queries=1).orderBy("query_id", "rank").collect()] == got


def test_near_dedup_tells_texts_of_one_hash_apart(spark, docs, monkeypatch):
    """With a first hash of seven values, the second one still keeps different texts apart, in classes and among representatives."""
    from vigilflow.llm import near_dedup as nd

    node = nd._node
    monkeypatch.setattr(nd, "_node", lambda text, norm, seed=0: F.pmod(node(text, norm, 0), F.lit(7)) if seed == 0 else node(text, norm, seed))
    of = {r["doc_id"]: r["class_id"] for r in nd.classes(docs).collect() if r["doc_id"] is not None}
    assert of == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 6, 9: 9}
    assert sorted((r["doc_id"] for r in nd.representatives(docs).collect()), key=str) == [1, 2, 3, 5, 6, 7, 9, None, None]


def test_near_dedup_drops_ids_where_they_are_whole(spark, docs, monkeypatch):
    from vigilflow.llm import near_dedup as nd

    whole = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    want = [1, 2, 3, 5, 6, 7, 9]
    assert sorted(r["doc_id"] for r in nd.representatives(whole).collect()) == want
    monkeypatch.setattr(nd, "BROADCAST_IDS", 0)
    assert sorted(r["doc_id"] for r in nd.representatives(whole).collect()) == want


def test_topk_keeps_scores_at_a_longs_end(spark):
    """Fewer candidates than k, all of them far below zero: none is lost."""
    rows = [(0, [1e17, 1e17]), (1, [-1e17, -1e17]), (2, [-2e17, 0.0])]
    got = [tuple(r)[:3] for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]


def test_topk_at_both_ends_of_a_long(spark):
    """More candidates than k with scores beyond a long at either end, small ones among them, and queries of zeros."""
    big = [(i, [1e17 * (-1) ** (i // 25), 1e17 * (-1) ** (i // 25)]) for i in range(1, 100)]
    rows = [(0, [1e17, 1e17]), (100, [-1e17, -1e17]), (150, [0.0, 0.0]), (200, [1e-2, 0.0]), (250, [1e300, 1e300]), *[(i, v) for i, v in big if i % 50], (300, [3.0, -7.0]), *[(300 + i, [i / 7, -i / 3]) for i in range(1, 40)]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows}
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    want = []
    for q in (i for i in whole if i % 50 == 0):
        scored = sorted((-clip(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:5])]
    assert sorted(tuple(r) for r in topk.search(vectors).collect()) == sorted(want)


@pytest.mark.parametrize("ids", ["null", "one", "own"])
def test_sharding_cuts_a_hot_text_whatever_its_ids(spark, ids):
    """A third of all rows is one text: with null ids, one id or ids of their own, shards stay about equal and slots gapless."""
    hot = {"null": F.lit(None).cast("long"), "one": F.lit(7).cast("long"), "own": F.col("id")}[ids]
    rows = spark.range(6000).repartition(5).select(F.when(F.col("id") % 3 == 0, hot).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("h" * 90)).otherwise(F.concat(F.lit("text number "), F.lpad(F.col("id").cast("string"), 78, "0"))).alias("text"))
    got = sharding.shard(rows, shards=6).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    fair = 6000 * 98 / 6
    assert len(got) == 6 and all(abs(r["bytes"] - fair) < 0.1 * fair and r["first"] == 0 and r["last"] == r["n"] - 1 == r["slots"] - 1 for r in got)


def test_mixing_with_many_rows_without_words(spark):
    """Rows without id and text take no part in the order; reruns agree."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.repeat(F.lit("w "), (F.col("id") % 9).cast("int"))).alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    one = sorted(map(str, mixing.mix(rows).select("doc_id", "size", "source_size", "target", "taken").collect()))
    assert len(one) == 3000 and sum("size=0" in r and "taken=0" in r for r in one) >= 1000
    assert sorted(map(str, mixing.mix(rows.repartition(7)).select("doc_id", "size", "source_size", "target", "taken").collect())) == one


def test_shared_folder_is_asked_for_off_local_sessions(monkeypatch):
    from types import SimpleNamespace

    from vigilflow.llm import common

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.work_folder(session)
