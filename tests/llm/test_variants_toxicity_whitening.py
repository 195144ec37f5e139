"""Spelling variants by brute force, voters and label model of toxicity, components against numpy; edges of all three."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilflow.llm import queries, toxicity, variants, whitening

SF = "/root/testdata/sf0.01"
LONG = "ab" * 60_000
CLASH = ("id", "word", "n", "rank", "part", "key", "run", "path", "prefix", "label", "half", "draw", "stem", "score", "held_out", "v", "w", "d", "component")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def vocabulary(rows, slips=31):
    n, low = Counter(), str.maketrans(variants.UPPER, variants.LOWER)
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if slips and h % slips == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}


def brute(n):
    near, gaps = defaultdict(set), defaultdict(list)
    for w in n:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
            gaps[w[:i], w[i + 1 :]].append(w)
    for same in gaps.values():
        for a in same:
            near[a].update(b for b in same if b != a)
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


@pytest.mark.parametrize("part_words", [300, 10**9])
def test_variants_of_documents(spark, part_words):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert {tuple(r) for r in variants.group(docs, part_words=part_words).collect()} == brute(vocabulary(rows))


def test_variants_of_dense_words_and_chains(spark):
    """Words of two letters that are near each other everywhere, runs of one letter, and chains of forms."""
    draw = random.Random(4)
    lines = [" ".join("".join(draw.choice("ab") for _ in range(draw.randrange(7, 10))) for _ in range(40)) for _ in range(40)]
    lines += [" ".join(["letters"] * 2 + ["letterz"] * 30 + ["lettrrz"] * 400 + ["letrrrz"] * 5000), "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa ÀÿÀÿÀÿÀ ÀÿÀÿÀÿÀ àÿÀÿÀÿÀ àÿÀÿÀÿÀ × ÷÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷÷"]
    rows = list(enumerate(lines))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(vocabulary(rows, slips=0))
    assert {tuple(r) for r in variants.group(docs, slips=0, part_words=40).collect()} == want
    chain = {r[0]: r[2] for r in want}
    assert chain["letters"] == "letrrrz" and chain["letterz"] == "letrrrz"


def test_variants_edges(spark):
    rows = [(None, None), (1, ""), (2, "short a b"), (3, f"{LONG} {LONG} {LONG}b {LONG}b"), (None, "strange stranger Strange Stranger"), (None, "strange stranger Strange Stranger"), (4, "ünïcødé ÜnïcødÉ ünïcødéx ünïcødéx")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [tuple(r) for r in variants.group(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(vocabulary(rows))
    assert variants.group(docs.limit(0)).count() == 0 and variants.group(docs.filter("doc_id < 3")).count() == 0


def test_pairs_of_letters_are_never_made(spark):
    """A group of many words around one place gives a row a word, not a row a pair."""
    letters = [chr(c) for c in [*range(97, 123), *range(0xDF, 0x100)]]
    docs = spark.createDataFrame([(i, f"prefix{c}suffix prefix{c}suffix") for i, c in enumerate(letters)], "doc_id long, text string")
    words = variants.words(docs, slips=0)
    assert variants.pairs(words).count() <= 6 * len(letters)
    assert {r["n_near"] for r in variants.neighbours(words).collect()} == {len(letters) - 1}


def test_voters_count_words_once():
    voters = toxicity.Voters({"grob": 50.0, "grobian ": 90.0, "übel": 20.0})
    got = dict(zip(voters.names, voters.counts("You IDIOT, you idiots! Grobian; grobes Übel. Un-grob b**d"), strict=False))
    assert got["stupid"] == 2 and got["fixed"] == 2 and got["strong"] == 3 and got["medium"] == 1 and got["any"] == 4 and got["addressed"] >= 2 and got["masked"] == 1
    assert not voters.counts(None).any() and not voters.counts("").any()
    assert toxicity.stems("Abc abcdefgh ab") == {"abc", "abc ", "abcd", "abcde", "abcdef", "abcdefg", "abcdefgh "}


def test_label_model_finds_accuracies_and_correlations():
    """Voters of known accuracy, one of them copied thrice: accuracies come out, copies lean on each other, and labels beat the majority."""
    draw = np.random.default_rng(3)
    n, rate = 6000, [0.9, 0.8, 0.75, 0.7, 0.65, 0.6, 0.6]
    truth = draw.random(n) < 0.3
    votes = np.zeros((n, len(toxicity.Voters.names)), np.int64)
    for j, r in enumerate(rate):
        votes[:, j] = 2 * np.where(draw.random(n) < r, truth, ~truth)
    for j in (7, 8, 9):
        votes[:, j] = np.where(draw.random(n) < 0.97, votes[:, 6], 0)
    given = np.where(draw.random(n) < 0.05, truth.astype(int), -1)
    model = toxicity.LabelModel(votes, given, np.ones(n), 0.3)
    # One of the four that copy each other is their root.
    assert sum(int(model.parent[j]) in (6, 7, 8, 9) for j in (6, 7, 8, 9)) == 3
    # A voter that speaks up rightly in r of all toxic rows does so wrongly in 1 - r of the others.
    for j, (on, off) in ((0, (0.9, 0.1)), (1, (0.8, 0.2)), (3, (0.7, 0.3))):
        table = np.exp(model.tables[j])
        assert model.parent[j] >= 0 or (abs(1 - table[1, 0, 0] - on) < 0.06 and abs(1 - table[0, 0, 0] - off) < 0.06)
    majority = (votes[:, :10] > 0).mean(axis=1) > 0.5
    assert ((model.truth > 0.5) == truth).mean() > max(0.9, (majority == truth).mean() + 0.05)


def test_toxicity_held_out(spark):
    """Precision and recall of rows whose labels weren't learned."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.fit(docs, labels)).filter("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").toPandas()
    caught = int((found.toxic * found.predicted).sum())
    assert caught >= 0.85 * found.toxic.sum() and caught >= 0.85 * found.predicted.sum()
    assert found.score.between(0, 1).all() and ((found.score >= 0.3) == (found.predicted == 1)).all()


def test_toxicity_learns_nothing_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    one = {tuple(r) for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert {tuple(r) for r in toxicity.score(other, toxicity.fit(other, turned)).collect()} == one and len(one) == docs.count()


def test_toxicity_edges(spark):
    rows = [(None, None), (1, ""), (2, "you worthless idiot, you pathetic loser"), (2, "you worthless idiot, you pathetic loser"), (3, "a calm day"), (4, LONG), (5, "!!! ???"), (None, "no id here")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame([(2, 1), (3, 0), (3, None), (1, 0), (None, 1), (99, 1), (2, 0)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        got = toxicity.score(docs, toxicity.fit(docs, some)).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 2}) == 1
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def whole(vectors):
    return np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000


def test_whitening_against_numpy(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    x = whole([v for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    e, z = np.linalg.eigh(v)
    want = np.abs(centred @ z[:, ::-1][:, :8] / np.sqrt(e[::-1][:8]))
    got = queries.QUERIES["op13_whitening"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 8 * n and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    assert np.abs(np.abs(got.whitened.to_numpy().reshape(n, 8)) - want).max() < 1e-8
    assert (got.deviation.to_numpy().reshape(n, 8) == ((n * x - s) ** 2).sum(axis=1)[:, None]).all()
    assert np.abs(got.explained.to_numpy().reshape(n, 8) - e[::-1][:8] / e.sum()).max() < 1e-12


@pytest.mark.parametrize("d", [1, 2, 3, 7, 64])
def test_components(d):
    draw = np.random.default_rng(d)
    q, _ = np.linalg.qr(draw.standard_normal((d, d)))
    kinds = [draw.random(d), np.ones(d), np.zeros(d), np.repeat([5.0, 5 - 1e-13, 1.0], d)[:: max(1, 3 * d // d)][:d], np.r_[1.0, np.zeros(d - 1)], 1e12 * draw.random(d) ** 9]
    for values in kinds:
        v = (q * values) @ q.T
        v = (v + v.T) / 2
        e, z = whitening.components(v)
        size = max(np.abs(v).max(), 1e-300)
        assert np.abs(e - np.linalg.eigvalsh(v)[::-1][:8]).max() <= 1e-13 * size * max(1, d)
        assert np.abs(z.T @ z - np.eye(len(e))).max() < 1e-11 and np.abs(v @ z - z * e).max() <= 1e-12 * size * max(1, d)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 1.0, 0.5]), (2, [2.0, 1.0, 0.5]), (None, [0.0, -1.0, 4.0]), (3, None), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, [1.0, 2.0]), (8, []), (9, [-3.0, 7.25, 1.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = whitening.whiten(df).toPandas()
    assert len(got) == 15 and set(got.n) == {5} and sorted(map(str, got.vec_id)) == sorted(map(str, [1.0, 2.0, 2.0, nan, 9.0] * 3)) and got.identity_error.iloc[0] < 1e-9
    # Without variance there is no whitened value; a row alone has none.
    alone = whitening.whiten(df.filter("vec_id = 1")).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(alone)] == [(i, 0, None, 0.0, 0.0) for i in (1, 2, 3)]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(6)], df.select("vec_id", "embedding").schema)
    flat = whitening.whiten(line).collect()
    assert {r["component"] for r in flat if r["whitened"] is not None} == {1}
    huge = whitening.whiten(spark.createDataFrame([(i, [1e300 * (-1) ** i, float(i), 1.0]) for i in range(4)], line.schema)).collect()
    assert len(huge) == 12 and all(r["deviation"] is None for r in huge)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id in (3, 8)")).count() == 0


def test_whitening_sums_are_exact(spark):
    """Large, uneven entries: sums and covariance equal those of whole numbers without bound, however rows are dealt."""
    draw = random.Random(8)
    rows = [(i, [draw.choice([1e-3, 1.0, 1e9, -1e14]) * draw.random() for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    want = [[(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x)) / n**3 for j in range(4)] for i in range(4)]
    for parts in (1, 7):
        fit, d = whitening.fit_rows(df.repartition(parts), "vec_id", "embedding")
        assert whitening.sums(fit, d) == (n, s)
        assert np.allclose(whitening.covariance(fit, n, s), want, rtol=1e-15, atol=0)
