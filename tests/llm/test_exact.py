"""Operators against brute force, round trips, oracles and held-out accuracy."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigilflow.llm import chat, decontaminate, language, licenses, near_dedup, pii, queries, sharding, shingles, token_counts, tokens

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bag(w):
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def similarity(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def brute_classes(texts):
    """doc id -> smallest id of its class, by comparing every pair that shares a shingle."""
    bags, holders, up = {d: bag(words(t)) for d, t in texts.items()}, collections.defaultdict(list), {d: d for d in texts}
    for d, b in bags.items():
        for s in b:
            holders[s].append(d)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in {(a, b) for ds in holders.values() for a in ds for b in ds if a < b}:
        if similarity(bags[a], bags[b]) >= 0.8:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {d: top(d) for d in texts}


def brute_leaks(texts, items):
    found = set()
    known = {s for t in items.values() for s in bag(words(t))}
    for d, t in texts.items():
        w = words(t)
        if known.isdisjoint(bag(w)):
            continue
        for i, item in items.items():
            n = len(words(item))
            if any(similarity(bag(w[k : k + n]), bag(words(item))) >= 0.8 for k in range(max(1, len(w) - n + 1))):
                found.add((d, i))
    return found


def test_near_dedup(spark, docs):
    got = {r["doc_id"]: r["class_id"] for r in queries.QUERIES["op10_near_dedup"](spark, SF).collect()}
    assert got == brute_classes({d: t for d, t, _ in docs})


def test_near_dedup_chains_and_hot_groups(spark):
    """Near copies of one text by the hundred, whose links form a component only through each other."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for d in range(300):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            w[r.randrange(150)] = f"x{r.randrange(10**9)}"
        texts[d] = " ".join(w)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x["doc_id"]: x["class_id"] for x in near_dedup.classes(frame).collect()} == brute_classes(texts)


def test_blocks_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK_NODES", 20)
    test_near_dedup_chains_and_hot_groups(spark)


def altered(rng, base, changes):
    """base with that many of its words, apart from each other, replaced."""
    out = list(base)
    for at in rng.sample(range(2, len(base) - 2, 6), changes):
        out[at] = f"w{rng.randrange(10**9)}"
    return " ".join(out)


def test_near_dedup_sends_a_group_of_near_copies_to_few_blocks(spark, monkeypatch):
    """200 texts around one that they are copies of or nearly so, and 30 that are farther from it, in chunks of 20."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(104)]
    texts = {0: " ".join(base)} | {i: altered(rng, base, 2 + i % 2) for i in range(1, 200)}
    texts |= {i: altered(rng, base, 4) for i in range(200, 230)}
    monkeypatch.setattr(near_dedup, "CHUNK_NODES", 20)
    sent, plain = [], near_dedup._dealt

    def counted(members, texts_of):
        out = plain(members, texts_of)
        parts = members.groupBy("label", "part").count().collect()
        sent.append((out.count(), sum(r["count"] for r in parts), max(r["count"] for r in parts)))
        return out

    monkeypatch.setattr(near_dedup, "_dealt", counted)
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_classes(texts)
    for rows, nodes, most in sent:
        beside = nodes - most
        # The largest component's nodes go to the chunks of the others; theirs to all chunks.
        assert rows <= most * (beside / 20 + 1) + beside * (nodes / 20 + 2), (rows, nodes, most)


def test_near_dedup_blocks_hold_every_pair_of_components_once(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK_NODES", 10)
    # Two groups: one of components of 45, 30 and many single nodes, one of a single chunk.
    part = {n: 0 if n < 45 else 1 if n < 75 else n for n in range(110)} | {n: n % 2 for n in range(200, 206)}
    members = spark.createDataFrame([(n, n // 200, p) for n, p in part.items()], "node long, label long, part long")
    texts = spark.createDataFrame([(n, "some words") for n in part], "node long, norm string")
    blocks = collections.defaultdict(set)
    for r in near_dedup._dealt(members, texts).collect():
        blocks[r["label"], r["low"], r["high"]].add(r["node"])
    met = {(a, b) for held in blocks.values() for a in held for b in held if a < b}
    apart = {(a, b) for a in part for b in part if a < b and a // 200 == b // 200 and part[a] != part[b]}
    assert apart <= met and all(a // 200 == b // 200 for a, b in met)
    # No block is made of the chunks of one large component alone.
    assert all(len({part[n] for n in held}) > 1 for held in blocks.values())


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(1)
    shared, a, b = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (300, 60, 60))
    left, right = np.concatenate((shared, shared[:50], a)), np.concatenate((shared, shared[:50], b))
    sig = near_dedup.dart_signatures(np.concatenate((left, right)), np.array([0, len(left), len(left) + len(right)]), k=2000)
    assert abs((sig[0] == sig[1]).mean() - shingles.weighted_jaccard(left, right)) < 0.05 and (sig != 0).all()
    alone = near_dedup.dart_signatures(left, np.array([0, len(left)]), k=2000)
    assert (alone[0] == sig[0]).all()


def test_linked_block_is_all_pairs():
    r = np.random.default_rng(2)
    pool = r.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.concatenate((r.choice(pool, 50, replace=False), pool[:3])) for _ in range(40)]
    links = near_dedup.linked_block(np.arange(40), sets, 0.75, columns=7)
    up = list(range(40))
    top = lambda x: x if up[x] == x else top(up[x])
    for i in range(40):
        for j in range(i):
            if shingles.weighted_jaccard(sets[i], sets[j]) >= 0.75:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    want = [top(i) for i in range(40)]
    up = list(range(40))
    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    assert [top(i) for i in range(40)] == want


def test_decontamination(spark, docs):
    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall())
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op4_decontamination"](spark, SF).collect()}
    assert got == brute_leaks({d: t for d, t, _ in docs}, items)


def test_hamming_index_finds_all_within_radius():
    r = np.random.default_rng(4)
    prints = r.integers(0, 2**63, 5000, dtype=np.uint64)
    marks = np.concatenate((prints[:20] ^ np.uint64(0b1011 << 7), r.integers(0, 2**63, 20, dtype=np.uint64)))
    for index in (decontaminate.HammingIndex(prints), decontaminate.HammingIndex(prints[:30])):
        got = set(zip(*map(list, index.near(marks)), strict=True))
        want = {(i, j) for i, m in enumerate(marks) for j, p in enumerate(index.prints) if bin(int(m) ^ int(p)).count("1") <= decontaminate.RADIUS}
        assert got == want


def test_licenses(spark, docs):
    got = {(r["doc_id"], r["template"]) for r in queries.QUERIES["op5_license_scan"](spark, SF).collect()}
    want = set()
    for i, (_, template) in enumerate(licenses.TEMPLATES):
        t = set(bag(words(template)))
        m = len(t)
        stride = max(1, m // 2)
        for d, text, _ in docs:
            w = words(text)
            s = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))]
            if t.isdisjoint(s):
                continue
            if any(len(t & set(s[k : k + m + stride - 1])) >= 0.8 * m for k in range(len(s))):
                want.add((d, i))
    assert got == want and len(got) > 10


def test_language_held_out(spark):
    rows = queries.QUERIES["op6_language_id"](spark, SF).collect()
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    out = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and len(out) > 100
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) / len(out) > 0.98


def test_language_families_split_by_pairs():
    model = language.Model(np.eye(6, language.SIZE, dtype=np.float32), np.array(["en", "de", "fr", "es", "xx", "yy"]))
    assert model.families == ["=xx", "=yy", "germanic", "romance"] and len(model.inside["germanic"]) == 1 and len(model.between) == 6
    assert model.predict(np.eye(6, language.SIZE, dtype=np.float32))[0] == ["en", "de", "fr", "es", "xx", "yy"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = sorted(map(tuple, con.sql(f"SELECT {', '.join(sorted(queries.QUERIES[name](spark, SF).columns))} FROM ({queries.ORACLES[name]})").fetchall()), key=repr)
    frame = queries.QUERIES[name](spark, SF)
    # By their texts, as rows may hold nulls.
    assert sorted(map(tuple, frame.select(*sorted(frame.columns)).collect()), key=repr) == want


def test_sharding(spark):
    rows = queries.QUERIES["op8_sharding"](spark, SF).collect()
    held, texts, slots = collections.Counter(), collections.defaultdict(set), collections.defaultdict(list)
    for r in rows:
        held[r["shard"]] += r["size"]
        texts[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert set(held) == set(range(24)) and max(held.values()) < 1.1 * min(held.values())
    assert all(len(s) == 1 for s in texts.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_of_a_hot_text(spark):
    """A third of the rows hold one text: it is cut over shards, all others stay together."""
    rows = [(i, "the same text " * 20 if i % 3 == 0 else f"text number {i // 2} " * 15) for i in range(6000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=6).collect()
    held, texts = collections.Counter(), collections.defaultdict(set)
    for r in got:
        held[r["shard"]] += r["size"]
        texts[r["text_crc32"]].add(r["shard"])
    assert max(held.values()) < 1.1 * min(held.values()) and sum(len(s) > 1 for s in texts.values()) == 1


def plain_spans(text):
    """The base patterns, straight from their definition."""
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub(r"\D", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
    }
    out = [(m.start(), m.end(), k) for k, (p, ok) in kinds.items() for m in re.finditer(p, text, re.ASCII) if ok(m[0])]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+1289 ()%,é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_query(spark, docs):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op9_pii"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for d, text, _ in docs:
        base = plain_spans(text)
        assert rows[d]["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(filter(None, pii.joined(base).split(","))) <= set(rows[d]["spans"].split(","))


def test_field_adds_spans_and_leaves_other_numbers():
    field = pii.fitted()
    found = lambda t: [(t[a:b], k) for a, b, k in pii.all_spans(t, field, pii.base_spans(t))]
    assert found("please call (415) 555-2671 today") == [("(415) 555-2671", "phone")]
    assert found("my phone is 415 555 2671") == [("415 555 2671", "phone")]
    assert found("write to jane (at) mails (dot) org now") == [("jane (at) mails (dot) org", "email")]
    for plain in ("on 2024-05-17 it rained", "a total of 12,345,678 units", "order 4041894974608796 shipped", "pages 10, 20, 30 and 40"):
        assert found(plain) == []


def test_chat_round_trip(spark):
    rows = queries.QUERIES["op1_chat_format"](spark, SF).collect()
    turns = collections.defaultdict(list)
    for c, t, role, text in duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet' ORDER BY 1, 2, 3, 4").fetchall():
        turns[c].append((role, text or ""))
    turns[-1] = [("user", queries.FORGED), ("assistant", queries.FORGED)]
    assert len(rows) == len(turns)
    for r in rows:
        own = turns[r["conv_id"]]
        said = "".join(t for role, t in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in own).encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.text(alphabet="a<|>im_startend[/INST]s\\\n é漢", max_size=30)), max_size=4))
def test_template_is_reversible(turns):
    template = chat.Template()
    text, spans = template.render(turns)
    assert template.parse(text) == turns
    _, ends = tokens.encode(text)
    at = np.append(np.flatnonzero((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80), len(text.encode()))
    masked = chat.pieces(ends, [(int(at[a]), int(at[b])) for a, b in spans])
    assert "".join(chat.masked_text(text, masked)) == "".join(t for _, t in turns)


def test_token_attribution(docs):
    for _, text, lang in docs[:50]:
        whole, starts, owner = token_counts.sections([lang, text])
        ids, ends = tokens.encode(whole)
        assert ends[-1] == len(whole.encode())
        for rule in ("first", "most"):
            counts, _ = token_counts.allocate(ends, starts, rule)
            assert counts.sum() == len(ids)
        brute = collections.Counter(max(i for i, s in enumerate(starts) if s <= (ends[t - 1] if t else 0)) for t in range(len(ids)))
        assert dict(brute) == {i: int(n) for i, n in enumerate(token_counts.allocate(ends, starts)[0]) if n}


def test_shingles_match_plain_python():
    r = random.Random(6)
    texts = [" ".join(r.choice(["a", "bb", "ccc", "é"]) for _ in range(r.randrange(12))) for _ in range(200)] + [None, ""]
    plain = [bag((t or "").split()) for t in texts]
    for size in (1, 50, 1 << 20):
        got = [h[b[i] : b[i + 1]] for first, last, h, b, _ in shingles.text_shingles(pa.array(texts), size) for i in range(last - first)]
        assert len(got) == len(texts)
        names = {}
        for p, g in zip(plain, got, strict=True):
            assert sorted(p.values()) == sorted(collections.Counter(g.tolist()).values())
            if len(p) and sum(p.values()) > 1:
                names.setdefault(frozenset(p.items()), set()).add(frozenset(collections.Counter(g.tolist()).items()))
        assert all(len(v) == 1 for v in names.values())


def test_pipeline_stages(spark, docs):
    """Each stage on its own input: brute-force classes and leaks, conservation of the rest."""
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "decontaminate", "mix", "shard"]
    frame, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        columns, before = frame.columns, frame.select("doc_id", "text").collect()
        frame = stage(spark, frame, SF).cache()
        seen.append((columns, before, frame.columns, [r["doc_id"] for r in frame.select("doc_id").collect()]))
    assert all(a == c for a, _, c, _ in seen[:-1]) and {"shard", "slot"} <= set(seen[-1][2])
    assert len(seen[0][3]) == len(docs)
    classes = brute_classes({r["doc_id"]: r["text"] for r in seen[1][1]})
    assert sorted(seen[1][3]) == sorted(set(classes.values()))
    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall())
    leaked = {d for d, _ in brute_leaks({r["doc_id"]: r["text"] for r in seen[2][1]}, items)}
    assert sorted(seen[2][3]) == sorted(set(r["doc_id"] for r in seen[2][1]) - leaked)
    assert max(collections.Counter(seen[3][3]).values()) <= 3
    assert sorted(seen[4][3]) == sorted(seen[3][3])


def test_language_stage_rejects_what_was_not_learned(spark):
    """Languages and scripts that were not learned, and no language, go; learned ones, mixed ones and short texts stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    alien = [
        " ".join(["Tämä on suomenkielinen lause joka kertoo säästä ja ihmisistä kaupungissa tänään"] * 4), "これは日本語の文章です。天気はとても良いです。これは日本語の文章です。", "Это русский текст о погоде и людях в городе",
        "Αυτό είναι ελληνικό κείμενο για τον καιρό", "Toto je česká věta o počasí a lidech ve městě", " ".join(["Bu bir Türkçe cümledir hava ve insanlar hakkında"] * 8), "هذا نص باللغة العربية عن الطقس والناس", "12 34 !!!",
    ]
    own = [r["text"] for r in docs.filter("length(text) > 400").orderBy("doc_id").limit(60).collect()]
    stay = [*own, own[0][:200] + " " + own[1][:200], "Merci", "a"]
    rows = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(alien + stay)], docs.schema)
    kept = {r["doc_id"] for r in language.keep_known(rows, model).collect()}
    assert kept == set(range(len(alien), len(alien) + len(stay)))


def test_language_counts_a_long_text_in_pieces(docs):
    long = np.frombuffer(" ".join(t for _, t, _ in docs[:80]).encode(), np.uint8)
    whole, ends = language.features(long, np.array([0, len(long)])), np.array([0, len(long)])
    assert np.allclose(whole, language.features(long, ends, piece=1000), atol=1e-6) and len(long) > 100_000


def test_language_pairs_vote_like_a_plain_count():
    """predict() against a loop over all duels: the family with most duels won, then the language with most inside it."""
    r = np.random.default_rng(9)
    names = ["en", "de", "nl", "fr", "es", "xx"]
    centres = r.normal(size=(6, language.SIZE)).astype(np.float32)
    x = np.concatenate([c + r.normal(scale=2.0, size=(30, language.SIZE)).astype(np.float32) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = language.Model(x, np.repeat(names, 30))
    got, score, _ = model.predict(x)

    def winner(row, pairs, n):
        won = [0.0] * n
        for a, b, w, bias in pairs:
            sure = 1 / (1 + np.exp(-language.SLOPE * float(row @ w + bias)))
            won[a] += (sure >= 0.5) + sure * 1e-3
            won[b] += (sure < 0.5) + (1 - sure) * 1e-3
        return int(np.argmax(won))

    for row, label, s in zip(x, got, score, strict=True):
        family = model.families[winner(row, model.between, len(model.families))]
        members = model.members[family]
        assert label == members[winner(row, model.inside[family], len(members))] and 0 <= s <= 1
    assert np.mean(np.array(got) == np.repeat(names, 30)) > 0.9


def brute_splits(tokens, field, text):
    """The best score of all segmentations of a zone, by listing them."""
    runs, rows = field.segments(tokens, text)
    score = {run: float((f @ field.weights.T).max()) for run, f in zip(runs, rows, strict=True)}

    def best(i):
        if i == len(tokens):
            return 0.0
        return max([field.outside + best(i + 1), *(score[i, j] + best(j) for j in range(i + 1, len(tokens) + 1) if (i, j) in score)])

    return best(0)


@pytest.mark.parametrize("text", ["call 415-555-1234, 10", "visa 4111.1111.1111.1111", "ip 10, 0, 0, 1", "jane (at) mails (dot) org", "on 2024-05-17 5", "+12 (34) 5678 90"])
def test_field_finds_the_best_of_all_segmentations(text):
    field = pii.fitted()
    for start, end in pii._zones(text):
        tokens = pii._tokens(text, start, end)[:9]
        found = field.best(tokens, text)
        covered = sum(j - i for i, j, _ in found)
        runs, rows = field.segments(tokens, text)
        at = {run: f for run, f in zip(runs, rows, strict=True)}
        total = field.outside * (len(tokens) - covered) + sum(float((at[i, j] @ field.weights.T)[k]) for i, j, k in found)
        assert abs(total - brute_splits(tokens, field, text)) < 1e-9


def test_token_counts_query(spark):
    """The registered query on whole documents: each token goes to the section that holds its first byte, counted one by one."""
    rows = {r["doc_id"]: r for r in queries.QUERIES["op2_token_counts"](spark, SF).collect()}
    table = duckdb.sql(f"SELECT doc_id, lang, source, text FROM '{SF}/documents.parquet'").fetchall()
    assert len(rows) == len(table)
    for d, *fields in table:
        fields = [f or "" for f in fields]
        whole = "\n\n".join(fields).encode()
        _, ends = tokens.encode(whole.decode())
        # The section of each byte: a line with its line end, the last line of a field with the separator.
        section, field, of_section, of_field = 0, 0, [], []
        for f in fields:
            for line in f.encode().split(b"\n"):
                of_section.append((section, len(line) + 1))
                of_field.append(field)
                section += 1
            of_section[-1] = (of_section[-1][0], of_section[-1][1] + 1)
            field += 1
        owner = np.concatenate([np.full(n, s) for s, n in of_section])[: len(whole)]
        first = [0, *ends[:-1]]
        want = collections.Counter(int(owner[b]) for b in first) if len(ends) else collections.Counter()
        got = rows[d]
        assert got["n_tokens"] == len(ends) and got["section_tokens"] == [want[s] for s in range(section)], d
        assert [got["lang_tokens"], got["source_tokens"], got["text_tokens"]] == [sum(n for s, n in want.items() if of_field[s] == i) for i in range(3)]
        assert got["n_crossing"] == sum(owner[b] != owner[e - 1] for b, e in zip(first, ends))


def test_sharding_query_is_whole_and_even(spark):
    """The registered query against each document by itself: sizes, crc32, slots without gaps, shards nearly equal, equal texts together."""
    import zlib

    rows = queries.QUERIES["op8_sharding"](spark, SF).collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots, held = collections.defaultdict(list), collections.Counter()
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(held) <= set(range(24))
    fair = sum(held.values()) / 24
    assert max(abs(h - fair) for h in held.values()) < 0.1 * fair
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in queries.QUERIES["op8_sharding"](spark, SF).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}


def test_added_spans_recall():
    """On generated sentences that the field was not fitted to: how many planted spans it finds, and how many it makes up."""
    found, planted, made_up = 0, 0, 0
    for text, spans in pii._examples(400, seed=77):
        got = {(text[a:b], k) for a, b, k in pii.all_spans(text, pii.fitted(), pii.base_spans(text))}
        base = {(text[a:b], k) for a, b, k in pii.base_spans(text)}
        planted += len(spans)
        found += len(set(spans) & got)
        made_up += len(got - set(spans) - base)
    assert found / planted >= 0.9 and made_up / planted <= 0.1, (found / planted, made_up / planted)
