"""Spelling variants by a dictionary of trie-node pairs.

Words are the distinct letter runs of whole texts that are long and frequent enough. Two tries, of the words and of
the words reversed, have their nodes numbered; a word is then two paths of numbers, and what is left of it when one
place is skipped is a pair of numbers (prefix node, suffix node). Words that differ in one replaced letter have an equal
skipped pair; a word with a letter more has a skipped pair that equals a pair of the shorter word cut at a place. So
one shuffle by pair finds every word at one insertion, deletion or replacement, and nothing else. Of a run
of one letter only the first place counts as deleted, so no link is found twice.

Only nodes that more than one word shares are numbered and paired: a pair with a node of one word meets nothing.
That leaves a few pairs a word. A pair has at most one word a letter of the alphabet and one that is cut there,
so its group is bounded by the alphabet; counts and best partners are taken by windows, and no pair of words is made.

Numbering: words are dealt into ranges by boundary words (a bounded sample: PARTS * PER_PART words at most) and read
in order; a node is new where a word leaves the path of the one before it. A prefix that reaches over
a range's edge is a prefix of the boundary word there, and all those have numbers of their own beforehand.

Defined results: null and empty texts have no words; a null id reads as the empty text; repeated rows count again;
words of any length are read whole; no words, no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilflow.llm.common import limit_batches, written

RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_N, TIMES = 7, 2, 10
#: One in so many occurrences loses a letter.
SLIPS = 31
#: Ranges of a trie at most, words in one at least, and boundary words drawn for each.
PARTS, PART_WORDS, PER_PART = 4096, 20_000, 16


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = SLIPS, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N) -> DataFrame:
    """(word, n): the vocabulary. Occurrences whose crc32 of id and word is divisible by slips lose a letter (0: none do)."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    if slips:
        drawn = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
        at = (F.col("drawn") % F.length("run")).cast("int")
        without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        found = found.withColumn("drawn", drawn).select(F.when(F.col("drawn") % slips == 0, without).otherwise(F.col("run")).alias("run"))
    return found.filter(F.length("run") >= least_length).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


class Bounds:
    """Boundary words of one trie in order, and the numbers (below 0) of all their nodes."""

    def __init__(self, some: list[str]):
        self.words, self.paths, last, path, fresh = sorted(some), [], "", [], 0
        for word in self.words:
            path = path[: _shared(last, word)]
            while len(path) < len(word):
                fresh -= 1
                path.append(fresh)
            self.paths.append(path)
            last, path = word, list(path)

    def part(self, word: str) -> int:
        return bisect_right(self.words, word)

    def beside(self, part: int, word: str) -> list[int]:
        """Numbers of the longest beginning of a word that a boundary of its range has too."""
        found: list[int] = []
        for i in (part - 1, part):
            if 0 <= i < len(self.words) and (n := _shared(self.words[i], word)) > len(found):
                found = self.paths[i][:n]
        return found


def _numbered(bounds: Bounds):
    """(word, path) of rows (part, key, word) in order: numbers of the key's nodes from the root on, as deep as other words share them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, fresh, path = None, 0, [0]
        held: tuple[str, str, int] | None = None  # the word before, until the next one tells how deep it is shared
        words_, paths = [], []

        def settle(shared: int) -> None:
            nonlocal fresh
            key, word, before = held
            beside = bounds.beside(part, key)
            deep = max(shared, before, len(beside))
            del path[before + 1 :]
            for d in range(len(path), deep + 1):
                if d <= len(beside):
                    path.append(beside[d - 1])
                else:
                    fresh += 1
                    path.append((part + 1) << 40 | fresh)
            words_.append(word)
            paths.append(list(path))

        for batch in batches:
            for p, key, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = 0
                if held is not None:
                    same = _shared(held[0], key) if p == part else 0
                    settle(same)
                if p != part:
                    part, fresh, path = p, 0, [0]
                held = (key, word, same)
            if words_:
                yield pa.RecordBatch.from_arrays([pa.array(words_, pa.string()), pa.array(paths, pa.list_(pa.int64()))], names=["word", "path"])
                words_, paths = [], []
        if held is not None:
            settle(0)
            yield pa.RecordBatch.from_arrays([pa.array(words_, pa.string()), pa.array(paths, pa.list_(pa.int64()))], names=["word", "path"])

    return of


def _paths(vocabulary: DataFrame, key: Column, n: int, part_words: int) -> DataFrame:
    """(word, path) in the trie of the keys."""
    keyed = vocabulary.select(key.alias("key"), "word")
    parts = min(PARTS, n // part_words)
    drawn: list[str] = []
    if parts:
        some = keyed.filter(F.pmod(F.xxhash64("word", F.lit(5)), F.lit(max(1, n // (parts * PER_PART)))) == 0)
        drawn = sorted(r["key"] for r in some.select("key").limit(2 * PARTS * PER_PART).collect())
    # The shortest of each few: boundaries stay short whatever the words are.
    bounds = Bounds(sorted({min(drawn[i : i + PER_PART], key=len) for i in range(0, len(drawn), PER_PART)}))

    @F.arrow_udf("int")
    def part(keys: pa.Array) -> pa.Array:
        return pa.array([bounds.part(k) for k in keys.to_pylist()], pa.int32())

    dealt = keyed.select(part("key").alias("part"), "key", "word").repartition("part").sortWithinPartitions("part", "key")
    return dealt.mapInArrow(_numbered(bounds), "word string, path array<long>")


def pairs(vocabulary: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(prefix, suffix, word, n, cut, first): pairs of shared nodes of each word (word, n), around a skipped letter or, if cut, around no letter. first: the skipped letter is the first of its run."""
    limit_batches(vocabulary.sparkSession)
    n = vocabulary.count()
    forward = _paths(vocabulary, F.col("word"), n, part_words).withColumnRenamed("path", "f")
    backward = _paths(vocabulary, F.reverse("word"), n, part_words).withColumnRenamed("path", "r")
    both = vocabulary.join(forward, "word").join(backward, "word")
    length = F.length("word")

    def places(gap: int) -> Column:
        """Places i with a shared node before i and one behind i + gap."""
        low, high = F.greatest(F.lit(0), length - gap - F.size("r") + 1), F.least(F.size("f") - 1, length - gap)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def pair(i: Column, gap: int) -> Column:
        first = F.lit(True) if not gap else (i == 0) | (F.substring("word", i, F.lit(1)) != F.substring("word", i + 1, F.lit(1)))
        return F.struct(F.col("f")[i].alias("prefix"), F.col("r")[length - gap - i].alias("suffix"), F.lit(not gap).alias("cut"), first.alias("first"))

    every = F.concat(F.transform(places(1), lambda i: pair(i, 1)), F.transform(places(0), lambda i: pair(i, 0)))
    return both.select("word", "n", F.explode(every).alias("at")).select("at.prefix", "at.suffix", "word", "n", "at.cut", "at.first")


def neighbours(vocabulary: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, n_near, near, near_n): of each word that has near words their number and the most frequent one (ties: the smallest)."""
    group = Window.partitionBy("prefix", "suffix")
    by_rank = group.orderBy("rank")
    skipped, longer = ~F.col("cut"), ~F.col("cut") & F.col("first")
    best = lambda which: F.min(F.when(which, F.col("rank"))).over(group)
    seen = (
        pairs(vocabulary, part_words)
        .withColumn("rank", F.struct((-F.col("n")).alias("minus_n"), F.col("word").alias("word")))
        .withColumn("place", F.row_number().over(by_rank))
        .withColumns({"n_skipped": F.count_if(skipped).over(group), "n_longer": F.count_if(longer).over(group), "n_cut": F.count_if("cut").over(group)})
        .filter((F.col("n_skipped") > 1) | ((F.col("n_cut") > 0) & (F.col("n_longer") > 0)))
        .withColumns({"best": best(skipped), "best_longer": best(longer), "shorter": best(F.col("cut"))})
    )
    # The best of the others: the second of the group for the best one itself.
    second = F.min(F.when(skipped & (F.col("rank") != F.col("best")), F.col("rank"))).over(group)
    other = F.when(F.col("rank") == F.col("best"), F.col("second")).otherwise(F.col("best"))
    ranked = seen.withColumn("second", second).select(
        "word",
        F.when(F.col("cut"), F.col("n_longer")).otherwise(F.col("n_skipped") - 1 + F.when(F.col("first"), F.col("n_cut")).otherwise(0)).alias("n_near"),
        F.when(F.col("cut"), F.col("best_longer")).otherwise(F.least(other, F.when(F.col("first"), F.col("shorter")))).alias("near"),
    )
    found = ranked.filter("n_near > 0").groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("near").alias("near"))
    return found.select("word", "n_near", F.col("near.word").alias("near"), (-F.col("near.minus_n")).alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): each word's last form. Steps double, so a chain of 2^k links takes k rounds."""
    at = links.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-roots")
        if not at.filter("moved").limit(1).count():
            return at.select("word", "root")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = SLIPS, times: int = TIMES, part_words: int = PART_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word with the frequent near word that it is a variant of, and the last of such forms."""
    vocabulary = written(words(docs, id_col, text_col, slips), "variants-words")
    near = vocabulary.join(neighbours(vocabulary, part_words), "word", "left")
    variant = F.col("near_n") >= times * F.col("n")
    found = written(
        near.select(
            "word", F.when(variant, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(variant, F.col("near_n")).alias("form_n")
        ),
        "variants",
    )
    ends = roots(found.filter(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
