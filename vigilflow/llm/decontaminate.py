"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact check.

An item of m shingles (shingles.SHINGLE words) is looked for in every window of m shingles of every text,
at every word; a text with fewer shingles is one window. A window's 64-bit SimHash is looked up among those
of the items: BLOCKS blocks of 16 bits each, and every value within RADIUS // BLOCKS flips of a block, so
each item within RADIUS is found (by the pigeonhole principle, one of its blocks has that few flips). Two
windows of similarity 0.8 differ in 9.7 bits on average, with a deviation of 2.9. What is found is
checked exactly: weighted Jaccard similarity of the two multisets of shingles, SIMILARITY or more.

Before that, windows are passed over that share too few shingles with all items together to reach
SIMILARITY with any; this drops no match.

The benchmark is a stated query set. It is read in blocks of at most BLOCK_ITEMS items, each a pass over
the documents, and only one block at a time is on the driver and in the tasks.

Defined results: null and empty texts, and items without words, match nothing; repeated rows each match;
equal items each match; ids may be null; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilflow.llm import shingles
from vigilflow.llm.common import limit_batches, normalized, written
from vigilflow.llm.passages import KnownShingles, windows

SIMILARITY = 0.8
BLOCKS, RADIUS = 4, 19
BLOCK_ITEMS = 5000
#: Shingles over which windows begin that are fingerprinted at a time.
RUN = 1 << 15
_BITS = 64 // BLOCKS


def simhash(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit fingerprints of the windows hashes[s : s + length], starts rising: each bit is the sign of its sum. Memory follows RUN and length, not the text."""
    out, i = [np.zeros(0, np.uint64)], 0
    while i < len(starts):
        j = int(np.searchsorted(starts, starts[i] + RUN))
        low, high = int(starts[i]), int(starts[j - 1]) + length
        bits = np.unpackbits(hashes[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
        total = np.zeros((high - low + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=total[1:])
        sums = total[starts[i:j] - low + length] - total[starts[i:j] - low]
        out.append(np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1))
        i = j
    return np.concatenate(out)


class HammingIndex:
    """Fingerprints by the values of their blocks; a lookup returns all within the radius."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius, self.most = prints, radius, radius // BLOCKS
        flips = [0]
        for r in range(1, self.most + 1):
            flips += [sum(1 << b for b in c) for c in combinations(range(_BITS), r)]
        self.flips = np.array(flips, np.uint64)
        self.blocks = []
        for b in range(BLOCKS):
            value = self._block(prints, b)
            order = np.argsort(value, kind="stable")
            distinct, first = np.unique(value[order], return_index=True)
            self.blocks.append((distinct, np.append(first, len(order)), order))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(_BITS * b)) & np.uint64((1 << _BITS) - 1)

    def near(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of marks, which fingerprint), each pair within the radius once."""
        size, found = len(self.prints), [np.zeros(0, np.int64)]
        for b, (distinct, bounds, order) in enumerate(self.blocks):
            values = self._block(marks, b)
            if len(distinct) <= len(self.flips):
                # Fewer values than flips: hold each against all of them.
                mark, at = np.nonzero(np.bitwise_count(values[:, None] ^ distinct[None, :]) <= self.most)
            else:
                tried = values[:, None] ^ self.flips[None, :]
                place = np.minimum(np.searchsorted(distinct, tried), len(distinct) - 1)
                mark, flip = np.nonzero(distinct[place] == tried)
                at = place[mark, flip]
            n = bounds[at + 1] - bounds[at]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.repeat(mark, n) * size + order[np.repeat(bounds[at], n) + within])
        pairs = np.unique(np.concatenate(found))
        mark, item = pairs // max(size, 1), pairs % max(size, 1)
        close = np.bitwise_count(self.prints[item] ^ marks[mark]) <= self.radius
        return mark[close], item[close]


class Benchmark:
    """The items of one block, ready to be looked up."""

    def __init__(self, texts: list[str], similarity: float = SIMILARITY, radius: int = RADIUS):
        self.similarity = similarity
        self.items = []
        for first, last, hashes, bounds, _ in shingles.text_shingles(pa.array(texts, pa.string())):
            self.items += [hashes[bounds[i] : bounds[i + 1]] for i in range(last - first)]
        self.known = KnownShingles(np.concatenate([np.zeros(0, np.uint64), *self.items]))
        # A window meets the items of its own size only: one index for each size.
        self.sizes: dict[int, tuple[list[int], HammingIndex]] = {}
        for m in sorted({len(h) for h in self.items if len(h)}):
            own = [i for i, h in enumerate(self.items) if len(h) == m]
            prints = np.concatenate([simhash(self.items[i], np.zeros(1, np.int64), m) for i in own])
            self.sizes[m] = own, HammingIndex(prints, radius)

    def matches(self, hashes: np.ndarray, hit: np.ndarray) -> dict[int, tuple[float, int]]:
        """Item -> (best similarity, first window that has it), for one text."""
        best: dict[int, tuple[float, int]] = {}
        for m, (own, index) in self.sizes.items():
            length = min(m, len(hashes))
            # Of a window of length and an item of m, the shared shingles are (m + length) s / (1 + s) at least.
            least = int(np.ceil((m + length) * self.similarity / (1 + self.similarity) - 1e-9))
            starts = windows(hit, length, least) if least <= length else np.zeros(0, np.int64)
            if not len(starts):
                continue
            for first in range(0, len(starts), RUN):
                some = starts[first : first + RUN]
                for w, i in zip(*index.near(simhash(hashes, some, length)), strict=True):
                    item, start = own[i], int(some[w])
                    value = shingles.weighted_jaccard(hashes[start : start + length], self.items[item])
                    if value >= self.similarity and value > best.get(item, (0.0, 0))[0]:
                        best[item] = (value, start)
        return best


def _matcher(block: Benchmark):
    @F.arrow_udf("array<struct<item:int,similarity:double,word_start:int,n_words:int>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item", pa.int32()), ("similarity", pa.float64()), ("word_start", pa.int32()), ("n_words", pa.int32())]))
        for texts in batches:
            out: list[list] = [[] for _ in range(len(texts))]
            for first, last, hashes, bounds, words in shingles.text_shingles(texts):
                hit = block.known.hits(hashes)
                if not hit.any():
                    continue
                counts = np.diff(np.concatenate(([0], np.cumsum(hit)))[bounds])
                for i in np.flatnonzero(counts):
                    own = slice(bounds[i], bounds[i + 1])
                    best = block.matches(hashes[own], hit[own])
                    out[first + i] = [
                        {"item": item, "similarity": value, "word_start": start, "n_words": min(len(block.items[item]) + shingles.SHINGLE - 1, int(words[i]))}
                        for item, (value, start) in sorted(best.items())
                    ]
            yield pa.array(out, kind)

    return find


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list[tuple]]:
    """The items in bounded blocks, with their normalised texts."""
    block: list[tuple] = []
    for row in benchmark.select(F.col(id_col).alias("id"), normalized(F.col(text_col)).alias("norm")).filter("norm <> ''").toLocalIterator():
        block.append((row["id"], row["norm"]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(id, item_id, similarity, word_start, n_words): each item that a text holds, with its best window."""
    spark = docs.sparkSession
    limit_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), normalized(F.col(text_col)).alias("norm"))
    found, n = None, 0
    for block in _blocks(benchmark, item_col, item_text, block_items):
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"item int, item_id {benchmark.schema[item_col].dataType.simpleString()}")
        hits = texts.select("id", F.explode(_matcher(Benchmark([t for _, t in block], similarity))("norm")).alias("m")).select("id", "m.*")
        # A block's names: block_items rows at most.
        rows = hits.join(F.broadcast(names), "item").select(F.col("id").alias(id_col), "item_id", "similarity", "word_start", "n_words")
        n += 1
        if n == 2:
            found = written(found, "leaks")
        found = rows if found is None else found.unionByName(written(rows, "leaks"))
    if found is None:
        return docs.select(F.col(id_col), F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("word_start"), F.lit(0).alias("n_words")).limit(0)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs, all columns, that hold no item: a block is a filter on the scan, without a shuffle. What a block leaves is written before the next one, so a plan holds one."""
    limit_batches(docs.sparkSession)
    columns = docs.columns
    for n, block in enumerate(_blocks(benchmark, item_col, item_text, block_items)):
        if n:
            docs = written(docs, "clean")
        mark = F.size(_matcher(Benchmark([t for _, t in block], similarity))(normalized(F.col(text_col))))
        docs = docs.withColumn("__leaks", mark).filter("__leaks = 0").select(*columns)
    return docs
