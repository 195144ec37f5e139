"""Exact top-k inner products by distributed histogram selection.

Vectors are whole numbers, floor(SCALE * x) for each component x. Queries are read in blocks of at most
about BLOCK_QUERIES; a block goes to every task, candidates never move. Everything is scored, several times
over rather than kept: a first pass counts scores in BINS bins of each query's possible range (plus or minus
the product of the norms), the counts of all tasks are summed, and the bin that holds the kth best score
becomes the range of the next pass, until bins are one wide. A last pass keeps the scores that reach the
kth, and a rank by score and then smaller id settles ties. A task counts all its scores and sends the bins that hold
any; a query whose kth score is known is counted no more. In the last pass a task sends its own k best of a query
(ties by id): no other can be among the k best of all.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part; vectors of
another length than the query's aren't its candidates; a row with a query's id isn't its candidate; ids
that repeat give each row its place; a null id is a candidate, behind equal scores, and never a query;
fewer candidates than k give that many rows; scores beyond a long's range stop at its ends; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilflow.llm.common import limit_batches, written

SCALE = 256
BINS = 1024
BLOCK_QUERIES = 4096
#: Scores that are held at a time.
CELLS = 1 << 22
_SAFE = 1 << 52


def _whole(embedding: pa.Array, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of whole numbers as doubles) for each vector length; unfit vectors left out."""
    lengths = embedding.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = embedding.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    first = np.concatenate(([0], np.cumsum(np.maximum(lengths, 0))))
    out = []
    for n in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == n)
        matrix = flat[first[rows][:, None] + np.arange(n)]
        fit = np.isfinite(matrix).all(axis=1)
        with np.errstate(over="ignore"):
            matrix = np.floor(matrix[fit] * scale)
        # floor(scale * x) beyond a double's range is no number either.
        fine = np.isfinite(matrix).all(axis=1)
        out.append((rows[fit][fine], matrix[fine]))
    return out


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, one row a query."""
    if q.size == 0 or c.size == 0:
        return np.zeros((len(q), len(c)), np.int64)
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < _SAFE:
        return (q @ c.T).astype(np.int64)
    ends = (1 << 63) - 1
    qi, ci = [[int(x) for x in r] for r in q], [[int(x) for x in r] for r in c]
    return np.array([[max(-ends - 1, min(ends, sum(a * b for a, b in zip(x, y, strict=True)))) for y in ci] for x in qi], np.int64)


class Block:
    """Some queries, by vector length."""

    def __init__(self, ids: np.ndarray, vectors: pa.Array, scale: float):
        self.parts = {m.shape[1]: (np.arange(len(ids))[rows], ids[rows], m) for rows, m in _whole(vectors, scale)}

    def scored(self, batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query numbers, candidate ids, which are null, scores with own rows at None) for a batch of candidates."""
        ids = batch.column(0)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        for rows, matrix in _whole(batch.column(1), scale):
            if matrix.shape[1] not in self.parts or not len(rows):
                continue
            numbers, own, queries = self.parts[matrix.shape[1]]
            step = max(1, CELLS // max(1, len(queries)))
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                scores = _scores(queries, matrix[i : i + step])
                mine = (own[:, None] == ids[some][None, :]) & ~null[some][None, :]
                yield numbers, ids[some], null[some], scores, mine


def _histogram(block: Block, low: np.ndarray, width: np.ndarray, open_: np.ndarray, scale: float):
    """(query, bin, n) of a task's candidates: all scores of the open queries in bins of their ranges; above a range is its last bin, below it nothing."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.cumsum(open_) - 1
        counts = np.zeros(int(open_.sum()) * (BINS + 1), np.int64)
        for batch in batches:
            for numbers, _, _, scores, mine in block.scored(batch, scale):
                todo = np.flatnonzero(open_[numbers])
                for part in np.array_split(todo, max(1, scores[todo].size >> 20)):
                    own, some = numbers[part], scores[part]
                    # Two longs are less than 2**64 apart: their difference is whole as an unsigned number.
                    apart = np.maximum(some, low[own][:, None]).astype(np.uint64) - low[own][:, None].astype(np.uint64)
                    at = np.minimum(apart // width[own][:, None].astype(np.uint64), np.uint64(BINS)).astype(np.int64)
                    counted = ~mine[part] & (some >= low[own][:, None])
                    counts += np.bincount((place[own][:, None] * (BINS + 1) + at)[counted], minlength=len(counts))
        cell = np.flatnonzero(counts)
        query = np.flatnonzero(open_)[cell // (BINS + 1)]
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(cell % (BINS + 1), pa.int32()), pa.array(counts[cell], pa.int64())], names=["q", "bin", "n"])

    return of


def _reaching(block: Block, least: np.ndarray, k: int, scale: float):
    """(query, vec_id, score): scores of least or more, of a batch's own k best at most."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers, ids, null, scores, mine in block.scored(batch, scale):
                r, c = np.nonzero(~mine & (scores >= least[numbers][:, None]))
                value = scores[r, c]
                order = np.lexsort((ids[c], null[c], -value.astype(np.float64) if np.abs(value).max(initial=0) < _SAFE else ~value, r))
                r, c, value = r[order], c[order], value[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                r, c, value = r[place < k], c[place < k], value[place < k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[r], pa.int32()), pa.array(ids[c], pa.int64(), mask=null[c]), pa.array(value, pa.int64())], names=["q", "vec_id", "score"]
                )

    return of


def _kth(candidates: DataFrame, block: Block, n: int, reach: float, k: int, scale: float) -> np.ndarray:
    """Each query's kth best score (or below all, if there are fewer). A pass over the candidates for each refinement; the driver gets one bin a query."""
    bound = np.zeros(n, np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        for numbers, _, m in block.parts.values():
            size = np.linalg.norm(m, axis=1)
            bound[numbers] = np.where(size > 0, np.ceil(size * reach) + 1, 1)
    # A range that could leave the longs is all of them.
    whole, least = ~(bound < float(1 << 61)), np.iinfo(np.int64).min
    bound = np.where(whole, 0, bound).astype(np.int64)
    low = np.where(whole, least, -bound)
    width = np.where(whole, (1 << 64) // BINS, np.maximum(1, -(-(2 * bound + 1) // BINS)))
    open_ = np.ones(n, bool)
    best_first = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    while open_.any():
        rows = candidates.mapInArrow(_histogram(block, low, width, open_, scale), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        kth = rows.withColumn("seen", F.sum("n").over(best_first)).filter((F.col("seen") >= k) & (F.col("seen") - F.col("n") < k)).select("q", "bin").toArrow()
        q, at = kth.column("q").to_numpy().astype(np.int64), kth.column("bin").to_numpy().astype(np.int64)
        # Fewer than k in the range: no score is left out.
        fewer = open_.copy()
        fewer[q] = False
        low[fewer], open_[fewer] = least, False
        low[q] += at * width[q]
        open_[q[width[q] == 1]] = False
        width[q] = np.maximum(1, -(-width[q] // BINS))
    return low


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates. Queries: ids divisible by every."""
    spark = vectors.sparkSession
    limit_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    queries = rows.filter(F.col("id") % every == 0)
    facts = rows.agg(F.count(F.when(F.col("id") % every == 0, 1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.coalesce(F.when(F.abs(x) < float("inf"), F.pow(F.abs(x * scale) + 1, F.lit(2.0))), F.lit(0.0))))).alias("reach")).first()
    blocks = max(1, -(-facts["n"] // block_queries))
    found = None
    for number in range(blocks):
        # A block is a hash class of the queries: about block_queries of them, whatever their number.
        part = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow()
        ids = part.column("id").to_numpy()
        block = Block(ids, part.column("v").combine_chunks(), scale)
        least = _kth(rows, block, len(ids), (facts["reach"] or 0.0) + 1, k, scale)
        names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "q int, query_id long")
        kept = rows.mapInArrow(_reaching(block, least, k, scale), "q int, vec_id long, score long")
        order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
        best = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).join(F.broadcast(names), "q").select("query_id", "rank", "vec_id", "score")
        found = (best if blocks == 1 else written(best, "topk")) if found is None else found.unionByName(written(best, "topk"))
    return found
