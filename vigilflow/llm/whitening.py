"""Whitening of embeddings by principal components.

Vectors become whole numbers, floor(SCALE * c) + SHIFT for each entry c. Three passes over the rows: their number and
sums by dimension; the covariance, centred before multiplying; the projection, in which rows don't move. The driver
gets d sums and d * (d + 1) / 2 products of d dimensions and hands out the components, whatever the number of rows.

Sums are exact. A covariance is centred on the whole number m below the mean, so entries are small whole numbers and
their products add up without rounding in any order; what the mean lies above m is taken off in exact
arithmetic at the end, so reruns and other partitionings give the same components.

Components: the covariance is made tridiagonal by Householder reflections; Sturm counts bisect the leading
eigenvalues; inverse iteration gives their vectors, made orthogonal again inside clusters of close eigenvalues; the reflections
carry them back. A vector's largest entry (ties: the first) is positive.

Defined results: a vector that is null, or holds a null or non-finite entry, takes no part; of vectors of several lengths
those of the most frequent one do (ties: the longest); empty vectors have no component; entries beyond +-2^61 stop there;
null and repeated ids each keep their row; a component without variance (up to rounding) has a null whitened value; deviation is
null where it is beyond a long; no rows, no result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilflow.llm.common import limit_batches, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Largest entry of a vector, and whole numbers that doubles hold without rounding.
_END, _EXACT = 1 << 61, 1 << 53
_EPS = float(np.finfo(np.float64).eps)
#: Eigenvalues closer than this share of the norm are one cluster.
CLUSTER = 1e-3


def _whole(vectors: pa.Array, scale: int, shift: int) -> np.ndarray:
    """Rows of whole numbers of vectors of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(flat * scale), -float(_END), float(_END)).astype(np.int64)
    return (x + shift).reshape(len(vectors), -1)


def fit_rows(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part, and their length (0: none)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
        F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))), F.lit(False))
    )
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = most["d"] if most else 0
    return rows.filter(F.size("v") == d), d


def sums(rows: DataFrame, d: int, scale: int = SCALE, shift: int = SHIFT) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = _whole(batch.column(0), scale, shift)
            n += len(x)
            # Halves of 31 bits add up without overflow.
            total += (x >> 31).sum(axis=0).astype(object) * (1 << 31) + (x & ((1 << 31) - 1)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([str(n), *map(str, total)], pa.string())], names=["at", "part"])

    found = rows.select("v").mapInArrow(of, "at int, part string").groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    total = {r["at"]: int(r["total"]) for r in found}
    return total.get(0, 0), [total.get(i + 1, 0) for i in range(d)]


def covariance(rows: DataFrame, n: int, s: list[int], scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """Covariance over all rows, divisor n, each entry rounded once."""
    d = len(s)
    below = [x // n for x in s]
    upper = np.triu_indices(d)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, total, part, room = np.array(below, np.int64), np.zeros(len(upper[0]), object), np.zeros((d, d)), 0
        for batch in batches:
            y = _whole(batch.column(0), scale, shift) - middle
            largest = np.abs(y).max(axis=1, initial=0).astype(object)
            small = np.array([a * a * 4096 < _EXACT for a in largest], bool)
            some = y[small].astype(np.float64)
            for i in range(0, len(some), 4096):
                piece = some[i : i + 4096]
                more = int(np.abs(piece).max(initial=0)) ** 2 * len(piece)
                if room + more >= _EXACT:
                    total += part[upper].astype(np.int64).astype(object)
                    part, room = np.zeros((d, d)), 0
                part += piece.T @ piece
                room += more
            for row in y[~small].astype(object):
                total += np.outer(row, row)[upper]
        total += part[upper].astype(np.int64).astype(object)
        # In two halves, as a sum of products can be wider than any number column.
        halves = [x >> 62 for x in total] + [x & ((1 << 62) - 1) for x in total]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(halves)), pa.int32()), pa.array([str(x) for x in halves], pa.string())], names=["at", "part"])

    found = rows.select("v").mapInArrow(of, "at int, part string").groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    total = {r["at"]: int(r["total"]) for r in found}
    rest = [x - n * b for x, b in zip(s, below, strict=True)]
    v = np.zeros((d, d))
    for k, (i, j) in enumerate(zip(*upper, strict=True)):
        whole = (total[k] << 62) + total[k + len(upper[0])]
        v[i, j] = v[j, i] = float(Fraction(whole * n - rest[i] * rest[j], n * n))
    return v


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors (unit; reflection k leaves the first k + 1 entries) of a symmetric matrix."""
    a, d = np.array(v, np.float64), len(v)
    mirrors = []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        if not x[1:].any():
            mirrors.append(np.zeros(d - k - 1))
            continue
        x /= np.abs(x).max()  # squares of tiny entries would vanish
        size = np.linalg.norm(x[1:])
        x[0] += np.copysign(np.hypot(x[0], size), x[0])
        u = x / np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ u
        w = p - (u @ p) * u
        rest -= 2 * (np.outer(u, w) + np.outer(w, u))
        edge = a[k + 1 :, k] - 2 * u * (u @ a[k + 1 :, k])
        a[k + 1 :, k] = a[k, k + 1 :] = edge
        mirrors.append(u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each of some places."""
    square = off * off
    tiny = max(_EPS * _EPS * float(square.max(initial=0.0)), np.finfo(np.float64).tiny)
    count, q = np.zeros(len(at), np.int64), np.ones(len(at))
    for i in range(len(diagonal)):
        q = diagonal[i] - at - (square[i - 1] / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until doubles lie no closer."""
    d = len(diagonal)
    reach = np.abs(np.concatenate(([0.0], off))) + np.abs(np.concatenate((off, [0.0])))
    room = max(float(np.abs(diagonal).max() + reach.max()), np.finfo(np.float64).tiny) * _EPS * 4
    low, high = np.full(k, float((diagonal - reach).min()) - room), np.full(k, float((diagonal + reach).max()) + room)
    place = d - np.arange(k)  # so many eigenvalues aren't above the wanted one
    for _ in range(2200):
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            break
        over = below(diagonal, off, middle) >= place
        high, low = np.where(over, middle, high), np.where(over, low, middle)
    return low + (high - low) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, b: np.ndarray, tiny: float) -> np.ndarray:
    """x of a tridiagonal system, by elimination with row exchanges; pivots of zero become tiny."""
    d = len(diagonal)
    main, above, second, x = diagonal.copy(), np.append(off, 0.0), np.zeros(d), b.copy()
    for i in range(d - 1):
        under, here, right = off[i], main[i + 1], above[i + 1]
        if abs(under) > abs(main[i]):
            factor = main[i] / under
            main[i], main[i + 1] = under, above[i] - factor * here
            above[i], above[i + 1] = here, -factor * right
            second[i] = right
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            factor = under / (main[i] if main[i] else tiny)
            main[i + 1] = here - factor * above[i]
            x[i + 1] -= factor * x[i]
    for i in range(d - 1, -1, -1):
        rest = x[i] - (above[i] * x[i + 1] if i + 1 < d else 0.0) - (second[i] * x[i + 2] if i + 2 < d else 0.0)
        x[i] = rest / (main[i] if abs(main[i]) > tiny else np.copysign(tiny, main[i]))
    return x


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of falling eigenvalues, one a column; those of a cluster are made orthogonal in each step."""
    d, norm = len(diagonal), max(float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0)), np.finfo(np.float64).tiny)
    draw, out, first, last = np.random.default_rng(13), np.zeros((d, len(values))), 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        # Equal eigenvalues get shifts that differ a little, so that their systems do too.
        at = min(value, last - 4 * _EPS * norm) if k > first else value
        last = at
        z = draw.standard_normal(d)
        for _ in range(6):
            z = _solved(diagonal - at, off, z / np.linalg.norm(z), _EPS * norm)
            z /= np.abs(z).max()
            for _ in range(3):
                z -= out[:, first:k] @ (out[:, first:k].T @ z)
                z /= np.linalg.norm(z)
        out[:, k] = z
    return out


def components(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues of a covariance, falling, and their unit vectors, one a column."""
    k = min(k, len(v))
    scale = float(np.abs(v).max(initial=0.0))
    if not k or not scale:
        return np.zeros(k), np.eye(len(v), k)
    diagonal, off, mirrors = tridiagonal(v / scale)
    values = leading(diagonal, off, k)
    z = inverse_iteration(diagonal, off, values)
    for i in range(len(mirrors) - 1, -1, -1):
        z[i + 1 :] -= 2 * np.outer(mirrors[i], mirrors[i] @ z[i + 1 :])
    z *= np.sign(z[np.abs(z).argmax(axis=0), np.arange(k)])
    return values * scale, z


def _projected(rows: DataFrame, n: int, s: list[int], z: np.ndarray, e: np.ndarray, scale: int, shift: int) -> DataFrame:
    """(id, deviation, w): w holds the whitened values of a row, null for a component without variance."""
    middle = [x // n for x in s]
    rest = np.array([(x - n * m) / n for x, m in zip(s, middle, strict=True)])
    with np.errstate(divide="ignore"):
        factor = np.where(e > 0, 1 / np.sqrt(np.where(e > 0, e, 1)), np.nan)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(batch.column(1), scale, shift)
            y = x - np.array(middle, np.int64)
            w = ((y - rest) @ z) * factor
            # n * x - S is n * y less what the mean lies above its floor.
            most = n * (int(np.abs(y).max(initial=0)) + 1)
            if most * most * max(1, len(s)) < 1 << 63:
                apart = n * y - np.array([a - n * m for a, m in zip(s, middle, strict=True)], np.int64)
                deviation = pa.array((apart * apart).sum(axis=1), pa.int64())
            else:
                exact = [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x.tolist()]
                deviation = pa.array([t if t < 1 << 63 else None for t in exact], pa.int64())
            flat = pa.array(w.ravel(), pa.float64(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * len(e), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], names=["id", "deviation", "w"])

    return rows.select("id", "v").mapInArrow(of, f"id {rows.schema['id'].dataType.simpleString()}, deviation long, w array<double>")


def identity_error(projected: DataFrame, e: np.ndarray) -> float:
    """Largest entry of the covariance of the whitened values less the identity: measured on the rows, means first."""
    kept = [i for i in range(len(e)) if e[i] > 0]
    if not kept:
        return 0.0
    means = projected.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in kept]).first()
    apart = projected.select(*[(F.col("w")[i] - means[f"m{i}"]).alias(f"a{i}") for i in kept])
    pairs = [(i, j) for i in kept for j in kept if i <= j]
    found = apart.agg(*[F.avg(F.col(f"a{i}") * F.col(f"a{j}")).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), one row for each vector and component."""
    spark = vectors.sparkSession
    limit_batches(spark)
    rows, d = fit_rows(vectors, id_col, vector_col)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return spark.createDataFrame([], schema)
    n, s = sums(rows, d, scale, shift)
    v = covariance(rows, n, s, scale, shift)
    e, z = components(v, k)
    trace = float(np.trace(v))
    fit = np.where(e > d * _EPS * max(trace, 0.0), e, 0.0)
    projected = written(_projected(rows, n, s, z, fit, scale, shift), "whitening")
    error = identity_error(projected, fit)
    share = F.array(*[F.lit(float(x / trace) if trace > 0 else 0.0) for x in fit])
    each = projected.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error")
    )
