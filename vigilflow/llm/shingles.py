"""Vectorised word shingles: numpy over the UTF-8 buffers of normalised texts.

A text here is normalised (common.normalized): words joined by one space. A word's hash is a polynomial
over its bytes, taken from prefix sums; a shingle's is a mix of SHINGLE consecutive word hashes. A text
of fewer words has one shingle, over all its words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words in a shingle.
SHINGLE = 5
#: Bytes of text that are hashed at a time; a longer text is a chunk by itself.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_factors = np.array([(0xD6E8FEB86659FD93 * (2 * i + 1)) | 1 for i in range(SHINGLE)], dtype=object)
_FACTORS = [np.uint64(x & (1 << 64) - 1) for x in _factors]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> list[np.ndarray]:
    """Powers 0 to n-1 of the base and of its inverse, modulo 2**64; kept up to one chunk's length."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        if size > 4 * CHUNK:
            return tables
        _powers = tables
    return _powers


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end in data, and where each text's words begin and end."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    blank = data == 32
    after = np.empty(n, bool)
    after[0], after[1:] = True, blank[:-1]
    after[offsets[:-1][offsets[:-1] < n]] = True
    before = np.empty(n, bool)
    before[-1], before[:-1] = True, blank[1:]
    ends_at = offsets[1:]
    before[ends_at[ends_at > 0] - 1] = True
    starts, ends = np.flatnonzero(~blank & after), np.flatnonzero(~blank & before) + 1
    power, inverse = _power_table(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
        hashes = mix((prefix[ends] - prefix[starts]) * inverse[starts])
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts whose words lie between bounds, and the bounds of each text's shingles."""
    counts = np.diff(bounds)
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    out = np.concatenate(([0], np.cumsum(sizes)))
    n = len(words)
    with np.errstate(over="ignore"):
        if n >= SHINGLE:
            every = words[: n - SHINGLE + 1] * _FACTORS[0]
            for j in range(1, SHINGLE):
                every += words[j : n - SHINGLE + 1 + j] * _FACTORS[j]
            every = mix(every)
        else:
            every = np.zeros(0, np.uint64)
        full = counts >= SHINGLE
        lengths = np.where(full, sizes, 0)
        total = int(lengths.sum())
        if total == out[-1]:
            at = np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(total)
            return every[at], out
        hashes = np.empty(int(out[-1]), np.uint64)
        at = np.repeat(bounds[:-1] - out[:-1], lengths)
        place = np.repeat(out[:-1] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(total)
        hashes[place] = every[at + place]
        for i in np.flatnonzero(~full & (counts > 0)):
            own = words[bounds[i] : bounds[i + 1]]
            whole = np.uint64(len(own))
            for j, w in enumerate(own):
                whole = whole + w * _FACTORS[j]
            hashes[out[i]] = mix(np.array([whole], np.uint64))[0]
    return hashes, out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow string array; null reads as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about size bytes: first and last row, their bytes, their offsets from 0."""
    if len(texts) == 0:
        return
    data, offsets = buffers(texts)
    first, n = 0, len(texts)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def text_shingles(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk: first and last row, shingle hashes, shingle bounds by row, words by row."""
    for first, last, data, offsets in chunks(texts, size):
        words, bounds = word_hashes(data, offsets)
        hashes, out = shingle_hashes(words, bounds)
        yield first, last, hashes, out, np.diff(bounds)


def occurrences(hashes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For each hash, how many equal ones of the same owner come before it."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        keys = mix(hashes + owners.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.empty(n, bool)
    new[0], new[1:] = True, ordered[1:] != ordered[:-1]
    begins = np.flatnonzero(new)
    rank = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
    out = np.empty(n, np.int64)
    out[order] = rank
    return out


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets of hashes; 0 if either is empty."""
    if len(a) == 0 or len(b) == 0:
        return 0.0
    keys = np.concatenate((a, b))
    owner = np.concatenate((np.zeros(len(a), np.int64), np.ones(len(b), np.int64)))
    _, inverse = np.unique(keys, return_inverse=True)
    left = np.bincount(inverse[owner == 0], minlength=inverse.max() + 1)
    right = np.bincount(inverse[owner == 1], minlength=inverse.max() + 1)
    return float(np.minimum(left, right).sum() / np.maximum(left, right).sum())
