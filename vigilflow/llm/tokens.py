"""Byte-level BPE with exact byte offsets: a token's bytes are known, so offsets are running sums of lengths."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: Vocabulary of ranks that is installed on every machine; a parameter of each operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text is cut before merging; belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    """(encoding, byte length of each token id)."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def encode(text: str, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a text, control strings read as plain text, and the byte at which each token ends."""
    encoding, lengths = encoder(path)
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    return ids, np.cumsum(lengths[ids]) if len(ids) else np.zeros(0, np.int64)
