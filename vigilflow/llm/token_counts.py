"""Token counts by offset-mapped attribution.

A document is its fields, joined by SEPARATOR, encoded once as a whole. Sections are the lines of each
field; a section's span takes in the line end or separator that follows it. Token spans are joined to the
sections by binary search, and a token that crosses a boundary goes by an explicit rule: `first`, to the
section that holds its first byte, or `most`, to the section that holds most of its bytes (ties: the first).
Either way the sections' counts add up to the document's tokens.

Defined results: a null field is empty; an empty field is one empty section, which holds no token but its
separator's; repeated rows each count; ids may be null; no rows, no result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilflow.llm import tokens
from vigilflow.llm.common import limit_batches

SEPARATOR = "\n\n"


def sections(fields: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined document, the byte at which each section begins, and the field of each section."""
    starts, owner, at = [], [], 0
    for i, value in enumerate(fields):
        lines = value.split("\n")
        for j, line in enumerate(lines):
            starts.append(at)
            owner.append(i)
            at += len(line.encode()) + (1 if j < len(lines) - 1 else 0)
        at += len(SEPARATOR)
    return SEPARATOR.join(fields), np.array(starts, np.int64), np.array(owner, np.int64)


def allocate(ends: np.ndarray, starts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary. Of equal starts, the last section is the one that holds bytes."""
    if len(ends) == 0:
        return np.zeros(len(starts), np.int64), 0
    begins = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    home = first.copy()
    if rule == "most":
        for t in np.flatnonzero(first != last):
            edges = np.concatenate(([begins[t]], starts[first[t] + 1 : last[t] + 1], [ends[t]]))
            home[t] = first[t] + int(np.argmax(np.diff(edges)))
    elif rule != "first":
        raise ValueError(f"unknown rule {rule}")
    return np.bincount(home, minlength=len(starts)), int((first != last).sum())


def count(docs: DataFrame, fields: tuple[str, ...] = ("text",), id_col: str = "doc_id", rule: str = "first", vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """One row a document: id, n_tokens, field_tokens and section_tokens (arrays), n_sections, n_crossing."""
    limit_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("_id"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, by_field, by_section, n_sections, crossing = [], [], [], [], []
            for row in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                text, starts, owner = sections(list(row))
                ids, ends = tokens.encode(text, vocabulary)
                counts, crossed = allocate(ends, starts, rule)
                n.append(len(ids))
                by_field.append(np.bincount(owner, weights=counts, minlength=len(row)).astype(np.int64))
                by_section.append(counts)
                n_sections.append(len(starts))
                crossing.append(crossed)
            long, longs = pa.int64(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, long), pa.array(by_field, longs), pa.array(by_section, longs), pa.array(n_sections, long), pa.array(crossing, long)],
                names=["id", "n_tokens", "field_tokens", "section_tokens", "n_sections", "n_crossing"],
            )

    return chosen.mapInArrow(encode, f"id {kind}, n_tokens long, field_tokens array<long>, section_tokens array<long>, n_sections long, n_crossing long").withColumnRenamed("id", id_col)
