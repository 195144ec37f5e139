"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once, and the byte spans of its turns' contents are intersected
with the token spans by binary search. A token under the mask may reach over a content's edge; its piece of
the mask is cut at the edge, so the masked text is each content exactly.

Inside roles and contents every control string is broken by a backslash after its first character, and
every backslash is doubled; unescape() takes it back. (In roles a line end is escaped too.) So no text can
forge a marker.

A conversation is one training example: it is rendered, and so held, as a whole, whatever its rows.

Defined results: rows go by turn, then role, then text, nulls first; a null text or role is empty; rows that
repeat a turn are turns of their own; a null conv_id is a conversation; no rows, no result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilflow.llm import tokens
from vigilflow.llm.common import limit_batches

#: Control strings of common chat formats, besides the template's own.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>")


@dataclass(frozen=True)
class Template:
    """open role middle content close, for each turn."""

    open: str = "<|im_start|>"
    middle: str = "\n"
    close: str = "<|im_end|>\n"
    controls: tuple[str, ...] = CONTROLS
    _pattern: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        strings = {s for s in (*self.controls, self.open.strip(), self.close.strip()) if s}
        # Looked ahead, so that control strings that overlap are all broken.
        found = "|".join(re.escape(s) for s in sorted(strings, key=len, reverse=True))
        object.__setattr__(self, "_pattern", re.compile(f"(?=(?:{found}))(.)", re.DOTALL))

    def escape(self, text: str) -> str:
        return self._pattern.sub(r"\1\\", text.replace("\\", "\\\\"))

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The text of a conversation and the code points at which each content begins and ends."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head = self.open + self.escape(role).replace("\n", "\\\n") + self.middle
            body = self.escape(text)
            spans.append((at + len(head), at + len(head) + len(body)))
            parts += (head, body, self.close)
            at = spans[-1][1] + len(self.close)
        return "".join(parts), spans

    def parse(self, rendered: str) -> list[tuple[str, str]]:
        """Roles and texts, read back from a rendered conversation."""
        turns, at = [], 0
        while at < len(rendered):
            if not rendered.startswith(self.open, at):
                raise ValueError(f"no turn begins at {at}")
            start = at + len(self.open)
            middle = re.compile(r"(?:\\.|[^\\\n])*", re.DOTALL).match(rendered, start).end()
            end = rendered.index(self.close.strip(), middle + len(self.middle))
            turns.append((unescape(rendered[start:middle]), unescape(rendered[middle + len(self.middle) : end])))
            at = end + len(self.close)
        return turns


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def pieces(ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Rows (token, start, end) in bytes: where tokens that end at ends overlap the sorted spans."""
    starts, out = np.concatenate(([0], ends[:-1])), [np.zeros((0, 3), np.int64)]
    for low, high in spans:
        if low == high:
            continue
        first, last = np.searchsorted(ends, low, side="right"), np.searchsorted(starts, high, side="left")
        out.append(np.stack((np.arange(first, last), np.maximum(low, starts[first:last]), np.minimum(high, ends[first:last])), axis=1))
    return np.concatenate(out)


def masked_text(rendered: str, masked: np.ndarray) -> list[str]:
    """The unescaped runs of text under the mask."""
    if not len(masked):
        return []
    data = rendered.encode()
    fresh = np.flatnonzero(np.concatenate(([True], masked[1:, 1] != masked[:-1, 2])))
    last = np.append(fresh[1:], len(masked)) - 1
    return [unescape(data[a:b].decode()) for a, b in zip(masked[fresh, 1], masked[last, 2], strict=True)]


def _lists(parts: list[np.ndarray], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(p) for p in parts]))), pa.int32()), values)


def _structs(rows: np.ndarray, names: list[str], kinds: list[pa.DataType]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(rows[:, i]).cast(k) for i, k in enumerate(kinds)], names=names)


_SCHEMA = "conv_id {id}, formatted string, token_ids array<int>, token_ends array<int>, loss_mask array<boolean>, turn_spans array<struct<start:int,end:int,loss:boolean>>, loss_pieces array<struct<token:int,start:int,end:int>>"


def format_conversations(turns: DataFrame, id_col: str = "conv_id", template: Template | None = None, loss_roles: tuple[str, ...] = ("assistant",), vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """One row a conversation: conv_id, formatted, token_ids, token_ends (bytes), loss_mask, turn_spans (code points), loss_pieces (bytes)."""
    limit_batches(turns.sparkSession)
    template = template or Template()
    empty = F.lit("")
    row = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    grouped = turns.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    grouped = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(F.coalesce(t["role"], empty).alias("role"), F.coalesce(t["text"], empty).alias("text"))).alias("turns"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, ends, masks, turn_spans, masked = [], [], [], [], [], []
            for rows in batch.column(1):
                own = rows.as_py()
                text, spans = template.render([(r["role"], r["text"]) for r in own])
                token, end = tokens.encode(text, vocabulary)
                data = np.frombuffer(text.encode(), np.uint8)
                at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                loss = np.array([r["role"] in loss_roles for r in own], bool)
                part = pieces(end, [(int(at[a]), int(at[b])) for (a, b), chosen in zip(spans, loss, strict=True) if chosen])
                mask = np.zeros(len(token), bool)
                mask[part[:, 0]] = True
                texts.append(text)
                ids.append(token)
                ends.append(end)
                masks.append(mask)
                turn_spans.append(np.column_stack((np.array(spans, np.int64).reshape(-1, 2), loss)))
                masked.append(part)
            if not texts:
                continue
            whole = lambda parts: np.concatenate(parts)
            int32 = pa.int32()
            columns = [
                pa.array(texts, pa.string()), _lists(ids, pa.array(whole(ids)).cast(int32)), _lists(ends, pa.array(whole(ends)).cast(int32)), _lists(masks, pa.array(whole(masks))),
                _lists(turn_spans, _structs(whole(turn_spans), ["start", "end", "loss"], [int32, int32, pa.bool_()])), _lists(masked, _structs(whole(masked), ["token", "start", "end"], [int32] * 3)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["conv_id", "formatted", "token_ids", "token_ends", "loss_mask", "turn_spans", "loss_pieces"])

    return grouped.mapInArrow(render, _SCHEMA.format(id=turns.schema[id_col].dataType.simpleString()))


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What reads back from the output of format_conversations(): turns and masked text, as counts and hashes."""
    template = template or Template()
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            lists = batch.column(2)
            flat = lists.flatten()
            every_piece = np.stack([flat.field(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            for i, text in enumerate(batch.column(1).to_pylist()):
                turns, said = template.parse(text), "".join(masked_text(text, every_piece[bounds[i] : bounds[i + 1]]))
                every = "".join(f"{role}\n{content}\n" for role, content in turns)
                rows.append((len(turns), hashlib.sha256(every.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(text)))
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["conv_id", *names])

    return formatted.select("conv_id", "formatted", "loss_pieces").mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
