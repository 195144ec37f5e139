"""Terms of fixed vocabularies, all found by one pass over a text and kept as one short array of hits.

The terms of all vocabularies that a query asks about make one Aho-Corasick automaton, so a text is read once, whatever
their number, and each vocabulary is then an intersection with the few terms that the text holds. Spark has no such
function; one regular expression of all terms for each kind, in the JVM, took thirty times the CPU time.

Kinds: a whole token (runs of letters and digits, joined by hyphens), a stem (the beginning of a token), a phrase
(anywhere), a word (between characters that aren't of a word). Hits carry their kind as a first character.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilflow.functions.text import literal_array

TOKEN, STEM, PHRASE, WORD = "=", "^", "~", "#"


def _stands(kind: str, text: str, start: int, end: int) -> bool:
    """Whether what was found from start to end is bounded as its kind asks."""
    if kind == PHRASE:
        return True
    if kind == WORD:
        free = lambda i: not (0 <= i < len(text)) or not (text[i].isalnum() or text[i] == "_")
        return free(start - 1) and free(end)
    if start and (text[start - 1].isalnum() or (text[start - 1] == "-" and start > 1 and text[start - 2].isalnum())):
        return False
    if text[end - 1] == "-" and not text[end : end + 1].isalnum():
        return False
    goes_on = end < len(text) and (text[end].isalnum() or (text[end] == "-" and end + 1 < len(text) and text[end + 1].isalnum()))
    return kind == STEM or not goes_on


class Lexicon:
    """The hits that texts are read for."""

    def __init__(self, wanted: Iterable[str]):
        # A token or the head of one holds letters, digits and single hyphens; other terms of these kinds are in no text.
        self.wanted = tuple(dict.fromkeys(k for k in wanted if len(k) > 1 and (k[0] in (PHRASE, WORD) or re.fullmatch(r"[^\W_]+(?:-[^\W_]+)*" + ("-?" if k[0] == STEM else ""), k[1:]))))

    def automaton(self):
        import ahocorasick

        by_term: dict[str, list[str]] = {}
        for key in self.wanted:
            by_term.setdefault(key[1:], []).append(key)
        out = ahocorasick.Automaton()
        for term, own in by_term.items():
            out.add_word(term, (len(term), own))
        if by_term:
            out.make_automaton()
        return out

    def find(self, automaton, text: str) -> list[str]:
        """The hits of one lower-case text, each once, in order of their ends."""
        found: dict[str, None] = {}
        for last, (length, own) in automaton.iter(text) if self.wanted else ():
            for key in own:
                if key not in found and _stands(key[0], text, last + 1 - length, last + 1):
                    found[key] = None
        return list(found)

    def hits(self, text: Column) -> Column:
        """array<string> of what a lower-case text holds; none for null."""
        @F.arrow_udf("array<string>")
        def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            automaton = self.automaton()
            for texts in batches:
                yield pa.array([self.find(automaton, t or "") for t in texts.to_pylist()], pa.list_(pa.string()))

        return of(text)


def keys(terms: Iterable[str]) -> list[str]:
    """The hits that vocabulary terms stand for: stems end with *, phrases hold a blank or a hyphen, others are whole tokens."""
    return [STEM + t[:-1] if t.endswith("*") else PHRASE + t if " " in t or "-" in t else TOKEN + t for t in terms if t not in ("", "*")]


def phrases(terms: Iterable[str]) -> list[str]:
    """The hits of terms that may stand anywhere."""
    return [PHRASE + t for t in terms]


def aliases(terms: Iterable[str]) -> list[str]:
    """The hits of names: single words between word bounds, others anywhere."""
    return [(PHRASE if " " in t else WORD) + t for t in terms]


def lexicon(*wanted: Iterable[str]) -> Lexicon:
    """What texts must be read for to answer for all these hits."""
    return Lexicon(k for some in wanted for k in some)


def count(hits: Column, wanted: list[str]) -> Column:
    """How many of the wanted hits are there, each once."""
    return F.size(F.array_intersect(literal_array(dict.fromkeys(wanted)), hits)) if wanted else F.lit(0)


def any_of(hits: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(hits, literal_array(wanted)) if wanted else F.lit(False)
