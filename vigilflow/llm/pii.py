"""Personal data: base patterns, and more spans by a semi-Markov conditional random field.

The base patterns (e-mail, IPv4, card and phone numbers) are matched per kind, leftmost and without overlap,
by scans that are linear in the text. Their spans always stay.

What they don't take is read by the field: zones around other digit runs, and around spelled-out addresses
("name at host dot com", with or without brackets), are cut into tokens, and every run of at most MAX_TOKENS
tokens, and a spelled-out address of any length, is a candidate segment of each kind. A segment's score is a weighted sum of features of the whole span (digits, groups,
separators, Luhn check, cue words in the CUE_WINDOW words before it); dynamic programming chooses segments and kinds jointly. The
weights are fitted here, by gradient ascent on the log-likelihood (forward and backward sums over all
segmentations) of sentences that are generated with known spans. A segment is added only if it overlaps no
base span.

Defined results: a null text is empty; an empty text has no span; repeated rows each have their own; ids may
be null; extra columns are ignored; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilflow.llm.common import limit_batches

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 12
#: Tokens whose segments are scored at a time, so that memory doesn't grow with a zone's length.
BLOCK = 512

# The base patterns. Possessive repeats and a look-behind keep failing scans linear; they match the same
# spans, as a match that fails from the first character of such a run fails from the others too.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one @: the longest local part before it that is still free, a domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    out = []
    if "@" in text:
        out += [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if len(m[0]) >= 12 and 12 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# Zones that the field reads: digit groups with one or two separators, as many as there are, of four digits or more together, and
# spelled-out addresses. A group that a letter follows isn't part of a zone; the groups before it are.
_NUMBERS = re.compile(r"(?<![\w@.])\+?\(?[0-9]++(?![\w@])(?:[\x20().,/-]{1,2}[0-9]++(?![\w@]))*+")
_AT, _DOT = r"[ ]?[\[({][ ]?at[ ]?[\])}][ ]?", r"(?:[ ]?[\[({][ ]?dot[ ]?[\])}][ ]?|[ ]dot[ ])"
_HOST = r"[A-Za-z0-9-]++"
_SPELLED = re.compile(
    rf"(?<![\w.])(?<![ ]dot[ ])[A-Za-z0-9_]++(?:(?:[._%+-]|{_DOT})[A-Za-z0-9_]++)*+(?:{_AT}{_HOST}(?:(?:{_DOT}|\.|(?-i:[ ]?\.[ ]?(?=[a-z0-9]))){_HOST})+|[ ]at[ ]{_HOST}(?:\.{_HOST})*+{_DOT}{_HOST}(?:(?:{_DOT}|\.){_HOST})*)", re.IGNORECASE
)
_BARE_AT = re.compile(r"([A-Za-z0-9_]+)[ ]at[ ]", re.IGNORECASE)
#: Words before a bare "at" that are no mailbox: "visit us at example dot com".
_PROSE = frozenset("us me him her them it look visit available found find more read here online hosted published live located see meet meeting start starts based site website page is are be was were arrive stay posted shop join and or out up down back there stop sold buy".split())
_TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")
#: Words that announce a kind in English, German, French and Spanish: beginnings, or whole words where they end in a dot.
CUE_WORDS = {
    "email": ("mail", "email", "courriel", "correo", "contact", "kontakt", "write.", "reach", "schreib", "écri", "escrib"),
    "ip": ("ip.", "ipv4", "host", "server", "serveur", "servidor", "address", "addr.", "adresse", "direcci"),
    "card": ("card", "karte", "kreditkarte", "carte", "tarjeta", "visa.", "mastercard", "amex", "credit", "kredit", "crédit", "debit", "cc."),
    "phone": ("phone", "tel.", "telep", "telef", "teléf", "télép", "ph.", "call", "mobil", "móvil", "cell", "handy", "fax", "dial", "ring.", "whatsapp", "sms.", "hotline", "anruf", "ruf", "durchwahl", "llam", "llám", "appel", "portable"),
}
#: A cue is one of the last CUE_WINDOW words before a place, in its sentence and in the last CUE_CHARS characters; near, if it is one of the last NEAR.
CUE_WINDOW, NEAR, CUE_CHARS = 8, 2, 160
_LETTERS = re.compile(r"[^\W\d_]+[0-9]?")
_SENTENCE = re.compile(r"[\n!?]|\.\s+(?=[A-ZÀ-Þ])")
_CUE_OF = re.compile("|".join(f"(?P<{kind}>{'|'.join(w[:-1] + '$' if w.endswith('.') else w for w in words)})" for kind, words in CUE_WORDS.items()))
N_FEATURES = 40


def cues(before: str) -> list[bool]:
    """Which kind the nearest cue word before a place announces: a flag for each kind if it is near, then one for each if it is farther off."""
    flags = [False] * (2 * len(KINDS))
    for m in _SENTENCE.finditer(before):
        before = before[m.end() - len(m.string) :] if m.end() < len(m.string) else ""
    for n, word in enumerate(reversed(_LETTERS.findall(before)[-CUE_WINDOW:])):
        if m := _CUE_OF.match(word.lower()):
            flags[KINDS.index(m.lastgroup) + (0 if n < NEAR else len(KINDS))] = True
            break
    return flags


def features(span: str, near: list[bool], head: list[bool], address: bool, around: tuple[str, str] = ("", "")) -> np.ndarray:
    """Of a whole candidate span, the cues before it (cues()), those before the first token that is read with it (of a list), whether it is a whole spelled-out address, and the two characters before and after it."""
    digits, groups = _only_digits(span), re.findall(r"[0-9]+", span)
    n, sizes = len(digits), [len(g) for g in groups]
    f = np.zeros(N_FEATURES)
    f[0] = 1
    f[1] = n < 7
    f[2] = 7 <= n <= 8
    f[3] = n == 9
    f[4] = 10 <= n <= 11
    f[5] = 12 <= n <= 15
    f[6] = n == 16
    f[7] = n > 16
    f[8] = 12 <= n <= 19 and luhn(digits)
    f[9] = len(groups) == 4 and all(s <= 3 and int(g) <= 255 for s, g in zip(sizes, groups, strict=True))
    f[10] = sizes in ([3, 3, 4], [3, 4], [1, 3, 3, 4], [3, 4, 4], [3, 7], [2, 3, 2, 2], [2, 2, 2, 2, 2], [5, 6], [4, 3, 3])
    f[11] = sizes in ([4, 4, 4, 4], [4, 6, 5])
    f[12] = span.count("(") == span.count(")") == 1
    f[13] = len({c for c in span if c in " -./,"}) > 1
    f[14] = not address and ("." in span or "," in span)
    f[15] = "/" in span
    f[16] = any(c.isalpha() for c in span)
    f[17] = address
    f[18] = len(groups) == 1
    f[19] = not (span[:1].isalnum() or span[:1] in ("(", "+")) or not span[-1:].isalnum()
    f[20:24] = near[:4]
    f[32:36] = near[4:]
    f[24] = span[:1] == "+"
    f[25:29] = [a or b for a, b in zip(head[:4], head[4:], strict=True)]
    # A number that goes on to the left or the right of the span, by a sign or by a blank.
    left, right = around
    f[36] = left[:1].isdigit() and left[1:] in ("-", ".", "/")
    f[37] = left[:1].isdigit() and left[1:] == " "
    f[38] = right[:1] in ("-", ".", "/") and right[1:].isdigit()
    f[39] = right[:1] == " " and right[1:].isdigit()
    bare = _BARE_AT.search(span)
    f[29] = bare is not None
    f[30] = bare is not None and bare[1].lower() in _PROSE
    f[31] = address and bare is None
    return f


class SemiMarkovField:
    """Weights for each kind of segment and for a token outside of any; segments are independent given their bounds."""

    def __init__(self):
        self.weights = np.zeros((len(KINDS), N_FEATURES))
        self.outside = 0.0

    @staticmethod
    def segments(tokens: list[tuple[int, int]], text: str, first: int = 1, last: int | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
        """All runs of tokens (from, to) up to MAX_TOKENS that end at token first to last, and a spelled-out address as a whole; their features."""
        runs = [(i, j) for j in range(first, (last or len(tokens)) + 1) for i in range(max(0, j - MAX_TOKENS), j)]
        whole = (0, len(tokens)) if runs[-1][1] == len(tokens) and _SPELLED.fullmatch(text, tokens[0][0], tokens[-1][1]) else None
        if whole and len(tokens) > MAX_TOKENS:
            runs.append(whole)
        near = {i: cues(text[max(0, tokens[i][0] - CUE_CHARS) : tokens[i][0]]) for i in {0, *(i for i, _ in runs)}}
        span = lambda i, j: (tokens[i][0], tokens[j - 1][1])
        around = lambda a, b: (text[max(0, a - 2) : a], text[b : b + 2])
        rows = [features(text[slice(*span(i, j))], near[i], near[0], (i, j) == whole, around(*span(i, j))) for i, j in runs]
        return runs, np.array(rows)

    def best(self, tokens: list[tuple[int, int]], text: str) -> list[tuple[int, int, int]]:
        """The best segmentation: (from token, to token, kind) of its segments."""
        top, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
        for first in range(1, len(tokens) + 1, BLOCK):
            last = min(first + BLOCK - 1, len(tokens))
            runs, rows = self.segments(tokens, text, first, last)
            scores = rows @ self.weights.T
            at = 0
            for j in range(first, last + 1):
                top[j] = top[j - 1] + self.outside
                while at < len(runs) and runs[at][1] == j:
                    i, kind = runs[at][0], int(scores[at].argmax())
                    if top[i] + scores[at][kind] > top[j]:
                        top[j], back[j] = top[i] + scores[at][kind], (i, j, kind)
                    at += 1
        out, j = [], len(tokens)
        while j:
            if back[j]:
                out.append(back[j])
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]

    def gradient(self, zone: LabelledZone) -> tuple[np.ndarray, float]:
        """Of the log-likelihood of one labelled zone: observed less expected features."""
        scores = zone.rows @ self.weights.T
        best = scores.max(axis=1)
        whole = (best + np.log(np.exp(scores - best[:, None]).sum(axis=1))).tolist()
        n, outside = zone.n, self.outside
        alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            alpha[j] = _log_sum([alpha[j - 1] + outside, *[alpha[i] + whole[r] for r, i in zone.by_end[j]]])
        for i in range(n - 1, -1, -1):
            beta[i] = _log_sum([beta[i + 1] + outside, *[beta[j] + whole[r] for r, j in zone.by_start[i]]])
        before, after = np.array(alpha), np.array(beta)
        chance = np.exp(before[zone.starts][:, None] + scores + after[zone.ends][:, None] - alpha[n])
        expected = np.exp(before[:-1] + outside + after[1:] - alpha[n]).sum()
        return (zone.observed - chance).T @ zone.rows, (n - zone.covered) - expected


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class LabelledZone:
    """A zone's candidate segments and features, by where they begin and end, and which of them are true."""

    def __init__(self, runs: list[tuple[int, int]], rows: np.ndarray, gold: set[tuple[int, int, int]], n: int):
        self.rows, self.n = rows, n
        self.starts, self.ends = np.array([i for i, _ in runs]), np.array([j for _, j in runs])
        self.by_end: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        self.by_start: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for r, (i, j) in enumerate(runs):
            self.by_end[j].append((r, i))
            self.by_start[i].append((r, j))
        self.observed = np.array([[(i, j, kind) in gold for kind in range(len(KINDS))] for i, j in runs], float)
        self.covered = sum(j - i for i, j, _ in gold)


def _examples(n: int = 240, seed: int = 5) -> list[tuple[str, list[tuple[str, str]]]]:
    """Generated sentences with the spans that they hold; also numbers that aren't personal."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        head = r.choice("3456") + d(14)
        digits = next(head + str(c) for c in range(10) if luhn(head + str(c)))
        sep = r.choice([".", "/", ". "])
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 7)))
    makers = {
        "phone": lambda: (r.choice(["call ", "phone: ", "tel. ", "mobile ", "fax: ", "phone is ", "phone number is "]), r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}"])),
        "card": lambda: (r.choice(["card number ", "visa ", "credit card: "]), card()),
        "ip": lambda: (r.choice(["ip ", "host ", "server ip: "]), ", ".join(str(r.randint(0, 255)) for _ in range(4))),
        "email": lambda: (r.choice(["", "mail ", "contact "]), f"{word()} {r.choice(['(at)', '[at]', '{at}'])} {word()} {r.choice(['(dot)', '[dot]'])} {r.choice(['com', 'org', 'net'])}"),
    }
    plain = [
        lambda: f"{d(4)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: d(r.randint(1, 19)), lambda: f"{r.randint(1, 999)},{d(3)},{d(3)}", lambda: f"{d(2)}/{d(2)}/{d(4)}",
        lambda: f"{d(1)}.{d(2)}.{d(1)}", lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)} {d(3)} {d(4)}", lambda: f"{d(1)}, {d(2)}, {d(1)}, {d(3)}", lambda: f"{d(3)}/{d(3)}/{d(4)}",
    ]
    out = []
    for i in range(n):
        if i % 2:
            kind = KINDS[i // 2 % len(KINDS)]
            cue, span = makers[kind]()
            out.append((f"{word()} {cue}{span} {word()}", [(span, kind)]))
        else:
            out.append((f"{word()} {word()} {plain[i // 2 % len(plain)]()} {word()}", []))
    for i in range(n // 4):
        phone = r.choice([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"+{d(2)}-{d(2)}-{d(4)}-{d(3)}"])
        sign = r.choice([f"+{d(r.randint(1, 6))}", f"+{r.randint(1, 99)}.{d(2)}", f"+{r.randint(1, 99)},{d(3)}", f"+{d(2)}, {d(2)}, {d(1)}"])
        out.append((f"{word()} {phone if i % 2 else sign} {word()}", [(phone, "phone")] if i % 2 else []))
    shapes = [(3, 3, 4), (1, 3, 3, 4), (3, 4, 4), (3, 7), (2, 3, 2, 2), (2, 2, 2, 2, 2), (5, 6), (4, 3, 3)]
    for i in range(n):  # numbers after cue words of all languages, some words between them; numbers of the same shapes without; other numbers after cues
        kind = r.choice(KINDS[1:]) if i % 4 == 3 else "phone"
        cue = r.choice([w.rstrip(".") + ("" if w.endswith(".") else r.choice(["", "", "s", "er", "ono"])) for w in CUE_WORDS[kind]])
        between = " ".join(word() for _ in range(r.choice([0, 0, 1, 2, 3, 5])))
        lead = f"{word()} {cue}{r.choice([':', '', ''])} {between}{' ' if between else ''}{r.choice(['', '', 'is ', 'at ', 'no. '])}"
        number = r.choice(" -. ").join(d(k) for k in r.choice(shapes))
        date = r.choice([f"{d(4)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{d(4)}", d(r.randint(4, 6)), f"{r.randint(1, 999)},{d(3)},{d(3)}"])
        if i % 4 == 0:
            out.append((f"{lead}{number} {word()}", [(number, "phone")]))
        elif i % 4 == 1:
            out.append((f"{word()} {word()} {number} {word()}", []))
        elif i % 4 == 2:
            out.append((f"{lead}{date} {word()}", []))
        else:
            made = makers[kind]()[1]
            out.append((f"{lead}{made} {word()}", [(made, kind)]))
    for i in range(n // 2):  # addresses with a bare "at", and prose that reads like them
        host = f"{word()}{r.choice([' dot ', ' (dot) '])}{r.choice(['com', 'org', 'net'])}"
        address = f"{word()} at {host}"
        if i % 4 == 3:
            at, dot = r.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot ")])
            address = f"{word()}{r.choice(['.', dot])}{word()}{at}{word()}{r.choice(['.', dot])}{word()}{dot}{r.choice(['com', 'org', 'net'])}"
        cue = r.choice(["", "mail ", "contact ", "email: "])
        prose = f"{word()} {r.choice(sorted(_PROSE))} at {host}"
        out.append((f"{cue}{address} {word()}", [(address, "email")]) if i % 4 else (f"{prose} {word()}", []))
    for i in range(n // 3):  # lists: of phone numbers after a cue, of other numbers, of both
        shape = r.choice([(3, 3, 4), (3, 3, 4), (3, 4), (4, 4), (2, 3, 4)])
        sep, between = r.choice("-.-"), r.choice([", ", ", ", " "])
        numbers = [sep.join(d(k) for k in shape) for _ in range(3)]
        date = f"{d(4)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
        if i % 2:
            phones = [sep.join((d(3), d(3), d(4))) for _ in range(3)]
            out.append((f"{word()} {r.choice(['call ', 'phones: ', 'phone: ', 'tel. ', 'fax: '])}{between.join([*phones[: r.randint(2, 3)], *r.choice([[], [date], [d(2)]])])} {word()}", [(p, "phone") for p in phones]))
        else:
            out.append((f"{word()} {word()} {between.join([*r.choice([[], [d(1)], [date]]), *numbers])} {word()}", []))
    return out


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    lower = text.lower() if "at" in text or "AT" in text else ""
    if any(x in lower for x in ("(at", "[at", "{at", "( at", "[ at", "{ at")) or (" at " in lower and "dot" in lower):
        yield from (m.span() for m in _SPELLED.finditer(text))


def _numbers(text: str) -> Iterator[tuple[int, int]]:
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            if sum(c.isdigit() for c in m[0]) >= 4:
                yield m.span()


def _zones(text: str) -> Iterator[tuple[int, int]]:
    yield from _spelled(text)
    yield from _numbers(text)


def _tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


@lru_cache(maxsize=1)
def fitted(steps: int = 120) -> SemiMarkovField:
    """The field, fitted to generated sentences; a few seconds, the same on every machine."""
    field, zones = SemiMarkovField(), []
    for text, spans in _examples():
        for start, end in _zones(text):
            tokens = _tokens(text, start, end)[:24]
            if not tokens:
                continue
            gold = set()
            for span, kind in spans:
                if (a := text.find(span)) < 0:
                    continue
                inside = [t for t, (i, j) in enumerate(tokens) if i >= a and j <= a + len(span)]
                if inside and tokens[inside[0]][0] == a and tokens[inside[-1]][1] == a + len(span) and (len(inside) <= MAX_TOKENS or kind == "email" and len(inside) == len(tokens)):
                    gold.add((inside[0], inside[-1] + 1, KINDS.index(kind)))
            zones.append(LabelledZone(*field.segments(tokens, text), gold, len(tokens)))
    for step in range(steps):
        # A third of the zones in turn: every third step has seen all.
        total, outside, some = np.zeros_like(field.weights), 0.0, zones[step % 3 :: 3]
        for zone in some:
            g, o = field.gradient(zone)
            total += g
            outside += o
        rate = 2.0 / (1 + step / 40)
        field.weights += rate * (total / len(some) - 1e-3 * field.weights)
        field.outside += rate * outside / len(some)
    return field


def _union(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover together."""
    starts, ends = [], []
    for a, b, _ in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _free(tokens: list[tuple[int, int]], starts: list[int], ends: list[int]) -> Iterator[list[tuple[int, int]]]:
    """The runs of tokens that nothing covers."""
    piece: list[tuple[int, int]] = []
    s = bisect_right(ends, tokens[0][0]) if tokens else 0
    for start, end in tokens:
        while s < len(ends) and ends[s] <= start:
            s += 1
        if s == len(ends) or starts[s] >= end:
            piece.append((start, end))
        elif piece:
            yield piece
            piece = []
    if piece:
        yield piece


def all_spans(text: str, field: SemiMarkovField, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The base spans and those that the field adds where no base span is: it reads each piece of a zone between them."""
    out = list(base)
    for zones in (_spelled, _numbers):
        covered = _union(out)
        for start, end in zones(text):
            for tokens in _free(_tokens(text, start, end), *covered):
                out += [(tokens[i][0], tokens[j - 1][1], KINDS[kind]) for i, j, kind in field.best(tokens, text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): array<struct<start, end, kind, base>> of each whole text."""
    limit_batches(docs.sparkSession)
    field = fitted()

    @F.arrow_udf("array<struct<start:int,end:int,kind:string,base:boolean>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                base = base_spans(text or "")
                known = set(base)
                out.append([{"start": a, "end": b, "kind": k, "base": (a, b, k) in known} for a, b, k in all_spans(text or "", field, base)])
            yield pa.array(out, kind)

    return docs.select(F.col(id_col), of(F.col(text_col)).alias("spans"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the hash of the base spans and the list of all."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in KINDS]
    return found.select(id_col, *counts, F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"))
