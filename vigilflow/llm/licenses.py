"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

For a template of m shingles (shingles.SHINGLE words), windows of m + stride - 1 shingles begin every
stride = max(1, m // 2), so each occurrence lies whole in one window, which then has a Jaccard similarity
of at least 0.8 m / (1.5 m + 0.2 m) = 0.47 with a template that it contains by 0.8. BANDS bands of ROWS
minima: such a pair shares no band with a chance of (1 - 0.47**2)**32 = 4e-4, an exact copy with one of
(1 - 0.67**2)**32 = 8e-9. What is retrieved is checked exactly: the share of the template's distinct
shingles that the window holds, CONTAINMENT or more.

Windows that share too few shingles with all templates together are passed over first; this drops no match.
Templates are a parameter: a short list of names and texts that goes to every task. By default they are notices
and whole license texts (license_texts/: bodies without appendix or copyright line). Versions of a license share
most of their words: a match gives way to one of another version that holds more of the shingles of its place.
So does a sentence that the text of another license has too.
A short notice (NOTICES) gives way to a template of its license that holds its place as well.

SPDX tag lines are shorter than a shingle, so they are read by words: after "SPDX-License-Identifier:", each
known identifier (TAGS, the longest that fits) of a list joined by and, or, with. Each identifier is a template.

Defined results: null and empty texts hold nothing; templates without words are never found; a template of
fewer than five words is one shingle, found only where it is a whole text; repeated rows each count; ids may
be null; no rows or no templates, no result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilflow.llm import shingles
from vigilflow.llm.common import limit_batches, normalized
from vigilflow.llm.passages import KnownShingles, windows

CONTAINMENT = 0.8
BANDS, ROWS = 32, 2

#: Notices of common licenses: names by SPDX, and the sentence by which a text states them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Names of licenses as notices write them.
_NAMES = {
    "MIT": ("MIT License",),
    "Apache-1.1": ("Apache License, Version 1.1", "Apache License 1.1"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    **{f"GPL-{v}.0": (f"GNU General Public License, version {v}", f"GNU General Public License v{v}.0", f"GNU General Public License v{v}", f"GNU GPL version {v}", f"GNU GPL v{v}") for v in (1, 2, 3)},
    **{f"LGPL-{v}": (f"GNU Lesser General Public License, version {v.removesuffix('.0')}", f"GNU Lesser General Public License v{v}", f"GNU LGPL version {v.removesuffix('.0')}", f"GNU LGPL v{v.removesuffix('.0')}") for v in ("2.1", "3.0")},
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU Affero General Public License v3", "GNU AGPL version 3", "GNU AGPL v3"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "ISC": ("ISC License",),
    "MPL-1.1": ("Mozilla Public License, version 1.1", "Mozilla Public License 1.1"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"),
    **{f"EPL-{v}": (f"Eclipse Public License {v}", f"Eclipse Public License v{v}", f"Eclipse Public License, version {v}", f"Eclipse Public License - v {v}") for v in ("1.0", "2.0")},
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Zlib": ("zlib License",),
    "Unlicense": ("The Unlicense",),
    **{f"CC-BY{k}-{v}": (f"CC BY{k} {v}", f"Creative Commons Attribution{long} {v} International License", f"Creative Commons Attribution{long} {v} Unported License", f"Creative Commons Attribution{long} {v} License")
       for v in ("2.0", "3.0", "4.0") for k, long in (("", ""), ("-SA", "-ShareAlike"), ("-NC", "-NonCommercial"), ("-ND", "-NoDerivatives"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives"))},
}
_VERBS = ("Licensed", "Released", "Distributed", "Available", "Published")

#: Short notices, each with its version.
NOTICES = (
    *((name, f"{verb} under {the}{title}") for name, titles in _NAMES.items() for title in titles for verb in _VERBS for the in (("", "a ") if "CC-BY" in name else ("the ",) if not title.startswith("The ") else ("",))),
    *((f"GPL-{v}.0", f"This work is licensed under the GNU General Public License, version {v}.") for v in (1, 2)),
    *((f"{g}-{v}", f"under the terms of the GNU {long} General Public License as published by the Free Software Foundation; either version {v.removesuffix('.0')}") for g, long, v in (("GPL", "", "1.0"), ("LGPL", "Library", "2.0"), ("LGPL", "Lesser", "2.1"), ("LGPL", "Lesser", "3.0"), ("AGPL", "Affero", "3.0"))),
)

#: Whole texts: name.txt holds the body of the license of that name.
WHOLE = tuple((path.name.removesuffix(".txt"), path.read_text(encoding="utf-8")) for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))

#: SPDX identifiers that tag lines are read for.
TAGS = tuple(sorted({
    *(f"{g}-{v}{end}" for g, vs in (("GPL", ("1.0", "2.0", "3.0")), ("LGPL", ("2.0", "2.1", "3.0")), ("AGPL", ("1.0", "3.0")), ("GFDL", ("1.1", "1.2", "1.3"))) for v in vs for end in ("", "-only", "-or-later")),
    *(f"CC-BY{k}-{v}" for k in ("", "-SA", "-NC", "-ND", "-NC-SA", "-NC-ND") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")),
    "0BSD", "AFL-2.1", "AFL-3.0", "APSL-2.0", "Apache-1.0", "Apache-1.1", "Apache-2.0", "Artistic-1.0", "Artistic-1.0-Perl", "Artistic-2.0", "BSD-1-Clause", "BSD-2-Clause", "BSD-2-Clause-Patent", "BSD-3-Clause", "BSD-3-Clause-Clear",
    "BSD-4-Clause", "BSL-1.0", "BUSL-1.1", "BlueOak-1.0.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "CPL-1.0", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "ISC", "LPPL-1.3c", "MIT", "MIT-0", "MPL-1.0", "MPL-1.1",
    "MPL-2.0", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OFL-1.1", "OSL-3.0", "OpenSSL", "PHP-3.01", "PSF-2.0", "PostgreSQL", "Python-2.0", "Ruby", "SSPL-1.0", "UPL-1.0", "Unicode-3.0", "Unicode-DFS-2016", "Unlicense", "Vim",
    "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
}))
_MARK = "spdx license identifier"


def family(name: str) -> str | None:
    """What the versions of a license have in common; null for a name without a version."""
    if name in ("ISC", "0BSD"):
        return "ISC"
    return name[: m.start()] if (m := re.search(r"-[0-9]", name)) else None


class Tags:
    """SPDX tag lines of normalised texts."""

    def __init__(self, tags: tuple[str, ...]):
        self.words = {tuple(re.findall(r"[^\W_]+", t.lower())): t for t in tags}
        self.longest = max(map(len, self.words), default=0)

    def find(self, text: str) -> list[tuple[str, int]]:
        """(identifier, word at which its tag line begins), the first of each."""
        out: dict[str, int] = {}
        words = text.split(" ")
        for k in range(len(words) - 3):
            if words[k] != "spdx" or words[k + 1] != "license" or words[k + 2] != "identifier":
                continue
            at = k + 3
            while n := next((n for n in range(self.longest, 0, -1) if tuple(words[at : at + n]) in self.words), 0):
                out.setdefault(self.words[tuple(words[at : at + n])], k)
                at += n + 1
                if words[at - 1 : at] not in (["and"], ["or"], ["with"]):
                    break
        return list(out.items())


class Templates:
    """Templates by their band hashes. Texts come normalised; names tell versions apart, minor ones are short notices."""

    def __init__(self, texts: list[str], containment: float = CONTAINMENT, bands: int = BANDS, rows: int = ROWS, names: list[str] | None = None, minor: frozenset[int] = frozenset()):
        self.containment, self.bands, self.rows = containment, bands, rows
        self.sets: list[np.ndarray] = []
        for first, last, hashes, bounds, _ in shingles.text_shingles(pa.array(texts, pa.string())):
            self.sets += [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(last - first)]
        self.spans = [len(s) for s in self.sets]
        self.names, self.minor = names or [""] * len(texts), minor
        self.families = [family(n) for n in self.names]
        with np.errstate(over="ignore"):
            self.seeds = shingles.mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.known = KnownShingles(np.concatenate([np.zeros(0, np.uint64), *self.sets]))
        self.sizes = sorted({len(s) for s in self.sets if len(s)})
        self.buckets: dict[tuple[int, int], list[int]] = {}
        for i, own in enumerate(self.sets):
            if len(own):
                for b, h in enumerate(self.band_values(own)):
                    self.buckets.setdefault((b, int(h)), []).append(i)

    def band_values(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            least = shingles.mix(hashes[:, None] ^ self.seeds[None, :]).min(axis=0).reshape(self.bands, self.rows)
            value = np.zeros(self.bands, np.uint64)
            for j in range(self.rows):
                value = shingles.mix(value + least[:, j])
        return value

    def find(self, hashes: np.ndarray, hit: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Template -> (best containment, start of its first window that has it, windows that hold it) for one text."""
        found: dict[int, tuple[float, int, int]] = {}
        kept: dict[bytes, list[tuple[int, float]]] = {}
        for m in self.sizes:
            stride = max(1, m // 2)
            length = min(m + stride - 1, len(hashes))
            for start in windows(hit, length, int(np.ceil(m * self.containment - 1e-9)), stride):
                window = np.unique(hashes[start : start + length])
                if (key := window.tobytes()) not in kept:
                    near = {i for b, h in enumerate(self.band_values(window)) for i in self.buckets.get((b, int(h)), ())}
                    kept[key] = [(i, float(np.isin(self.sets[i], window, assume_unique=True).mean())) for i in sorted(near)]
                for i, share in kept[key]:
                    if len(self.sets[i]) == m and share >= self.containment:
                        best, at, n = found.get(i, (0.0, int(start), 0))
                        found[i] = (share, int(start), n + 1) if share > best else (best, at, n + 1)
        return {i: f for i, f in found.items() if not self.beaten(i, f[1], found, hashes)}

    def beaten(self, i: int, start: int, found: dict, hashes: np.ndarray) -> bool:
        """Whether another found template holds more of the place of this one: what of it is there, and as much around it as it lacks.

        Such are other versions, other licenses whose text has this sentence too, and for a short notice all of its license, also those that hold as much.
        """
        own = self.sets[i]
        others = [j for j in found if self.names[j] != self.names[i]]
        part = [j for j in others if len(own) < len(self.sets[j]) and np.isin(own, self.sets[j], assume_unique=True).all()]
        versions = [j for j in others if self.families[i] and self.families[j] == self.families[i]]
        same = [j for j in found if i in self.minor and j != i and self.names[j] == self.names[i]]
        if not (part or versions or same):
            return False
        held = start + np.flatnonzero(np.isin(hashes[start : start + len(own) + max(1, len(own) // 2) - 1], own))
        lacks = len(own) - len(np.unique(hashes[held]))

        def shares(room: int) -> Callable[[int], int]:
            place = np.unique(hashes[max(0, held[0] - room) : held[-1] + 1 + room])
            return lambda j: int(np.isin(place, self.sets[j], assume_unique=True).sum())

        close, wide = shares(lacks), shares(max(1, lacks))
        rank = lambda j: (close(j), j not in self.minor, len(self.sets[j]), -j)
        return any(close(j) > close(i) for j in versions) or any(wide(j) > wide(i) for j in part) or any(rank(j) > rank(i) for j in same)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + NOTICES + WHOLE, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """(id, license, template, containment, word_start): each template that a text holds, with its best window; tags are numbered after templates."""
    spark = docs.sparkSession
    limit_batches(spark)
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(templates)], "i int, t string").select("i", normalized(F.col("t")).alias("t")).collect()
    names, notices = [n for n, _ in templates], frozenset(NOTICES)
    ready = Templates([r["t"] for r in sorted(rows, key=lambda r: r["i"])], containment, names=names, minor=frozenset(i for i, t in enumerate(templates) if t in notices))
    tagged, number = Tags(tags), {t: len(names) + i for i, t in enumerate(tags)}

    @F.arrow_udf("array<struct<license:string,template:int,containment:double,word_start:int>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("containment", pa.float64()), ("word_start", pa.int32())]))
        for texts in batches:
            out: list[list] = [[] for _ in range(len(texts))]
            for first, _, hashes, bounds, _ in shingles.text_shingles(texts):
                hit = ready.known.hits(hashes)
                if not hit.any():
                    continue
                counts = np.diff(np.concatenate(([0], np.cumsum(hit)))[bounds])
                for i in np.flatnonzero(counts):
                    own = slice(bounds[i], bounds[i + 1])
                    out[first + i] = [{"license": names[t], "template": t, "containment": share, "word_start": at} for t, (share, at, _) in sorted(ready.find(hashes[own], hit[own]).items())]
            for i in np.flatnonzero(pc.fill_null(pc.match_substring(texts, _MARK), False).to_numpy(zero_copy_only=False)):
                out[i] += [{"license": t, "template": number[t], "containment": 1.0, "word_start": at} for t, at in tagged.find(texts[i].as_py())]
            yield pa.array(out, kind)

    return docs.select(F.col(id_col), F.explode(find(normalized(F.col(text_col)))).alias("_m")).select(id_col, "_m.*")
