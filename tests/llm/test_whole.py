"""Cases that operators once passed over."""

import pytest

from vigilflow.llm import licenses, pii


def spans(text):
    return [(text[a:b], k) for a, b, k in pii.all_spans(text, pii.fitted(), pii.base_spans(text))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Des +1 (826) 555-4081 190.137.223.204 du", [("+1 (826) 555-4081", "phone"), ("190.137.223.204", "ip")]),
        ("call 415-555-1234, 192.168.0.1 now", [("415-555-1234", "phone"), ("192.168.0.1", "ip")]),
        ("up +12,345,678 units", []),
    ],
)
def test_field_reads_beside_base_spans(text, want):
    assert spans(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("call 415-555-1234 2nd floor", ["415-555-1234"]),
        ("phone: 415-555-1234 24h", ["415-555-1234"]),
        ("fax: (415) 555-1234 3rd", ["(415) 555-1234"]),
        ("call " + ", ".join(f"415-555-{i:04d}" for i in range(700)), [f"415-555-{i:04d}" for i in range(700)]),
        ("rows " + ", ".join(f"415-555-{i:04d}" for i in range(700)), []),
        ("call 415-555-1234, 2024-05-17 now", ["415-555-1234"]),
    ],
)
def test_field_reads_numbers_before_letters_and_long_lists(text, want):
    assert spans(text) == [(w, "phone") for w in want]


def test_zones_are_whole():
    text = "7 415-555-1230, 415-555-1231, 415-555-1232, 415-555-1233, 415-555-1234"
    assert list(pii._zones(text)) == [(0, len(text))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail jane at example dot com", ["jane at example dot com"]),
        ("jane (at) example dot com", ["jane (at) example dot com"]),
        ("first.last (at) mail.company (dot) com", ["first.last (at) mail.company (dot) com"]),
        ("mail first.last [at] mail [dot] company [dot] co [dot] uk now", ["first.last [at] mail [dot] company [dot] co [dot] uk"]),
        ("visit us at example dot com", []),
        ("look at the dot com boom", []),
    ],
)
def test_field_reads_spelled_out_addresses(text, want):
    assert spans(text) == [(w, "email") for w in want]


FILL = " ".join(f"filler{i}" for i in range(60))


@pytest.fixture(scope="module")
def licensed(spark):
    """License names found in texts, all at once: (text, names)."""
    whole = dict(licenses.WHOLE)
    cases = [
        *((f"{FILL} {text} {FILL}", {name}) for name, text in licenses.WHOLE),
        ("// SPDX-License-Identifier: MIT\nint x;", {"MIT"}),
        (f"{FILL}\n# SPDX-License-Identifier: (GPL-2.0-or-later OR BSD-3-Clause) WITH thing\n{FILL}", {"GPL-2.0-or-later", "BSD-3-Clause"}),
        ("Distributed under the MIT License. See LICENSE.", {"MIT"}),
        ("Licensed under the BSD 3-Clause License", {"BSD-3-Clause"}),
        ("Licensed under the Eclipse Public License 2.0.", {"EPL-2.0"}),
        ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"GPL-3.0"}),
        (f"{FILL} you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or later", {"GPL-2.0"}),
        (f"{whole['GPL-2.0']} {FILL} This work is licensed under the GNU General Public License, version 3.", {"GPL-2.0", "GPL-3.0"}),
        ("the license identifier of a spdx file is the identifier", set()),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    found = {}
    for r in licenses.scan(docs).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"])
    return [(text[:40], found.get(i, set()), want) for i, (text, want) in enumerate(cases)]


def test_license_texts_tags_and_versions(licensed):
    #: An opening sentence is a template too, BSD without a number of clauses.
    assert [(t, got - {"BSD"} if any(n.startswith("BSD-") for n in want) else got) for t, got, want in licensed] == [(t, want) for t, _, want in licensed]


@pytest.mark.parametrize("before", range(12))
def test_one_version_a_notice(spark, before):
    """Wherever windows begin, a notice is found once and in its own version."""
    texts = [(v, " ".join(f"w{i}" for i in range(before)) + f" This work is licensed under the GNU General Public License, version {v}. And so on it goes.") for v in (1, 2, 3)]
    texts += [(v, " ".join(f"w{i}" for i in range(before)) + f" Distributed under the GNU General Public License, version {v}. And so on it goes.") for v in (1, 2, 3)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()) == [(i, f"GPL-{v}.0") for i, (v, _) in enumerate(texts)]


def test_numbers_in_everyday_phrases():
    """Cue words of four languages, near and farther off; a number that nothing announces, dates and amounts stay out."""
    from vigilflow.llm import pii

    found = lambda t: [t[a:b] for a, b, _ in pii.all_spans(t, pii.fitted(), pii.base_spans(t))]
    announced = {
        "my telephone number for urgent enquiries is 415 555 1234": ["415 555 1234"], "Ph: 020 7946 0958": ["020 7946 0958"], "ring 020 7946 0958 today": ["020 7946 0958"], "Telefon: 030 1234567": ["030 1234567"],
        "teléfono 91 123 45 67": ["91 123 45 67"], "call us toll free at 1-800-555-0199": ["1-800-555-0199"], "call 415.555.2671 or 415.555.2672": ["415.555.2671", "415.555.2672"], "Téléphone : 01 23 45 67 89": ["01 23 45 67 89"],
        "Rufen Sie uns an unter 030 123 4567": ["030 123 4567"], "llámame al 612 345 678": ["612 345 678"], "my mobile is 555-867-5309, thanks": ["555-867-5309"], "Fax 212-555-0187": ["212-555-0187"], "appelez le 01 98 76 54 32": ["01 98 76 54 32"],
        "Handy: 0171 234 5678": ["0171 234 5678"], "text or call 646 555 0101 after six": ["646 555 0101"],
    }
    missed = [t for t, spans in announced.items() if found(t) != spans]
    assert len(missed) <= 1, [(t, found(t)) for t in missed]
    plain = ("The meeting was on 2024-05-12 at noon", "We sold 1,234,567 units", "Order 48213 was shipped", "In 1998 and 2003 and 2011", "Call me before 2024-05-12", "version 3.14.15 is out", "He called in 1987", "Serial 123 456 7890 is printed below", "pages 112-118")
    assert not [(t, found(t)) for t in plain if found(t)]
