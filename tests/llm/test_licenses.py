import re

import pytest

from tidemark.llm.licenses import BASE_PHRASES, Rule, Scanner, default_rules, resolve, with_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}

TEXTS = [
    None, "", "...", "Licensed under CC BY-NC 4.0.\nrest", "cc by cc by cc by", "GNU Lesser General Public License v2.1",
    "This work is licensed under the GNU General Public License, version 3.", "All rights  reserved, ALL RIGHTS RESERVED",
    "Licensed under the Apache License, Version 2.0.", "ééé general\x00public-license élan", "accc by", "cc bye", "Licence mit",
    "x " * 50_000 + "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy",
]


def plain(text):
    words = WORD.findall((text or "").translate(UPPER))
    hits = []
    for phrase, label in BASE_PHRASES.items():
        want = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    at = [i for i, _ in hits]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] * 2, "doc_id INT, text STRING, license STRING")
    rows = with_licenses(docs).orderBy("doc_id").collect()
    assert len(rows) == 2 * len(TEXTS)
    for row in rows:
        got = row.license
        assert (got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels) == plain(TEXTS[row.doc_id])
        assert set(filter(None, got.base_labels.split(","))) <= set(filter(None, got.labels.split(",")))
        assert 0 <= got.score <= 1 and (got.score > 0) == bool(got.labels)
    assert with_licenses(docs.limit(0)).collect() == []


def labels(text):
    return Scanner(tuple(default_rules())).scan(text.encode())[5]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Licensed under the Apache License, Version 2.0.", "apache"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("SPDX-License-Identifier: LGPL-2.1", "lgpl"),
        ("licensed under the GNU General Public License, version 3.", "gpl"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("a permit for a bsdish thing", ""),
    ],
)
def test_labels(text, expected):
    assert labels(text) == expected


def test_hundreds_of_rules_and_suppression():
    assert len(default_rules()) > 200
    low, high = Rule("low", "k", "k", 1, 0.1), Rule("high", "k", "k", 9, 0.9)
    assert [r.label for _, _, r in resolve([(0, 5, low), (1, 9, high), (0, 9, low), (2, 4, low), (8, 12, low)])] == ["low", "high", "low"]
    assert resolve([(0, 4, low), (0, 4, high)]) == [(0, 4, high)]


def test_resolve_equals_brute_force():
    import random

    draw = random.Random(5)
    for _ in range(200):
        found = []
        for _ in range(draw.randrange(12)):
            a = draw.randrange(20)
            found.append((a, a + 1 + draw.randrange(8), Rule(draw.choice("abc"), "", "", draw.randrange(3), 0.5)))
        stands = []
        for f in sorted(found, key=lambda f: (-f[2].priority, f[0] - f[1], f[0], f[2].label)):
            if not any(a <= f[0] and f[1] <= b for a, b, _ in stands):
                stands.append(f)
        assert resolve(found) == sorted(stands, key=lambda f: (f[0], f[1], f[2].label))


@pytest.mark.parametrize(
    "text, expected",
    [
        ("This file is GPLv3.", "gpl"),
        ("GPLv2", "gpl"),
        ("GPL3 or newer", "gpl"),
        ("LGPLv3", "lgpl"),
        ("under LGPLv2.1+", "lgpl"),
        ("AGPLv3", "agpl"),
        ("MPLv2", "mpl"),
        ("distributed under the GPL", "gpl"),
        ("under the terms of the GNU GPL v2", "gpl"),
        ("released under CC0", "cc0"),
        ("License: MIT", "mit"),
        ("an MIT-licensed tool", "mit"),
        ("available under an Apache v2 license", "apache"),
        ("under CC BY-SA", "cc-by,cc-by-sa"),
        ("SPDX-License-Identifier: GPLv2", "gpl"),
        ("dual GPL", "gpl"),
        ("it runs under PHP and apache2, gplot and mitv are words, er kam mit 3 Hunden", ""),
    ],
)
def test_bare_and_glued_identifiers(text, expected):
    assert {*labels(text).split(",")} - {"licensed"} == {*expected.split(",")}
