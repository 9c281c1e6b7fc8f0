"""License scans: ordered signature rules over the words of whole texts.

A text is reduced to its lower-case words joined by single blanks. One Aho-Corasick pass finds the keywords of all rules
and the base phrases; a rule's expression runs only on a text that holds one of its keywords. Overlapping detections are
settled by priority: the one with the higher priority (then the longer, then the earlier) stands, and what lies inside an
interval that stands goes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that always give their label.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License families; label, names as they stand in running text, identifier stems and versions.
# Names are written as words in lower case, the way a text is reduced.
FAMILIES = [
    ("apache", ["apache license", "apache software license"], ["apache", "asl"], ["1 0", "1 1", "2 0"]),
    ("mit", ["mit license", "expat license", "x11 license"], ["mit", "expat"], []),
    ("bsd", ["bsd license", "berkeley software distribution license"], ["bsd"], ["2 clause", "3 clause", "4 clause"]),
    ("isc", ["isc license", "internet systems consortium license"], ["isc"], []),
    ("lgpl", ["gnu lesser general public license", "lesser general public license", "gnu library general public license"], ["lgpl"], ["2 0", "2 1", "3 0", "3"]),
    ("agpl", ["gnu affero general public license", "affero general public license"], ["agpl"], ["1 0", "3 0", "3"]),
    ("gpl", ["gnu general public license", "general public license", "gnu public license"], ["gpl"], ["1 0", "2 0", "3 0", "2", "3"]),
    ("gfdl", ["gnu free documentation license", "free documentation license"], ["gfdl"], ["1 1", "1 2", "1 3"]),
    ("mpl", ["mozilla public license"], ["mpl"], ["1 0", "1 1", "2 0"]),
    ("epl", ["eclipse public license"], ["epl"], ["1 0", "2 0"]),
    ("cddl", ["common development and distribution license"], ["cddl"], ["1 0", "1 1"]),
    ("cpl", ["common public license"], ["cpl"], ["1 0"]),
    ("eupl", ["european union public license", "european union public licence"], ["eupl"], ["1 0", "1 1", "1 2"]),
    ("artistic", ["artistic license"], ["artistic"], ["1 0", "2 0"]),
    ("zlib", ["zlib license", "zlib libpng license"], ["zlib"], []),
    ("boost", ["boost software license"], ["bsl"], ["1 0"]),
    ("python", ["python software foundation license", "psf license"], ["psf"], ["2 0"]),
    ("unlicense", ["the unlicense"], ["unlicense"], []),
    ("wtfpl", ["do what the fuck you want to public license"], ["wtfpl"], ["2"]),
    ("ofl", ["sil open font license", "open font license"], ["ofl"], ["1 0", "1 1"]),
    ("odbl", ["open database license", "open data commons open database license"], ["odbl"], ["1 0"]),
    ("odc-by", ["open data commons attribution license"], ["odc by"], ["1 0"]),
    ("pddl", ["public domain dedication and license"], ["pddl"], ["1 0"]),
    ("ms-pl", ["microsoft public license"], ["ms pl"], []),
    ("ms-rl", ["microsoft reciprocal license"], ["ms rl"], []),
    ("openssl", ["openssl license"], ["openssl"], []),
    ("php", ["php license"], ["php"], ["3 0", "3 01"]),
    ("postgresql", ["postgresql license"], ["postgresql"], []),
    ("ncsa", ["university of illinois ncsa open source license", "ncsa open source license"], ["ncsa"], []),
    ("afl", ["academic free license"], ["afl"], ["2 1", "3 0"]),
    ("osl", ["open software license"], ["osl"], ["2 1", "3 0"]),
    ("upl", ["universal permissive license"], ["upl"], ["1 0"]),
    ("sspl", ["server side public license"], ["sspl"], ["1"]),
    ("busl", ["business source license"], ["busl"], ["1 1"]),
    ("elastic", ["elastic license"], ["elastic"], ["2 0"]),
    ("openrail", ["responsible ai license", "open rail license", "openrail license"], ["openrail"], []),
    ("cc0", ["creative commons zero", "cc0 license", "cc0 public domain dedication"], ["cc0"], ["1 0"]),
    ("cc-by-nc-sa", ["creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike"], ["cc by nc sa"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd", ["creative commons attribution noncommercial noderivatives", "creative commons attribution noncommercial noderivs"], ["cc by nc nd"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", ["creative commons attribution noncommercial", "creative commons attribution non commercial"], ["cc by nc"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", ["creative commons attribution sharealike", "creative commons attribution share alike"], ["cc by sa"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", ["creative commons attribution noderivatives", "creative commons attribution noderivs"], ["cc by nd"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by", ["creative commons attribution"], ["cc by"], ["2 0", "2 5", "3 0", "4 0"]),
]

# Stems that are also words or products, told from a license by a verb, 'license' or a version only,
# and stems that mean nothing but a license, found by themselves.
PLAIN_WORDS = {"apache", "expat", "artistic", "zlib", "openssl", "php", "postgresql", "elastic"}
UNMISTAKABLE = {
    "gpl", "lgpl", "agpl", "gfdl", "cddl", "eupl", "unlicense", "wtfpl", "odbl", "odc by", "pddl", "sspl", "busl", "openrail",
    "cc0", "cc by nc sa", "cc by nc nd", "cc by nc", "cc by sa", "cc by nd",
}
GRANTED = r"(?:licen[sc]ed|relicen[sc]ed|released|distributed|redistributed|published|available|provided|offered|covered|shared)"

# Statements that name no family; label, keyword, expression, score.
STATEMENTS = [
    ("reserved", "rights reserved", r"(?:all|some) rights reserved", 0.9),
    ("reserved", "reproduced", r"no part of this \w+ may be (?:copied|reproduced)", 0.8),
    ("reserved", "prior written", r"without (?:the )?prior written (?:permission|consent)", 0.7),
    ("proprietary", "proprietary", r"proprietary and confidential|confidential and proprietary", 0.8),
    ("public-domain", "public domain", r"(?:dedicated to|released into|in|into) the public domain", 0.8),
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("isc", "hereby granted", r"permission to use copy modify and or distribute this software for any purpose", 1.0),
    ("bsd", "binary forms", r"redistribution and use in source and binary forms", 1.0),
    ("zlib", "express or implied", r"provided as is without any express or implied warranty", 0.7),
    ("permissive", "freely", r"may be freely (?:used|copied|distributed|redistributed)", 0.5),
    ("noncommercial", "commercial", r"(?:for )?non ?commercial (?:use|purposes) only", 0.7),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d", 0.5),
    ("licensed", "licensed under", r"licensed under (?:the )?(?:terms of )?", 0.3),
    ("licensed", "license", r"(?:see|read) (?:the )?licen[sc]e(?: file)? for", 0.3),
]

WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


@dataclass(frozen=True)
class Rule:
    """A higher priority stands over a lower one. `keyword` must occur before the expression is tried."""

    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


def default_rules() -> list[Rule]:
    """The forms of every family name and identifier, most telling first, and the statements without a family.

    The rule list is built from the tables above: tag, reference with version, reference, name with version, name. An
    identifier's version may be glued to it, with or without a v ("gplv3", "gpl3"; plain words need the v), and may
    then be a major version alone.
    """
    rules: list[Rule] = []
    for label, names, stems, versions in FAMILIES:
        numbers = "|".join(re.escape(v) for v in versions)
        version = rf"(?: (?:version )?(?:v ?)?(?:{numbers})(?: only| or later)?)" if numbers else ""
        glued = "|".join(re.escape(v) for v in [*versions, *dict.fromkeys(v.split()[0] for v in versions)])
        for stem in stems:
            plain = stem in PLAIN_WORDS
            near = rf"(?:{version}|(?: ?version| ?v) ?(?:{glued})(?: only| or later)?" if numbers else ""
            if numbers:
                near += ")" if plain else rf"|(?:{glued})(?: only| or later)?)"
            some = f"{near}?" if near else ""
            the = r"(?:the |an? )?(?:terms of (?:the |an? )?)?(?:gnu )?"
            rules.append(Rule(label, stem, rf"spdx license identifier {stem}{some}", 50, 1.0))
            rules.append(Rule(label, stem, rf"{GRANTED} under {the}{stem}{some}(?: licen[sc]e)?", 40, 1.0))
            told = rf"(?:{near}(?: licen[sc]e)?| licen[sc]e)" if near else " licen[sc]e"
            end = told if plain else rf"{some}(?: licen[sc]e)?"
            rules.append(Rule(label, stem, rf"(?:under|terms of|subject to) {the}{stem}{end}", 40, 1.0))
            rules.append(Rule(label, stem, rf"licen[sc]es? (?:is |type )?(?:the )?(?:gnu )?{stem}{some}", 40, 0.9))
            rules.append(Rule(label, stem, rf"(?:gnu )?{stem}{some} licen[sc]ed?", 30, 0.9))
            if near:
                rules.append(Rule(label, stem, rf"{stem}{near}", 20, 0.8))
            if stem in UNMISTAKABLE:
                rules.append(Rule(label, stem, rf"(?:gnu )?{stem}", 10, 0.6))
        for name in names:
            rules.append(Rule(label, name, rf"(?:under|terms of|subject to) (?:the )?(?:terms of the )?{name}{version}?", 40, 1.0))
            rules.append(Rule(label, name, rf"{name}{version}", 30, 0.9) if version else Rule(label, name, rf"the {name}", 30, 0.9))
            rules.append(Rule(label, name, name, 10, 0.7))
    rules += [Rule(label, keyword, pattern, 5, score) for label, keyword, pattern, score in STATEMENTS]
    return rules


RESULT = (
    "n_words BIGINT, n_base BIGINT, first_word BIGINT, last_word BIGINT, base_labels STRING, labels STRING, score DOUBLE, "
    "detections ARRAY<STRUCT<label: STRING, first_word: BIGINT, end_word: BIGINT, priority: INT, score: DOUBLE>>"
)
_DETECTION = pa.struct(
    [("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("priority", pa.int32()), ("score", pa.float64())]
)
_ARROW = pa.struct(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(_DETECTION))]
)


class Scanner:
    """Compiled rules. Texts are handled as Latin-1 views of their UTF-8 bytes, so every byte is one character."""

    def __init__(self, rules: tuple[Rule, ...]):
        encoded = [(r, r.keyword.encode().decode("latin-1"), r.pattern.encode().decode("latin-1")) for r in rules]
        self.rules = [(r, re.compile(f"(?<= ){pattern.strip()}(?= )")) for r, _, pattern in encoded]
        self.by_keyword: dict[str, list[int]] = {}
        for number, (_, keyword, _) in enumerate(encoded):
            self.by_keyword.setdefault(keyword, []).append(number)
        self.search = ahocorasick.Automaton()
        for keyword in {*self.by_keyword, *(f" {p} " for p in BASE_PHRASES)}:
            self.search.add_word(keyword, keyword)
        self.search.make_automaton()

    def scan(self, text: bytes) -> tuple:
        words = b" ".join(text.translate(WORDS).split())
        n_words = words.count(b" ") + 1 if words else 0
        line = f" {words.decode('latin-1')} "
        wanted: set[int] = set()
        base: list[tuple[int, str]] = []
        for end, keyword in self.search.iter(line):
            if keyword[0] == " ":
                base.append((end - len(keyword) + 2, BASE_PHRASES[keyword[1:-1]]))
            else:
                wanted.update(self.by_keyword[keyword])
        found = []
        for number in sorted(wanted):
            rule, pattern = self.rules[number]
            found += [(m.start(), m.end(), rule) for m in pattern.finditer(line) if m.end() > m.start()]
        stands = resolve(found)
        if not base and not stands:
            return n_words, 0, None, None, "", "", 0.0, []
        marks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        word_at = lambda position: int(np.searchsorted(marks, position)) - 1
        starts = [word_at(at) for at, _ in base]
        labels = {label for _, label in base}
        score = max([r.score for _, _, r in stands] + [1.0] * bool(base))
        detections = [
            {"label": r.label, "first_word": word_at(a), "end_word": word_at(b) + 1, "priority": r.priority, "score": r.score}
            for a, b, r in stands
        ]
        return (
            n_words, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | {r.label for _, _, r in stands})), score, detections,
        )


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Drop every detection that lies inside one of higher rank (priority, length, earlier start, label)."""
    stands: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    furthest: list[int] = []  # furthest end among the kept intervals up to each start
    ranked = sorted(found, key=lambda f: (-f[2].priority, f[0] - f[1], f[0], f[2].label))
    for a, b, rule in ranked:
        at = bisect_right(starts, a)
        if at and furthest[at - 1] >= b:
            continue
        stands.append((a, b, rule))
        starts.insert(at, a)
        furthest.insert(at, max(b, furthest[at - 1] if at else 0))
        for k in range(at + 1, len(furthest)):
            if furthest[k] >= b:
                break
            furthest[k] = b
    return sorted(stands, key=lambda f: (f[0], f[1], f[2].label))


@lru_cache(maxsize=4)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def with_licenses(docs: DataFrame, text: str = "text", out: str = "license", rules: list[Rule] | None = None) -> DataFrame:
    """Add a struct with the word count, base phrases, labels, score and resolved detections of each whole text.

    Null and empty texts have no words, empty label lists, null word positions and score 0. Rows and other columns stay
    as they are, repeated rows alike; a column that has the name `out` is replaced; an empty table gives no rows.
    Ties between detections of one interval go to the label that sorts first.
    """
    ordered = tuple(default_rules() if rules is None else rules)

    def scan(column: pa.Array) -> pa.Array:
        scanner = _scanner(ordered)
        texts = pc.fill_null(column, "").cast(pa.large_binary())
        rows = [scanner.scan(value.as_py()) for value in texts]
        arrays = [pa.array([row[k] for row in rows], field.type) for k, field in enumerate(_ARROW)]
        return pa.StructArray.from_arrays(arrays, fields=list(_ARROW))

    return docs.withColumn(out, F.arrow_udf(scan, RESULT)(F.col(text)))
