"""License scans by ordered signature rules.

A rule is a pattern over the text's words (lower-cased A-Z, letters, digits and non-ASCII code
points, one blank between), with a label, a priority, a confidence and a keyword. A rule runs only on
texts that hold its keyword, which every match must contain. Where detections overlap, one that lies within another of higher
priority, or of the same priority and greater length, is suppressed. The rules are the product of
license families, their names and the ways in which a text states a license.

The base phrases are found apart and their labels always stay.

Cases: null and empty texts have no words, labels or places and a score of 0; ties between equal
detections go to the rule listed first; texts are scanned whole; repeated rows and extra columns are
kept as they are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from floodgrid.llm.texts import alnum_words, map_texts

# The base phrases and their labels.
BASE = {
    b"gnu general public license": "gpl",
    b"apache license": "apache",
    b"cc by": "cc-by",
    b"mit license": "mit",
}

# Families: label, keyword, names as patterns over words. Versions follow the name where known.
_VERSION = r"(?: (?:version|v|ver))?(?: ?v?\d+(?: \d+){0,2})?"
FAMILIES: list[tuple[str, str, list[str]]] = [
    ("gpl", "gpl", [r"gplv?\d?", r"gnu gpl"]),
    ("gpl", "general public", [r"(?:gnu )?general public licen[sc]e"]),
    ("lgpl", "lgpl", [r"(?:gnu )?lgplv?\d?"]),
    ("lgpl", "lesser general", [r"(?:gnu )?lesser general public licen[sc]e"]),
    ("lgpl", "library general", [r"(?:gnu )?library general public licen[sc]e"]),
    ("agpl", "agpl", [r"(?:gnu )?agplv?\d?"]),
    ("agpl", "affero", [r"(?:gnu )?affero general public licen[sc]e"]),
    ("gfdl", "gfdl", [r"(?:gnu )?gfdl"]),
    ("gfdl", "free documentation", [r"(?:gnu )?free documentation licen[sc]e"]),
    ("apache", "apache", [r"apache(?: software)? licen[sc]e", r"apache 2 0"]),
    ("mit", "mit", [r"mit licen[sc]e", r"mit x11 licen[sc]e"]),
    ("mit", "expat", [r"expat licen[sc]e"]),
    ("x11", "x11", [r"x11 licen[sc]e"]),
    ("bsd", "bsd", [r"bsd(?: licen[sc]e)?", r"(?:simplified|new|modified|revised|original) bsd(?: licen[sc]e)?"]),
    ("bsd-2-clause", "bsd", [r"(?:2|two) clause bsd(?: licen[sc]e)?", r"bsd (?:2|two) clause(?: licen[sc]e)?"]),
    ("bsd-3-clause", "bsd", [r"(?:3|three) clause bsd(?: licen[sc]e)?", r"bsd (?:3|three) clause(?: licen[sc]e)?"]),
    ("bsd-4-clause", "bsd", [r"(?:4|four) clause bsd(?: licen[sc]e)?", r"bsd (?:4|four) clause(?: licen[sc]e)?"]),
    ("isc", "isc", [r"isc licen[sc]e"]),
    ("mpl", "mpl", [r"mpl"]),
    ("mpl", "mozilla", [r"mozilla public licen[sc]e"]),
    ("epl", "eclipse", [r"eclipse public licen[sc]e"]),
    ("cddl", "cddl", [r"cddl"]),
    ("cddl", "common development", [r"common development and distribution licen[sc]e"]),
    ("cpl", "common public", [r"common public licen[sc]e"]),
    ("artistic", "artistic", [r"(?:perl )?artistic licen[sc]e"]),
    ("zlib", "zlib", [r"zlib licen[sc]e", r"zlib libpng licen[sc]e"]),
    ("boost", "boost", [r"boost software licen[sc]e"]),
    ("boost", "bsl 1 0", [r"bsl 1 0"]),
    ("unlicense", "unlicense", [r"(?:the )?unlicense"]),
    ("wtfpl", "wtfpl", [r"wtfpl"]),
    ("eupl", "eupl", [r"eupl"]),
    ("eupl", "european union", [r"european union public licen[sc]e"]),
    ("ofl", "open font", [r"(?:sil )?open font licen[sc]e"]),
    ("odbl", "odbl", [r"odbl"]),
    ("odbl", "open database", [r"open database licen[sc]e"]),
    ("python", "python", [r"python software foundation licen[sc]e"]),
    ("python", "psf", [r"psf licen[sc]e"]),
    ("ruby", "ruby", [r"ruby licen[sc]e"]),
    ("php", "php", [r"php licen[sc]e"]),
    ("openssl", "openssl", [r"openssl licen[sc]e"]),
    ("ms-pl", "microsoft", [r"microsoft (?:public|reciprocal|limited public) licen[sc]e"]),
    ("cc0", "cc0", [r"cc0"]),
    ("cc-by", "cc by", [r"cc by"]),
    ("cc-by-sa", "cc by sa", [r"cc by sa"]),
    ("cc-by-nc", "cc by nc", [r"cc by nc"]),
    ("cc-by-nd", "cc by nd", [r"cc by nd"]),
    ("cc-by-nc-sa", "cc by nc sa", [r"cc by nc sa"]),
    ("cc-by-nc-nd", "cc by nc nd", [r"cc by nc nd"]),
    ("cc-by", "creative commons", [r"creative commons attribution"]),
    ("cc-by-sa", "creative commons", [r"creative commons attribution share ?alike"]),
    ("cc-by-nc", "creative commons", [r"creative commons attribution non ?commercial"]),
    ("cc-by-nd", "creative commons", [r"creative commons attribution no ?deriv(?:ative)?s"]),
    ("cc-by-nc-sa", "creative commons", [r"creative commons attribution non ?commercial share ?alike"]),
    ("cc-by-nc-nd", "creative commons", [r"creative commons attribution non ?commercial no ?deriv(?:ative)?s"]),
]
# Names that are also plain words, so they count inside a frame only.
FRAMED_ONLY: list[tuple[str, str, list[str]]] = [
    ("apache", "apache", [r"apache"]),
    ("mit", "mit", [r"mit"]),
    ("isc", "isc", [r"isc"]),
    ("zlib", "zlib", [r"zlib"]),
    ("x11", "x11", [r"x11"]),
]
# Ways to state a license: frame with the name in it, priority, confidence.
FRAMES: list[tuple[str, int, float]] = [
    (r"spdx licen[sc]e identifier {name}", 5, 1.0),
    (r"(?:is |are |be )?(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{name}", 4, 0.95),
    (r"(?:under|by) the terms (?:and conditions )?of (?:the )?{name}", 4, 0.9),
    (r"(?:subject|according) to (?:the )?(?:terms of )?(?:the )?{name}", 3, 0.85),
    (r"(?:licen[sc]e|licen[sc]ing) {name}", 2, 0.7),
    (r"{name} licen[sc]ed", 2, 0.7),
    (r"{name}", 1, 0.5),
]
# Whole sentences of license texts: label, keyword, pattern; priority 6.
SENTENCES: list[tuple[str, str, str]] = [
    ("mit", "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "free software foundation", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("apache", "you may not use this file except", r"you may not use this file except in compliance with the license"),
    ("public-domain", "public domain", r"(?:released|dedicated|placed) (?:in)?to the public domain|in the public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern
    priority: int
    confidence: float


def default_rules() -> list[Rule]:
    """The families' names in every frame, then the sentences; order breaks ties."""
    rules = []
    for frame, priority, confidence in FRAMES:
        for label, keyword, names in FAMILIES if frame == "{name}" else FAMILIES + FRAMED_ONLY:
            for name in names:
                body = frame.format(name=f"(?:{name}){_VERSION}")
                rules.append(Rule(label, keyword.encode(), re.compile(rf"(?<=\x20){body}(?=\x20)".encode()), priority, confidence))
    for label, keyword, body in SENTENCES:
        rules.append(Rule(label, keyword.encode(), re.compile(rf"(?<=\x20)(?:{body})(?=\x20)".encode()), 6, 1.0))
    return rules


_STEP = 256


def detections(words: bytes, rules_by_keyword: dict[bytes, list[tuple[int, Rule]]]) -> list[tuple[int, int, int, Rule]]:
    """(start, end, rule number, rule) in bytes of ``words``, after suppression."""
    found = [
        (m.start(), m.end(), k, r)
        for keyword, rules in rules_by_keyword.items()
        if keyword in words
        for k, r in rules
        for m in r.pattern.finditer(words)
    ]
    # Best first: what an earlier one contains is suppressed.
    found.sort(key=lambda d: (-d[3].priority, d[0] - d[1], d[2], d[0]))
    kept: list[tuple[int, int, int, Rule]] = []
    # By the place of their start, so that a text with many detections compares only close ones.
    near: dict[int, list[tuple[int, int]]] = defaultdict(list)
    longest = 0
    for d in found:
        around = range((d[0] - longest) // _STEP, d[0] // _STEP + 1)
        if not any(s <= d[0] and d[1] <= e for k in around for s, e in near.get(k, ())):
            kept.append(d)
            near[d[0] // _STEP].append(d[:2])
            longest = max(longest, d[1] - d[0])
    return sorted(kept, key=lambda d: (d[0], d[1]))


def base_places(words: list[bytes], joined: bytes) -> list[tuple[int, str]]:
    """Every place of a base phrase: number of its first word, label."""
    out = []
    for phrase, label in BASE.items():
        parts = phrase.split()
        if b" " + phrase + b" " not in joined:
            continue
        for i in range(len(words) - len(parts) + 1):
            if words[i] == parts[0] and words[i : i + len(parts)] == parts:
                out.append((i, label))
    return sorted(out)


def _scanner() -> Callable[[bytes], tuple]:
    gated: dict[bytes, list[tuple[int, Rule]]] = defaultdict(list)
    for k, rule in enumerate(default_rules()):
        gated[rule.keyword].append((k, rule))

    def scan(raw: bytes) -> tuple:
        words = alnum_words(raw)
        joined = b" " + b" ".join(words) + b" "
        base = base_places(words, joined)
        found = detections(joined, gated)
        base_labels = sorted({label for _, label in base})
        labels = sorted({*base_labels, *(r.label for _, _, _, r in found)})
        doubt = 1.0
        for c in [0.5] * bool(base) + [r.confidence for *_, r in found]:
            doubt *= 1 - c
        places = [i for i, _ in base]
        where = ",".join(f"{r.label}:{joined.count(b' ', 0, s) - 1}:{joined.count(b' ', 0, e)}" for s, e, _, r in found)
        return (
            len(words), len(base), min(places, default=None), max(places, default=None),
            ",".join(base_labels), ",".join(labels), round(1 - doubt, 6), where,
        )

    return scan


def scan_licenses(documents: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with word and place counts, labels, score and the detections (label:start:end in words)."""
    new = (
        "n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double, detections string"
    )
    return map_texts(documents, text, _scanner, new, documents.columns if keep is None else keep)
