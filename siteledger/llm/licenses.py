"""License detection with ordered signature rules.

Some hundreds of regular expressions, made from a table of license families and a few
forms of wording, are run over the words of a text; a rule is tried only if its keyword is
among them. Overlapping finds are resolved by rule priority and interval containment. Three
base phrases are located besides, and their labels always stay.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import by_value, narrow, small_batches

by_value(sys.modules[__name__])

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, keyword, names as written in words (a regular expression), versions.
FAMILIES = (
    ("apache", "apache", "apache(?: software)?", ("1 0", "1 1", "2 0")),
    ("gpl", "general", "gnu general public|gnu gpl", ("1", "2", "3")),
    ("gpl", "gpl", "gpl", ("1", "2", "3")),
    ("lgpl", "lesser", "gnu lesser general public", ("2", "2 1", "3")),
    ("lgpl", "lgpl", "lgpl", ("2", "2 1", "3")),
    ("agpl", "affero", "gnu affero general public", ("1", "3")),
    ("agpl", "agpl", "agpl", ("1", "3")),
    ("fdl", "documentation", "gnu free documentation", ("1 1", "1 2", "1 3")),
    ("mit", "mit", "mit|mit x11", ()),
    ("bsd", "bsd", "bsd|new bsd|modified bsd|simplified bsd", ("2 clause", "3 clause", "4 clause")),
    ("mpl", "mozilla", "mozilla public", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public", ("1 0", "2 0")),
    ("epl", "epl", "epl", ("1 0", "2 0")),
    ("cddl", "cddl", "cddl|common development and distribution", ("1 0", "1 1")),
    ("eupl", "eupl", "eupl|european union public", ("1 0", "1 1", "1 2")),
    ("artistic", "artistic", "artistic", ("1 0", "2 0")),
    ("boost", "boost", "boost software", ("1 0",)),
    ("zlib", "zlib", "zlib|zlib libpng", ()),
    ("isc", "isc", "isc", ()),
    ("unlicense", "unlicense", "unlicense", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("1", "2")),
    ("python", "python", "python software foundation", ("2",)),
    ("postgresql", "postgresql", "postgresql", ()),
    ("ofl", "sil", "sil open font", ("1 0", "1 1")),
    ("odbl", "database", "open database", ("1 0",)),
    ("openssl", "openssl", "openssl", ()),
    ("php", "php", "php", ("3 0", "3 01")),
    ("ruby", "ruby", "ruby", ()),
    ("x11", "x11", "x11", ()),
    ("ncsa", "ncsa", "university of illinois ncsa|ncsa", ()),
    ("ms-pl", "microsoft", "microsoft public", ()),
    ("ms-rl", "microsoft", "microsoft reciprocal", ()),
    ("sspl", "sspl", "sspl|server side public", ("1",)),
    ("busl", "business", "business source", ("1 1",)),
    ("elastic", "elastic", "elastic", ("2 0",)),
    ("cc0", "cc0", "cc0", ("1 0",)),
    ("cc-by", "attribution", "creative commons attribution(?: international)?", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "sharealike", "creative commons attribution sharealike", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "cc", "cc by(?! (?:sa|nc|nd))", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc", "cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc", "cc by nc(?! (?:sa|nd))", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc", "cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc", "cc by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "cc", "cc by nc nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
)

# Forms of wording by priority, with their weight; {n} a name, {v} a version.
FORMS = (
    (0, 1.0, "spdx license identifier (?:{n})(?: {v})?"),
    (1, 0.95, "(?:licensed|released|distributed|available|published) (?:to you )?under (?:the )?(?:terms of )?(?:the )?(?:{n})(?: license| licence)?(?: as published by the free software foundation)?(?: either)?(?: version| v)? {v}"),
    (2, 0.9, "(?:{n})(?: license| licence)?(?: version| v)? {v}"),
    (3, 0.8, "(?:licensed|released|distributed|available|published) (?:to you )?under (?:the )?(?:terms of )?(?:the )?(?:{n})(?: license| licence)?"),
    (4, 0.6, "(?:{n}) (?:license|licence)"),
)

# Wordings of no license: label, keyword, pattern, priority, weight.
OTHER = (
    ("reserved", "reserved", "all rights reserved", 4, 0.5),
    ("reserved", "reserved", "alle rechte vorbehalten|tous droits réservés|todos los derechos reservados", 4, 0.5),
    ("proprietary", "confidential", "proprietary and confidential|confidential and proprietary", 3, 0.7),
    ("public-domain", "domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", 2, 0.9),
    ("public-domain", "domain", "public domain", 4, 0.6),
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 1, 0.95),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 1, 0.95),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 1, 0.95),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}", 5, 0.3),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    priority: int
    weight: float
    found: re.Pattern


def _rule(label: str, keyword: str, priority: int, weight: float, pattern: str) -> Rule:
    return Rule(label, keyword.encode(), priority, weight, re.compile(rf"(?<= )(?:{pattern})(?= )".encode()))


def rules() -> list[Rule]:
    """All rules: each family in each form and version, then the other wordings."""
    made = []
    for label, keyword, name, versions in FAMILIES:
        for priority, weight, form in FORMS:
            with_version = priority in (1, 2)
            for version in versions if with_version else ("",):
                own = f"{label}-{version.replace(' ', '.')}" if with_version else label
                # no version word is required where a form has an optional one
                made.append(_rule(own, keyword, priority, weight, form.replace("{n}", name).replace("(?: {v})?", "").replace("{v}", version)))
    made += [_rule(label, keyword, priority, weight, pattern) for label, keyword, pattern, priority, weight in OTHER]
    return made


def _fold() -> bytes:
    """A-Z become a-z; bytes that are neither a-z, 0-9 nor above 127 become spaces."""
    kept = b"abcdefghijklmnopqrstuvwxyz0123456789"
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in kept:
        table[c] = c
    for c in range(26):
        table[65 + c] = 97 + c
    return bytes(table)


FOLD = _fold()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def _places(line: bytes, found: re.Pattern) -> list[tuple[int, int]]:
    """(first, end) in words of all matches in a line that begins and ends with a space."""
    out, word, at = [], -1, 0
    for m in found.finditer(line):
        word += line.count(b" ", at, m.start())
        at = m.start()
        out.append((word, word + m[0].count(b" ") + 1))
    return out


def resolve(finds: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Drops finds (first, end, priority, label, weight) that lie inside one of better priority,
    or inside a longer one, or an equal one earlier by label, of the same priority.

    One pass in order of place; per priority only the furthest end so far is kept.
    """
    kept, reach = [], {}
    for find in sorted(set(finds), key=lambda f: (f[0], -f[1], f[2], f[3])):
        first, end, priority = find[:3]
        if not any(until >= end and p <= priority for p, until in reach.items()):
            kept.append(find)
        reach[priority] = max(reach.get(priority, 0), end)
    # of finds with one beginning the longer came first; a shorter, better one does not undo it
    return kept


_RULES = rules()
_KEYWORDS = frozenset(r.keyword for r in _RULES) | {p.split()[0].encode() for p in PHRASES}
_BASE = {label: re.compile(rf"(?<= ){phrase}(?= )".encode()) for phrase, label in PHRASES.items()}


def scan(text: str | None) -> dict:
    """Words, base places and the finds that remain, of one whole text."""
    words = words_of(text)
    seen = _KEYWORDS.intersection(words)
    base: list[tuple[int, str]] = []
    finds: list[tuple[int, int, int, str, float]] = []
    if seen:
        line = b" " + b" ".join(words) + b" "
        for label, pattern in _BASE.items():
            base += [(first, label) for first, _ in _places(line, pattern)]
        for rule in _RULES:
            if rule.keyword in seen:
                finds += [(first, end, rule.priority, rule.label, rule.weight) for first, end in _places(line, rule.found)]
    return {"n_words": len(words), "base": sorted(base), "finds": resolve(finds)}


FINDS = T.ArrayType(
    T.StructType(
        [
            T.StructField("first_word", T.LongType()),
            T.StructField("end_word", T.LongType()),
            T.StructField("priority", T.LongType()),
            T.StructField("label", T.StringType()),
            T.StructField("weight", T.DoubleType()),
        ]
    )
)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, finds.

    Places count words from 0. ``finds`` are the detections that remain (first word, end,
    priority, label, weight), score the largest weight among them, 0 without any; a text
    with base places scores at least 0.5. Null and wordless texts have no words and no
    labels (empty strings, null places). Null ids and repeated rows keep their rows.
    """
    small_batches(docs.sparkSession)
    rows = narrow(docs, doc_id=id_col, text=text_col)
    finds_type = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("priority", pa.int64()), ("label", pa.string()), ("weight", pa.float64())]))

    def run(batches):
        for batch in batches:
            out = [scan(t) for t in batch.column(1).to_pylist()]
            base_labels = [sorted({label for _, label in x["base"]}) for x in out]
            own = [sorted({f[3] for f in x["finds"]} | set(b)) for x, b in zip(out, base_labels)]
            names = ("first_word", "end_word", "priority", "label", "weight")
            columns = [
                pa.array([x["n_words"] for x in out], pa.int64()),
                pa.array([len(x["base"]) for x in out], pa.int64()),
                pa.array([x["base"][0][0] if x["base"] else None for x in out], pa.int64()),
                pa.array([x["base"][-1][0] if x["base"] else None for x in out], pa.int64()),
                pa.array([",".join(b) for b in base_labels], pa.string()),
                pa.array([",".join(b) for b in own], pa.string()),
                pa.array([max([f[4] for f in x["finds"]] + [0.5 * bool(x["base"])]) for x in out], pa.float64()),
                pa.array([[dict(zip(names, f)) for f in x["finds"]] for x in out], finds_type),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    longs = [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    texts = [T.StructField(n, T.StringType()) for n in ("base_labels", "labels")]
    schema = T.StructType([rows.schema["doc_id"], *longs, *texts, T.StructField("score", T.DoubleType()), T.StructField("finds", FINDS)])
    return rows.mapInArrow(run, schema)
