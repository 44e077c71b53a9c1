"""Operator 9: licence scans. Aho-Corasick finds phrases and identifier tags, a shunting-yard parser reads expressions.

The text is lower-cased (A-Z) and cut into words; one automaton over the words, joined by single blanks,
finds all phrases at once, overlapping ones too. A second automaton over the lower-cased text finds
identifier tags; what follows a tag on its line is parsed as a licence expression with ``or`` below
``and`` below ``with``, and evaluated to a class: ``or`` offers the mildest, ``and`` binds to the strictest,
``with`` a known exception makes a strong copyleft weak. A name of no known licence is ``unknown``: ``or`` offers the
other side, ``and`` is unknown then. A plain word before further words is prose and ends the expression.

Labels: ``base_labels`` of the base phrases; ``labels`` has these, the labels of notice phrases, the
licences named in expressions (lower case), and ``expression:<class>`` for each expression
(``expression:invalid`` if it cannot be parsed). ``score`` is 1 minus the product of (1 - weight) over the
distinct labels' evidence.

Cases: a null or empty text has no words, no places, null positions, empty labels and score 0. Texts of any
length are read whole, in time proportional to their length and their matches. Equal rows give equal
results; an empty table gives an empty table. Input columns with the name of an output are replaced.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from sievemark.llm.common import texts, with_columns

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Phrases of licence notices and the licence that they show.
NOTICES = {
    "apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons": "cc",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "public domain": "public-domain",
    "dedicated to the public": "public-domain",
    "no part of this": "reserved",
}
# Tags before a licence expression, lower case.
TAGS = ("spdx-license-identifier:", "license-expression:")
# Classes of licences, mildest first, and the identifiers that begin so.
CLASSES = ("public", "permissive", "weak-copyleft", "strong-copyleft", "restricted", "unknown")
PREFIXES = {
    "cc0": "public", "unlicense": "public", "0bsd": "public", "pddl": "public",
    "mit": "permissive", "apache": "permissive", "bsd": "permissive", "isc": "permissive", "zlib": "permissive", "cc-by": "permissive",
    "artistic": "permissive", "blueoak": "permissive", "bsl": "permissive", "ms-pl": "permissive", "ncsa": "permissive", "postgresql": "permissive", "psf": "permissive",
    "python": "permissive", "ruby": "permissive", "unicode": "permissive", "upl": "permissive", "vim": "permissive", "wtfpl": "permissive", "x11": "permissive",
    "lgpl": "weak-copyleft", "mpl": "weak-copyleft", "epl": "weak-copyleft", "cddl": "weak-copyleft", "ms-rl": "weak-copyleft", "ofl": "weak-copyleft",
    "gpl": "strong-copyleft", "agpl": "strong-copyleft", "cc-by-sa": "strong-copyleft", "cecill": "strong-copyleft", "eupl": "strong-copyleft", "osl": "strong-copyleft",
    "cc-by-nc": "restricted", "cc-by-nd": "restricted", "busl": "restricted", "elastic": "restricted", "sspl": "restricted",
}
# Exceptions that allow linking.
EXCEPTIONS = ("classpath-exception", "gcc-exception", "llvm-exception", "linking-exception", "bootloader-exception")
WEIGHTS = {"base": 0.6, "notice": 0.5, "expression": 0.9}

PRECEDENCE = {"or": 1, "and": 2, "with": 3}

OUTPUTS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " n_notices long, expressions array<string>"
)

# bytes of words stay, capitals become small, everything else separates
_keep = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_rest = re.compile(r"v?[0-9]|[^a-z0-9]|$")  # after the known beginning of an identifier
_token = re.compile(r"\(|\)|[a-z0-9.+:-]+")


def tokens(text: str) -> list[str]:
    """Parts of a licence expression; the first character of another kind ends it."""
    out, at = [], 0
    while True:
        while at < len(text) and text[at] in " \t":
            at += 1
        m = _token.match(text, at)
        if not m:
            return out
        out.append(m[0])
        at = m.end()


def in_postfix(parts: list[str]) -> list[str] | None:
    """Shunting yard: operands and operators in postfix order, None if the parts are no expression."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for part in parts:
        if part == "(":
            if not operand_next:
                return None
            waiting.append(part)
        elif part == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif part in PRECEDENCE:
            if operand_next:
                return None
            while waiting and PRECEDENCE.get(waiting[-1], 0) >= PRECEDENCE[part]:
                out.append(waiting.pop())
            waiting.append(part)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(part)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def class_of(identifier: str) -> str:
    found = max((p for p in PREFIXES if identifier.startswith(p) and _rest.match(identifier, len(p))), key=len, default=None)
    return PREFIXES[found] if found else "unknown"


def evaluated(postfix: list[str]) -> tuple[str, list[str]] | None:
    """The class of an expression and the licences that it names; None if ``with`` joins anything but a name and an exception."""
    stack: list[tuple[int, str | None]] = []
    named = []
    for part in postfix:
        if part not in PRECEDENCE:
            stack.append((CLASSES.index(class_of(part)), part))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if part == "with":
            if left is None or right is None:
                return None
            named.append(left)
            lenient = right.startswith(EXCEPTIONS) and CLASSES[a] == "strong-copyleft"
            stack.append((CLASSES.index("weak-copyleft") if lenient else a, None))
            continue
        named += [n for n in (left, right) if n is not None]
        stack.append((min(a, b) if part == "or" else max(a, b), None))
    level, alone = stack.pop()
    return CLASSES[level], named + ([alone] if alone else [])


def expression(text: str) -> tuple[str, list[str]]:
    """The class (or ``invalid``) and the licences of what follows a tag."""
    parts = tokens(text)
    # prose may follow: an operand right after an operand, or after a closed bracket, ends the expression
    for i in range(1, len(parts)):
        if parts[i] not in PRECEDENCE and parts[i] != ")" and parts[i - 1] not in PRECEDENCE and parts[i - 1] != "(":
            del parts[i:]
            # so the word before may be prose as well, and what led to it
            if parts[-1].isalpha() and class_of(parts[-1]) == "unknown":
                parts.pop()
                while parts and (parts[-1] in PRECEDENCE or parts[-1] == "("):
                    parts.pop()
            break
    postfix = in_postfix(parts)
    return (evaluated(postfix) if postfix else None) or ("invalid", [])


@cache
def _phrases() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES}:
        automaton.add_word(f" {phrase} ", phrase)
    automaton.make_automaton()
    return automaton


@cache
def _tags() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for tag in TAGS:
        automaton.add_word(tag, tag)
    automaton.make_automaton()
    return automaton


def scanned(text: bytes | None) -> tuple:
    words = (text or b"").translate(_keep).split()
    if not words:
        return (0, 0, None, None, "", "", 0.0, 0, [])
    joined = f" {b' '.join(words).decode()} "
    base, notices, starts = set(), set(), []
    n_notices = at = index = 0
    for end, phrase in _phrases().iter(joined):
        begin = end - len(phrase) - 1
        if phrase in NOTICES:
            notices.add(NOTICES[phrase])
            n_notices += 1
        if phrase in BASE:
            base.add(BASE[phrase])
            # blanks before a place number its first word; places come in the order of their ends
            index += joined.count(" ", at, begin) if begin >= at else -joined.count(" ", begin, at)
            at = begin
            starts.append(index)
    labels = base | notices
    expressions = []
    low = text.lower().decode()
    for end, _ in _tags().iter(low):
        stop = low.find("\n", end)
        kind, named = expression(low[end + 1 : stop if stop >= 0 else len(low)])
        expressions.append(kind)
        labels |= {f"expression:{kind}", *named}
    doubt = (1 - WEIGHTS["base"]) ** len(base) * (1 - WEIGHTS["notice"]) ** len(notices)
    doubt *= (1 - WEIGHTS["expression"]) ** len({e for e in expressions if e != "invalid"})
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), 1 - doubt, n_notices, expressions,
    )


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the counts, positions, labels and score of each text."""
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64(), pa.list_(pa.string())]
    names = [c.split()[0] for c in OUTPUTS.split(", ")]

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        columns = zip(*[scanned(t) for t in texts(batch, text)], strict=True)
        return {n: pa.array(c, k) for n, k, c in zip(names, kinds, columns, strict=True)}

    return with_columns(docs, OUTPUTS, compute, keep)
