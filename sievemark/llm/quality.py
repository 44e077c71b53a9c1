"""Operator 1: line-first cleaning. Lines are judged one by one; a document that loses too much goes.

Each line with a word is held against three kinds of rules, in this order:

* navigation: separators (``|``, ``>``, ...) make up a large share of its words;
* boilerplate: it contains a phrase of page furniture;
* punctuation: too many symbols, a mark such as ``!`` on nearly every word, or a long line without a
  terminal mark at its end.

Failing lines are removed; a document is rejected when the removed lines hold more than ``max_loss``
percent of its word characters, or when the document-level base rules fail.

Cases: a null or empty text has no words, counts of zero, ``base_failed`` true and a null or empty
``clean_text``. Texts of any length are read whole. Equal rows give equal results; an empty table gives
an empty table. Columns of the input that have the name of an output are replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievemark.llm.common import CONTINUATION, SPACES, texts, with_columns

SYMBOLS = b"#*$%&|<>"
# Words that separate the entries of a menu or a list of links.
SEPARATORS = ("|", ">", ">>", "<", "<<", "/", "-", "»", "«", "·", "•", "→")
# Marks that end a sentence in the scripts that have some, or close a quotation or bracket after one. Latin
# and Greek, Armenian, Hebrew, Arabic and Urdu, Syriac, Devanagari and its kin, Sinhala, Tibetan, Burmese, Ethiopic,
# Khmer, Mongolian, Ol Chiki, Chinese and Japanese.
TERMINALS = (
    ".", "!", "?", "…", "‼", "⁇", "⁈", "⁉", ":", ";", '"', "'", ")", "]", "}", "”", "“", "’", "‘", "»", "«", "›", "‹",
    "։", "׃", "؟", "۔", "؛", "܀", "܁", "܂", "।", "॥", "෴", "།", "༎", "၊", "။", "።", "፧", "፨", "។", "៕", "᠃", "᠉", "᱾", "᱿",
    "。", "．", "！", "？", "；", "：", "｡", "」", "』", "）", "】", "》", "〉",
)
# Phrases of page furniture, lower case.
BOILERPLATE = (
    "accept cookies",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "sign up for",
    "skip to content",
    "subscribe to our",
    "terms of use",
)
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated 3-word windows
MAX_LOSS = 30  # percent of word characters in removed lines
MAX_SYMBOLS = 10  # percent of a line's word characters
MAX_SEPARATORS = 20  # percent of a line's words
OPEN_LINE = 10  # a line with as many words must end with a terminal mark

OUTPUTS = (
    "clean_text string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " n_lines long, n_navigation long, n_boilerplate long, n_punctuation long, lost_chars long,"
    " base_failed boolean, kept boolean"
)

_separators = frozenset(s.encode() for s in SEPARATORS)
_terminals = tuple(s.encode() for s in TERMINALS)
_boilerplate = tuple(s.encode() for s in BOILERPLATE)
_no_word = CONTINUATION + SPACES


def word_chars(text: bytes) -> int:
    return len(text.translate(None, _no_word))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice, the first one included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    inside = np.zeros(len(words), bool)
    starts = np.flatnonzero(np.fromiter((counts[w] > 1 for w in windows), bool, len(windows)))
    for step in range(3):
        inside[starts + step] = True
    return int(inside.sum())


def line_fault(line: bytes) -> int:
    """0 for a line that stays, 1 navigation, 2 boilerplate, 3 punctuation."""
    words = line.split()
    separators = sum(w in _separators for w in words)
    if separators and 100 * separators > MAX_SEPARATORS * len(words):
        return 1
    lower = line.lower()
    if any(p in lower for p in _boilerplate):
        return 2
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if symbols and 100 * symbols > MAX_SYMBOLS * word_chars(line):
        return 3
    if line.count(b"!") + line.count(b"?") >= max(3, len(words)):
        return 3
    return 3 if len(words) >= OPEN_LINE and not words[-1].endswith(_terminals) else 0


def judged(text: bytes | None) -> tuple:
    if text is None:
        return (None, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, True, False)
    words = text.split()
    chars = word_chars(text)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    copies = lines = lost = 0
    faults = [0, 0, 0, 0]
    left = []
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            copies += line in seen
            seen.add(line)
            fault = line_fault(line)
            faults[fault] += 1
            if fault:
                lost += word_chars(line)
                continue
        left.append(line)
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED * len(words)
    kept = not failed and 100 * lost <= MAX_LOSS * chars
    clean = text if not lost and lines == faults[0] else b"\n".join(left)
    return (clean, len(words), chars, symbols, copies, repeated, lines, *faults[1:], lost, failed, kept)


def clean_lines(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the cleaned text, the counts and the verdict of each document."""

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = [judged(t) for t in texts(batch, text)]
        names = [c.split()[0] for c in OUTPUTS.split(",")]
        kinds = [pa.string()] + [pa.int64()] * 10 + [pa.bool_()] * 2
        columns = zip(*rows, strict=True)
        made = {}
        for name, kind, column in zip(names, kinds, columns, strict=True):
            made[name] = pa.array(column, pa.binary()).cast(kind) if name == "clean_text" else pa.array(column, kind)
        return made

    return with_columns(docs, OUTPUTS, compute, keep)


def _listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def oracle() -> str:
    """The same rules as DuckDB SQL, from word and line tables."""
    space = r"[\x20\x09-\x0D]"
    ends = " OR ".join(f"ends_with(w[-1], '{t.replace(chr(39), chr(39) * 2)}')" for t in TERMINALS)
    phrases = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM doc)),
rep AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
hit AS (
  SELECT DISTINCT doc_id, i + s AS i FROM (SELECT w.doc_id, w.i FROM win w JOIN rep r ON w.doc_id = r.doc_id AND w.g = r.g),
         (VALUES (0), (1), (2)) AS v(s)),
repeated AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
cut AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS ln FROM doc),
line AS (
  SELECT doc_id, ln, regexp_extract_all(ln, '[^\x20\x09-\x0D]+') AS w,
         length(regexp_replace(ln, '{space}', '', 'g')) AS chars,
         length(ln) - length(regexp_replace(ln, '[#*$%&|<>]', '', 'g')) AS symbols,
         length(ln) - length(regexp_replace(ln, '[!?]', '', 'g')) AS marks,
         translate(ln, '{upper}', '{lower}') AS low
  FROM cut WHERE regexp_matches(ln, '[^\x20\x09-\x0D]')),
fault AS (
  SELECT *, CASE
    WHEN 100 * len(list_filter(w, lambda x: list_contains({_listed(SEPARATORS)}, x))) > {MAX_SEPARATORS} * len(w) THEN 1
    WHEN {phrases} THEN 2
    WHEN 100 * symbols > {MAX_SYMBOLS} * chars THEN 3
    WHEN marks >= greatest(3, len(w)) THEN 3
    WHEN len(w) >= {OPEN_LINE} AND NOT ({ends}) THEN 3 ELSE 0 END AS f
  FROM line),
lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT ln) AS dup,
         count(*) FILTER (f = 1) AS f1, count(*) FILTER (f = 2) AS f2, count(*) FILTER (f = 3) AS f3,
         coalesce(sum(chars) FILTER (f > 0), 0) AS lost
  FROM fault GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '{space}', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         coalesce(l.n, 0)::BIGINT AS n_lines, coalesce(f1, 0)::BIGINT AS n_navigation,
         coalesce(f2, 0)::BIGINT AS n_boilerplate, coalesce(f3, 0)::BIGINT AS n_punctuation,
         coalesce(lost, 0)::BIGINT AS lost_chars
  FROM doc d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN repeated r ON r.doc_id = d.doc_id),
failed AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND 100 * lost_chars <= {MAX_LOSS} * word_chars AS kept FROM failed
"""
