from __future__ import annotations

import re

import duckdb
import pytest
from fixtures_llm import AWKWARD, SCHEMA, documents

from sievemark.llm import quality
from tools.check import canonical


def test_equals_its_sql_on_awkward_rows(spark):
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    rows = list({r[0]: r for r in AWKWARD if r[0] is not None}.values())  # its SQL groups by id
    db.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    cur = db.execute(quality.oracle())
    want = canonical(cur.fetchall(), [d[0] for d in cur.description])
    df = quality.clean_lines(documents(spark, rows).select("doc_id", "text"), keep=["doc_id"]).drop("clean_text")
    assert canonical([tuple(r) for r in df.collect()], df.columns) == want


def test_clashing_columns_are_replaced_and_others_kept(spark):
    out = quality.clean_lines(documents(spark, extra=["kept", "n_words", "note"]))
    assert out.schema["kept"].dataType.simpleString() == "boolean"
    assert {r.note for r in out.collect()} == {"mine"}
    assert out.count() == len(AWKWARD)


def test_empty_table(spark):
    assert quality.clean_lines(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    ("line", "fault"),
    [
        (b"Home | News | Sport | About", 1),
        (b"We use a Cookie Policy on this page.", 2),
        (b"wor### ds%%% with$$$ marks&&&.", 3),
        (b"BUY!! NOW!! OR!! NEVER!!", 3),
        (b"one two three four five six seven eight nine ten", 3),
        (b"A title", 0),
        (b"A sentence that is fine, and long enough to be judged by its end.", 0),
    ],
)
def test_line_rules(line, fault):
    assert quality.line_fault(line) == fault


def test_only_failing_lines_leave_the_text(spark):
    good = "These are eleven plain words that make one complete sentence here.\n" * 3 + "Numbers differ %d and so do the words of line number %d.\n"
    text = "".join(good % (i, i) for i in range(5)) + "Home | News | Sport\nLast line of all."
    df = quality.clean_lines(spark.createDataFrame([(1, text, "", "", 0)], SCHEMA))
    row = df.first()
    assert row.clean_text == text.replace("Home | News | Sport\n", "") and row.n_navigation == 1


def test_repeated_words_against_a_plain_count():
    words = b"a b c d a b c e f a b c c c c c".split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + s for i, w in enumerate(windows) if windows.count(w) > 1 for s in range(3)}
    assert quality.repeated_words(words) == len(inside)
    assert quality.repeated_words([]) == 0 and quality.word_chars("é ü\x0bß".encode()) == 3
    assert re.findall(r"[^\x20\x09-\x0D]+", "a\x1cb\xa0c") == [w.decode() for w in "a\x1cb\xa0c".encode().split()]


@pytest.mark.parametrize("mark", ["।", "۔", "؟", "。", "።", "။", "։", "“", "."])
def test_prose_in_many_scripts_ends_its_lines(mark):
    line = " ".join(f"शब्द{i}" for i in range(14))
    assert quality.line_fault(f"{line}{mark}".encode()) == 0
    assert quality.line_fault(line.encode()) == 3
