from __future__ import annotations

import re

import pytest
from fixtures_llm import AWKWARD, SCHEMA, documents

from sievemark.llm import licenses


@pytest.mark.parametrize(
    ("text", "kind", "named"),
    [
        (" MIT", "permissive", ["mit"]),
        (" mit or gpl-3.0-only", "permissive", ["mit", "gpl-3.0-only"]),
        (" mit and gpl-3.0-only", "strong-copyleft", ["mit", "gpl-3.0-only"]),
        (" gpl-2.0-only with classpath-exception-2.0", "weak-copyleft", ["gpl-2.0-only"]),
        (" gpl-2.0-only with nothing-known", "strong-copyleft", ["gpl-2.0-only"]),
        (" mit and gpl-2.0 or apache-2.0", "permissive", ["mit", "gpl-2.0", "apache-2.0"]),
        (" mit and (gpl-2.0 or cc-by-nc-4.0)", "strong-copyleft", ["gpl-2.0", "cc-by-nc-4.0", "mit"]),
        (" mit see the file", "permissive", ["mit"]),
        (" Artistic-2.0", "permissive", ["artistic-2.0"]),
        (" BSL-1.0 OR WTFPL", "permissive", ["bsl-1.0", "wtfpl"]),
        (" MIT and this file is", "permissive", ["mit"]),
        (" (MIT) and (this file", "permissive", ["mit"]),
        (" see the file", "invalid", []),
        (" Somebody-1.0", "unknown", ["somebody-1.0"]),
        (" mitigation-1.0", "unknown", ["mitigation-1.0"]),
        (" mit or LicenseRef-ours", "permissive", ["mit", "licenseref-ours"]),
        (" mit and LicenseRef-ours", "unknown", ["mit", "licenseref-ours"]),
        (" GPLv2 and MIT", "strong-copyleft", ["gplv2", "mit"]),
        (" mit and", "invalid", []),
        (" ((mit)", "invalid", []),
        (" mit with a with b", "invalid", []),
        ("", "invalid", []),
    ],
)
def test_expressions(text, kind, named):
    assert licenses.expression(text.lower()) == (kind, named)


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in licenses.BASE.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                starts.append(i)
                labels.add(label)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


TEXTS = [
    "CC-BY cc by CC_BY; all rights\nreserved. ALL RIGHTS RESERVED all rights é reserved",
    "general public license general public license lesser general public license",
    "ccby cc  by all rights reserved all rights reserved cc by",
    "cc by" * 3,
    "",
    None,
]


def test_base_equals_a_plain_search(spark):
    for text in TEXTS + [r[1] for r in AWKWARD if r[1] is None or len(r[1]) < 10_000]:
        assert licenses.scanned(text.encode() if text is not None else None)[:5] == plain(text)
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert licenses.scanned(row.text.encode())[:5] == plain(row.text)


def test_labels_and_score(spark):
    text = "Licensed under CC BY-NC 4.0.\n// SPDX-License-Identifier: (MIT OR GPL-3.0-only)\nend"
    df = spark.createDataFrame([(1, text, "", "", 0)], SCHEMA)
    row = licenses.scan(df).first()
    assert row.base_labels == "cc-by" and row.labels == "cc-by,cc-by-nc,expression:permissive,gpl-3.0-only,mit"
    assert 0.9 < row.score < 1 and row.expressions == ["permissive"] and row.n_notices == 1


def test_awkward_documents(spark):
    out = licenses.scan(documents(spark, extra=["labels", "note"]))
    rows = out.collect()
    assert len(rows) == len(AWKWARD) and {r.note for r in rows} == {"mine"}
    assert all((r.n_base, r.first_word, r.base_labels, r.labels, r.score) == (0, None, "", "", 0.0) for r in rows)
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
