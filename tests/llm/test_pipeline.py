from __future__ import annotations

import corpus_pipeline
import pytest
from fixtures_llm import SCHEMA, documents
from pyspark.sql import functions as F

from sievemark.llm import packing, quality, surrogates
from sievemark.llm import queries

FOLDER = "/root/testdata/sf0.001"


def plain_run(rows):
    """The stages one after another in plain Python, mixture and packing as word counts."""
    kept = []
    for doc_id, text, lang, source, _ in rows:
        verdict = quality.judged(text.encode() if text is not None else None)
        if verdict[-1]:
            kept.append((doc_id, verdict[0].decode(), source))
    groups = plain_groups([t for _, t, _ in kept])
    first = {}
    for (doc_id, _, _), g in zip(kept, groups, strict=True):
        first[g] = min(first.get(g, doc_id), doc_id)
    alone = [k for k, g in zip(kept, groups, strict=True) if k[0] == first[g]]
    return [(d, surrogates.replaced(surrogates.KEY, t)[0], s) for d, t, s in alone]


def plain_groups(texts):
    """Components of texts whose sets of 5-word shingles have a Jaccard similarity of at least 0.8."""
    sets = []
    for t in texts:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)})
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if group[i] != group[j] and 5 * len(a & b) >= 4 * len(a | b):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_run_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    clean = plain_run([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    # the mixture and the packing have brute-force tests of their own; here they run on the plain rows
    from sievemark.llm import mixing

    plain = spark.createDataFrame(clean, "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix(plain).collect() if r.copies}
    rows = queries.QUERIES["pipeline"](spark, FOLDER).collect()
    words = {d: len(t.encode().split()) for d, t, _ in clean}
    packed = {}
    for r in rows:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_words
    assert packed == {d: words[d] * n for d, n in copies.items()}
    bins = {}
    for r in rows:
        bins.setdefault((r.bin_id, r.bin_length), []).append((r.bin_offset, r.n_words))
    for (_, length), content in bins.items():
        end = 0
        for offset, n in sorted(content):
            assert offset == end
            end += n
        assert end <= length and length == min(n for n in packing.LENGTHS if n >= end)


@pytest.mark.parametrize("rows", [None, []])
def test_stages_on_awkward_and_empty_tables(spark, rows):
    docs = documents(spark, extra=["kept", "size", "entities"]) if rows is None else spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        out.count()
    assert corpus_pipeline.packing_stage(spark, docs, "").count() >= docs.count()


def test_clean_documents_stay(spark):
    docs = spark.range(40).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", *[F.md5((F.col("id") * 99 + i).cast("string")) for i in range(80)], F.lit("end.")).alias("text"),
        F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"),
    )
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, "")
        assert docs.count() == 40
