from __future__ import annotations

import itertools

import numpy as np
import pytest
from fixtures_llm import AWKWARD, SCHEMA, documents

from sievemark.llm import crf, queries


@pytest.mark.parametrize("n", [1, 2, 5])
def test_forward_backward_equals_all_paths(n):
    rng = np.random.default_rng(n)
    scores, moves = rng.normal(size=(1, n, 3)), rng.normal(size=(3, 3))
    total, marginals, expected = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=n):
        weight = np.exp(sum(scores[0, t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        total += weight
        for t, k in enumerate(path):
            marginals[t, k] += weight
        for a, b in itertools.pairwise(path):
            expected[a, b] += weight
    got, moved, logz = crf.forward_backward(scores, moves)
    assert np.allclose(got[0], marginals / total) and np.allclose(moved, expected / total) and np.allclose(logz, np.log(total))


def test_segments_give_the_marginals_of_whole_chains():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 127, 128, 129, 300, 5, 1000])
    scores, moves = 2 * rng.normal(size=(sizes.sum(), 3)), rng.normal(size=(3, 3))
    got, at = crf.chain_marginals(scores, sizes, moves), 0
    for n in sizes:
        assert np.allclose(got[at : at + n], crf.forward_backward(scores[None, at : at + n], moves)[0][0])
        at += n


def test_code_switching_is_labelled_word_by_word():
    pools = {"aa": ["tolima", "rasona", "velitu", "monaro"], "bb": ["krzt", "schwp", "brgnt", "vltsk"]}
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(rng.choice(w, 60))) for k, w in pools.items() for _ in range(40)]
    model = crf.trained(rows)
    assert model.labels == ["aa", "bb"] and (np.diag(model.moves) > model.moves[[0, 1], [1, 0]]).all()
    labeller = crf.Labeller(model)
    (pred, score, n, switches), = labeller.label([b"tolima rasona 12 velitu monaro krzt schwp brgnt tolima rasona velitu"])
    assert (pred, n, switches) == ("aa", 11, 2) and 0.6 < score < 0.8


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    out = queries.QUERIES["op4_crf_language"](spark, folder)
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [r for r in out.collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in rows) > 0.97 * len(rows) > 0


def test_awkward_documents(spark):
    docs = documents(spark, extra=["score", "words"])
    model = crf.fit(docs.where("lang is not null"))
    rows = {r.doc_id: r for r in crf.identify(docs, model).collect()}
    assert all((rows[i].lang_pred, rows[i].score) == ("und", 0.0) for i in (1, 2, 3, 5))
    assert rows[0].lang_pred in ("en", "fr", "de") and 0 <= rows[4].score <= 1
    assert {r.lang_pred for r in crf.identify(docs, None).collect()} == {"und"}
    assert crf.identify(spark.createDataFrame([], SCHEMA), model).count() == 0
    assert crf.fit(spark.createDataFrame([], SCHEMA)) is None
    assert len(crf.identify(docs, model).collect()) == len(AWKWARD)


def test_copies_and_wordless_texts_take_no_places(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen = []
    monkeypatch.setattr(crf, "trained", lambda rows: seen.extend(rows))
    few = spark.range(20_000).select(
        F.concat(F.lit("copy"), (F.col("id") % 3).cast("string"), F.lit(" of a text")).alias("text"), F.concat(F.lit("l"), (F.col("id") % 8).cast("string")).alias("lang")
    )
    one = spark.range(8 * 2_500).select(F.concat(F.lit("only text of "), (F.col("id") % 8).cast("string")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 8).cast("string")).alias("lang"))
    many = spark.range(3_000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"), F.lit("many"))
    blank = spark.range(5_000).select(F.when(F.col("id") % 3 > 0, F.concat(F.repeat(F.lit(" "), F.col("id").cast("int")), F.when(F.col("id") % 3 > 1, F.col("id").cast("string")).otherwise(""))).alias("text"), F.lit("many"))
    crf.fit(few.unionByName(one).union(many).union(blank))
    counts = {k: [t for lang, t in seen if lang == k] for k in {lang for lang, _ in seen}}
    assert {k: len(v) for k, v in counts.items()} == {f"l{i}": 3 for i in range(8)} | {f"s{i}": 1 for i in range(8)} | {"many": crf.TRAIN_DOCS}
    assert all(len(set(v)) == len(v) and all(any(map(str.isalpha, t)) for t in v) for v in counts.values())
