from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from fixtures_llm import AWKWARD, documents

from sievemark.llm import queries, ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k):
    """Every document scored; docs: (doc_id, text), items: {item_id: text}."""
    words = [split(t) for _, t in docs]
    counts = [Counter(w) for w in words]
    documents_, length = sum(map(bool, words)), sum(map(len, words))
    out = []
    for item, text in items.items():
        scores = []
        for (doc_id, _), w, c in zip(docs, words, counts, strict=True):
            score = 0
            for t in set(split(text)) & set(c):
                df = sum(t in o for o in counts)
                weight = math.floor(1000 * math.log((2 * documents_ + 2) / (2 * df + 1)))
                m = 100 - 50 + ((50 * len(w) * documents_) // length)
                score += weight * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def made_up(rng, rows, vocabulary):
    """Texts whose word frequencies fall off like a power, some repeated."""
    share = 1 / np.arange(1, vocabulary + 1)
    texts = [" ".join(f"W{i}" for i in rng.choice(vocabulary, rng.integers(1, 40), p=share / share.sum())) for _ in range(rows)]
    texts[10:16] = [texts[9]] * 6
    return texts


@pytest.mark.parametrize("shard", [7, 64, 100_000])
def test_nra_equals_scoring_everything(spark, monkeypatch, shard):
    rng = np.random.default_rng(shard)
    texts = made_up(rng, 300, 60)
    docs = list(zip(rng.permutation(300).tolist(), texts, strict=True))
    items = dict(enumerate(made_up(rng, 20, 60)))
    monkeypatch.setattr(ranking, "STEP", 2)
    for k in (1, 5, 400):
        words = [split(t) for t in texts]
        vocabulary = {t: n for n, t in enumerate(sorted({t for text in items.values() for t in split(text)}))}
        df = Counter(t for w in words for t in set(w))
        weights = np.array([math.floor(1000 * math.log((2 * 300 + 2) / (2 * df[t] + 1))) for t in vocabulary])
        best = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i in items}
        for at in range(0, 300, shard):
            part = list(range(at, min(300, at + shard)))
            cells = [(r, vocabulary[t], c) for r, d in enumerate(part) for t, c in Counter(words[d]).items() if t in vocabulary]
            rows, terms, counts = np.array(cells).T
            index = ranking.Shard(np.array([docs[d][0] for d in part]), np.array([len(words[d]) for d in part]), rows, terms, counts, weights, 300, sum(map(len, words)))
            best = {i: ranking.nra(index, np.array([vocabulary[t] for t in dict.fromkeys(split(text))]), best[i], k) for i, text in items.items()}
        got = [(i, rank, int(d), int(s)) for i, (scores, ids) in best.items() for rank, (s, d) in enumerate(zip(scores, ids, strict=True), 1)]
        assert got == plain(docs, items, k)


def test_lists_are_not_read_to_their_end():
    """One document holds everything asked for; the long list of a common term is left early."""
    n = 5000
    rows, terms, counts = np.arange(n), np.zeros(n, np.int64), np.ones(n, np.int64)
    counts[0] = 50
    read = []

    class Watched(ranking.Shard):
        def __init__(self, *a):
            super().__init__(*a)
            self.impacts = self.impacts.view(Count)

    class Count(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                read.append(key.stop - key.start)
            return super().__getitem__(key)

    shard = Watched(np.arange(n), np.full(n, 60), rows, terms, counts, np.array([300]), n, 60 * n)
    scores, ids = ranking.nra(shard, np.array([0]), (np.zeros(0, np.int64), np.zeros(0, np.int64)), 1)
    assert ids.tolist() == [0] and sum(read) == ranking.STEP


def test_spark_equals_scoring_everything(spark):
    rng = np.random.default_rng(2)
    docs = [(i, t) for i, t in enumerate(made_up(rng, 200, 50))] + [(None, "W1 W2"), (None, "w1 w2"), (3, "w1 W1 é")]
    items = dict(enumerate(made_up(rng, 12, 50))) | {90: "Unknown words only", 91: "", 92: "É é w1"}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([*items.items(), (93, None), (None, "W1")], "item_id long, text string")
    got = sorted((tuple(r) for r in ranking.search(df, asked, k=9).collect()), key=lambda r: r[:2])
    assert got == plain(docs, items, 9)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    docs = list(enumerate(made_up(rng, 60, 30)))
    items = dict(enumerate(made_up(rng, 10, 30)))
    monkeypatch.setattr(ranking, "ITEMS", 4)
    monkeypatch.setattr(ranking, "CELLS", 1)
    out = ranking.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"), k=3)
    assert sorted(tuple(r) for r in out.collect()) == plain(docs, items, 3)


def test_awkward_and_empty_tables(spark):
    docs = documents(spark, extra=["score", "rank", "item_id"])
    items = spark.createDataFrame([(1, "one LINE of plain words é 123"), (1, "another"), (2, None)], "item_id long, text string")
    got = sorted(tuple(r) for r in ranking.search(docs, items).collect())
    assert got == plain([(r[0], r[1]) for r in AWKWARD], {1: "one LINE of plain words é 123 another"}, 50)
    assert ranking.search(docs.limit(0), items).count() == 0
    assert ranking.search(docs, items.limit(0)).count() == 0
    assert ranking.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_query_columns(spark):
    rows = queries.QUERIES["op12_ranked_search"](spark, "/root/testdata/sf0.001")
    assert dict(rows.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
