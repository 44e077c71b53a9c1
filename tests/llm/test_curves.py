from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm import curves


@pytest.mark.parametrize(("axes", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_neighbours(axes, bits):
    cells = np.array(list(itertools.product(range(2**bits), repeat=axes)))
    keys = curves.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def plain(rows, k, every):
    """Brute force with the same ties; rows: {id: vector}."""
    out = {}
    for q, v in rows.items():
        if q % every == 0:
            scored = [(-float(curves.exact_scores(np.array([v]), np.array([w]))[0]), i) for i, w in rows.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = {i: rng.integers(-2, 3, 3).astype(float) for i in range(130)}  # many ties and copies
    rows = {i: v for i, v in rows.items() if v.any()}
    odd = [(900, None), (920, [0.0, 0.0, 0.0]), (940, [1.0, None, 2.0]), (960, [1.0, float("nan"), 0.0]), (980, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (1000, [1.0]), (1020, [])]
    data = [(i, [float(x) for x in v]) for i, v in rows.items()]
    df = spark.createDataFrame(data + odd + data[:5], "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "cls": F.lit(2)})
    out = curves.search(df, k=7)
    got = {}
    for r in sorted(out.collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got == plain(rows, 7, 20)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert curves.search(spark.createDataFrame([], schema)).count() == 0
    rows = curves.search(spark.createDataFrame([(20, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [3.0, 1.0])], schema)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(rows)] == [(20, 1, 1, 5.0), (20, 2, 2, 5.0)]


def test_recall_with_small_blocks_and_a_hot_vector(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 5)) * rng.uniform(0.5, 2, size=(900, 1))
    x[500:800] = x[500]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in curves.search(df, k=10, block=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 900, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        least = np.sort(scores)[-10]
        hits += sum(s >= least - 1e-9 for _, _, s in got[q])
        assert len(got[q]) == 10 and len({i for _, i, _ in got[q]}) == 10 and q not in {i for _, i, _ in got[q]}
    assert hits >= 0.9 * 10 * 45
    hot = [i for _, i, _ in sorted(got[500])]
    assert hot[:10] == list(range(501, 511)) or min(hot) < 500  # copies come in the order of their ids


def test_copies_on_many_curves_do_not_take_places(spark, monkeypatch):
    """With more curves than one, blocks far smaller than the table and the exact way behind them."""
    rng = np.random.default_rng(5)
    rows = {i: rng.normal(size=6) for i in range(400)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>")
    for most, asked in ((8, 4096), (0, 7)):
        monkeypatch.setattr(curves, "MOST", most)
        monkeypatch.setattr(curves, "ASKED", asked)
        got = {}
        for r in sorted(curves.search(df, k=5, block=32, target=1.01 if not most else 0.5).collect()):
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert {q: len({i for i, _ in x}) for q, x in got.items()} == dict.fromkeys(range(0, 400, 20), 5)
        if not most:
            assert got == plain(rows, 5, 20)


def test_large_entries_keep_their_order(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, (v * 1e200).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = curves.search(df, k=3).collect()
    assert len(rows) == 9
    for q in (0, 20, 40):
        scores = x @ x[q]
        scores[q] = -np.inf
        assert {r.vec_id for r in rows if r.query_id == q} == set(np.argsort(-scores)[:3].tolist())
