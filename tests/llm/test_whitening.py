from __future__ import annotations

import numpy as np
import pytest

from sievemark.llm import queries, whitening


@pytest.mark.parametrize("case", ["random", "equal values", "zeros in z", "clusters", "nothing yet"])
def test_rank_one_equals_a_whole_decomposition(case):
    rng = np.random.default_rng(5)
    for size in (1, 2, 7, 40):
        d = np.sort(rng.uniform(0, 10, size))
        z = rng.normal(size=size)
        if case == "equal values":
            d = np.sort(np.round(d / 4))
        elif case == "zeros in z":
            z[::2] = 0
        elif case == "clusters":
            d = np.sort(np.round(d) + rng.uniform(0, 1e-13, size))
        elif case == "nothing yet":
            d[:] = 0
        u = np.linalg.qr(rng.normal(size=(size, size)))[0]
        values, vectors = whitening.rank_one(d, u, u @ z, 1.7)
        whole = u @ np.diag(d) @ u.T + 1.7 * np.outer(u @ z, u @ z)
        assert np.allclose(values, np.linalg.eigvalsh(whole), atol=1e-11)
        assert np.allclose(vectors.T @ vectors, np.eye(size), atol=1e-12)
        assert np.allclose(vectors @ np.diag(values) @ vectors.T, whole, atol=1e-11)


def test_batches_and_combined_states_equal_one_scatter():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(500, 9)) @ rng.normal(size=(9, 9)) * 20).astype(np.int64)
    parts = []
    for rows in (x[:3], x[3:200], x[200:201], x[201:]):
        state = whitening.empty_state(9)
        for at in range(0, len(rows), 50):
            state = whitening.absorb(state, rows[at : at + 50])
        parts.append(state)
    whole = parts[0]
    for p in parts[1:]:
        whole = whitening.combined(whole, p)
    centred = x - x.mean(axis=0)
    assert whole[0] == 500 and (whole[1] == x.sum(axis=0)).all()
    assert np.allclose(whole[3] @ np.diag(whole[2]) @ whole[3].T, centred.T @ centred, rtol=1e-10, atol=1e-6)


def plain(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    away = n * x - sums
    centred = away / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return n, (away.astype(object) ** 2).sum(axis=1), values[::-1], centred @ basis[:, ::-1]


def compared(out, ids, vectors):
    n, squares, values, projected = plain(vectors)
    top = min(32, len(values))
    got = np.full((len(ids), top), np.nan)
    at = {i: k for k, i in enumerate(ids)}
    for r in out:
        k = at[r.vec_id]
        assert (r.n, r.deviation, int(r.deviation_wide)) == (n, squares[k], squares[k])
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-10)
        assert r.identity_error <= 1e-9
        got[k, r.component - 1] = r.whitened
    want = projected[:, :top] / np.sqrt(values[:top])
    sign = np.sign((got * want).sum(axis=0))
    assert np.allclose(got, want * sign, atol=1e-8)


def test_query_equals_a_plain_decomposition(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    out = queries.QUERIES["op11_whitening"](spark, folder).collect()
    assert len(out) == 32 * len(rows)
    compared(out, [r.vec_id for r in rows], [r.embedding for r in rows])


def test_many_partitions_merge_in_a_tree(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 5)) * [1, 5, 2, 9, 3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(40)
    compared(whitening.whiten(df).collect(), range(700), x)


def test_awkward_rows(spark):
    schema = "vec_id long, embedding array<float>, n string, component string"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    good = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [3.0, 2.0])]
    odd = [(5, None), (6, []), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("-inf"), 1.0]), (10, [1.0])]
    rows = whitening.whiten(spark.createDataFrame([(i, v, "x", "y") for i, v in good + odd], schema)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in rows) == sorted((i, c, 4) for i in (0, 1, 2, 2) for c in (1, 2))
    for r in rows:
        if r.component == 2:  # a constant entry
            assert r.whitened is None and r.explained == pytest.approx(0)
        else:
            assert abs(r.whitened) == pytest.approx(3**0.5 if r.vec_id is None else 3**-0.5) and r.explained == pytest.approx(1)
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "", "")], schema)).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in one] == [(1, 0, None, None)] * 2


def test_deviation_beyond_a_long_stays_exact(spark):
    big = float(1 << 33)
    df = spark.createDataFrame([(0, [0.0]), (1, [big])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(df).collect()
    assert {(r.deviation, int(r.deviation_wide)) for r in rows} == {(None, (64 * (1 << 33)) ** 2)}
