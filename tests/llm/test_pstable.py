from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm import pstable, queries


def plain(rows, least=0.95):
    """All pairs; rows: [(id, unit vector or None)]."""
    n = len(rows)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    good = [i for i, (_, v) in enumerate(rows) if v is not None]
    unit = np.array([rows[i][1] for i in good])
    linked = unit @ unit.T >= least
    np.fill_diagonal(linked, False)
    links = dict.fromkeys(range(n), 0)
    for a, i in enumerate(good):
        links[i] = int(linked[a].sum())
        for b in np.flatnonzero(linked[a]):
            x, y = sorted((root(i), root(good[b])))
            parent[y] = x
    least_id = {}
    for i, (name, _) in enumerate(rows):
        least_id[root(i)] = min(least_id.get(root(i), name), name)
    return sorted((name, links[i], least_id[root(i)], name == least_id[root(i)]) for i, (name, _) in enumerate(rows))


def clustered(rng, dims=16):
    """Single vectors, small groups, a tight crowd, a looser one and a chain, near the threshold on both sides."""
    base = rng.normal(size=(120, dims))
    near = [base[i] + rng.normal(size=dims) * s for i in range(40) for s in (0.05, 0.2, 0.3)]
    tight = base[50] + rng.normal(size=(150, dims)) * 0.06
    loose = base[60] + rng.normal(size=(90, dims)) * 0.22
    chain = [base[70] + base[71] * x for x in np.linspace(0, 2, 60)]
    x = np.concatenate([base, near, tight, loose, chain])
    return x[rng.permutation(len(x))]


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def frame(spark, x, kind="double"):
    return spark.createDataFrame([(i * 3 + 1, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")


@pytest.mark.parametrize(("crowd", "block"), [(32, 512), (4, 16), (10_000, 8)])
def test_equals_all_pairs(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(pstable, "CROWD", crowd)
    monkeypatch.setattr(pstable, "BLOCK", block)
    monkeypatch.setattr(pstable, "RECALL", 1 - 1e-9)
    x = clustered(np.random.default_rng(crowd))
    got = sorted(tuple(r) for r in pstable.near_copies(frame(spark, x)).collect())
    assert got == plain([(i * 3 + 1, v) for i, v in enumerate(unit(x))])


def test_recall_at_the_planned_size():
    """Pairs at the very threshold are found as often as planned."""
    rng = np.random.default_rng(1)
    a = unit(rng.normal(size=(4000, 64)))
    other = rng.normal(size=a.shape)
    other = unit(other - (other * a).sum(axis=1)[:, None] * a)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * other
    for rows in (10_000, 1_000_000):
        hashing = pstable.Hashing(64, *pstable.plan(rows))
        met = (hashing.keys(a) == hashing.keys(b)).any(axis=1) & (pstable.unlike(hashing.sketches(a), hashing.sketches(b)).diagonal() <= pstable.UNLIKE)
        assert met.mean() >= 0.985


def test_a_crowd_becomes_balls_not_pairs(spark):
    rng = np.random.default_rng(8)
    x = unit(np.concatenate([rng.normal(size=(300, 32)), rng.normal(size=32) + rng.normal(size=(3000, 32)) * 0.05]))
    df = frame(spark, x, "float")
    classes = df.select(F.col("embedding").alias("v"), F.monotonically_increasing_id().alias("cls"))
    hashes, tables = pstable.plan(3300)
    hashed = pstable.stored(pstable._hashed(classes, hashes, tables))
    inside = pstable.balls(hashed, tables).select(F.col("cls").alias("c"), "ball")
    members = hashed.join(inside, F.col("cls") == F.col("c"), "left").withColumn("ball", F.coalesce("ball", "cls"))
    assert pstable.candidates(members).count() < 20_000  # of 4.5 million linked pairs
    out = pstable.near_copies(df).where("n_links > 0").agg(F.count("*"), F.sum("n_links"), F.count_if("kept")).first()
    assert tuple(out) == (3000, 3000 * 2999, 1)


def test_query_equals_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op13_pstable_copies"](spark, folder).collect())
    assert got == plain([(i, v / np.linalg.norm(v)) for i, v in rows])


def test_awkward_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>, cls string, n string, ball string"
    assert pstable.near_copies(spark.createDataFrame([], schema)).count() == 0
    rows = [
        (4, [1.0, 0.0]), (5, [2.0, 0.0]), (5, [2.0, 0.0]), (6, [1e200, 1e199]), (7, [1e-200, 0.0]), (8, [0.0, 1.0]), (9, [1.0]), (10, [-3.0, -0.0]), (11, [-3.0, 0.0]),
        (20, None), (21, []), (22, [0.0, 0.0]), (23, [1.0, None]), (24, [float("nan"), 1.0]), (25, [float("inf"), 0.0]), (None, None),
    ]
    out = pstable.near_copies(spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], schema))
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0] is None, r))
    alone = [(i, 0, i, True) for i in (8, 9)] + [(10, 1, 10, True), (11, 1, 10, False)] + [(i, 0, i, True) for i in (20, 21, 22, 23, 24, 25, None)]
    assert got == [(4, 4, 4, True), (5, 4, 4, False), (5, 4, 4, False), (6, 4, 4, False), (7, 4, 4, False), *alone]
    only = pstable.near_copies(spark.createDataFrame([(1, None, "", "", "")], schema)).collect()
    assert [tuple(r) for r in only] == [(1, 0, 1, True)]
