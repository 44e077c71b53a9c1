from __future__ import annotations

import os
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemark.functions.hashing import text_signatures
from sievemark.operators import components, pairs, vector_pairs
from sievemark.session import freeze


def signatures(spark, values, key="i"):
    return spark.createDataFrame(list(enumerate(int(v) for v in values)), f"{key} long, h long")


def brute(a, b, d):
    x = np.asarray(a, dtype=np.int64).view(np.uint64)
    y = np.asarray(b, dtype=np.int64).view(np.uint64)
    return np.argwhere(np.bitwise_count(x[:, None] ^ y[None, :]) <= d)


def test_signature_literals(spark):
    got = pairs.record_links(signatures(spark, [0, 7, -1]), "i", "h", 3).collect()
    assert [(r.a, r.b, r.distance, r.pairs) for r in got] == [(0, 1, 3, 1)]


@pytest.fixture(scope="module")
def noisy_hashes():
    """Many signatures share most of their bits, so bands are crowded."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 30)
    out = []
    for b in base:
        for _ in range(12):
            v = int(b) & (2**64 - 1)
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                v ^= 1 << int(bit)
            out.append(v - 2**64 if v >> 63 else v)
    zeros = [int(x) for x in rng.integers(0, 2**16, 120)]  # upper bands all alike
    return np.unique(np.array(out + zeros, dtype=np.int64))


@pytest.mark.parametrize("bucket", [4096, 40, 3])
def test_near_signatures_equal_brute_force(spark, noisy_hashes, bucket):
    h = noisy_hashes
    df = signatures(spark, h).select(F.col("h").alias("signature"))
    got = pairs.signature_pairs(df, 4, bucket).collect()
    found = [(r.a, r.b) for r in got]
    assert len(found) == len(set(found))
    want = {(int(h[i]), int(h[j])) for i, j in brute(h, h, 4) if h[i] < h[j]}
    assert set(found) == want


def test_copies_are_counted_not_paired(spark):
    rows = spark.createDataFrame([(i, 5 if i < 50 else 6) for i in range(60)], "i long, h long")
    got = {(r.a, r.b): (r.distance, r.pairs) for r in pairs.record_links(rows, "i", "h", 2).collect()}
    assert got == {(0, 50): (2, 500), (0, 0): (0, 1225), (50, 50): (0, 45)}


@pytest.mark.parametrize("bucket", [4096, 5])
def test_variant_pairs_equal_brute_force(spark, noisy_hashes, bucket):
    h = noisy_hashes[:150]
    v = np.stack([h] + [h ^ np.int64((1 << (4 * k)) * 0x1111) for k in range(1, 8)], axis=1)
    df = spark.createDataFrame([(i, [int(x) for x in row]) for i, row in enumerate(v)], "i long, v array<long>")
    got = {(r.a, r.b) for r in pairs.variant_pairs(df, "i", "v", 3, bucket).collect()}
    want = set()
    for k in range(8):
        want |= {(min(i, j), max(i, j)) for i, j in brute(v[:, 0], v[:, k], 3) if i != j}
    assert got == {(int(a), int(b)) for a, b in want}


@pytest.mark.parametrize("bank_rows", [100_000, 1])
def test_nearest_distance_small_and_large_bank(spark, noisy_hashes, bank_rows):
    h = noisy_hashes
    q = np.concatenate([h[::9], np.random.default_rng(4).integers(-(2**62), 2**62, 5)])
    got = pairs.nearest_distance(signatures(spark, q), "i", "h", signatures(spark, h[1::3]), "h", 8, bank_rows).collect()
    x, y = q.view(np.uint64), h[1::3].view(np.uint64)
    want = np.bitwise_count(x[:, None] ^ y[None, :]).min(axis=1)
    assert {r.i: r.distance for r in got} == {i: int(d) for i, d in enumerate(want)}
    assert all(r.seen == (r.distance <= 8) for r in got)


@pytest.mark.parametrize("radius", [0, 2, 3])
def test_nearest_by_parts_equals_all_pairs(spark, noisy_hashes, monkeypatch, radius):
    """Near queries settle early, far ones go to the blocks of the bank; copies and NULL keep their rows."""
    monkeypatch.setattr(pairs, "PART_RADIUS", radius)
    rng = np.random.default_rng(7)
    bank = [[int(x), None, int(~x)] for x in noisy_hashes[1::3]] + [None, []]
    known = np.array([v for row in bank if row for v in row if v is not None], np.int64).view(np.uint64)
    asked = [int(x) for x in np.concatenate([noisy_hashes[::11], noisy_hashes[1:30:3], rng.integers(-(2**62), 2**62, 6)])] + [None, 0, 0]
    queries = spark.createDataFrame([(i, h) for i, h in enumerate(asked)], "i long, h long")
    df = spark.createDataFrame([(b,) for b in bank], "v array<long>")
    got = {r.i: (r.distance, r.seen) for r in pairs.nearest_variants(queries, "i", "h", df, "v", 8, bank_rows=0).collect()}
    want = [None if h is None else int(np.bitwise_count(np.int64(h).view(np.uint64) ^ known).min()) for h in asked]
    assert got == {i: (d, None if d is None else d <= 8) for i, d in enumerate(want)}


def test_turned_signatures_are_not_computed_again_by_a_filter(spark, monkeypatch):
    """explode filters on its array; with the array's expression inlined the code outgrew the compiler."""
    banks = []
    monkeypatch.setattr(pairs, "nearest_distance", lambda q, key, s, bank, *rest: banks.append(bank))
    one = text_signatures(spark.createDataFrame([(1, "a b c")], "i long, t string"), "i", "t")
    s = F.col("signature")
    turned = F.array(s, *[F.shiftleft(s, 8 * k).bitwiseOR(F.shiftrightunsigned(s, 64 - 8 * k)) for k in range(1, 8)])
    pairs.nearest_variants(one, "i", "signature", one.select(F.when(F.col("i") > 0, turned).alias("v")), "v")
    plan = banks[0].where("_variant is not null").distinct()._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 5000 and banks[0].count() == 8


def vectors(spark, x, labels=None):
    rows = [(i, [float(f) for f in v], int(labels[i]) if labels is not None else 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "i long, v array<double>, label int").repartition(5)


def test_vector_literals(spark):
    got = vector_pairs.cosine_pairs(vectors(spark, [[1, 0], [0.99, 0.05], [0, 1]]), "i", "v", 0.95).collect()
    assert [(r.a, r.b) for r in got] == [(0, 1)]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    sizes = [150] + [12] * 11  # one hot cluster
    x = np.concatenate([c + 0.25 * rng.normal(size=(n, 16)) for c, n in zip(centres, sizes)])
    return x, rng.integers(0, 3, len(x))


@pytest.mark.parametrize("threshold,block", [(0.97, 4096), (0.9, 20), (0.2, 50)])
def test_cosine_pairs_equal_brute_force(spark, clustered, threshold, block):
    x, label = clustered
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    want = {(int(i), int(j)) for i, j in np.argwhere(sims >= threshold) if i < j}
    got = [(r.a, r.b) for r in vector_pairs.cosine_pairs(vectors(spark, x), "i", "v", threshold, pivots=10, block_rows=block).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    same = vector_pairs.cosine_pairs(vectors(spark, x, label), "i", "v", threshold, same="label", pivots=10, block_rows=block)
    assert {(r.a, r.b) for r in same.collect()} == {(i, j) for i, j in want if label[i] == label[j]}


def test_copies_of_vectors_collapse(spark):
    df = vectors(spark, [[1, 0]] * 40 + [[0, 1]])
    assert {(r.i, r.copies) for r in vector_pairs.collapse_copies(df, "i", "v").collect()} == {(0, 40), (40, 1)}


@pytest.mark.parametrize("threshold,block", [(0.95, 25), (0.5, 4096)])
def test_forest_links_keep_the_components(spark, clustered, threshold, block):
    x, label = clustered
    x = np.concatenate([x, np.repeat(x[:1], 60, axis=0)])  # a crowd of copies
    label = np.concatenate([label, np.repeat(label[:1], 60)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    edges = [(int(i), int(j)) for i, j in np.argwhere((u @ u.T >= threshold) & (label[:, None] == label[None, :])) if i < j]
    links = vector_pairs.component_links(vectors(spark, x, label), "i", "v", threshold, same="label", pivots=10, block_rows=block)
    links = [(r.a, r.b) for r in links.collect()]
    assert len(links) < len(edges) / 2
    assert roots(len(x), links) == roots(len(x), edges)
    whole = vector_pairs.similar_links(vectors(spark, x, label), "i", "v", threshold, same="label", pivots=10, block_rows=block)
    assert whole.agg(F.sum("pairs")).first()[0] == len(edges)


@pytest.mark.parametrize("k,block", [(1, 4096), (10, 30), (500, 30)])
def test_kth_neighbour_broadcast_and_cells_agree(spark, clustered, k, block):
    x, _ = clustered
    q, b = x[::3], x[1::3]
    asked, bank = vectors(spark, q), vectors(spark, b)
    u = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.sort(u(q) @ u(b).T, axis=1)[:, ::-1][:, min(k, len(b)) - 1]
    for size in (64 << 20, 0):
        got = vector_pairs.kth_cosine(asked, "i", "v", bank, "i", "v", k, bank_bytes=size, pivots=8, block_rows=block)
        rows = {r.i: r.kth for r in got.collect()}
        np.testing.assert_allclose([rows[i] for i in range(len(q))], want)


@pytest.mark.parametrize("key,vector", [("id", "v"), ("vec", "id"), ("cell", "vec")])
def test_kth_neighbour_takes_any_column_names(spark, clustered, key, vector):
    x, _ = clustered
    asked, bank = vectors(spark, x[::3]).toDF(key, vector, "label"), vectors(spark, x[1::3])
    sent, cells = (
        {r[key]: r.kth for r in vector_pairs.kth_cosine(asked, key, vector, bank, "i", "v", 5, bank_bytes=size).collect()}
        for size in (64 << 20, 0)
    )
    assert cells == pytest.approx(sent) and len(cells) == len(x[::3])


def test_nearest_of_a_bank_holds_a_slice_of_similarities():
    """Memory of one batch: a view of each slice's last column kept all 4,000 x 5,000 similarities (160 MB)."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(4000, 8)), rng.normal(size=(5000, 8))
    tracemalloc.start()
    best = vector_pairs._kth_largest(x, y, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    np.testing.assert_allclose(best[:, 0], np.sort(x @ y.T, axis=1)[:, -3])


def workers_mb(spark):
    """Most memory that any of the current Python workers has held, in MB."""

    def held(batches):
        list(batches)
        peaks = []
        for status in Path("/proc").glob("[0-9]*/status"):
            try:
                fields = dict(line.split(":", 1) for line in status.read_text().splitlines())
            except OSError:  # ended meanwhile
                continue
            if int(fields["PPid"]) == os.getppid() and "VmHWM" in fields:
                peaks.append(int(fields["VmHWM"].split()[0]) / 1024)
        yield pa.RecordBatch.from_pydict({"mb": [max(peaks)]})

    return spark.range(0, 8, 1, 1).mapInArrow(held, "mb double").first()["mb"]


@pytest.mark.parametrize("bank_bytes", [64 << 20, 0])
def test_memory_of_workers_does_not_follow_the_bank(spark, bank_bytes, monkeypatch):
    """A full batch against 2,000 and 20,000 rows that are sent: a worker held every similarity, 1.6 GB of the larger bank."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20_000, 8))
    bank = freeze(vectors(spark, x))
    asked = freeze(vectors(spark, x[:10_000]).coalesce(1))
    peaks = []
    for rows in (2_000, 20_000):
        monkeypatch.setitem(spark.sparkContext.environment, "TEST_WORKERS", f"{bank_bytes} {rows}")  # workers of their own
        near = vector_pairs.kth_cosine(asked, "i", "v", bank.where(F.col("i") < rows), "i", "v", 5, bank_bytes=bank_bytes)
        got = {r.i: r.kth for r in near.collect()}
        peaks.append(workers_mb(spark))
    assert peaks[1] - peaks[0] < 250
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 10_000
    for i in range(0, 10_000, 997):
        assert got[i] == pytest.approx(np.sort(unit @ unit[i])[-5])


def roots(n, edges):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for e in edges for i in e}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components_equal_union_find(spark, shape):
    rng = np.random.default_rng(6)
    edges = {
        "chain": [(i, i + 1) for i in range(120)],
        "star": [(60, i) for i in range(120) if i != 60],
        "random": [tuple(map(int, e)) for e in rng.integers(0, 300, (180, 2)) if e[0] != e[1]],
        "none": [],
    }[shape]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == roots(301, edges)
