from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from fixtures_llm import AWKWARD, SCHEMA, documents
from pyspark.sql import functions as F

from sievemark.llm import simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", low)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, radius):
    """Smallest id of everything reachable, by comparing all pairs."""
    parent = list(range(len(pairs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, f) in enumerate(pairs):
        for j in range(i):
            if (f ^ pairs[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    out = []
    for i, _ in enumerate(pairs):
        ids = [pairs[j][0] for j in range(len(pairs)) if root(j) == root(i) and pairs[j][0] is not None]
        out.append(min(ids, default=None))
    return out


def test_fingerprint_is_the_plain_one():
    for _, text, *_ in AWKWARD:
        if text is None or len(text) < 10_000:
            assert simhash.fingerprint(text.encode() if text is not None else None) % 2**64 == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [2, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(3000):
        flips = sum(1 << i for i in rng.sample(range(64), rng.randint(1, radius)))
        assert any(not flips & m for m in masks)


@pytest.mark.parametrize("crowd", [simhash.CROWD, 2])
@pytest.mark.parametrize("radius", [2, 4])
def test_components_equal_all_pairs(spark, radius, crowd):
    if radius == 4 and crowd == 2:
        pytest.skip("half a million points; the meeting points are tested with radius 2")
    rng = random.Random(5)
    prints, centre = [], rng.getrandbits(64)
    for i in range(160):
        if i % 20 == 0:
            centre = rng.getrandbits(64)
        near = rng.choice(prints or [centre]) if rng.random() < 0.5 else centre
        prints.append(near ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    pairs = [(i, f) for i, f in enumerate(prints)] + [(500, prints[0]), (None, prints[3]), (None, 77)]
    df = spark.createDataFrame([(i, simhash.signed(f)) for i, f in pairs], "doc_id long, _fp long")
    got = {r.fp % 2**64: r.component_id for r in simhash.components(df, radius=radius, crowd=crowd).collect()}
    want = plain_components(pairs, radius)
    assert got == {f: c for (_, f), c in zip(pairs, want, strict=True)}


def test_awkward_documents(spark):
    out = simhash.near_copies(documents(spark, extra=["fingerprint", "_fp"]))
    rows = out.collect()
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and len(rows) == len(AWKWARD)
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16
    assert {by[i].component_id for i in (1, 2, 3)} == {1}
    assert by[None].component_id is None
    assert simhash.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark)
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in simhash.first_of_groups(docs).collect())
    groups = {r.component_id for r in simhash.near_copies(docs).collect()}
    assert ids == sorted(-1 if g is None else g for g in groups)


def test_hot_group_of_copies_and_near_copies(spark):
    base = "some words of a long text with many different parts " * 3 + " ".join(f"w{i}" for i in range(200))
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 1000, F.lit(base)).when(F.col("id") < 2000, F.concat(F.lit(base + " end"), F.col("id").cast("string")))
        .otherwise(F.concat_ws(" ", *[F.md5((F.col("id") * 7 + i).cast("string")) for i in range(6)])).alias("text"),
    )
    rows = simhash.near_copies(docs).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    distinct = sorted({(min(i for i, g in prints.items() if g == f), f) for f in set(prints.values())})
    want = dict(zip([f for _, f in distinct], plain_components(distinct, 2), strict=True))
    assert all(r.component_id == want[prints[r.doc_id]] for r in rows)


def test_forest_spans_what_links_connect():
    rng = np.random.default_rng(1)
    nodes = np.unique(rng.integers(0, 2**12, 300).astype(np.uint64))
    a, b = simhash.forest(nodes, 2)
    want = plain_components([(i, int(f)) for i, f in enumerate(nodes)], 2)
    assert len(a) == len(nodes) - len(set(want))
    assert all((int(x) ^ int(y)).bit_count() <= 2 for x, y in zip(a, b, strict=True))
