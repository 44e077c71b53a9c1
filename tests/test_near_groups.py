from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.operators import components, groups, near_groups
from sievemark.session import stored

SCHEMA = "signature long, label string, node string, n long"


def signatures(rng, templates, copies, bits):
    """Templates and copies of them with up to ``bits`` flipped bits."""
    out = []
    for _ in range(templates):
        base = int(rng.integers(0, 2**63))
        for _ in range(int(rng.integers(1, copies + 1))):
            flips = rng.choice(64, int(rng.integers(0, bits + 1)), replace=False)
            out.append(base ^ sum(1 << int(f) for f in flips))
    return [s - (1 << 64) if s >> 63 else s for s in out]


def plain(nodes, reach):
    """(components of nodes that have links, mixed nodes, record pairs, of one label), from all pairs."""
    parent = {x[2]: x[2] for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    mixed, total, same, linked = set(), 0, 0, set()
    for i, (s, lab, node, n) in enumerate(nodes):
        for t, other, name, m in nodes[:i]:
            if ((s ^ t) & (2**64 - 1)).bit_count() > reach:
                continue
            total += n * m
            if lab is not None and lab == other:
                same += n * m
                linked |= {node, name}
                low, high = sorted((root(node), root(name)))
                parent[high] = low
            elif lab is not None and other is not None:
                mixed |= {node, name}
    return {x: root(x) for x in linked}, mixed, total, same


@pytest.mark.parametrize(("reach", "crowd", "block"), [(5, 4096, 2048), (3, 8, 4), (0, 4096, 2048), (8, 2, 1)])
def test_facts_equal_all_pairs(spark, reach, crowd, block):
    rng = np.random.default_rng(reach)
    rows = {(s, [None, "x", "y", "z"][int(rng.choice(4, p=[0.1, 0.6, 0.2, 0.1]))]) for s in signatures(rng, 40, 9, 6)}
    nodes = [(s, lab, f"n{i:03}", int(rng.integers(1, 4))) for i, (s, lab) in enumerate(sorted(rows, key=str))]
    df = stored(spark.createDataFrame(nodes, SCHEMA).repartition(3))
    met = stored(near_groups.near_facts(df, reach, crowd=crowd, block=block))
    want = plain(nodes, reach)
    links = met.where(F.col("kind") == near_groups.LINK)
    for small in (0, 1000):
        assert {r.node: r.component for r in components.connected_components(links, in_task=small).collect()} == want[0]
    assert {r.a for r in met.where(F.col("kind") == near_groups.MIXED).collect()} == want[1]
    sums = met.where(F.col("kind") == near_groups.SUMS).agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("same"), F.lit(0))).first()
    assert tuple(sums) == want[2:]


def test_a_template_with_20_000_near_copies_leaves_few_links(spark):
    rng = np.random.default_rng(9)
    flips = np.array([rng.choice(64, 2, replace=False) for _ in range(60_000)])
    found = np.unique(np.uint64(0x123456789ABCDEF0) ^ (np.uint64(1) << flips[:, 0].astype(np.uint64)) ^ (np.uint64(1) << flips[:, 1].astype(np.uint64)))
    pool = np.unique(np.concatenate([found ^ np.uint64(1 << b) for b in range(0, 64, 3)]))[:20_000]
    nodes = [(int(s), "x", i, 1) for i, s in enumerate(pool.view(np.int64))]
    df = stored(spark.createDataFrame(nodes, "signature long, label string, node long, n long").repartition(8))
    met = stored(near_groups.near_facts(df, 6))
    pairs = met.where(F.col("kind") == near_groups.SUMS).agg(F.sum("pairs")).first()[0]
    links = met.where(F.col("kind") == near_groups.LINK)
    assert pairs > 100_000_000 and links.count() < 20 * len(pool)
    assert components.connected_components(links).select("component").distinct().count() == 1


def test_empty_and_lonely_nodes(spark):
    assert near_groups.near_facts(spark.createDataFrame([], SCHEMA), 5).count() == 0
    lone = spark.createDataFrame([(1, "x", "a", 5), (-1, None, "b", 2)], SCHEMA)
    assert near_groups.near_facts(lone, 5).count() == 0


def test_counts_alone_need_no_components(spark, monkeypatch):
    """The counts of a grouping, label conflicts and copies included, without one round of components."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**40, 12)
    rows = [(f"p{i:03}", f"d{i % 70}", "ab"[int(rng.integers(2))], int(base[i % 12] ^ (1 << int(rng.integers(3))))) for i in range(90)]
    df = spark.createDataFrame(rows, "path string, sha256 string, label string, signature long").withColumn("status", F.lit("ok"))
    want = groups.assign_groups(df, max_distance=3)[1].first()

    def never(*_, **__):
        raise AssertionError("components for counts")

    monkeypatch.setattr(groups, "connected_components", never)
    assert groups.near_counts(df, max_distance=3).first() == want and want.near_pairs > 0


def test_variants_are_used_only_if_every_ok_row_has_them(spark):
    rows = [("a", "s1", "x", 0b1111, [0b1111, 0xFF00]), ("b", "s2", "x", 0xFF00, [0xFF00, -1]), ("c", "s3", "y", -1, [-1, 1 << 40])]
    schema = "path string, sha256 string, label string, signature long, variants array<long>"

    def grouped(data):
        df = spark.createDataFrame(data, schema).withColumn("status", F.lit("ok"))
        out, counts = groups.assign_groups(df, max_distance=0, variant_list="variants")
        return {r.path: (r.status, r.group_id) for r in out.collect()}, tuple(counts.first())

    assert grouped(rows) == ({"a": ("ok", 0), "b": ("conflict", None), "c": ("conflict", None)}, (2, 1))
    lacking = [*rows[:2], (*rows[2][:4], None)]
    assert grouped(lacking) == ({"a": ("ok", 0), "b": ("ok", 1), "c": ("ok", 2)}, (0, 0))
