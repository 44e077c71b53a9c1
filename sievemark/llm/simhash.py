"""Operator 8: near copies by SimHash fingerprints and covering locality-sensitive hashing (Pagh 2016).

A fingerprint has 64 bits. For a radius r each bit position gets a nonzero vector of r + 1 bits; the
mask of a nonzero vector v keeps the positions whose vector has an odd product with v. Up to r
differing positions give at most r linear conditions on v in r + 1 dimensions, so some mask hides them
all: every pair within the radius has an equal masked fingerprint in at least one of the 2^(r+1) - 1
tables. No pair is lost and no pair is compared that shares no table.

Equal fingerprints are one node. Buckets with one node are dropped by a count (partial sums, so a hot
bucket is not gathered). A bucket of up to ``crowd`` nodes is searched in one task, from node to node
over those not reached yet, which gives a spanning forest of its links instead of all pairs. Larger
buckets are linked by meeting points: two nodes within an even radius r share a point within r/2 of
both, so nodes that share a point are linked through it and nothing is compared at all.

Cases: a null, empty or wordless text has the fingerprint zero and is linked like any other. A null id
never names a component unless all ids of the component are null. Equal rows share their component; an
empty table gives an empty table. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import texts, with_columns
from sievemark.operators.components import connected_components
from sievemark.session import stored

BITS = 64
SHINGLE = 3
SEED = 42
CROWD = 20_000  # nodes of a bucket that one task searches; more are linked by meeting points


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes."""
    words = text.lower().split() if text else []  # bytes.lower changes A-Z only
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return majority(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The signed fingerprint of 64-bit hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "_fp", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a signed 64-bit fingerprint of the whole text."""

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {name: pa.array([fingerprint(t) for t in texts(batch, text)], pa.int64())}

    return with_columns(docs, f"{name} long", compute, keep)


def covering_masks(radius: int) -> list[int]:
    """One mask for each nonzero vector of radius + 1 bits; positions take the nonzero vectors in turn."""
    vectors = 2 ** (radius + 1) - 1
    return [
        sum(1 << i for i in range(BITS) if (((i % vectors) + 1) & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def forest(nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what chains of links within the radius connect: one for each node reached."""
    left, a, b = nodes, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            found = left[near]
            if len(found):
                left = left[~near]
                queue += list(found)
                a.append(np.full(len(found), at))
                b.append(found)
    if not a:
        return nodes[:0], nodes[:0]
    return np.concatenate(a), np.concatenate(b)


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket may go on in the next batch, but is never above the crowd."""
        rest = np.zeros((0, 3), np.int64)

        def links(rows: np.ndarray) -> pa.RecordBatch | None:
            edge = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
            parts = [forest(g.view(np.uint64), radius) for g in np.split(rows[:, 2], edge) if len(g) > 1]
            if not parts:
                return None
            a, b = (np.concatenate([p[i] for p in parts]).view(np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "key", "fp")], axis=1)
            rows = np.concatenate([rest, new])
            if not len(rows):
                continue
            last = np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))
            cut = last[-1] + 1 if len(last) else 0
            rest = rows[cut:]
            if cut and (found := links(rows[:cut])) is not None:
                yield found
        if len(rest) and (found := links(rest)) is not None:
            yield found

    return run


def _through_points(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links of crowded buckets: each node with the smallest node at each point within radius / 2 of it.

    Pairs of the bucket differ only at positions that its mask hides, so points differ only there.
    """
    half = radius // 2
    hidden = [[i for i in range(BITS) if not m >> i & 1] for m in masks]
    flips = []
    for positions in hidden:
        balls = [[0]]
        for _ in range(half):
            balls.append(sorted({x ^ (1 << i) for x in balls[-1] for i in positions} | set(balls[-1])))
        flips.append([signed(x) for x in balls[-1]])
    table = rows.sparkSession.createDataFrame(
        [(i, f) for i, f in enumerate(flips)], "mask int, flips array<long>"
    )
    points = rows.join(F.broadcast(table), "mask").select("fp", "mask", F.explode("flips").alias("flip"))
    points = points.select("fp", "mask", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    lowest = stored(points.groupBy("mask", "point").agg(F.min("fp").alias("a")), "points")
    return points.join(lowest, ["mask", "point"]).where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def linked(nodes: DataFrame, radius: int, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that span the components of the distinct fingerprints ``fp`` under the radius."""
    if radius < 1 or radius % 2:
        raise ValueError("the radius must be even and positive")
    masks = covering_masks(radius)
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask", "bits"))
    keyed = keyed.select("mask", F.col("fp").bitwiseAND(F.col("bits")).alias("key"), "fp")
    sizes = stored(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    rows = stored(keyed.join(sizes, ["mask", "key"]), "bucketed")
    searched = (
        rows.where(F.col("n") <= crowd).select("mask", "key", "fp")
        .repartition("mask", "key").sortWithinPartitions("mask", "key")
        .mapInArrow(_search(radius), "a long, b long")
    )
    crowded = rows.where(F.col("n") > crowd)
    if crowded.isEmpty():
        return searched
    return searched.unionByName(_through_points(crowded, masks, radius))


def components(printed: DataFrame, doc_id: str = "doc_id", name: str = "_fp", radius: int = 2, crowd: int = CROWD) -> DataFrame:
    """``(fp, n, component_id)`` for each distinct fingerprint of a stored table with fingerprints."""
    nodes = stored(printed.groupBy(F.col(name).alias("fp")).agg(F.min(doc_id).alias("first"), F.count("*").alias("n")), "nodes")
    found = stored(connected_components(linked(nodes, radius, crowd)), "components")
    members = nodes.join(found, nodes.fp == found.node, "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component"))
    members = stored(members, "members")
    named = stored(members.groupBy("component").agg(F.min("first").alias("component_id")), "named")
    return members.join(named, "component").select("fp", "n", "component_id")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, crowd: int = CROWD) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: fingerprints within ``radius`` bits are linked."""
    printed = stored(with_fingerprints(docs.select(doc_id, text), text, keep=[doc_id]), "fingerprints")
    groups = stored(components(printed, doc_id, radius=radius, crowd=crowd), "groups")
    return printed.join(groups, printed._fp == groups.fp).select(
        doc_id, F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def first_of_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """``docs`` without all but one document of each group of near copies.

    The document with the smallest id stays; of repeated rows with that id one stays, and of rows
    without an id one stays where no document of the group has one.
    """
    printed = stored(with_fingerprints(docs.select(doc_id, text), text, keep=[doc_id]), "fingerprints")
    groups = stored(components(printed, doc_id, radius=radius), "groups")
    # the id that names a group names its survivor; ids without any are few and are told apart by fingerprint
    names = groups.select(F.col("component_id").alias("_keep")).where("_keep is not null").distinct()
    # a hash join whatever the size of the list: texts move once, without a sort, at every size alike
    kept = docs.join(names.hint("shuffle_hash"), docs[doc_id] == names["_keep"], "left_semi")
    again = stored(printed.groupBy(doc_id).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(doc_id).alias("_again")), "repeats")
    if not again.isEmpty():
        same = F.col(doc_id) == F.col("_again")
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([doc_id]))
    nameless = groups.where("component_id is null").select("fp")
    if nameless.isEmpty():
        return kept
    bare = with_fingerprints(docs.where(F.col(doc_id).isNull()), text, "_fp")
    one = bare.join(nameless, bare._fp == nameless.fp, "left_semi").dropDuplicates(["_fp"]).drop("_fp")
    return kept.unionByName(one)
