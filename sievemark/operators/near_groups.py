"""What grouping needs of near signatures without writing out their pairs.

Nodes are (signature, label) with a count. Nodes whose signatures agree on a band of bits meet in a bucket, a
crowded bucket is parted by a second band of the bits that are left, and one that stays crowded is dealt into
blocks; every pair of blocks is a piece of work of bounded size. A pair of nodes counts where it agrees first,
so nothing is counted twice. Out of a piece come

- links that connect what chains of near nodes of one label connect: a spanning forest, not the pairs;
- the nodes that have a near node with another label;
- two sums: record pairs, and record pairs of one label.

A task remembers what it has linked and marked already (up to MEMORY nodes, then it starts anew), so of the
pieces of one crowd that meet in a task only the first links each node. A crowd of n near copies of one
template therefore leaves a few links a node instead of n² / 2 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.operators import pairs
from sievemark.session import stored

BLOCK = 2048  # nodes of a block
ROWS = 256  # rows of a block that are compared at a time
MEMORY = 1_000_000  # nodes that a task remembers
KINDS = LINK, MIXED, SUMS = 0, 1, 2


def _masks(band: int, sub: int, max_distance: int) -> list[np.uint64]:
    """Masks under which a pair must differ to count in this band and sub-band (-1: none)."""
    bands = pairs.band_masks(range(64), max_distance + 1)
    earlier = bands[:band]
    if sub >= 0:
        rest = [b for b in range(64) if not bands[band] >> b & 1]
        earlier = earlier + pairs.band_masks(rest, max_distance + 1)[:sub]
    return [np.uint64(m) for m in earlier]


def near(a: np.ndarray, b: np.ndarray, masks: list[np.uint64], max_distance: int) -> np.ndarray:
    x = a[:, None] ^ b[None, :]
    close = np.bitwise_count(x) <= max_distance
    if close.any():
        for m in masks:
            close &= (x & m) != 0
    return close


def _forest(close: list[tuple[np.ndarray, np.ndarray]], size: int) -> list[tuple[int, int]]:
    """Links that span the components of the pairs given in ``close``."""
    root = np.arange(size)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found = []
    for x, y in close:
        # pairs that are joined already are dropped in bulk, so a crowd costs its nodes
        while len(x):
            rx, ry = root[x], root[y]
            while (root[rx] != rx).any() or (root[ry] != ry).any():
                rx, ry = root[rx], root[ry]
            apart = rx != ry
            x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
            if not len(x):
                break
            _, first = np.unique(np.maximum(rx, ry), return_index=True)
            for i in first.tolist():
                p, q = find(int(rx[i])), find(int(ry[i]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    found.append((int(x[i]), int(y[i])))
    return found


def _worked(signature: np.ndarray, label: np.ndarray, n: np.ndarray, own: np.ndarray, masks: list[np.uint64], max_distance: int, across: bool) -> tuple[list[tuple[int, int]], np.ndarray, int, int]:
    """``(links, mixed, record pairs, of one label)`` of the nodes of one piece; label -1 is no label."""
    size = len(signature)
    mixed, total, same, close = np.zeros(size, bool), 0, 0, []
    for at in range(0, size, ROWS):
        rows = slice(at, min(at + ROWS, size))
        hit = near(signature[rows], signature[at:], masks, max_distance)
        hit &= np.arange(at, size)[None, :] > np.arange(rows.start, rows.stop)[:, None]
        if across:
            hit &= own[rows][:, None] != own[at:][None, :]
        x, y = np.nonzero(hit)
        if not len(x):
            continue
        x, y = x + at, y + at
        both = n[x] * n[y]
        alike = (label[x] == label[y]) & (label[x] >= 0)
        other = (label[x] != label[y]) & (label[x] >= 0) & (label[y] >= 0)
        total += int(both.sum())
        same += int(both[alike].sum())
        mixed[x[other]] = True
        mixed[y[other]] = True
        close.append((x[alike], y[alike]))
    return _forest(close, size), np.flatnonzero(mixed), total, same


def near_facts(nodes: DataFrame, max_distance: int, node: str = "node", crowd: int = pairs.BUCKET_ROWS, block: int = BLOCK) -> DataFrame:
    """``(kind, a, b, pairs, same)`` of stored nodes ``(signature, label, node, n)``; the kinds are above."""
    keys = ["band", "bits", "sub", "sub_bits"]
    codes = stored(nodes.where("label is not null").groupBy("label").agg(F.min(F.xxhash64("label")).alias("code")), "labels")
    plain = nodes.select(F.col(node).alias("node"), "signature", "n", F.shiftrightunsigned(F.xxhash64("label"), 1).alias("code"), F.col("label").isNull().alias("_bare"))
    if codes.groupBy(F.shiftrightunsigned("code", 1)).count().where("count > 1").limit(1).count():
        raise ValueError("two labels share a hash")
    plain = plain.withColumn("code", F.when(F.col("_bare"), F.lit(-1).cast("long")).otherwise(F.col("code"))).drop("_bare")
    banded = pairs.with_bands(plain, "signature", max_distance)
    sizes = stored(banded.groupBy("band", "bits").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    right = sizes.select(F.col("band").alias("_band"), F.col("bits").alias("_bits"), "m")
    held = banded.join(right, (F.col("band") == F.col("_band")) & (F.col("bits") == F.col("_bits"))).drop("_band", "_bits")
    roomy = held.where(F.col("m") <= crowd).withColumns({"sub": F.lit(-1), "sub_bits": F.lit(0).cast("long"), "k": F.lit(1)})
    work = roomy.drop("m")
    if not sizes.where(F.col("m") > crowd).isEmpty():
        deep = stored(pairs.with_sub_bands(held.where(F.col("m") > crowd).drop("m"), "signature", max_distance), "crowded")
        counted = deep.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("k"), F.count("*").alias("m")).where("m > 1")
        counted = stored(counted.select(*[F.col(c).alias(f"_{c}") for c in keys], "k"), "sizes")
        cond = [F.col(c) == F.col(f"_{c}") for c in keys]
        dense = deep.join(counted, cond).drop(*[f"_{c}" for c in keys])
        work = work.unionByName(dense)
    work = work.withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = work.withColumn("other", F.explode(F.when((F.col("k") == 1), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("k") - 1))))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "k")
    order = [*keys, "i", "j"]
    # one hash of the key moves and sorts instead of six columns
    dealt = dealt.withColumn("_at", F.xxhash64(*order)).repartition("_at").sortWithinPartitions("_at", *order)
    kind = nodes.schema[node].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        parent: dict = {}
        marked: set = set()

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def pieces(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """The whole pieces of ``table``; what may go on in the next batch is held back."""
            key = np.column_stack([table.column(c).to_numpy().astype(np.int64) for c in order])
            cuts = np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1
            ends = np.append(cuts, len(key)) if last else cuts
            starts = np.append(0, cuts)[: len(ends)]
            if not last:
                held[:] = table.slice(int(cuts[-1]) if len(cuts) else 0).to_batches()
            names = table.column("node")
            values = names.to_pylist()
            signature = table.column("signature").to_numpy().view(np.uint64)
            label, n, own = (table.column(c).to_numpy() for c in ("code", "n", "own"))
            a, b, bad, total, same = [], [], [], 0, 0
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s < 2:
                    continue
                band, sub, i, j = (int(key[s, c]) for c in (0, 2, 4, 5))
                links, mixed, more, alike = _worked(signature[s:e], label[s:e], n[s:e], own[s:e], _cached(band, sub), max_distance, i != j)
                if len(parent) > MEMORY:
                    parent.clear()
                if len(marked) > MEMORY:
                    marked.clear()
                for x, y in links:
                    p, q = root(values[s + x]), root(values[s + y])
                    if p != q:
                        parent[q] = p
                        a.append(s + x)
                        b.append(s + y)
                for x in (s + mixed).tolist():
                    if values[x] not in marked:
                        marked.add(values[x])
                        bad.append(x)
                total += more
                same += alike
            rows = [*a, *bad]
            if rows or total:
                count = len(rows)
                first = names.take(pa.array(rows, pa.int64())).combine_chunks()
                second = names.take(pa.array(b, pa.int64())).combine_chunks()
                kinds = [LINK] * len(a) + [MIXED] * len(bad) + [SUMS]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(kinds, pa.int32()),
                        pa.concat_arrays([first, pa.nulls(1, first.type)]),
                        pa.concat_arrays([second, pa.nulls(len(bad) + 1, second.type)]),
                        pa.array([None] * count + [total], pa.int64()),
                        pa.array([None] * count + [same], pa.int64()),
                    ],
                    ["kind", "a", "b", "pairs", "same"],
                )

        made: dict[tuple[int, int], list[np.uint64]] = {}

        def _cached(band: int, sub: int) -> list[np.uint64]:
            if (band, sub) not in made:
                made[band, sub] = _masks(band, sub, max_distance)
            return made[band, sub]

        for batch in batches:
            if batch.num_rows:
                yield from pieces(pa.Table.from_batches([*held, batch]), False)
        if held:
            yield from pieces(pa.Table.from_batches(held), True)

    columns = dealt.select("_at", *order, "own", "node", "signature", "code", "n")
    return columns.mapInArrow(run, f"kind int, a {kind}, b {kind}, pairs long, same long")
