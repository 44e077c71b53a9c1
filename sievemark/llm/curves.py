"""Operator 5: nearest neighbours by shifted Hilbert curves.

Largest inner product becomes smallest distance with one more coordinate, sqrt(M² - |x|²) for a row and 0
for a query, where M is the largest norm. Each curve projects these vectors on a few random directions,
shifts the grid by a random offset and orders all rows by their place on the Hilbert curve. Spark sorts by
(curve, key) in ranges, the positions of each curve are cut into blocks of equal size, and a query is compared
with three blocks of each curve, its own in the middle where there is one on either side: no block grows with
the data, whatever the keys, and a table of up to three blocks is compared whole. Candidates of all curves are
merged and ranked by the exact inner product.

Equal vectors are one class (with its k + 1 smallest ids, more are never needed), so a vector that a third
of the rows share neither fills blocks nor hides others, and its queries are answered once.

Curves are added until the recall of a bounded sample of queries, measured against all rows, reaches the
target. How many are needed grows with the number of rows and their dimension. Where MOST curves are not
enough, the queries are compared with all rows instead, block by block, so a search always ends.

Cases: vectors that are null, zero or hold a null, NaN or infinite component take no part, nor do rows
without an id or with another number of components than most. A repeated (id, vector) counts once; rows
with the id of a query are its own. Ties go to the smaller id. Entries so large that an inner product
overflows keep their order, by the products of the rows scaled down; their score is what doubles give. An empty table gives an empty table. Columns
besides id and vector are not returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.operators.ordered import with_position
from sievemark.session import broadcast_if_small, stored

K = 20
EVERY = 20  # ids divisible by it are queries
DIRECTIONS = 4
BITS = 8  # a direction has 2^BITS cells
BLOCK = 2048
CURVES, MORE_CURVES, MOST = 8, 4, 32
TARGET = 0.95
ASKED = 4096  # queries of a block that is compared with all rows
MEASURED = 256  # queries of which the recall is measured
FITTED = 10_000  # rows from which the spread of the projections is taken
SEED = 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows of ``cells``), after Skilling (2004)."""
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for i in range(len(axes)):
            turned = (axes[i] & top) != 0
            swap = np.where(turned, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(turned, low, swap)
            if i:
                axes[i] ^= swap
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    flip = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((axes[-1] >> level) & 1 != 0, (1 << level) - 1, 0)
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | ((axis ^ flip) >> level) & 1
    return key


def matrix(batch: pa.RecordBatch, name: str, size: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of paired rows; the order of summation depends on nothing but the length."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.ascontiguousarray(queries * rows).sum(axis=1)


def best(queries: np.ndarray, rows: np.ndarray, first: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, row numbers, exact scores) of its k best rows, ties to the smaller first id."""
    largest = np.abs(rows).max(initial=0.0)
    small = rows / largest if largest > 0 else rows
    for at in range(0, len(queries), 256):
        some = queries[at : at + 256]
        rough = (some / np.abs(some).max(axis=1, keepdims=True)) @ small.T
        for i, scores in enumerate(rough):
            near = np.arange(len(rows))
            if len(rows) > k:
                least = np.partition(scores, len(rows) - k)[len(rows) - k]
                near = np.flatnonzero(scores >= least - 1e-9 * (1 + abs(least)))  # rounding must not decide
            exact = exact_scores(some[i][None, :], rows[near])
            ranked = exact if np.isfinite(exact).all() else scores[near]
            order = np.lexsort((first[near], -ranked))[:k]
            yield at + i, near[order], exact[order]


class Curve:
    """One projection, shift and scale."""

    def __init__(self, number: int, size: int, sample: np.ndarray):
        rng = np.random.default_rng((SEED, number))
        axes = min(DIRECTIONS, size)
        self.directions = np.linalg.qr(rng.normal(size=(size, axes)))[0]
        seen = sample @ self.directions
        self.middle = seen.mean(axis=0)
        spread = seen.std(axis=0)
        self.spread = np.where(spread > 0, spread, 1.0)
        self.shift = rng.uniform(size=axes)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        z = (vectors @ self.directions - self.middle) / self.spread
        even = 1 / (1 + np.exp(-1.702 * np.clip(z, -30, 30)))  # nearly even for bell-shaped projections
        cells = ((even + self.shift) / 2 * (1 << (BITS + 1))).astype(np.int64)
        return hilbert_keys(np.minimum(cells, (1 << (BITS + 1)) - 1), BITS + 1)


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    v = F.col(embedding)
    rows = vectors.where(F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    )
    rows = rows.select(F.col(vec_id).alias("vec_id"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("v") == (sizes.size if sizes else 1)), int(sizes["size"]) if sizes else 1


def _is_query(c: str, every: int) -> Column:
    return F.pmod(F.col(c), F.lit(every)) == 0


def search(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = K,
    every: int = EVERY,
    target: float = TARGET,
    block: int = BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows found for each query."""
    rows, size = _usable(vectors, vec_id, embedding)
    rows = stored(rows, "vectors")
    classes = stored(
        rows.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("cls", F.monotonically_increasing_id()),
        "classes",
    )
    # members of a class: itself, or the rows that share its vector
    shared = stored(classes.where("n > 1").select(F.col("v").alias("_v"), "cls"), "shared")
    members = stored(rows.join(shared, rows.v == shared["_v"]).select("cls", "vec_id").distinct(), "members")
    alone = classes.where("n = 1").select("cls", F.col("first").alias("vec_id"))
    w = Window.partitionBy("cls").orderBy("vec_id")
    lowest = members.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).drop("_r")
    asked = stored(members.unionByName(alone).where(_is_query("vec_id", every)), "asked")
    seekers = stored(asked.select("cls").distinct(), "seekers")

    found = _found(classes, seekers, size, k + 1, target, block)
    listed = found.join(stored(lowest.unionByName(alone), "ids"), found.near == F.col("cls")).select("seeker", "score", "vec_id")
    nearest = Window.partitionBy("seeker").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= k + 1)
    lists = listed.groupBy("seeker").agg(F.sort_array(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("list"))
    answered = asked.select(F.col("vec_id").alias("query_id"), "cls").join(stored(lists, "lists"), F.col("cls") == F.col("seeker"))
    own = F.filter("list", lambda x: x.vec_id != F.col("query_id"))
    ranked = answered.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("pos", "x"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _found(classes: DataFrame, seekers: DataFrame, size: int, k: int, target: float, block: int) -> DataFrame:
    """``(seeker, near, score)`` of classes, the k best of what the curves bring together."""
    schema = "seeker long, near long, first long, score double"
    facts = classes.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x).cast("double")))), F.count("*")).first()
    if facts[0] is None:
        return classes.sparkSession.createDataFrame([], schema).select("seeker", "near", "score")
    scale, total = facts
    shrunk = classes.select(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") / scale, 2)).alias("s"))
    longest = shrunk.agg(F.max("s")).first()[0]
    hashed = classes.orderBy(F.xxhash64("cls"), "cls").limit(FITTED).select("v").toArrow()
    fit = hashed.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)

    def extended(rows: np.ndarray, query: bool) -> np.ndarray:
        rows = rows / scale
        more = np.zeros(len(rows)) if query else np.sqrt(np.maximum(0.0, longest - (rows * rows).sum(axis=1)))
        return np.column_stack([rows, more])

    sample = extended(fit, False)
    asking = stored(classes.join(seekers, "cls"), "asking")
    truth, sampled = _measured_truth(classes, asking, size, k)
    number, pool = 0, None
    few = total + asking.count() <= 3 * block  # then three blocks are the whole table
    while number < MOST:
        curves = [Curve(number + i, size + 1, sample) for i in range(1 if few else CURVES if pool is None else MORE_CURVES)]
        placed = _blocks(classes, asking, curves, number, size, extended, block)
        near = _compared(placed, classes, size, k)
        number += len(curves)
        both = near if pool is None else pool.unionByName(near)
        merged = both.groupBy("seeker", "near", "first").agg(F.max("score").alias("score"))
        w = Window.partitionBy("seeker").orderBy(F.desc("score"), "first")
        pool = stored(merged.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r"), "found")
        if few or _recall(pool, truth, sampled) >= target:
            return pool.select("seeker", "near", "score")
    return _all_rows(classes, asking, size, k)


def _all_rows(classes: DataFrame, asking: DataFrame, size: int, k: int) -> DataFrame:
    """Every query against every row, a bounded block of queries at a time."""
    parts = math.ceil(asking.count() / ASKED)
    dealt = F.pmod(F.xxhash64("cls"), F.lit(parts))
    found = None
    for p in range(parts):
        table = asking.where(dealt == p).select("cls", "v").toArrow()
        ids = table.column("cls").to_numpy()
        queries = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, queries=queries) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(ids):
                    cls, first = batch.column("cls").to_numpy(), batch.column("first").to_numpy()
                    for q, n, s in best(queries, matrix(batch, "v", size), first, k):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), ids[q])), pa.array(cls[n]), pa.array(first[n]), pa.array(s)], ["seeker", "near", "first", "score"])

        scored = classes.select("cls", "first", "v").mapInArrow(run, "seeker long, near long, first long, score double")
        w = Window.partitionBy("seeker").orderBy(F.desc("score"), "first")
        top = stored(scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("seeker", "near", "score"), "found")
        found = top if found is None else found.unionByName(top)
    return found


def _measured_truth(classes: DataFrame, asking: DataFrame, size: int, k: int) -> tuple[dict[int, float], dict[int, int]]:
    """For a bounded sample of queries: the score of the last of their k nearest of all rows, and how many there are."""
    table = asking.orderBy(F.xxhash64("cls", F.lit(1)), "cls").limit(MEASURED).select("cls", "v").toArrow()
    ids = table.column("cls").to_numpy()
    queries = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                first = batch.column("first").to_numpy()
                parts = [(ids[q], s) for q, _, s in best(queries, matrix(batch, "v", size), first, k)]
                seeker = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array(seeker), pa.array(np.concatenate([p[1] for p in parts]))], ["seeker", "score"])

    if not len(ids):
        return {}, {}
    scores = classes.select("first", "v").mapInArrow(run, "seeker long, score double")
    w = Window.partitionBy("seeker").orderBy(F.desc("score"))
    top = scores.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    last = top.groupBy("seeker").agg(F.min("score").alias("least"), F.count("*").alias("n")).collect()
    return {r.seeker: r.least for r in last}, {r.seeker: r.n for r in last}


def _recall(pool: DataFrame, least: dict[int, float], wanted: dict[int, int]) -> float:
    if not wanted:
        return 1.0
    got = pool.where(F.col("seeker").isin(list(wanted))).select("seeker", "score").collect()
    hits = sum(r.score >= least[r.seeker] for r in got)
    return hits / sum(wanted.values())


def _blocks(classes, asking, curves, number, size, extended, block) -> DataFrame:
    """``(curve, block, cls, query)``: a row in its block, a query in the three about it."""

    def keyed(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors = extended(matrix(batch, "v", size), query)
                for i, curve in enumerate(curves):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(vectors), number + i, np.int32)), pa.array(curve.keys(vectors)),
                            batch.column("cls"), pa.array(np.full(len(vectors), query)),
                        ],
                        ["curve", "key", "cls", "query"],
                    )

        return run

    schema = "curve int, key long, cls long, query boolean"
    keys = classes.select("cls", "v").mapInArrow(keyed(False), schema).unionByName(asking.select("cls", "v").mapInArrow(keyed(True), schema))
    placed = with_position(keys, ["key", "cls", "query"], by=["curve"], name="_p", total="_n")
    last = F.floor((F.col("_n") - 1) / block).cast("long")
    at = F.floor((F.col("_p") - 1) / block).cast("long")
    middle = F.greatest(F.lit(0), F.least(F.greatest(at, F.lit(1)), last - 1))
    spots = F.when(F.col("query"), F.sequence(F.greatest(middle - 1, F.lit(0)), F.least(middle + 1, last))).otherwise(F.array(at))
    return stored(placed.select("curve", "cls", "query", F.explode(spots).alias("block")), "blocks")


def _compared(placed: DataFrame, classes: DataFrame, size: int, k: int) -> DataFrame:
    """The k best rows of each query in each block."""

    def run(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy()
        cls, first = table.column("cls").to_numpy(), table.column("first").to_numpy()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        rows = np.flatnonzero(~query)
        seekers = cls[query]
        parts = [(seekers[q], rows[n], s) for q, n, s in best(v[query], v[rows], first[rows], k)] if len(rows) else []
        seeker = np.repeat(np.array([p[0] for p in parts], np.int64), [len(p[1]) for p in parts])
        near = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        score = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0)
        return pa.table({"seeker": seeker, "near": cls[near], "first": first[near], "score": score})

    filled = placed.join(classes.select("cls", "first", "v"), "cls")
    return filled.groupBy("curve", "block").applyInArrow(run, "seeker long, near long, first long, score double")
