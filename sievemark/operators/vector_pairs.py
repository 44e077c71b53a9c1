"""Exact cosine joins: similar pairs and k-th nearest neighbours, pruned by pivots.

Angles between unit vectors are a metric, so the triangle inequality bounds how far a match can
be from a pivot. Every vector lives in the cell of its nearest pivot; a vector visits another
cell only if that bound allows a match there. Crowded cells are cut into blocks on both sides,
and a task compares one block with one block in numpy and emits matches only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions.arrays import from_matrix, spread_out, to_matrix
from sievemark.functions.hashing import hash_order
from sievemark.session import freeze

BLOCK_ROWS = 4096
BANK_BYTES = 64 << 20
SEARCH_ROWS = 32_768  # rows of a block where only the k nearest are wanted: larger blocks move fewer copies of a vector
CELLS = 1 << 21  # numbers of a matrix of similarities or angles that a task holds at a time (16 MB)
_SLACK = 1e-7  # arccos near 1 is off by about 2e-8


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _slices(rows: int, width: int) -> Iterator[slice]:
    """Slices of rows whose matrix of ``width`` columns stays within CELLS numbers."""
    step = max(1, CELLS // max(1, width))
    return (slice(s, min(s + step, rows)) for s in range(0, rows, step))


def _kth_largest(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The k largest products of each row of x with the rows of y, as a matrix with the k-th first."""
    best = np.empty((len(x), k))
    for s in _slices(len(x), len(y)):
        sims = x[s] @ y.T
        sims.partition(len(y) - k, axis=1)
        best[s] = sims[:, len(y) - k :]  # a copy; a view would hold the whole matrix
    return best


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit_rows(x) @ pivots.T, -1.0, 1.0))


def _pivots(vectors: DataFrame, key: str, vector: str, count: int) -> np.ndarray:
    """A hash-ordered choice of ``count`` vectors: a fixed number of rows on the driver."""
    rows = vectors.orderBy(hash_order("pivot", key), key).limit(count).select(vector).collect()
    return _unit_rows(np.array([r[0] for r in rows], dtype=np.float64))


def _pivot_count(rows: int) -> int:
    """Cells of about a quarter block; of large tables no more than four times the root of the rows, so the pivots fit the driver."""
    return max(8, min(math.isqrt(16 * rows), rows * 4 // BLOCK_ROWS))


def _with_home(vectors: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    @F.arrow_udf("struct<cell:int,radius:double>")
    def home(v: pa.Array) -> pa.Array:
        x, present = to_matrix(v)
        if not len(x):
            return pa.nulls(len(v), pa.struct([("cell", pa.int32()), ("radius", pa.float64())]))
        cell, radius = np.empty(len(x), np.int32), np.empty(len(x))
        for s in _slices(len(x), len(pivots)):
            a = _angles(x[s], pivots)
            cell[s] = a.argmin(axis=1)
            radius[s] = a.min(axis=1)
        homes = pa.StructArray.from_arrays([pa.array(cell), pa.array(radius)], ["cell", "radius"])
        return spread_out(homes, present)

    return vectors.withColumn("_home", home(vector)).select("*", "_home.cell", "_home.radius").drop("_home")


def _visits(vectors: DataFrame, vector: str, rule, cells: int) -> DataFrame:
    """One row per cell a vector has to visit; ``rule(x)`` gives a boolean row over ``cells`` cells."""

    @F.arrow_udf("array<int>")
    def visited(v: pa.Array) -> pa.Array:
        x, present = to_matrix(v)
        if not len(x):
            return pa.nulls(len(v), pa.list_(pa.int32()))
        flat, counts = [], []
        for s in _slices(len(x), cells):
            wanted = rule(x[s])
            flat.append(np.nonzero(wanted)[1].astype(np.int32))
            counts.append(wanted.sum(axis=1))
        offsets = np.concatenate([[0], np.concatenate(counts).cumsum()]).astype(np.int32)
        return spread_out(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat))), present)

    return vectors.withColumn("cell", F.explode(visited(vector)))


def _blocked(home: DataFrame, visit: DataFrame, cells: int, block_rows: int) -> DataFrame:
    """Both sides tagged with (cell, home block, visit block), so every group stays bounded."""
    sizes = {r["cell"]: r["n"] for r in home.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    guests = {r["cell"]: r["n"] for r in visit.groupBy("cell").agg(F.count("*").alias("n")).collect()}

    def blocks(counts: dict[int, int]) -> Column:
        per_cell = [max(1, -(-counts.get(c, 0) // block_rows)) for c in range(cells)]
        return F.get(F.array(*[F.lit(v) for v in per_cell]), F.col("cell"))

    nh, nv = blocks(sizes), blocks(guests)
    h = home.withColumn("hb", F.pmod(F.xxhash64("id"), nh).cast("int")).withColumn(
        "vb", F.explode(F.sequence(F.lit(0), nv - 1))
    )
    v = visit.withColumn("vb", F.pmod(F.xxhash64("id"), nv).cast("int")).withColumn(
        "hb", F.explode(F.sequence(F.lit(0), nh - 1))
    )
    cols = ["cell", "hb", "vb", "id", "vec"]
    extra = [c for c in home.columns if c not in ("cell", "id", "vec", "radius")]
    return h.select(*cols, *extra, F.lit(True).alias("resident")).unionByName(
        v.select(*cols, *extra, F.lit(False).alias("resident"))
    )


def cosine_pairs(
    vectors: DataFrame,
    key: str,
    vector: str,
    threshold: float,
    same: str | None = None,
    pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
    forest: bool = False,
) -> DataFrame:
    """``(a, b, cosine)`` for a < b with cosine ≥ ``threshold``; exact.

    With ``same`` given, only pairs that agree on that column are returned. Expects distinct vectors:
    see :func:`similar_links`, which collapses copies first. ``forest`` keeps, per pair of blocks,
    just enough pairs to connect what is connected there, so a crowd of near copies gives one link
    per row instead of all its pairs; components over these links are the same.
    """
    base = freeze(
        vectors.select(
            F.col(key).alias("id"), F.col(vector).alias("vec"), *([F.col(same).alias("tag")] if same else [])
        ).where(F.col(vector).isNotNull())
    )
    centres = _pivots(base, "id", "vec", pivots or _pivot_count(base.count()))
    if not len(centres):
        return base.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("cosine")).limit(0)
    homes = freeze(_with_home(base, "vec", centres))
    reach = {r["cell"]: r["r"] for r in homes.groupBy("cell").agg(F.max("radius").alias("r")).collect()}
    radius = np.array([reach.get(c, -np.inf) for c in range(len(centres))])
    turn = float(np.arccos(np.clip(threshold, -1.0, 1.0)))
    order = np.arange(len(centres))

    def rule(x: np.ndarray) -> np.ndarray:
        a = _angles(x, centres)
        cell = a.argmin(axis=1)
        own = a[np.arange(len(x)), cell]
        near = (a <= own[:, None] + 2 * turn + _SLACK) & (a <= radius[None, :] + turn + _SLACK)
        return (near & (order[None, :] < cell[:, None])) | (order[None, :] == cell[:, None])

    visits = _visits(homes.withColumnRenamed("cell", "_own").drop("radius"), "vec", rule, len(centres))
    visits = visits.withColumn("native", F.col("cell") == F.col("_own")).drop("_own")
    work = _blocked(homes.withColumn("native", F.lit(True)), visits, len(centres), block_rows)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        left = group[group["resident"]]
        right = group[~group["resident"]]
        if left.empty or right.empty:
            return pd.DataFrame({"a": left["id"][:0], "b": left["id"][:0], "cosine": np.array([])})
        x = _unit_rows(np.stack(left["vec"].to_numpy()).astype(np.float64))
        y = _unit_rows(np.stack(right["vec"].to_numpy()).astype(np.float64))
        li, ri = left["id"].to_numpy(), right["id"].to_numpy()
        native = right["native"].to_numpy()
        found = []
        for s in range(0, len(x), 512):
            sims = x[s : s + 512] @ y.T
            hit = sims >= threshold
            # a visitor from another cell meets residents once; natives of one cell meet both ways
            hit &= ~native[None, :] | (li[s : s + 512, None] < ri[None, :])
            if same:
                hit &= left["tag"].to_numpy()[s : s + 512, None] == right["tag"].to_numpy()[None, :]
            i, j = np.nonzero(hit)
            chunk = pd.DataFrame({"p": li[s + i], "q": ri[j], "cosine": sims[i, j]})
            found.append(chunk)
            if forest:
                found = [_spanning(pd.concat(found))]
        out = pd.concat(found)
        swap = out["p"] > out["q"]
        return pd.DataFrame(
            {"a": out["p"].where(~swap, out["q"]), "b": out["q"].where(~swap, out["p"]), "cosine": out["cosine"]}
        )

    kind = dict(base.dtypes)["id"]
    return work.groupBy("cell", "hb", "vb").applyInPandas(compare, f"a {kind}, b {kind}, cosine double")


def _spanning(edges: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of one block's edges (hook each root to the smallest root it touches)."""
    if len(edges) < 2:
        return edges
    nodes, flat = np.unique(np.concatenate([edges["p"].to_numpy(), edges["q"].to_numpy()]), return_inverse=True)
    u, v = flat[: len(edges)], flat[len(edges) :]
    root = np.arange(len(nodes))
    kept = np.zeros(len(edges), dtype=bool)
    while True:
        ru, rv = root[u], root[v]
        open_edges = np.nonzero(ru != rv)[0]
        if not len(open_edges):
            return edges[kept]
        high, low = np.maximum(ru, rv)[open_edges], np.minimum(ru, rv)[open_edges]
        order = np.lexsort((low, high))
        first = order[np.unique(high[order], return_index=True)[1]]  # one edge per root that moves
        kept[open_edges[first]] = True
        root[high[first]] = low[first]
        while True:  # every node points at its root again
            nxt = root[root]
            if (nxt == root).all():
                break
            root = nxt


def similar_links(
    vectors: DataFrame, key: str, vector: str, threshold: float, same: str | None = None, **options: int
) -> DataFrame:
    """Similar pairs without writing out pairs of copies: ``(a, b, cosine, pairs)``.

    One row per pair of similar distinct vectors, named by their first records, and one row (a = b,
    cosine 1) per vector with copies; ``pairs`` is the number of record pairs a row stands for.
    """
    by = [same] if same else []
    single = freeze(collapse_copies(vectors.where(F.col(vector).isNotNull()), key, vector, by))
    near = cosine_pairs(single, key, vector, threshold, same=same, **options)
    size = single.select(F.col(key).alias("k"), "copies")
    sa, sb = size.alias("sa"), size.alias("sb")
    across = (
        near.join(sa, F.col("a") == F.col("sa.k"))
        .join(sb, F.col("b") == F.col("sb.k"))
        .select("a", "b", "cosine", (F.col("sa.copies") * F.col("sb.copies")).alias("pairs"))
    )
    inside = single.where("copies > 1").select(
        F.col(key).alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("cosine"), F.expr("copies * (copies - 1) div 2").alias("pairs")
    )
    return across.unionByName(inside)


def component_links(
    vectors: DataFrame, key: str, vector: str, threshold: float, same: str | None = None, **options: int
) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all similar pairs; at most a few per record.

    Copies hang on their first record; distinct vectors give a spanning forest per pair of blocks.
    """
    by = [same] if same else []
    known = vectors.where(F.col(vector).isNotNull())
    single = freeze(collapse_copies(known, key, vector, by))
    near = cosine_pairs(single, key, vector, threshold, same=same, forest=True, **options)
    repeated = single.where("copies > 1").select(*by, vector, F.col(key).alias("a"))
    copies = known.join(repeated, [*by, vector]).select("a", F.col(key).alias("b")).where("a <> b")
    return near.select("a", "b").unionByName(copies)


def collapse_copies(vectors: DataFrame, key: str, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct vector (and ``by``): its first key and the number of copies."""
    return vectors.groupBy(*by, vector).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def kth_cosine(
    queries: DataFrame,
    key: str,
    vector: str,
    bank: DataFrame,
    bank_key: str,
    bank_vector: str,
    k: int = 10,
    bank_bytes: int = BANK_BYTES,
    pivots: int | None = None,
    block_rows: int = SEARCH_ROWS,
) -> DataFrame:
    """``(key, kth)``: cosine to the k-th nearest bank vector, k at most the size of the bank.

    A bank whose counted size fits ``bank_bytes`` goes to every task (one matrix product per batch);
    a larger one is searched cell by cell with an exact bound on the k-th distance. Where the bound prunes nothing every
    query meets every cell, so cells are large and a vector is copied once per cell; a task holds two blocks and a
    slice of their similarities, whatever the sizes. Every query row gets
    its own answer, whether its key is repeated or not; a NULL vector has none.
    """
    base = freeze(bank.select(F.col(bank_key).cast("string").alias("id"), F.col(bank_vector).alias("vec")).where("vec is not null"))
    size = base.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    n, width = int(size["n"]), int(size["d"] or 0)
    k = min(k, n)
    if k == 0:
        return queries.select(key, F.lit(None).cast("double").alias("kth"))
    if n * width * 8 <= bank_bytes:
        known = _unit_rows(to_matrix(base.select("vec").toArrow().column("vec"))[0])

        @F.arrow_udf("double")
        def nearest(v: pa.Array) -> pa.Array:
            x, present = to_matrix(v)
            if not len(x):
                return pa.nulls(len(v), pa.float64())
            return spread_out(pa.array(_kth_largest(_unit_rows(x), known, k)[:, 0]), present)

        return queries.select(key, nearest(vector).alias("kth"))

    centres = _pivots(base, "id", "vec", pivots or max(8, min(math.isqrt(16 * n), 2 * n // SEARCH_ROWS)))
    homes = freeze(_with_home(base, "vec", centres))
    stats = {
        r["cell"]: (r["n"], r["r"])
        for r in homes.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("r")).collect()
    }
    counts = np.array([stats.get(c, (0, 0.0))[0] for c in range(len(centres))])
    radius = np.array([stats.get(c, (0, 0.0))[1] for c in range(len(centres))])

    def rule(x: np.ndarray) -> np.ndarray:
        a = _angles(x, centres)
        far = np.where(counts[None, :] > 0, a + radius[None, :], np.inf)
        by_far = np.argsort(far, axis=1)
        enough = (counts[by_far].cumsum(axis=1) >= k).argmax(axis=1)
        bound = np.take_along_axis(far, by_far, axis=1)[np.arange(len(x)), enough]
        return (counts[None, :] > 0) & (a - radius[None, :] <= bound[:, None] + _SLACK)

    # the caller's key may have any name, also one that is used here
    number = F.monotonically_increasing_id().cast("string")
    rows = freeze(queries.select(F.col(key).alias("_key"), F.col(vector).alias("vec"), number.alias("id")))
    visits = _visits(rows.where("vec is not null").select("id", "vec"), "vec", rule, len(centres))
    work = _blocked(homes, visits, len(centres), block_rows)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        known = group[group["resident"]]
        seek = group[~group["resident"]]
        if known.empty or seek.empty:
            return pd.DataFrame({"id": seek["id"][:0], "best": pd.Series([], dtype=object)})
        x = _unit_rows(np.stack(seek["vec"].to_numpy()).astype(np.float64))
        y = _unit_rows(np.stack(known["vec"].to_numpy()).astype(np.float64))
        keep = min(k, len(y))
        return pd.DataFrame({"id": seek["id"].to_numpy(), "best": list(_kth_largest(x, y, keep))})

    parts = work.groupBy("cell", "hb", "vb").applyInPandas(search, "id string, best array<double>")
    # the k best of each query are picked before and after the shuffle; no list grows with the blocks
    nearest = Window.partitionBy("id").orderBy(F.desc("s"))
    best = parts.select("id", F.explode("best").alias("s")).withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= k)
    merged = best.groupBy("id").agg(F.min("s").alias("kth"))
    return rows.select("_key", "id").join(merged, "id", "left").select(F.col("_key").alias(key), "kth")
