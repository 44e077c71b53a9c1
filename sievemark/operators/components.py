"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sievemark.session import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """``edges`` must be stored: then the join below has a plain scan on each side."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
    return (
        both.where(F.col("v") > F.col("u"))
        .join(lowest, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = stored(down.groupBy("u").agg(F.min("v").alias("m")), "stars")
    moved = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Union-find over a counted number of stored edges (u, v)."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                low, high = sorted((root(u), root(v)))
                parent[high] = low
        nodes = list(parent)
        made = pa.array([root(x) for x in nodes], schema[1].type), pa.array(nodes, schema[0].type)
        yield pa.RecordBatch.from_arrays([made[1], made[0]], ["node", "component"])

    ddl = f"node {kind}, component {kind}"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    return edges.select("u", "v").coalesce(1).mapInArrow(run, ddl)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", in_task: int = 0) -> DataFrame:
    """``(node, component)`` for every node on an edge; the component is its smallest node.

    Each round replaces a node's neighbours by its smallest one through two equi-joins, so no
    neighbour list is ever collected; rounds grow with log²(nodes), not with the path length. The
    smallest neighbours are stored before they are joined, so the node of a giant component is split
    by AQE. Rounds go on until nothing changes; every round merges or shortens, so they end. A graph
    counted at no more than ``in_task`` edges is joined in one task instead, without rounds.
    """
    current = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    if in_task and current.limit(in_task + 1).count() <= in_task:
        return _in_one_task(current)
    state = None
    while True:
        seen = current.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()
        if seen == state or not seen[0]:
            break
        state = seen
        current = stored(_small_star(stored(_large_star(current), "edges")), "edges")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
