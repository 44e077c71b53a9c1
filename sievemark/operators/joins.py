"""Joins by key between records, lookups, vectors and result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.session import stored


def attach(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join on a lookup reduced to one row per key, so no row is multiplied."""
    others = [c for c in lookup.columns if c != key]
    single = lookup.groupBy(key).agg(F.min(F.struct(*others)).alias("_l")).select(key, "_l.*")
    return rows.join(stored(single, "lookup"), key, "left")  # stored: AQE then splits a hot key of the rows


def missing_keys(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``rows`` without a lookup row; must be empty before an inner lookup."""
    return rows.select(key).distinct().join(lookup.select(key), key, "left_anti")


def lookup_all(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    lost = missing_keys(rows, lookup, key).limit(1).collect()
    if lost:
        raise KeyError(f"no lookup row for {key}={lost[0][0]}")
    return rows.join(lookup, key)


def new_keys(rows: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """One row per key that the store does not hold yet (copies are folded before the join)."""
    return rows.dropDuplicates([key]).join(store.select(key), key, "left_anti")


def aligned_vectors(rows: DataFrame, store: DataFrame, row_key: str, store_key: str, vector: str) -> DataFrame:
    """Every row with its stored vector; NULL where there is none."""
    return rows.join(
        store.select(F.col(store_key).alias(row_key), F.col(vector)), row_key, "left"
    ).withColumn("missing", F.col(vector).isNull())


def zero_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is absent or all zeros."""
    return rows.where(F.col(vector).isNull() | ~F.exists(vector, lambda x: x != 0))


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only or more than once on a side; empty means one to one."""
    sides = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        b.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return sides.groupBy(key).agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows")).where(
        "left_rows <> 1 or right_rows <> 1"
    )


def align(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One-to-one join of two prediction tables; raises when a key has no single partner."""
    lost = unmatched(a, b, key).limit(1).collect()
    if lost:
        raise ValueError(f"{key}={lost[0][key]} has {lost[0]['left_rows']} and {lost[0]['right_rows']} rows")
    return a.join(b, key)


def optional_join(base: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Left joins of optional result tables: a missing document leaves NULL columns."""
    return reduce(lambda left, part: left.join(part, key, "left"), parts, base)


def referenced(records: DataFrame, users: Sequence[DataFrame], key: str) -> DataFrame:
    """Records named by any of the user tables."""
    named = reduce(lambda x, y: x.unionByName(y), [u.select(key) for u in users])
    return records.join(named.distinct(), key, "left_semi")
