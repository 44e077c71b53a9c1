"""Exact Hamming joins on 64-bit signatures by shared bit bands."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.hashing import hamming
from sievemark.session import freeze, stored

BUCKET_ROWS = 4096
PART_BITS = 16  # of a signature that is looked up by its parts
PART_RADIUS = 2  # flipped bits of a part that are looked up


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def band_masks(bits: Sequence[int], bands: int) -> list[int]:
    """Masks of ``bands`` disjoint runs that cover the given bit positions."""
    size, extra = divmod(len(bits), bands)
    masks, start = [], 0
    for i in range(bands):
        width = size + (1 if i < extra else 0)
        masks.append(sum(1 << b for b in bits[start : start + width]))
        start += width
    return masks


def _first_agreeing(x: Column, masks: Sequence[int]) -> Column:
    """Index of the first mask under which the two signatures agree (x is their XOR)."""
    out = F.lit(None).cast("int")
    for i, mask in reversed(list(enumerate(masks))):
        out = F.when(x.bitwiseAND(F.lit(_signed(mask)).cast("long")) == 0, F.lit(i)).otherwise(out)
    return out


def with_bands(df: DataFrame, signature: str, max_distance: int) -> DataFrame:
    masks = band_masks(range(64), max_distance + 1)
    keys = F.array(
        *[
            F.struct(
                F.lit(i).alias("band"),
                F.col(signature).bitwiseAND(F.lit(_signed(m)).cast("long")).alias("bits"),
            )
            for i, m in enumerate(masks)
        ]
    )
    return df.select("*", F.inline(keys))


def with_sub_bands(df: DataFrame, signature: str, max_distance: int) -> DataFrame:
    """Second-level keys: the bits outside the shared band are banded again (pigeonhole twice)."""
    options = F.lit(None)
    for band, mask in enumerate(band_masks(range(64), max_distance + 1)):
        rest = [b for b in range(64) if not mask >> b & 1]
        keys = F.array(
            *[
                F.struct(
                    F.lit(i).alias("sub"),
                    F.col(signature).bitwiseAND(F.lit(_signed(m)).cast("long")).alias("sub_bits"),
                )
                for i, m in enumerate(band_masks(rest, max_distance + 1))
            ]
        )
        options = F.when(F.col("band") == band, keys).otherwise(options)
    return df.select("*", F.inline(options))


def _first_sub(x: Column, band: Column, max_distance: int) -> Column:
    out = F.lit(None).cast("int")
    for i, mask in enumerate(band_masks(range(64), max_distance + 1)):
        rest = [b for b in range(64) if not mask >> b & 1]
        out = F.when(band == i, _first_agreeing(x, band_masks(rest, max_distance + 1))).otherwise(out)
    return out


def _matches(
    left: DataFrame, right: DataFrame, keys: Sequence[str], max_distance: int, order: Column
) -> DataFrame:
    x = F.col("l.signature").bitwiseXOR(F.col("r.signature"))
    cond = reduce(lambda a, b: a & b, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys])
    cond = cond & order & (F.bit_count(x) <= max_distance)
    cond = cond & (_first_agreeing(x, band_masks(range(64), max_distance + 1)) == F.col("l.band"))
    if "sub" in keys:
        cond = cond & (_first_sub(x, F.col("l.band"), max_distance) == F.col("l.sub"))
    return left.alias("l").join(right.alias("r"), cond)


def _hamming_join(left: DataFrame, right: DataFrame, max_distance: int, order: Column, bucket_rows: int) -> DataFrame:
    """Rows of two frozen inputs (column ``signature``) within ``max_distance``, each pair once.

    Signatures that differ in at most d bits agree on one of d + 1 bands: an equi-join on the band.
    A pair is kept only under its first common band, so no ``distinct`` follows. Crowded bands are
    banded a second time on their remaining bits, and a key that stays crowded is cut into blocks.
    """
    keys = ["band", "bits"]
    lb = with_bands(left, "signature", max_distance)
    rb = with_bands(right, "signature", max_distance)
    sizes = rb.groupBy(*keys).agg(F.count("*").alias("members"))
    crowded = sizes.where(F.col("members") > bucket_rows)
    if crowded.isEmpty():
        return _matches(lb, rb, keys, max_distance, order)
    crowded = freeze(crowded.select(*keys))
    roomy = _matches(
        lb.join(crowded, keys, "left_anti"), rb.join(crowded, keys, "left_anti"), keys, max_distance, order
    )
    deep = [*keys, "sub", "sub_bits"]
    ls = with_sub_bands(lb.join(crowded, keys, "left_semi"), "signature", max_distance)
    rs = with_sub_bands(rb.join(crowded, keys, "left_semi"), "signature", max_distance)
    blocks = rs.groupBy(*deep).agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias("blocks"))
    rs = rs.join(blocks, deep).withColumn("block", F.pmod(F.xxhash64("signature"), F.col("blocks")).cast("int"))
    ls = ls.join(blocks, deep).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dense = _matches(ls.drop("blocks"), rs.drop("blocks"), [*deep, "block"], max_distance, order)
    pick = [F.col(f"l.{c}").alias(f"l_{c}") for c in left.columns]
    pick += [F.col(f"r.{c}").alias(f"r_{c}") for c in right.columns]
    both = roomy.select(*pick).unionByName(dense.select(*pick))
    return both.select(
        F.struct(*[F.col(f"l_{c}").alias(c) for c in left.columns]).alias("l"),
        F.struct(*[F.col(f"r_{c}").alias(c) for c in right.columns]).alias("r"),
    )


def signature_pairs(signatures: DataFrame, max_distance: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(a, b, distance)`` for distinct signatures a < b within ``max_distance``.

    ``signatures`` has one row per distinct value in column ``signature``: copies are collapsed
    first, so a group of copies costs one row however large it is.
    """
    base = freeze(signatures.select("signature").distinct())
    joined = _hamming_join(
        base, base, max_distance, F.col("l.signature") < F.col("r.signature"), bucket_rows
    )
    return joined.select(
        F.col("l.signature").alias("a"),
        F.col("r.signature").alias("b"),
        hamming(F.col("l.signature"), F.col("r.signature")).alias("distance"),
    )


def record_links(
    records: DataFrame, key: str, signature: str, max_distance: int, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Near pairs of records without writing out every pair: ``(a, b, distance, pairs)``.

    One row per pair of near signatures, named by their first records, plus one row (a = b,
    distance 0) per signature with copies. ``pairs`` is the number of record pairs it stands for.
    """
    members = freeze(
        records.groupBy(F.col(signature).alias("signature")).agg(
            F.min(key).alias("first"), F.count("*").alias("n")
        )
    )
    near = signature_pairs(members, max_distance, bucket_rows)
    ma, mb = members.alias("ma"), members.alias("mb")
    across = (
        near.join(ma, F.col("a") == F.col("ma.signature"))
        .join(mb, F.col("b") == F.col("mb.signature"))
        .select(
            F.least("ma.first", "mb.first").alias("a"),
            F.greatest("ma.first", "mb.first").alias("b"),
            "distance",
            (F.col("ma.n") * F.col("mb.n")).alias("pairs"),
        )
    )
    inside = members.where("n > 1").select(
        F.col("first").alias("a"),
        F.col("first").alias("b"),
        F.lit(0).alias("distance"),
        F.expr("n * (n - 1) div 2").alias("pairs"),
    )
    return across.unionByName(inside)


def variant_pairs(
    records: DataFrame, key: str, variants: str, max_distance: int, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Unordered pairs where one identity signature (first variant) is near any variant of the other.

    Expects one row per distinct variant list; copies are collapsed by the caller.
    """
    base = freeze(records.select(F.col(key).alias("id"), F.col(variants).alias("v")))
    identity = freeze(base.select("id", F.get("v", F.lit(0)).alias("signature")))
    spread = freeze(base.select("id", F.explode(F.array_distinct("v")).alias("signature")))
    joined = _hamming_join(identity, spread, max_distance, F.col("l.id") != F.col("r.id"), bucket_rows)
    return joined.select(
        F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")
    ).distinct()


def _smallest(known: np.ndarray):
    """Arrow function: the smallest distance of a signature to any of ``known`` (NULL stays NULL)."""

    @F.arrow_udf("int")
    def smallest(s: pa.Array) -> pa.Array:
        # NULL is masked in Arrow: a float column would lose the low bits of every signature
        values = s.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        best = np.full(len(values), 65, dtype=np.int64)
        for start in range(0, len(known), 1024):
            part = np.bitwise_count(values[:, None] ^ known[None, start : start + 1024])
            best = np.minimum(best, part.min(axis=1).astype(np.int64))
        unknown = s.is_null().to_numpy(zero_copy_only=False)
        return pa.array(best.astype(np.int32), pa.int32(), mask=unknown | (best == 65))

    return smallest


def _turned(bits: int) -> Column:
    """Every way to flip ``bits`` bits of a part, as an array of masks."""
    masks = [sum(1 << b for b in c) for c in combinations(range(PART_BITS), bits)]
    return F.expr(f"array({', '.join(map(str, masks))})")


def _in_parts(df: DataFrame) -> DataFrame:
    low = F.lit((1 << PART_BITS) - 1)
    parts = [F.struct(F.lit(i).alias("part"), F.shiftrightunsigned("signature", PART_BITS * i).bitwiseAND(low).alias("bits")) for i in range(64 // PART_BITS)]
    return df.select("*", F.inline(F.array(*parts)))


def _nearest_by_parts(asked: DataFrame, bank: DataFrame, bank_rows: int) -> DataFrame:
    """``(signature, distance)`` of distinct stored signatures by multi-index hashing with a growing radius.

    A signature is cut into parts, and the bank is keyed by (part, bits). Round r looks up each part of a
    query with r of its bits flipped. After it every bank row within parts * (r + 1) - 1 bits has been met, so
    a query whose smallest distance so far is at most parts * (r + 1) is settled and leaves. Only the smallest
    distance is kept, summed up before it moves. Queries with nothing that near are compared with the whole
    bank, a bounded block of it at a time.
    """
    parts = 64 // PART_BITS
    keyed = stored(_in_parts(bank).withColumnRenamed("signature", "_known"), "keyed")
    pending, found = asked.withColumn("distance", F.lit(65)), []
    for r in range(PART_RADIUS + 1):
        probes = _in_parts(pending).select("signature", F.col("part").alias("_part"), F.explode(F.transform(_turned(r), lambda m: F.col("bits").bitwiseXOR(m.cast("long")))).alias("_bits"))
        met = probes.join(keyed, (F.col("part") == F.col("_part")) & (F.col("bits") == F.col("_bits")))
        best = met.groupBy(F.col("signature").alias("_s")).agg(F.min(hamming(F.col("signature"), F.col("_known"))).alias("_d"))
        pending = pending.join(best, F.col("signature") == F.col("_s"), "left").select("signature", F.least("distance", "_d").alias("distance"))
        pending = stored(pending, "pending")
        settled = F.col("distance") <= parts * (r + 1)
        found.append(pending.where(settled))
        pending = pending.where(~settled)
        if pending.isEmpty():
            break
    else:
        dealt = max(1, -(-bank.count() // max(bank_rows, 1024)))
        for d in range(dealt):
            block = bank.where(F.pmod(F.xxhash64("signature"), F.lit(dealt)) == d).toArrow().column("signature")
            known = block.to_numpy().astype(np.int64).view(np.uint64)
            pending = stored(pending.select("signature", F.least("distance", _smallest(known)("signature")).alias("distance")), "pending")
        found.append(pending)
    return reduce(DataFrame.unionByName, found)


def nearest_variants(
    queries: DataFrame, query_key: str, query_signature: str, bank: DataFrame, bank_variants: str, seen_within: int = 8, bank_rows: int = 100_000
) -> DataFrame:
    """:func:`nearest_distance` to a bank whose rows have an array of signatures, one for each way to turn them.

    A NULL array and NULL entries are left out of the bank.
    """
    # written first: explode filters on the array, and a filter repeats the array's whole expression for each entry
    known = stored(bank.select(F.col(bank_variants).alias("_variants")), "variants")
    spread = known.select(F.explode("_variants").alias("_variant"))
    return nearest_distance(queries, query_key, query_signature, spread, "_variant", seen_within, bank_rows)


def nearest_distance(
    queries: DataFrame,
    query_key: str,
    query_signature: str,
    bank: DataFrame,
    bank_signature: str,
    seen_within: int = 8,
    bank_rows: int = 100_000,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``(key, distance, seen)``: smallest distance of each query to any bank signature.

    A bank counted at no more than ``bank_rows`` distinct signatures (0.8 MB at the default) goes to
    every task; a larger one is searched by :func:`_nearest_by_parts`. A NULL signature has no distance
    on either way.
    """
    left = freeze(queries.select(query_key, F.col(query_signature).alias("signature")))
    right = freeze(bank.select(F.col(bank_signature).alias("signature")).where("signature is not null").distinct())
    if right.limit(bank_rows + 1).count() <= bank_rows:
        known = np.array([r[0] for r in right.collect()], dtype=np.int64).view(np.uint64)

        out = left.withColumn("distance", _smallest(known)("signature"))
    else:
        asked = stored(left.select("signature").where("signature is not null").distinct(), "asked")
        near = _nearest_by_parts(asked, right, bank_rows).withColumnRenamed("signature", "_s")
        out = left.join(near, F.col("signature") == F.col("_s"), "left").drop("_s")
    return out.select(query_key, "distance", (F.col("distance") <= seen_within).alias("seen"))
