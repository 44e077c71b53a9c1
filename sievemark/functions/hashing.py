"""Content hashes, hash-based randomness, 64-bit signatures and byte signatures."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.session import spread

WORDS = 65_536  # words of a batch whose bits are summed at a time


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_to_long(digits: Column) -> Column:
    """Up to 16 hex digits as a signed 64-bit value (the bit pattern is kept)."""
    return F.conv(digits, 16, -10).cast("long")


def hash_order(seed: str | int, key: Column | str) -> Column:
    """A reproducible shuffle key; unlike rand() it does not depend on the partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")))


def hash_uniform(seed: str | int, key: Column | str) -> Column:
    """A reproducible number in [0, 1) from 32 hash bits."""
    return F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("double") / F.lit(
        4294967296.0
    )


def record_seed(digest: Column | str) -> Column:
    """The number given by the first 12 hex digits of a content hash."""
    return F.conv(F.substring(_col(digest), 1, 12), 16, 10).cast("long")


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def sniff_format(content: Column | str) -> Column:
    """Image format from the first bytes, NULL when unknown."""
    head = F.hex(F.substring(_col(content), 1, 12))
    # File signatures.
    return (
        F.when(head.startswith("FFD8FF"), "JPEG")
        .when(head.startswith("89504E470D0A1A0A"), "PNG")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WEBP")
    )


def text_signatures(texts: DataFrame, key: str, text: str) -> DataFrame:
    """64-bit word signature per text (sign of summed word-hash bits; Charikar 2002).

    Words are told apart by Spark; a task hashes each word of an Arrow batch once and sums the bits of a text with
    numpy, so no row per word is made. Each of 32 counters holds two bit counts, 32 bits apart; a row of counters per
    text is shuffled.
    """
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    bit_counts = F.arrow_udf(_bit_counts, "array<long>")
    counted = spread(texts.select(key, text)).select(key, bit_counts(words).alias("_counts"))
    # One SQL string per result: hundreds of Column objects would cost more than the query.
    lanes = [F.expr(f"sum(_counts[{i}])").alias(f"s{i}") for i in range(32)]
    counts = counted.groupBy(key).agg(F.expr("sum(_counts[32])").alias("_words"), *lanes)
    majority = "if(2 * ({count}) > _words, shiftleft(1L, {bit}), 0L)"
    bits = [majority.format(count=f"s{i} & 4294967295L", bit=i) for i in range(32)]
    bits += [majority.format(count=f"shiftrightunsigned(s{i}, 32)", bit=i + 32) for i in range(32)]
    return counts.select(key, F.expr(" | ".join(bits)).alias("signature"))


def _bit_counts(words: pa.Array) -> pa.Array:
    """32 counters of the bits of md5 prefixes, and the number of words, for each list of words ('' is none)."""
    sizes = words.value_lengths().to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    position = coded.indices.to_numpy(zero_copy_only=False)
    known = coded.dictionary.cast(pa.binary()).to_pylist()
    heads = b"".join(md5(w, usedforsecurity=False).digest()[:8] for w in known)
    bits = np.unpackbits(np.frombuffer(heads, np.uint8).reshape(-1, 8)[:, ::-1], axis=1, bitorder="little")
    empty = np.array([not w for w in known], bool)
    bits[empty] = 0
    packed = bits.view(np.uint64)  # eight counters of a byte side by side hold the sums of 255 words
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    total = np.zeros((len(sizes), 64), np.int64)
    for at in range(0, len(row), WORDS):
        cut = place[at : at + WORDS] % 255 == 0
        cut[0] = True
        starts = np.flatnonzero(cut)
        sums = np.add.reduceat(packed[position[at : at + WORDS]], starts, axis=0)
        np.add.at(total, row[at + starts], sums.view(np.uint8))
    named = np.bincount(row[~empty[position]], minlength=len(sizes))
    lanes = np.column_stack([total[:, :32] + (total[:, 32:] << 32), named])
    offsets = np.arange(0, lanes.size + 1, 33, dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(lanes.ravel()))
