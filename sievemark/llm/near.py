"""Near copies by SimHash fingerprints under covering masks (operator 8), widened by MinHash, verified exactly.

Texts are near copies if the sets of their 5-word shingles have a Jaccard similarity of at least 4/5. Each text
has the SimHash fingerprint of its shingles and one key for each covering mask of :mod:`simhash`, so every pair
within RADIUS bits is a candidate without fail. At 0.8 about ten bits differ on average and fifteen often, and masks
that cover so many positions keep too few bits to tell texts apart. So each text also gets BANDS keys of ROWS
minima each: a pair of similarity s shares one of these with probability 1 - (1 - s^ROWS)^BANDS, 0.9999 at 0.8
and more above. Each candidate of either kind is then verified on the whole shingle sets, so no pair below the
threshold is linked.

Texts with equal words (letter case A-Z and blanks set aside) are one node. Buckets of one node are dropped
by a count, and of buckets with the same nodes one is kept. A task searches a bucket from node to node over
those not reached yet, which gives a spanning forest of its links instead of all pairs. A bucket of more
than ``block`` nodes is dealt into blocks and every pair of blocks is a task of its own, so no pair is left out.

Cases: null, empty and wordless texts are one node; a text of fewer than five words is one shingle. A
component keeps one row: the smallest id, of repeated ids the smallest hash of the words, then the smallest
row; rows without an id stay only where no row of the component has one. An empty table gives an empty
table. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm import simhash
from sievemark.llm.common import texts, with_columns
from sievemark.operators.components import connected_components
from sievemark.session import stored

SHINGLE = 5
SIMILAR = (4, 5)  # the least Jaccard similarity, as a fraction
RADIUS = 4  # differing bits of fingerprints that no mask misses
BANDS, ROWS = 24, 5
SEED = 43
BLOCK = 512  # nodes of a bucket that are dealt to one block

_random = np.random.default_rng(SEED)
_turn = _random.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
_stretch = _random.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_masks = np.array(simhash.covering_masks(RADIUS), np.uint64)
_mask_turn = _random.integers(0, 2**64, len(_masks), np.uint64)
_mask_stretch = _random.integers(0, 2**64, len(_masks), np.uint64) | np.uint64(1)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []  # bytes.lower changes A-Z only


def node_of(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED) - (1 << 63)


def shingles(words: list[bytes]) -> np.ndarray:
    """The distinct shingle hashes; a wordless text has the one of the empty string."""
    if len(words) <= SHINGLE:
        parts = {b" ".join(words)}
    else:
        parts = set(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), np.uint64, len(parts))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a shingle set, each of ROWS minima and the number of its band."""
    lowest = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(lowest, ((hashes[at : at + 1024] ^ _turn) * _stretch).min(axis=1), out=lowest)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(lowest.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def mask_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each covering mask: what the mask keeps of the fingerprint, turned one to one for that mask."""
    kept = np.uint64(simhash.majority(hashes) & (1 << 64) - 1) & _masks
    return ((kept ^ _mask_turn) * _mask_stretch).view(np.int64)


def keys(hashes: np.ndarray) -> np.ndarray:
    """All keys of a shingle set: texts that share one are candidates."""
    return np.concatenate([mask_keys(hashes), band_keys(hashes)])


def _nodes(docs: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"_node": pa.array([node_of(words_of(t)) for t in texts(batch, text)], pa.int64())}

    return with_columns(docs, "_node long", compute, keep)


def _printed(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        words = [words_of(t) for t in texts(batch, text)]
        nodes = pa.array([node_of(w) for w in words], pa.int64())
        return {"_node": nodes, "_bands": pa.array([keys(shingles(w)) for w in words], pa.list_(pa.int64()))}

    return with_columns(docs, "_node long, _bands array<long>", compute, keep)


def _shingled(docs: DataFrame, text: str) -> DataFrame:
    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        words = [words_of(t) for t in texts(batch, text)]
        nodes = pa.array([node_of(w) for w in words], pa.int64())
        return {"_node": nodes, "_set": pa.array([shingles(w).view(np.int64) for w in words], pa.list_(pa.int64()))}

    return with_columns(docs, "_node long, _set array<long>", compute, [])


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (positions) that connect what chains of similar sets connect: one for each set reached."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    part, whole = SIMILAR
    marked = np.zeros(ids.max() + 1, bool)
    left, found = np.arange(len(sets)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = left[(part * sizes[left] <= whole * sizes[at]) & (part * sizes[at] <= whole * sizes[left])]
            own = ids[starts[at] : starts[at] + sizes[at]]
            marked[own] = True
            both = np.array([np.count_nonzero(marked[ids[starts[i] : starts[i] + sizes[i]]]) for i in near], np.int64)
            marked[own] = False
            near = near[whole * both >= part * (sizes[near] + sizes[at] - both)]
            if len(near):
                left = np.setdiff1d(left, near, assume_unique=True)
                queue += list(near)
                found += [(int(at), int(i)) for i in near]
    return found


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and pair of blocks; a group may go on in the next batch."""
    group, nodes, sets = None, [], []

    def links() -> pa.RecordBatch:
        pairs = forest(sets) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[p[i]] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")), strict=True))
        members, column = batch.column("node").to_pylist(), batch.column("_set")
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
        for r, key in enumerate(keys):
            if key != group:
                if len(sets) > 1:
                    yield links()
                group, nodes, sets = key, [], []
            nodes.append(members[r])
            sets.append(values[offsets[r] : offsets[r + 1]])
    if len(sets) > 1:
        yield links()


def linked(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that span the components of ``nodes``: (node, first, bands), stored."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("sum")
    )
    # buckets with the same nodes give the same links
    alike = sizes.where("n > 1").groupBy("n", "low", "high", "sum").agg(F.min("key").alias("key"))
    buckets = stored(alike.select("key", "n"), "buckets")
    rows = stored(keyed.join(buckets, "key"), "bucketed")
    wanted = stored(nodes.join(rows.select("node").distinct(), "node", "left_semi").select("node", "first"), "candidates")
    ids = wanted.where("first is not null").select(F.col("first").alias("_id")).distinct()
    found = docs.select(doc_id, text).join(ids.hint("shuffle_hash"), F.col(doc_id) == F.col("_id"), "left_semi")
    if not wanted.where("first is null").isEmpty():
        found = found.unionByName(docs.select(doc_id, text).where(F.col(doc_id).isNull()))
    sets = stored(_shingled(found, text).groupBy("_node").agg(F.first("_set").alias("_set")), "shingles")
    k = F.ceil(F.col("n") / block).cast("int")
    dealt = rows.select("key", "node", k.alias("k"), F.pmod(F.xxhash64("node"), k).cast("int").alias("own"))
    others = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("k") - 1), F.col("own")))
    dealt = dealt.select("key", "node", "own", F.explode(others).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node")
    met = stored(dealt, "blocks").join(sets, F.col("node") == F.col("_node")).select("key", "i", "j", "node", "_set")
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return met.mapInArrow(_search, "a long, b long")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, _node)`` of each row, and ``(node, first, component)`` of each node with its smallest id."""
    printed = stored(_printed(docs.select(doc_id, text), text, [doc_id]), "printed")
    nodes = printed.groupBy(F.col("_node").alias("node")).agg(F.min(doc_id).alias("first"), F.first("_bands").alias("bands"))
    nodes = stored(nodes, "nodes")
    found = stored(connected_components(linked(docs, nodes, doc_id, text, block)), "components")
    members = nodes.select("node", "first").join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    return printed.select(doc_id, "_node"), stored(members.select("node", "first", F.coalesce("component", "node").alias("component")), "members")


def first_of_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` with one fixed row of each component of near copies."""
    printed, members = groups(docs, doc_id, text, block)
    best = members.groupBy("component").agg(F.min(F.struct(F.col("first").isNull().alias("bare"), "first", "node")).alias("b"))
    best = stored(best.select("b.first", "b.node"), "survivors")
    names = best.select(F.col("first").alias("_keep")).where("_keep is not null").distinct()
    # a hash join whatever the size of the list: texts move once, without a sort, at every size alike
    kept = docs.join(names.hint("shuffle_hash"), docs[doc_id] == names["_keep"], "left_semi")
    again = stored(printed.groupBy(doc_id).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(doc_id).alias("_again")), "repeats")
    same = F.col(doc_id) == F.col("_again")
    several = not again.where("_again is not null").isEmpty()
    bare = not best.where("first is null").isEmpty()
    if not several and not bare:
        return kept
    doubtful = kept.join(again, same, "left_semi").unionByName(docs.where(F.col(doc_id).isNull()))
    marked = _nodes(doubtful, text)
    chosen = marked.join(best, F.col(doc_id).eqNullSafe(F.col("first")) & (F.col("_node") == F.col("node")), "left_semi")
    row = F.struct(text, *[c for c in docs.columns if c != text])
    one = chosen.groupBy("_node", doc_id).agg(F.min(row).alias("_row")).select("_row.*").select(*docs.columns)
    return kept.join(again, same, "left_anti").unionByName(one)
