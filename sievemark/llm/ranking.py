"""Operator 12: ranked lexical search by NRA (no random access).

Documents are dealt to shards inside Spark tasks; each shard holds impact-sorted lists, one for each term that
an item asks for. An item reads its lists from the top in growing steps and keeps for every document a lower
score (what was read) and an upper one (what the lists it was not yet seen in may still add, by their last
impact). It stops when no document outside the best k can reach them, ties by id included, and the scores of
the best are known to the last digit; until then only lists that can change this are read on. The best k of a
task's earlier shards are the bar for its later ones, and the lists of all tasks meet in two small rankings.

Before that, one pass over the texts gives each document's length and its counts of the terms asked for, from
which the number of documents, all lengths and document frequencies follow. A term weighs
floor(1000 ln((2N + 2) / (2 df + 1))); an impact is w * ((1000000000 tf) div (1000 tf + 20 m)) with
m = 50 + ((50 n N) div L), in 64-bit integers, so every sum is exact in any order.

Items are taken in blocks of a bounded number, and a shard is a bounded number of documents (fewer for items
of many terms). A hot term has its list cut over all shards, so no list meets in one task.

Cases: a null text has no term and counts in no statistic. Empty texts alike. A document's repeated rows are
ranked each; rows without an id are ranked behind equal scores. Items without an id are left out; rows with
the same item id are one item with the terms of all of them. An item without a known term returns nothing, and
empty tables give an empty table. Texts of any length are read whole. Other columns are not returned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.llm.common import texts, with_columns
from sievemark.session import stored

K = 50
ITEMS = 512  # items of one block
SHARD = 16_384  # documents of a shard at most
CELLS = 8_000_000  # documents x terms of an item at most
STEP, GROWTH = 128, 4  # rows read of a list in the first step, and the growth of a step
NO_ID = (1 << 63) - 1

# bytes outside the term class become blanks, A-Z become a-z; bytes of longer code points stay
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(LETTERS).split() if text else []


def counted(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n, terms, counts)``: a document's length and its counts of the terms of ``vocabulary``."""

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n, terms, counts = [], [], []
        for t in texts(batch, text):
            words = terms_of(t)
            found = [(vocabulary[w], c) for w, c in Counter(words).items() if w in vocabulary]
            n.append(len(words))
            terms.append([f[0] for f in found])
            counts.append([f[1] for f in found])
        return {"n": pa.array(n, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int64()))}

    only = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_columns(only, "n long, terms array<int>, counts array<long>", compute, keep=["doc_id"])


class Shard:
    """Impact-sorted lists of some documents: ``rows`` and ``impacts``, list t from starts[t] to starts[t + 1]."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, documents: int, length: int):
        m = 50 + (50 * n * documents) // max(length, 1)
        impacts = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[rows]))
        some = np.flatnonzero(impacts > 0)
        order = some[np.lexsort((rows[some], -impacts[some], terms[some]))]
        self.ids, self.rows, self.impacts = ids, rows[order], impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: highest score, then smallest id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))


def nra(shard: Shard, terms: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """``(scores, ids)`` of the k best of the shard and of ``best``, whose scores are final."""
    old_scores, old_ids = best
    at, end = shard.starts[terms], shard.starts[terms + 1]
    some = end > at
    at, end = at[some].copy(), end[some]
    bounds = shard.impacts[at].copy() if len(at) else np.zeros(0, np.int64)
    if not len(at) or (len(old_scores) == k and bounds.sum() < old_scores[-1]):
        return best
    size, lists = len(shard.ids), np.arange(len(at))
    lower = np.zeros(size, np.int64)
    seen = np.zeros((len(at), size))
    step, reading = STEP, lists
    while True:
        for i in reading:
            upto = min(at[i] + step, end[i])
            rows = shard.rows[at[i] : upto]
            lower[rows] += shard.impacts[at[i] : upto]
            seen[i, rows] = 1.0
            at[i] = upto
            bounds[i] = shard.impacts[upto - 1] if upto < end[i] else 0
        step *= GROWTH
        # integers below 2^53 are exact as doubles
        upper = lower + (bounds.sum() - (bounds.astype(np.float64) @ seen).astype(np.int64))
        touched = np.flatnonzero(lower)
        scores = np.concatenate([old_scores, lower[touched]])
        ids = np.concatenate([old_ids, shard.ids[touched]])
        top = _first(scores, ids, k)
        own = touched[top[top >= len(old_scores)] - len(old_scores)]
        rest = np.ones(size, bool)
        rest[own] = False
        if len(top) == k:
            least, last = scores[top[-1]], ids[top[-1]]
            rest &= (upper > least) | ((upper == least) & (shard.ids < last))
        else:
            rest &= upper > 0
        left = at < end
        if rest.any():
            reading = lists[left]
        else:  # membership is settled: lists that hold back a score or an order among the best
            unsure = own[upper[own] > lower[own]]
            reading = lists[left & (seen[:, unsure] == 0).any(axis=1)] if len(unsure) else lists[:0]
        if not len(reading):
            return scores[top], ids[top]


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple]:
    """``(ids, n, rows, terms, counts)`` of at most ``limit`` documents."""
    parts, size = [], 0

    def joined() -> tuple:
        ids, n, sizes, terms, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
        return ids, n, np.repeat(np.arange(len(ids)), sizes), terms, counts

    for whole in batches:
        at = 0
        while at < whole.num_rows:
            batch = whole.slice(at, limit - size)
            at += batch.num_rows
            size += batch.num_rows
            terms, counts = batch.column("terms"), batch.column("counts")
            parts.append(
                (
                    batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False),
                    batch.column("n").to_numpy(),
                    np.diff(terms.offsets.to_numpy()),
                    terms.flatten().to_numpy(),
                    counts.flatten().to_numpy(),
                )
            )
            if size == limit:
                yield joined()
                parts, size = [], 0
    if size:
        yield joined()


def _ranked(df: DataFrame, k: int) -> DataFrame:
    """The k best of each item: first within salted parts, then of what they keep."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = Window.partitionBy("item_id", "_part").orderBy(*order)
    some = df.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k)
    w = Window.partitionBy("item_id").orderBy(*order)
    return some.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, items: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """The k best documents of at most some ITEMS items."""
    table = items.toArrow()
    wanted: dict = {}
    for i, t in zip(table.column("item_id").to_pylist(), texts(table, "text"), strict=True):
        wanted.setdefault(i, {}).update(dict.fromkeys(terms_of(t)))
    vocabulary = {t: n for n, t in enumerate(dict.fromkeys(t for terms in wanted.values() for t in terms))}
    lists = [np.array([vocabulary[t] for t in terms], np.int64) for terms in wanted.values()]
    names = pa.array(list(wanted), table.schema.field("item_id").type)
    rows = stored(counted(docs, vocabulary, doc_id, text), "counted")
    total = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    documents, length = int(total[0]), int(total[1])
    weights = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the terms of the block
        weights[r.term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["count"] + 1)))
    limit = max(256, min(SHARD, CELLS // max([1, *map(len, lists)])))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in lists]
        for ids, n, places, terms, counts in _shards(batches, limit):
            shard = Shard(ids, n, places, terms, counts, weights, documents, length)
            best = [nra(shard, wanted_terms, b, k) for wanted_terms, b in zip(lists, best, strict=True)]
        for i, (scores, ids) in enumerate(best):
            if len(ids):
                own = pa.array(ids, mask=ids == NO_ID)
                yield pa.RecordBatch.from_arrays([names.take(pa.array([i] * len(ids))), own, pa.array(scores)], ["item_id", "doc_id", "score"])

    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id long, score long"
    found = rows.mapInArrow(run, schema).withColumn("_part", F.spark_partition_id() % 64)
    return _ranked(found, k).withColumn("doc_id", F.col("doc_id").cast(id_type))


def search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k highest-scoring documents of each item, ties by ascending id."""
    asked = stored(items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), "items")
    blocks = max(1, math.ceil(asked.select("item_id").distinct().count() / ITEMS))
    if blocks == 1:
        return _block(docs, asked, doc_id, text, k)
    dealt = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    # each block's answer is written before the next block starts, so one vocabulary lives at a time
    return reduce(DataFrame.unionByName, [stored(_block(docs, asked.where(dealt == b), doc_id, text, k), "answers") for b in range(blocks)])


def oracle(k: int = K) -> str:
    found = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    WITH words AS (SELECT row_number() OVER () AS r, doc_id, {found} AS terms FROM documents),
    sizes AS (SELECT r, doc_id, CAST(coalesce(len(terms), 0) AS BIGINT) AS n FROM words),
    facts AS (SELECT count_if(n > 0) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
    asked AS (SELECT DISTINCT item_id, unnest({found}) AS term FROM benchmark WHERE item_id IS NOT NULL),
    counts AS (
      SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM words)
      WHERE term IN (SELECT term FROM asked) GROUP BY r, term
    ),
    weights AS (
      SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), facts
    ),
    impacts AS (
      SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * docs) // length)))) AS impact
      FROM counts JOIN weights USING (term) JOIN sizes USING (r), facts
    ),
    scores AS (
      SELECT item_id, r, CAST(sum(impact) AS BIGINT) AS score
      FROM asked JOIN impacts USING (term) GROUP BY item_id, r HAVING sum(impact) > 0
    ),
    ranked AS (
      SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM scores JOIN sizes USING (r)
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {k}
    """
