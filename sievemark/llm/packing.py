"""Operator 3: variable-capacity best-fit packing of documents into training sequences.

Sizes are whole numbers up to the largest permitted length, so best-fit decreasing runs on counts: the
histogram of piece sizes has at most that many rows, whatever the table. Sizes go from large to small;
pieces of a size go to the open bins that they fill tightest, whole groups of equal bins at once. Where
none fits, the bin length with the least cost per word is opened, judged by how the sizes still to come
would fill it. At the end every bin shrinks to the smallest permitted length that holds its contents.

The result is a list of rank ranges for each size. Spark gives each piece its rank among the pieces of
its size (a distributed position, no single-task window), and the ranges map ranks to bins and offsets.

Documents above the largest length are cut into pieces of that length and a rest: no word is dropped.

Cases: a null, empty or wordless text is one piece of 0 words without a bin. Ids may be null or
repeated; each row is packed once. An empty table gives an empty table. Columns of the input besides
the id and the text are not returned, so none can clash.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import with_columns
from sievemark.llm.mixing import size_column
from sievemark.operators.ordered import with_position
from sievemark.session import stored

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 64  # words of cost that every sequence has besides its length
OPEN_SHARE = 8  # at least one in so many of the bins that a size needs is opened at once


def default_costs(lengths: Sequence[int]) -> dict[int, float]:
    return {n: n + OVERHEAD for n in lengths}


class Plan:
    """Where the pieces of each size go.

    ``places``: rows of (size, first rank, pieces, first bin, pieces a bin, offset in the bin).
    ``bins``: rows of (first bin, bins, words used, length).
    """

    def __init__(self, counts: Mapping[int, int], lengths: Sequence[int] = LENGTHS, costs: Mapping[int, float] | None = None):
        self.lengths = sorted(lengths)
        self.costs = dict(costs or default_costs(lengths))
        self.left = {s: n for s, n in counts.items() if n > 0 and s > 0}
        self.sizes = sorted(self.left)
        if self.sizes and self.sizes[-1] > self.lengths[-1]:
            raise ValueError("a piece is longer than the largest bin")
        self.places: list[tuple[int, int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int, int]]] = {}  # room -> groups of (first bin, bins, length)
        self.rooms: list[int] = []
        self.next_bin = 0
        while self.sizes:
            size = self.sizes[-1]
            self._place(size)
            self.sizes.pop()
        self.bins = sorted(
            (first, n, length - room, self.shrunk(length - room))
            for room, groups in self.open.items()
            for first, n, length in groups
        )

    def shrunk(self, used: int) -> int:
        return self.lengths[bisect_left(self.lengths, used)]

    def _push(self, room: int, group: tuple[int, int, int]) -> None:
        if not group[1]:
            return
        if room not in self.open:
            self.open[room] = []
            insort(self.rooms, room)
        self.open[room].append(group)

    def _pop(self, room: int) -> tuple[int, int, int]:
        groups = self.open[room]
        group = groups.pop()
        if not groups:
            del self.open[room]
            self.rooms.pop(bisect_left(self.rooms, room))
        return group

    def _place(self, size: int) -> None:
        rank = 0
        while self.left[size]:
            at = bisect_left(self.rooms, size)
            if at == len(self.rooms):
                self._open_bins(size)
                continue
            room = self.rooms[at]
            first, bins, length = self._pop(room)
            each = room // size  # a bin that took one of them is the tightest one for the next
            full = min(bins, self.left[size] // each)
            if full:
                self.places.append((size, rank, full * each, first, each, length - room))
                self._push(room - each * size, (first, full, length))
                rank += full * each
                self.left[size] -= full * each
            rest = bins - full
            if rest and self.left[size]:  # fewer than fill one more bin
                n = self.left[size]
                self.places.append((size, rank, n, first + full, n, length - room))
                self._push(room - n * size, (first + full, 1, length))
                rank += n
                self.left[size] = 0
                full, rest = full + 1, rest - 1
            self._push(room, (first + full, rest, length))

    def _filled(self, size: int, length: int) -> tuple[int, int]:
        """Words in a new bin of that length, and how many such bins the sizes to come can fill so."""
        each = min(length // size, self.left[size])
        room, times = length - each * size, self.left[size] // each
        below = len(self.sizes) - 1
        while room and below:
            at = bisect_right(self.sizes, room, 0, below) - 1
            if at < 0:
                break
            filler = self.sizes[at]
            n = min(room // filler, self.left[filler])
            room -= n * filler
            times = min(times, self.left[filler] // n)
            below = at
        return length - room, times

    def _open_bins(self, size: int) -> None:
        best = None
        for length in self.lengths[bisect_left(self.lengths, size):]:
            used, times = self._filled(size, length)
            cost = self.costs[self.shrunk(used)] / used
            if best is None or cost <= best[0]:
                best = (cost, length, times)
        _, length, times = best
        wanted = -(-self.left[size] // (length // size))
        bins = min(wanted, max(times, -(-wanted // OPEN_SHARE)))
        self._push(length, (self.next_bin, bins, length))
        self.next_bin += bins


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", longest: int = LENGTHS[-1]) -> DataFrame:
    """``(doc_id, piece, first_word, n_words)``: each document cut at the largest length."""
    sized = docs.select(F.col(doc_id), size_column(text).alias("_n"))
    last = F.greatest(F.floor((F.col("_n") - 1) / longest), F.lit(0)).cast("long")
    cut = sized.select(F.col(doc_id), "_n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    first = F.col("piece") * longest
    return cut.select(F.col(doc_id), "piece", first.alias("first_word"), F.least(F.col("_n") - first, F.lit(longest)).alias("n_words"))


OUTPUTS = "bin_id long, bin_length long, bin_words long, bin_offset long"


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lengths: Sequence[int] = LENGTHS,
    costs: Mapping[int, float] | None = None,
) -> DataFrame:
    """``(doc_id, piece, first_word, n_words, bin_id, bin_length, bin_words, bin_offset)``."""
    cut = stored(pieces(docs, doc_id, text, max(lengths)), "pieces")
    # at most one row for each size up to the largest length
    counts = {r.n_words: r.n for r in cut.where("n_words > 0").groupBy("n_words").agg(F.count("*").alias("n")).collect()}
    plan = Plan(counts, lengths, costs)
    places = np.array(sorted(plan.places) or [(0, 0, 0, 0, 1, 0)], np.int64)
    bins = np.array(plan.bins or [(0, 0, 0, 0)], np.int64)
    before = np.cumsum([0, *(counts.get(s, 0) for s in range(1, max(lengths) + 1))])
    # a place is found by the position of its first piece in the order of sizes
    starts = before[np.maximum(places[:, 0] - 1, 0)] + places[:, 1]
    context = docs.sparkSession.sparkContext
    tables = context.broadcast((places, starts, bins))

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        places, starts, bins = tables.value
        position = batch.column("_position").to_numpy() - 1
        at = np.searchsorted(starts, position, side="right") - 1
        place = places[at]
        index = position - starts[at]
        bin_id = place[:, 3] + index // place[:, 4]
        group = bins[np.searchsorted(bins[:, 0], bin_id, side="right") - 1]
        offset = place[:, 5] + index % place[:, 4] * place[:, 0]
        return {
            "bin_id": pa.array(bin_id), "bin_length": pa.array(group[:, 3]),
            "bin_words": pa.array(group[:, 2]), "bin_offset": pa.array(offset),
        }

    given = [doc_id, "piece", "first_word", "n_words"]
    placed = with_position(cut.where("n_words > 0"), ["n_words", doc_id, "piece"], name="_position")
    packed = with_columns(placed, OUTPUTS, compute, given)
    none = [F.lit(None).cast("long").alias(c.split()[0]) for c in OUTPUTS.split(", ")]
    return packed.unionByName(cut.where("n_words = 0").select(*given, *none))
