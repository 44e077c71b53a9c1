from __future__ import annotations

import random

import pytest
from fixtures_llm import SCHEMA, documents

from sievemark.llm import packing


def checked(plan, counts, lengths):
    """Every piece in one place, bins filled without gaps, each the smallest length that holds its contents."""
    placed, bins = set(), {}
    for size, rank, n, first, each, offset in plan.places:
        for i in range(n):
            assert (size, rank + i) not in placed
            placed.add((size, rank + i))
            bins.setdefault(first + i // each, []).append((offset + i % each * size, size))
    assert placed == {(s, i) for s, n in counts.items() for i in range(n)}
    facts = {first + i: (used, length) for first, n, used, length in plan.bins for i in range(n)}
    assert set(facts) == set(bins)
    for number, content in bins.items():
        end = 0
        for offset, size in sorted(content):
            assert offset == end
            end += size
        assert facts[number] == (end, min(n for n in lengths if n >= end))


@pytest.mark.parametrize("seed", range(40))
def test_plans_are_complete_and_tight(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(5, 60), 3))
    counts = {}
    for _ in range(rng.randint(1, 150)):
        size = rng.randint(1, lengths[-1])
        counts[size] = counts.get(size, 0) + rng.choice([1, 1, 5, 40])
    checked(packing.Plan(counts, lengths), counts, lengths)


def test_single_length_is_plain_best_fit_decreasing():
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 100) for _ in range(400)), reverse=True)
    rooms = []
    for s in sizes:
        fits = [r for r in rooms if r >= s]
        room = min(fits) if fits else 100
        if fits:
            rooms.remove(room)
        rooms.append(room - s)
    counts = {s: sizes.count(s) for s in set(sizes)}
    plan = packing.Plan(counts, [100])
    assert sum(n for _, n, _, _ in plan.bins) == len(rooms)
    assert sorted(100 - used for _, n, used, _ in plan.bins for _ in range(n)) == sorted(rooms)


def test_costs_decide_what_is_opened():
    counts = {10: 8}
    dear = packing.Plan(counts, [10, 40], {10: 10, 40: 100})
    cheap = packing.Plan(counts, [10, 40], {10: 30, 40: 41})
    assert {length for *_, length in dear.bins} == {10} and {length for *_, length in cheap.bins} == {40}


def test_size_of_the_plan_does_not_grow_with_the_counts():
    rng = random.Random(9)
    counts = {s: rng.randint(1, 50) for s in range(1, 1000)}
    small, large = packing.Plan(counts, [512, 1024]), packing.Plan({s: n * 10_000 for s, n in counts.items()}, [512, 1024])
    assert len(large.places) < 4 * len(small.places)


def test_pieces_of_awkward_documents(spark):
    docs = documents(spark, extra=["bin_id", "piece", "n_words"])
    rows = packing.pack(docs, lengths=[64, 256, 1024]).collect()
    words = sum(len((r.text or "").encode().split()) for r in docs.collect())
    assert sum(r.n_words for r in rows) == words
    assert [r.bin_id for r in rows if r.n_words == 0] == [None] * 3
    bins = {}
    for r in rows:
        if r.n_words:
            assert r.first_word == r.piece * 1024 and r.n_words <= r.bin_length in (64, 256, 1024)
            bins.setdefault((r.bin_id, r.bin_length, r.bin_words), []).append((r.bin_offset, r.n_words))
    for (_, length, used), content in bins.items():
        end = 0
        for offset, n in sorted(content):
            assert offset == end
            end += n
        assert end == used <= length
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
