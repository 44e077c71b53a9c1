from __future__ import annotations

import random

import pytest
from fixtures_llm import SCHEMA, documents

import corpus_pipeline
from sievemark.llm import near, simhash


def plain_survivors(rows):
    """Ids that stay if all pairs are compared."""
    sets = []
    for _, text in rows:
        words = text.encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    return sorted(min(rows[j][0] for j in range(len(rows)) if root(j) == r) for r in {root(i) for i in range(len(rows))})


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"edit{rng.getrandbits(32)}"
    return words


@pytest.mark.parametrize("block", [near.BLOCK, 4])
def test_survivors_equal_all_pairs(spark, block):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 120, 400]))]
        for n in [0, 0, 1, 2, 3, 4, 6, 9]:
            rows.append((len(rows), " ".join(edited(rng, base, n))))
    rows += [(900, "Short text"), (901, "short text"), (902, "short texts")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in near.first_of_groups(docs, block=block).collect())
    assert got == plain_survivors(rows) and len(got) < len(rows)


def test_stage_finds_copies_far_apart_in_fingerprints(spark):
    """Four edited words of 200: a similarity of about 0.82, mostly more than 4 differing bits."""
    rng = random.Random(3)
    rows = []
    for g in range(20):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((2 * g, " ".join(base), "en", "s", 0))
        rows.append((2 * g + 1, " ".join([*base[:20], "a", *base[21:80], "b", *base[81:140], "c", *base[141:180], "d", *base[181:]]), "en", "s", 0))
    out = corpus_pipeline.near_copies_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 40, 2))


def test_fingerprints_under_masks_give_candidates_of_their_own(spark):
    """Operator 8's method is a step of the stage: masked fingerprints alone link texts within the radius."""
    rng = random.Random(5)
    rows, nodes = [], []
    for g in range(20):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join([*base, "more"]))]
    for i, text in rows:
        words = near.words_of(text.encode())
        found = near.shingles(words)
        assert set(near.mask_keys(found)) | set(near.band_keys(found)) == set(near.keys(found))
        nodes.append((near.node_of(words), i, [int(k) for k in near.mask_keys(found)]))
    close = {(i, i + 1) for i in range(0, 40, 2) if len(set(nodes[i][2]) & set(nodes[i + 1][2]))}
    fingerprints = [simhash.majority(near.shingles(near.words_of(t.encode()))) for _, t in rows]
    within = {(i, i + 1) for i in range(0, 40, 2) if ((fingerprints[i] ^ fingerprints[i + 1]) & (1 << 64) - 1).bit_count() <= near.RADIUS}
    assert within and within <= close
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = near.linked(docs, spark.createDataFrame(nodes, "node long, first long, bands array<long>"), "doc_id", "text").collect()
    place = {n[0]: n[1] for n in nodes}
    assert {tuple(sorted((place[r.a], place[r.b]))) for r in links} == close


def test_repeated_and_missing_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, b, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1), (None, a, "en", "s", 1)]
    for _ in range(2):
        out = near.first_of_groups(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
        assert sorted((str(r.doc_id), r.text) for r in out) == sorted([("1", a), ("1", b), ("None", c)])


def test_awkward_documents(spark):
    rows = near.first_of_groups(documents(spark, extra=["kept"])).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["0", "1", "4", "5", "None"])
    assert near.first_of_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stage_on_shared_documents_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clean = corpus_pipeline.quality_stage(spark, docs, "").collect()
    want = plain_survivors([(r.doc_id, r.text) for r in clean])
    out = corpus_pipeline.near_copies_stage(spark, spark.createDataFrame(clean, SCHEMA), "")
    assert sorted(r.doc_id for r in out.collect()) == want and not {145, 177} & set(want)
