from __future__ import annotations

import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures_llm import AWKWARD, SCHEMA, documents
from tokenizers import Tokenizer

from sievemark.llm import huffman

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(5))
def test_lengths_are_optimal(seed):
    rng = random.Random(seed)
    counts = {i: rng.randint(1, 60) for i in rng.sample(range(400), rng.randint(2, 120))}
    heap, cost = list(counts.values()), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    lengths = huffman.code_lengths(counts)
    assert cost == sum(n * int(lengths[i]) for i, n in counts.items())


@pytest.mark.parametrize("limit", [4, 5, 16])
def test_limited_lengths_fill_the_code(limit):
    lengths = huffman.code_lengths({i: 2**i for i in range(16)}, limit)
    assert lengths.max() <= limit and sum(2.0 ** -int(n) for n in lengths if n) == 1
    assert huffman.code_lengths({7: 3}).tolist()[7] == 1 and len(huffman.code_lengths({})) == 0


@pytest.mark.parametrize("n", [1, 127, 128, 129, 5000])
def test_bits_round_trip_from_every_checkpoint(n):
    rng = np.random.default_rng(n)
    counts = {i: 2 ** min(i, 30) for i in range(40)}
    lengths = huffman.code_lengths(counts)
    ids = rng.integers(0, 40, n)
    bits, offsets = huffman.encode_bits(ids, huffman.high_codes(lengths), lengths)
    table = huffman.decoding_table(lengths)
    assert (huffman.decode_bits(bits, offsets, n, table) == ids).all()
    last = len(offsets) - 1  # a checkpoint alone
    assert (huffman.decode_bits(bits, offsets[last:], n - last * huffman.CHECKPOINT, table) == ids[last * huffman.CHECKPOINT :]).all()


def test_cuts_at_blanks_do_not_change_the_ids():
    rng = random.Random(0)
    parts = [" ", " ", " ", "\n", "a", "b", "é", "'s", "1", "<|endoftext|>", ".", "\t", "xyz", "\x1c", "　", "²", "Ⅷ", "'ll", "é", "中", "_", "-", "e\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20000)]
    library, ours = Tokenizer.from_file(PATH), huffman.Encoder(PATH)
    assert ours.cuts
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u2").tolist() for b in ours.encode(texts)] == want


def test_tokenizers_with_other_rules_are_used_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, ours = Tokenizer.from_file(path), huffman.Encoder(path)
    texts = ["Some words", "", "  more   words "]
    assert not ours.cuts
    assert [np.frombuffer(b, f"<u{ours.width}").tolist() for b in ours.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_awkward_documents_come_back_from_the_files(spark, monkeypatch):
    monkeypatch.setattr(huffman, "FILE", 20_000)  # several files
    library = Tokenizer.from_file(PATH)
    rows = huffman.round_trip(documents(spark, extra=["start", "ids"]), PATH, with_ids=True).collect()
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in AWKWARD}
    assert len(rows) == len(AWKWARD)
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r[0] for r in AWKWARD), key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        assert list(r.ids) == want[r.doc_id] and r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert huffman.round_trip(spark.createDataFrame([], SCHEMA), PATH).count() == 0
