"""Operator 6: token ids under a canonical length-limited Huffman code, in blocks with bit-offset checkpoints.

1. Texts become ids (a ``tokenizers`` file) and each document ends with an end id.
2. Ids are counted over all documents; package-merge turns the counts into code lengths of at most 16 bits.
3. Documents are range-partitioned by id, and each task writes one file: a header with the code lengths,
   then blocks. A block knows its number of ids, the documents that start in it and the bit offset of
   every 128th id, so it is decoded without its neighbours.
4. A reader rebuilds the code from the lengths and decodes by a table of 2^16 entries, one step for all
   checkpoints of a block at a time.

Files are written by Spark's text writer with the block mark as line separator: a row is a block.

The tokenizer's byte-level pre-tokenizer never joins what stands on both sides of a single blank, so texts
are cut there and each cut is remembered. A new cut is a word of letters and a rest, which that
pre-tokenizer parts as well; new words go through the library many at a time. Texts with runs of blanks,
and tokenizers with other rules, go through it whole.

Cases: a null or empty text is the end id alone. Null document ids come first; repeated ids keep all their
rows, in the order of their checksums. An empty table gives no file and an empty result. A document of any
length is cut over blocks. Columns of the input besides id and text are not stored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.operators.ordered import with_running_sums
from sievemark.session import broadcast_if_small, scratch_path, stored

LIMIT = 16  # bits of the longest code, and of the decoding table
CHECKPOINT = 128  # ids between two bit offsets
BLOCK = 1 << 17  # ids of a block
FILE = 1 << 23  # ids that a file should hold
CACHE = 250_000  # remembered beginnings and rests of a worker, and four times as many cuts; a full memory starts anew
TOGETHER = 500  # new words that the library encodes as one text
END_ID = 2

MARK = b"\x00#\x00#BLK\n"  # after every block; lengths, not marks, tell a reader where blocks end
HEADER, BODY = b"HUFH", b"HUFB"

_odd = re.compile(r"\s (?:\s|\Z)")
_letters = re.compile(r"[^\W\d_]+")
_tokenizers: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        before = rules.get("pre_tokenizer") or {}
        self.cuts = (
            rules.get("normalizer") is None
            and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules.get("added_tokens", []))
        )
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.rests: dict[str, bytes] = {}
        self.starts = np.zeros(self.library.get_vocab_size(), bool)  # ids that begin with the sign for a blank
        for token, i in self.library.get_vocab().items():
            self.starts[i] = token.startswith("Ġ")

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        kind = f"<u{self.width}"
        return [np.array(e.ids, kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, memory: dict[str, bytes], pieces: set[str], before: str = "") -> None:
        new = [p for p in pieces if p not in memory]
        memory.update(zip(new, self._library_ids([before + p for p in new]), strict=True))

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters after a blank: each begins with the one id of its own that shows a blank."""
        parts = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        made = self.library.encode_batch_fast([" " + " ".join(p) for p in parts], add_special_tokens=False)
        for part, encoding in zip(parts, made, strict=True):
            ids = np.array(encoding.ids, np.int64)
            data = ids.astype(f"<u{self.width}").tobytes()
            edges = [*(np.flatnonzero(self.starts[ids]) * self.width).tolist(), len(data)]
            self.later.update(zip(part, map(data.__getitem__, map(slice, edges, edges[1:])), strict=True))

    def _learn_cuts(self, new: set[str]) -> None:
        """What follows a blank: a word, a word and a rest, or else a piece for the library."""
        later, rests = self.later, self.rests
        words, parted, whole = set(), [], set()
        for cut in new:
            if cut.isalpha():
                words.add(cut)
            elif cut[:-1].isalpha():  # a word and one more sign, the usual case
                parted.append((cut, cut[:-1], cut[-1]))
            else:
                m = _letters.match(cut)
                if m and m[0].isalpha():
                    parted.append((cut, m[0], cut[m.end() :]))
                else:
                    whole.add(cut)
        words.update(w for _, w, _ in parted if w not in later)
        self._learn_words(list(words))
        self._learn(rests, {r for _, _, r in parted})
        self._learn(later, whole, " ")
        later.update((c, later[w] + rests[r]) for c, w, r in parted)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._library_ids(texts)
        for memory, most in ((self.first, CACHE), (self.later, 4 * CACHE), (self.rests, CACHE)):
            if len(memory) > most:
                memory.clear()
        whole = [i for i, t in enumerate(texts) if _odd.search(t)]
        odd = dict(zip(whole, self._library_ids([texts[i] for i in whole]), strict=True))
        parts = [[] if i in odd else t.split(" ") for i, t in enumerate(texts)]
        self._learn(self.first, {p[0] for p in parts if p})
        # sets find the new cuts of all texts at once; then every cut is known
        self._learn_cuts(set().union(*(p[1:] for p in parts)).difference(self.later))
        known = self.later.__getitem__
        return [odd[i] if i in odd else self.first[p[0]] + b"".join(map(known, p[1:])) for i, p in enumerate(parts)]


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def tokenized(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """``(doc_id, n_tokens, crc, width, ids, counts)``: ids as little-endian bytes, the end id last.

    A task's last row has nothing but ``counts``, how often each id occurs in its documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        end = end_id.to_bytes(tool.width, "little")
        total = np.zeros(max(len(tool.starts), end_id + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounds what is in hand at once
                part = batch.slice(at, 256)
                ids = [b + end for b in tool.encode([t or "" for t in part.column("text").to_pylist()])]
                total += np.bincount(np.frombuffer(b"".join(ids), f"<u{tool.width}"), minlength=len(total))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(b) // tool.width for b in ids], pa.int64()),
                        pa.array([zlib.crc32(b) for b in ids], pa.int64()),
                        pa.array([tool.width] * len(ids), pa.int32()),
                        pa.array(ids, pa.binary()),
                        pa.nulls(len(ids), pa.list_(pa.int64())),
                    ],
                    names,
                )
        last = [pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*last, pa.array([total], pa.list_(pa.int64()))], names)

    names = ["doc_id", "n_tokens", "crc", "width", "ids", "counts"]
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_tokens long, crc long, width int, ids binary, counts array<long>")


def id_counts(ids: DataFrame) -> dict[int, int]:
    """How often each id occurs: at most one row for each id of the vocabulary reaches the driver."""
    each = ids.where("counts is not null").select(F.posexplode("counts").alias("id", "n")).where("n > 0")
    return {r.id: r.n for r in each.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths up to ``limit`` bits (package-merge), by id; 0 for ids that do not occur."""
    if not counts:
        return np.zeros(0, np.uint8)
    ids = np.array(sorted(counts, key=lambda i: (counts[i], i)), np.int64)
    weights = np.array([counts[i] for i in ids], np.float64)
    n = len(ids)
    if n > 1 << limit:
        raise ValueError("more ids than codes of that length")
    lengths = np.zeros(int(ids.max()) + 1, np.uint8)
    if n == 1:
        lengths[ids] = 1
        return lengths
    packages, single = np.zeros(0), []
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        single.append(np.concatenate([[0], np.cumsum(order < n)]))  # single ids among the first k
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    depth = np.zeros(n, np.uint8)
    take = 2 * n - 2
    for seen in reversed(single):
        alone = seen[take]
        depth[:alone] += 1
        take = 2 * (take - alone)
    lengths[ids] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the one before plus 1, shifted to its length."""
    codes = np.zeros(len(lengths), np.uint64)
    code = 0
    for size in range(1, LIMIT + 1):
        code <<= 1
        ids = np.flatnonzero(lengths == size)
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every 16 bits: the id whose code they begin with, and its length."""
    codes = canonical_codes(lengths)
    ids = np.flatnonzero(lengths)
    order = ids[np.lexsort((ids, lengths[ids]))]
    span = 1 << (LIMIT - lengths[order].astype(np.int64))
    first = codes[order].astype(np.int64) << (LIMIT - lengths[order].astype(np.int64))
    symbols, sizes = np.zeros(1 << LIMIT, np.int64), np.ones(1 << LIMIT, np.int64)
    if len(order):
        end = int(first[-1] + span[-1])
        symbols[:end] = np.repeat(order, span)
        sizes[:end] = np.repeat(lengths[order], span)
    return symbols, sizes


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes one after another, first bit highest, and the bit offset of every checkpoint.

    ``codes`` are moved to the high end of 64 bits, see :func:`high_codes`.
    """
    size = lengths[ids]
    end = np.cumsum(size, dtype=np.int64)
    start = end - size
    word = start >> 5
    pair = codes[ids] >> (start & 31).view(np.uint64)  # within the 64 bits that begin at the word
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    whole = np.add.reduceat(pair, first)  # the codes of a word share no bit
    words = np.zeros(int(end[-1] >> 5) + 2, np.uint64)
    at = word[first]
    words[at] += whole >> np.uint64(32)
    words[at + 1] += whole & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes(), start[::CHECKPOINT]


def high_codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes with their first bit in the highest of 64."""
    room = np.where(lengths > 0, 64 - lengths.astype(np.int64), 0).astype(np.uint64)
    return canonical_codes(lengths) << room


def decode_bits(bits: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All checkpoints of a block go on by one id in each step."""
    symbols, sizes = table
    words = np.frombuffer(bits, ">u4").astype(np.uint64)
    words = np.concatenate([words, np.zeros(2, np.uint64)])
    pairs = words[:-1] << np.uint64(32) | words[1:]
    out = np.zeros((CHECKPOINT, len(offsets)), np.int64)
    at = offsets.astype(np.int64)
    last = n - (len(offsets) - 1) * CHECKPOINT  # ids behind the last checkpoint
    for step in range(min(CHECKPOINT, n)):
        if step == last:
            at = at[:-1]
        window = pairs[at >> 5] >> (np.uint64(64 - LIMIT) - (at & 31).astype(np.uint64)) & np.uint64(0xFFFF)
        found = window.astype(np.int64)
        out[step, : len(at)] = symbols[found]
        at = at + sizes[found]
    return out.T.reshape(-1)[:n]


def header(lengths: np.ndarray) -> bytes:
    data = zlib.compress(lengths.tobytes(), 9)
    return HEADER + struct.pack("<II", len(lengths), len(data)) + data


def block(ids: np.ndarray, starts: list[tuple[int | None, int]], codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """``starts``: (document id, tokens) of the documents that start in this block."""
    bits, offsets = encode_bits(ids, codes, lengths)
    docs = b"".join(struct.pack("<?qq", d is None, d or 0, n) for d, n in starts)
    offset_bytes = offsets.astype("<u4").tobytes()
    return BODY + struct.pack("<IIII", len(ids), len(starts), len(offset_bytes), len(bits)) + docs + offset_bytes + bits


def write_ids(ids: DataFrame, lengths: np.ndarray, path: str) -> None:
    """Files of blocks in ascending order of document ids, from a stored table of :func:`tokenized`."""
    session = ids.sparkSession
    table = session.sparkContext.broadcast(lengths)
    total = ids.agg(F.sum("n_tokens")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = table.value
        codes = high_codes(sizes)
        waiting: list[np.ndarray] = []
        starts: list[tuple[int | None, int]] = []
        held, begun = 0, False

        def row(data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["block"])

        def flush() -> pa.RecordBatch:
            nonlocal held
            made = block(np.concatenate(waiting), starts, codes, sizes)
            waiting.clear()
            starts.clear()
            held = 0
            return row(made)

        for batch in batches:
            for doc, n, width, cell in zip(
                batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(),
                batch.column("width").to_pylist(), batch.column("ids"), strict=True,
            ):
                if not begun:
                    yield row(header(sizes))
                    begun = True
                starts.append((doc, n))
                left = np.frombuffer(cell.as_buffer(), f"<u{width}").astype(np.int64)
                while len(left):
                    taken, left = left[: BLOCK - held], left[BLOCK - held :]
                    waiting.append(taken)
                    held += len(taken)
                    if held == BLOCK:
                        yield flush()
        if held:
            yield flush()

    order = ["doc_id", "crc", "n_tokens"]
    sorted_ids = ids.repartitionByRange(max(1, -(-total // FILE)), *order).sortWithinPartitions(*order)
    blocks = sorted_ids.select("doc_id", "n_tokens", "width", "ids").mapInArrow(run, "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", MARK.decode()).text(path)


def read_file(data: memoryview) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, ids) of a file, in its order."""
    at, table = 0, None
    docs: list[tuple[int | None, int]] = []
    held: list[np.ndarray] = []
    have = 0
    while at < len(data):
        kind = bytes(data[at : at + 4])
        if kind == HEADER:
            n, size = struct.unpack_from("<II", data, at + 4)
            lengths = np.frombuffer(zlib.decompress(data[at + 12 : at + 12 + size]), np.uint8)
            if len(lengths) != n:
                raise ValueError("a header of another length")
            table = decoding_table(lengths)
            at += 12 + size + len(MARK)
            continue
        if kind != BODY or table is None:
            raise ValueError(f"no block at byte {at}")
        n, n_docs, n_offsets, n_bits = struct.unpack_from("<IIII", data, at + 4)
        at += 20
        for null, doc, tokens in struct.iter_unpack("<?qq", data[at : at + 17 * n_docs]):
            docs.append((None if null else doc, tokens))
        at += 17 * n_docs
        offsets = np.frombuffer(data[at : at + n_offsets], "<u4")
        at += n_offsets
        held.append(decode_bits(bytes(data[at : at + n_bits]), offsets, n, table))
        have += n
        at += n_bits + len(MARK)
        if docs and docs[0][1] <= have:
            stream, used, done = np.concatenate(held), 0, 0
            for doc, tokens in docs:
                if used + tokens > len(stream):
                    break
                yield doc, stream[used : used + tokens]
                used += tokens
                done += 1
            del docs[:done]
            held, have = [stream[used:]], len(stream) - used


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)``, and the ids if wanted, of all files in a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for name, cell in zip(files.column("path").to_pylist(), files.column("content"), strict=True):
                start, rows = 0, []

                def made(rows: list[tuple]) -> pa.RecordBatch:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                    names = ["file", "doc_id", "begin", "n_tokens", "ids_crc32", "ids"]
                    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

                for doc, ids in read_file(memoryview(cell.as_buffer())):
                    rows.append((name, doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids if with_ids else None))
                    start += len(ids)
                    if len(rows) >= 1000:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    schema = "file string, doc_id long, begin long, n_tokens long, ids_crc32 long, ids array<long>"
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = stored(files.mapInArrow(run, schema), "decoded")
    # files are named in the order of the ranges
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("tokens"))
    before = with_running_sums(sizes, ["file"], ["tokens"]).select(F.col("file").alias("_file"), "tokens_before")
    out = rows.join(broadcast_if_small(before), F.col("file") == F.col("_file"))
    columns = ["doc_id", (F.col("tokens_before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"]
    return out.select(*columns, *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer: str, with_ids: bool = False, **columns) -> DataFrame:
    """Documents written as token ids in the shared folder and read back from the files."""
    ids = stored(tokenized(docs, tokenizer, **columns), "ids")
    path = scratch_path(docs.sparkSession, "huffman")
    write_ids(ids.where("counts is null").drop("counts"), code_lengths(id_counts(ids)), path)
    return read_ids(docs.sparkSession, path, with_ids)
