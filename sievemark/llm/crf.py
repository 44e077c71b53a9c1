"""Operator 4: language identification by a linear-chain conditional random field over words.

Each word gets a label (a language); a document's languages are read off the marginals of its words, so
code-switched text is labelled word by word. A word's features are its affixes, its character n-grams and
its place in lexicons of words that one language owns; transitions between labels are learned too.

Learning: a bounded sample of labelled documents (``TRAIN_DOCS`` a language, a window of ``TRAIN_WORDS``
words of each, both chosen by hashes) is cut into runs of a few words that are strung together across
languages, and the log-likelihood is climbed by Adam with gradients from forward-backward. The sample
and the model are small and of fixed size, whatever the table; the model is broadcast.

Prediction: whole texts. Long chains are cut into segments whose transfer matrices are multiplied in
lockstep, so the exact forward-backward marginals of a text of any length cost the same per word.

Cases: a null text or one without a letter is ``und`` with score 0. Words without a letter carry no
features and no vote. Without labelled documents every text is ``und``. Equal rows give equal results; an
empty table gives an empty table. Input columns with the name of an output are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.llm.common import texts, with_columns

UNKNOWN = "und"
BUCKETS = 1 << 16
TRAIN_DOCS = 300
TRAIN_WORDS = 240
SEQUENCE = 64  # words of a training chain
EPOCHS = 6
BATCH = 64
RATE = 0.02
DECAY = 1e-4
SEGMENT = 128  # words of a chain that are multiplied together in prediction
CACHE = 150_000  # words with remembered emissions in a worker
CHUNK_BYTES = 2 << 20
SEED = 4

OUTPUTS = "lang_pred string, score double, n_words long, n_switches long"


def letters(word: bytes) -> str:
    """The letters of a word, lower case."""
    text = word.decode().lower()
    return text if text.isalpha() else "".join(c for c in text if c.isalpha())


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature number) of n-grams of 1 to 3 characters, affixes of 1 to 3 and lexicon entries."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = "".join(f"^{w}$" for w in words)
    chars = np.frombuffer(marked.encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(chars))  # characters from here to the end of the word
    who, what = [], []
    gram = np.zeros(len(chars), np.uint64)
    for n in range(1, 4):
        shifted = np.concatenate([chars[n - 1 :], np.zeros(n - 1, np.uint64)])
        gram = _mixed(gram ^ shifted, n)
        at = np.flatnonzero(left >= n)
        who.append(owner[at])
        what.append(gram[at])
        long = np.flatnonzero(sizes >= n + 2)
        who += [long, long]
        what += [_mixed(gram[starts[long] + 1], 10 + n), _mixed(gram[ends[long] - 1 - n], 20 + n)]
    known = np.array([lexicon.get(w, -1) for w in words], np.int64)
    listed = np.flatnonzero(known >= 0)
    hashed = np.concatenate(what) % np.uint64(BUCKETS)
    return np.concatenate([*who, listed]), np.concatenate([hashed.astype(np.int64), BUCKETS + known[listed]])


class Model:
    """Emission weights for each feature and label, and transition weights."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((BUCKETS + len(labels), len(labels)))
        self.moves = np.zeros((len(labels), len(labels)))

    def emissions(self, words: list[str]) -> np.ndarray:
        who, what = features(words, self.lexicon)
        return np.stack([np.bincount(who, self.weights[what, k], len(words)) for k in range(len(self.labels))], axis=1)


def forward_backward(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of labels, expected moves and log-partition of chains of one length.

    ``scores``: (chains, words, labels). A chain starts and ends without a preference.
    """
    n, length, k = scores.shape
    top = scores.max(axis=2, keepdims=True)
    seen, step = np.exp(scores - top), np.exp(moves)
    alpha, scale = np.zeros_like(seen), np.zeros((n, length))
    before = np.ones((n, k))
    for t in range(length):
        now = (before if t == 0 else before @ step) * seen[:, t]
        scale[:, t] = now.sum(axis=1)
        before = alpha[:, t] = now / scale[:, t, None]
    beta = np.ones((n, k))
    marginals, expected = np.zeros_like(seen), np.zeros((k, k))
    for t in range(length - 1, -1, -1):
        marginals[:, t] = alpha[:, t] * beta
        if t:
            ahead = seen[:, t] * beta / scale[:, t, None]
            expected += alpha[:, t - 1].T @ ahead * step
            beta = ahead @ step.T
    return marginals, expected, (np.log(scale) + top[:, :, 0]).sum(axis=1)


def trained(rows: list[tuple[str, str]], epochs: int = EPOCHS) -> Model | None:
    """A model from (language, words) pairs; the same rows give the same model."""
    runs: dict[str, list[list[str]]] = {}
    counts: dict[str, Counter] = {}
    for lang, text in sorted(rows):
        words = [w for w in map(letters, text.encode().split()) if w]
        if words:
            runs.setdefault(lang, []).append(words)
            counts.setdefault(lang, Counter()).update(words)
    if not runs:
        return None
    labels = sorted(runs)
    total = sum(counts.values(), Counter())
    lexicon = {w: i for i, lang in enumerate(labels) for w, n in counts[lang].items() if n >= 3 and n >= 0.9 * total[w]}
    model = Model(labels, lexicon)
    rng = np.random.default_rng(SEED)
    chains, answers = [], []
    for _ in range(max(BATCH, sum(map(len, (w for r in runs.values() for w in r))) // SEQUENCE)):
        words: list[str] = []
        truth: list[int] = []
        while len(words) < SEQUENCE:  # runs of several languages, as in code-switched text
            k = int(rng.integers(len(labels)))
            source = runs[labels[k]][int(rng.integers(len(runs[labels[k]])))]
            size = int(rng.integers(6, 40))
            at = int(rng.integers(max(1, len(source) - size + 1)))
            words += source[at : at + size]
            truth += [k] * len(source[at : at + size])
        chains.append(words[:SEQUENCE])
        answers.append(truth[:SEQUENCE])
    truth = np.array(answers)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.weights, model.moves)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(chains))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            flat = [w for i in part for w in chains[i]]
            who, what = features(flat, lexicon)
            size = len(labels)
            scores = np.stack([np.bincount(who, model.weights[what, k], len(flat)) for k in range(size)], axis=1)
            marginals, expected, _ = forward_backward(scores.reshape(len(part), SEQUENCE, size), model.moves)
            right = np.eye(size)[truth[part]]
            error = (right - marginals).reshape(-1, size) / len(part)
            slope = np.stack([np.bincount(what, error[who, k], len(model.weights)) for k in range(size)], axis=1)
            moved = np.einsum("nti,ntj->ij", right[:, :-1], right[:, 1:]) - expected
            step += 1
            for p, g, (m, v) in zip((model.weights, model.moves), (slope, moved / len(part)), moments, strict=True):
                g -= DECAY * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def chain_marginals(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginals of every word of chains that follow each other in ``scores`` (words, labels)."""
    k = scores.shape[1]
    step = np.exp(moves - moves.max())
    # a row of ones for the first word of a chain: it has no move before it
    pieces = -(-sizes // SEGMENT)
    first_word = np.cumsum(sizes) - sizes
    piece_doc = np.repeat(np.arange(len(sizes)), pieces)
    piece_no = np.arange(len(piece_doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    piece_start = first_word[piece_doc] + piece_no * SEGMENT
    piece_size = np.minimum(SEGMENT, sizes[piece_doc] - piece_no * SEGMENT)
    column = np.arange(SEGMENT)
    real = column[None, :] < piece_size[:, None]
    index = np.where(real, piece_start[:, None] + column[None, :], 0)
    seen = np.exp(scores - scores.max(axis=1, keepdims=True))[index]

    product = np.broadcast_to(np.eye(k), (len(index), k, k)).copy()
    for t in range(SEGMENT):
        use = np.flatnonzero(real[:, t])
        if not len(use):
            break
        new = (product[use] @ step) * seen[use, t][:, None, :]
        if t == 0:
            begin = piece_no[use] == 0
            new[begin] = np.eye(k)[None] * seen[use[begin], 0][:, None, :]
        product[use] = new / new.sum(axis=(1, 2), keepdims=True)

    into = np.ones((len(index), k))
    onward = np.ones((len(index), k))
    by_no = [np.flatnonzero(piece_no == i) for i in range(int(pieces.max()))]
    for here in by_no[1:]:
        out = np.einsum("ni,nij->nj", into[here - 1], product[here - 1])
        into[here] = out / out.sum(axis=1, keepdims=True)
    for here in reversed(by_no[1:]):
        back = np.einsum("nij,nj->ni", product[here], onward[here])
        onward[here - 1] = back / back.sum(axis=1, keepdims=True)

    alpha = np.zeros((len(index), SEGMENT, k))
    before = into
    for t in range(SEGMENT):
        now = before @ step
        if t == 0:
            now = np.where((piece_no == 0)[:, None], before, now)
        now = now * seen[:, t]
        now /= now.sum(axis=1, keepdims=True)
        before = alpha[:, t] = np.where(real[:, t, None], now, before)
    marginals = np.zeros_like(alpha)
    beta = onward
    for t in range(SEGMENT - 1, -1, -1):
        both = alpha[:, t] * beta
        marginals[:, t] = both / both.sum(axis=1, keepdims=True)
        back = (seen[:, t] * beta) @ step.T
        back /= back.sum(axis=1, keepdims=True)
        beta = np.where(real[:, t, None], back, beta)
    return marginals[real]


class Labeller:
    """A model in a worker, with the emissions of words seen before."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((0, len(model.labels)))
        self.lettered = np.zeros(0, bool)

    def label(self, chunk: list[bytes]) -> list[tuple]:
        """(language, score, words, switches) of each text."""
        split = [t.split() for t in chunk]
        if len(self.known) > CACHE:
            self.known, self.rows, self.lettered = {}, self.rows[:0], self.lettered[:0]
        new = sorted(w for w in {w for s in split for w in s} if w not in self.known)
        if new:
            plain = [letters(w) for w in new]
            rows = self.model.emissions(plain)
            has = np.array([bool(p) for p in plain])
            rows[~has] = 0
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, rows])
            self.lettered = np.concatenate([self.lettered, has])
        sizes = np.array([len(s) for s in split], np.int64)
        answers: list[tuple] = [(UNKNOWN, 0.0, int(n), 0) for n in sizes]
        full = np.flatnonzero(sizes)
        if not len(full):
            return answers
        at = np.fromiter((self.known[w] for s in split for w in s), np.int64, int(sizes.sum()))
        marginals = chain_marginals(self.rows[at], sizes[full], self.model.moves)
        voices = self.lettered[at]
        owner = np.repeat(np.arange(len(full)), sizes[full])
        votes = np.stack([np.bincount(owner, marginals[:, k] * voices, len(full)) for k in range(marginals.shape[1])], axis=1)
        heard = np.bincount(owner, voices, len(full))
        best = marginals.argmax(axis=1)
        # switches between neighbouring words with letters
        spoken = np.flatnonzero(voices)
        change = (best[spoken[1:]] != best[spoken[:-1]]) & (owner[spoken[1:]] == owner[spoken[:-1]])
        switches = np.bincount(owner[spoken[1:]], change, len(full))
        for i, doc in enumerate(full):
            if heard[i]:
                k = int(votes[i].argmax())
                answers[doc] = (self.model.labels[k], min(1.0, float(votes[i, k] / heard[i])), int(sizes[doc]), int(switches[i]))
        return answers


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from; so are rows without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """A model of the labelled rows of ``docs``; at most TRAIN_DOCS distinct texts of a language, and a window of each, reach the driver."""
    labelled = docs.where(F.col(lang).isNotNull())
    rows = labelled.where(F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(2)))
    # places go to distinct texts, by their hashes alone: before any text moves, at least one for each language
    w = Window.partitionBy("lang").orderBy("h")
    places = rows.select("lang", "h").distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= TRAIN_DOCS).drop("_r")
    chosen = rows.join(F.broadcast(places), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    # words with letters, the only ones that are learned from
    words = F.regexp_extract_all("text", F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*+\p{L}[^\x20\x09-\x0D]*+"), F.lit(0))
    spare = F.greatest(F.size("w") - TRAIN_WORDS, F.lit(0)) + 1
    window = F.slice("w", (F.pmod(F.xxhash64("text", F.lit(1)), spare) + 1).cast("int"), TRAIN_WORDS)
    cut = chosen.withColumn("w", words).select("lang", F.array_join(window, " ").alias("text"))
    return trained([(r.lang, r.text) for r in cut.collect()])


_workers: dict[int, Labeller] = {}


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the language, its share of the words' marginals, the words and the switches between languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    number = id(shared)
    kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in OUTPUTS.split(", ")]

    def chunks(values: list[bytes | None]) -> Iterator[list[bytes]]:
        part, size = [], 0
        for v in values:
            part.append(v or b"")
            size += len(part[-1])
            if size >= CHUNK_BYTES:
                yield part
                part, size = [], 0
        if part:
            yield part

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if shared.value is None:
            rows = [(UNKNOWN, 0.0, len((t or b"").split()), 0) for t in texts(batch, text)]
        else:
            if number not in _workers:
                _workers.clear()
                _workers[number] = Labeller(shared.value)
            rows = [a for part in chunks(texts(batch, text)) for a in _workers[number].label(part)]
        return {n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows, strict=True), strict=True)}

    return with_columns(docs, OUTPUTS, compute, keep)
