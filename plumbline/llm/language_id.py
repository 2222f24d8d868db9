"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network reads a word at a time, between two spaces, and gives every byte a
distribution over languages; a document's languages are pooled over its bytes. Words
do not depend on each other, so each distinct word of a batch is read once, however
often it occurs. Words of one length advance together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.llm import bytetext
from plumbline.llm.storing import store

UNKNOWN = "und"
HIDDEN = 16
LONGEST = 32
SAMPLE_DOCS = 400
SAMPLE_WORDS = 20_000
MAX_LANGUAGES = 256
HASH_STEPS = 1 << 31
STEPS = 700
BATCH = 512
RATE = 0.01
SEED = 11
CACHED_WORDS = 1_000_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Direction:
    """One gated recurrent layer; a byte's input is its row of ``table``."""

    table: np.ndarray
    weights: np.ndarray

    @classmethod
    def fresh(cls, hidden: int, rng: np.random.Generator) -> Direction:
        scale = 1 / np.sqrt(hidden)
        return cls(
            rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),
            rng.uniform(-scale, scale, (hidden, 3 * hidden)).astype(np.float32),
        )

    def forward(self, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States after each step: ``(steps, rows, hidden)``."""
        size = self.weights.shape[0]
        h = np.zeros((x.shape[1], size), np.float32)
        out = np.empty((*x.shape, size), np.float32)
        for t in range(len(x)):
            a, u = self.table[x[t]], h @ self.weights
            gates = _sigmoid(a[:, : 2 * size] + u[:, : 2 * size])
            z, r = gates[:, :size], gates[:, size:]
            n = np.tanh(a[:, 2 * size :] + r * u[:, 2 * size :])
            if trace is not None:
                trace.append((h, z, r, n, u[:, 2 * size :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def backward(self, x: np.ndarray, grad: np.ndarray, trace: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the table and the weights, through all steps back."""
        d_table, d_weights = np.zeros_like(self.table), np.zeros_like(self.weights)
        later = np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, u = trace[t]
            d = grad[t] + later
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * u * r * (1 - r)
            np.add.at(d_table, x[t], np.hstack([dz, dr, dn]))
            du = np.hstack([dz, dr, dn * r])
            d_weights += h.T @ du
            later = d * z + du @ self.weights.T
        return d_table, d_weights


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray
    bias: np.ndarray
    moments: dict = field(default_factory=dict, repr=False)

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        out = rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32)
        return cls(languages, Direction.fresh(hidden, rng), Direction.fresh(hidden, rng), out, np.zeros(len(languages), np.float32))

    def log_probabilities(self, x: np.ndarray, trace: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log distribution at each position, ``(steps, rows, languages)``, and the states."""
        one, two = trace or (None, None)
        states = np.concatenate([self.ahead.forward(x, one), self.back.forward(x[::-1], two)[::-1]], axis=2)
        logits = states @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True)), states

    def step(self, x: np.ndarray, y: np.ndarray, rate: float, at: int) -> float:
        """One update on words of one length, ``y`` being their languages; the loss before it."""
        trace: tuple[list, list] = ([], [])
        logp, states = self.log_probabilities(x, trace)
        rows = np.arange(len(y))
        loss = -float(logp[:, rows, y].mean())
        grad = np.exp(logp)
        grad[:, rows, y] -= 1
        grad /= grad.shape[0] * grad.shape[1]
        size = self.ahead.weights.shape[0]
        d_states = grad @ self.out.T
        d_out = np.einsum("tbh,tbc->hc", states, grad, optimize=True)
        f_table, f_weights = self.ahead.backward(x, d_states[:, :, :size], trace[0])
        b_table, b_weights = self.back.backward(x[::-1], d_states[::-1, :, size:], trace[1])
        for name, value, g in (
            ("out", self.out, d_out),
            ("bias", self.bias, grad.sum(axis=(0, 1))),
            ("ft", self.ahead.table, f_table),
            ("fw", self.ahead.weights, f_weights),
            ("bt", self.back.table, b_table),
            ("bw", self.back.weights, b_weights),
        ):
            m, s = self.moments.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            value -= rate * (m / (1 - 0.9**at)) / (np.sqrt(s / (1 - 0.999**at)) + 1e-8)
        return loss


def as_steps(words: list[bytes]) -> np.ndarray:
    """Equally long words between two spaces, a row a position."""
    flat = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8)
    return flat.reshape(len(words), -1).T


def train(words: list[bytes], language: np.ndarray, weight: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = SEED) -> Network:
    """Fit on words drawn by weight, each language as often as another, by truncation-free backpropagation."""
    net = Network.fresh(languages, HIDDEN, seed)
    if not words:
        return net
    rng = np.random.default_rng(seed)
    share = weight / np.bincount(language, weight, len(languages))[language]
    length = np.array([len(w) for w in words])
    by_length = {n: np.flatnonzero(length == n) for n in np.unique(length)}
    sizes = np.array(list(by_length))
    mass = np.array([share[rows].sum() for rows in by_length.values()])
    for at in range(1, steps + 1):
        rows = by_length[rng.choice(sizes, p=mass / mass.sum())]
        pick = rng.choice(rows, BATCH, p=share[rows] / share[rows].sum())
        net.step(as_steps([words[i] for i in pick]), language[pick], RATE * (1 - 0.9 * at / steps), at)
    net.moments.clear()
    return net


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network:
    """Train on a bounded sample of the labelled rows where ``learn`` holds.

    Learned are the ``MAX_LANGUAGES`` languages with most such rows (ties by name); no other
    is ever predicted. The sample is at most ``SAMPLE_DOCS`` documents of each, those of least hash of
    key and text, and of their words at most ``SAMPLE_WORDS`` a language. Rows far
    above the wanted hash are left out before any text is shuffled; a language's least hash always
    stays, so that one whose rows all share a key is learned too. The driver holds that sample alone.
    """
    wanted = F.coalesce(learn, F.lit(False)) & F.col(text).isNotNull() & F.col(lang).isNotNull()
    labelled = docs.where(wanted).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("language"))
    hashed = labelled.withColumn("h", F.pmod(F.xxhash64("k", "t"), F.lit(HASH_STEPS)))
    sizes = hashed.groupBy("language").agg(F.count("*").alias("count"), F.min("h").alias("least"))
    sizes = sizes.orderBy(F.desc("count"), "language").limit(MAX_LANGUAGES)
    near = (F.col("h") * F.col("count") < F.lit(3 * SAMPLE_DOCS * HASH_STEPS)) | (F.col("h") == F.col("least"))
    order = W.partitionBy("language").orderBy("h", "k")
    some = (
        hashed.join(F.broadcast(sizes), "language").where(near)
        .withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE_DOCS)
    )
    counted = (
        some.select("language", F.explode(F.split("t", r"[ \t-\r]+")).alias("word"))
        .where("word != ''").groupBy("language", "word").count()
        .withColumn("nth", F.row_number().over(W.partitionBy("language").orderBy(F.xxhash64("word"), "word")))
        .where(F.col("nth") <= SAMPLE_WORDS).drop("nth")
    )
    table = store(counted, "words").toArrow()
    found = table.column("language").to_pylist()
    languages = sorted(set(found))
    pieces: dict[tuple[bytes, int], int] = {}
    for word, name, count in zip(table.column("word").to_pylist(), found, table.column("count").to_pylist(), strict=True):
        raw = bytetext.lower(np.frombuffer(word.encode(), np.uint8)).tobytes()
        for at in range(0, len(raw), LONGEST):
            piece = raw[at : at + LONGEST]
            if _lettered(piece):
                pieces[piece, languages.index(name)] = pieces.get((piece, languages.index(name)), 0) + count
    ordered = sorted(pieces)
    return train([w for w, _ in ordered], np.array([c for _, c in ordered], int), np.array([pieces[p] for p in ordered], float), languages)


def _lettered(piece: bytes) -> bool:
    return any(97 <= b <= 122 or b >= 128 for b in piece)


class Reader:
    """A network with the sums it gave for words already read, at most ``CACHED_WORDS``."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.sums = np.zeros((0, 2 * len(self.net.languages)), np.float32)

    def learn(self, keys: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        sums = np.zeros((len(keys), self.sums.shape[1]), np.float32)
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            for lo in range(0, len(rows), 8192):
                some = rows[lo : lo + 8192]
                x = np.full((n + 2, len(some)), 32, np.uint8)
                x[1:-1] = flat[starts[some] + np.arange(n)[:, None]]
                logp = self.net.log_probabilities(x)[0][1:-1]
                sums[some] = np.hstack([logp.sum(axis=0), np.exp(logp).sum(axis=0)])
        self.keys, self.sums = np.concatenate([self.keys, keys]), np.concatenate([self.sums, sums])
        order = np.argsort(self.keys)
        self.keys, self.sums = self.keys[order], self.sums[order]

    def batch(self, column: pa.Array) -> Iterator[tuple[int, list, np.ndarray]]:
        """``(first row, languages, scores)`` by chunks."""
        names, size = np.array([*self.net.languages, UNKNOWN], object), len(self.net.languages)
        for first, end, raw, offsets in bytetext.chunks(column):
            flat = bytetext.lower(raw)
            starts, stops, rows = bytetext.words(flat, offsets)
            pieces = -(-(stops - starts) // LONGEST)
            word = np.repeat(np.arange(len(starts)), pieces)
            starts = bytetext.ranges(np.zeros(len(pieces), np.int64), pieces) * LONGEST + starts[word]
            stops = np.minimum(starts + LONGEST, stops[word])
            doc = np.searchsorted(rows, word, "right") - 1
            letter = np.concatenate([[0], np.cumsum(((flat >= 97) & (flat <= 122)) | (flat >= 128))])
            keep = letter[stops] > letter[starts]
            starts, stops, doc = starts[keep], stops[keep], doc[keep]
            hashes = bytetext.span_hash(*bytetext.prefix_hash(flat), starts, stops)
            distinct, at, unit = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.keys) > CACHED_WORDS:
                self.clear()
            spot = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
            new = np.flatnonzero(self.keys[spot] != distinct) if len(self.keys) else np.arange(len(distinct))
            if len(new) and size:
                self.learn(distinct[new], flat, starts[at[new]], (stops - starts)[at[new]])
            spot = np.searchsorted(self.keys, distinct)[unit]
            count = end - first
            total = np.stack([np.bincount(doc, self.sums[spot, c], count) for c in range(2 * size)], 1) if size else np.zeros((count, 0))
            n = np.bincount(doc, stops - starts, count)
            ascii_letter = ((flat >= 97) & (flat <= 122)).astype(np.int64)
            plain = np.concatenate([[0], np.cumsum(ascii_letter)])[offsets]
            lettered = np.diff(plain) > 0
            for i in np.flatnonzero(~lettered & (n > 0)):
                lettered[i] = any(ch.isalpha() for ch in raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
            known = lettered & (n > 0) & (size > 0)
            best = np.argmax(total[:, :size], axis=1) if size else np.zeros(count, int)
            score = np.where(known, total[np.arange(count), size + best] / np.maximum(n, 1), 0.0) if size else np.zeros(count)
            yield first, list(names[np.where(known, best, size)]), np.clip(score, 0.0, 1.0)


def label(docs: DataFrame, net: Network, text: str = "text", to: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The input with two more columns, named by ``to``: the language and its score.

    The language is the one of highest mean log probability over all bytes of words
    with a letter; the score is its mean probability there. A text that is null, empty
    or without a letter, and any text if the network knows no language, is ``und`` with
    score 0. Very long words are read in parts of ``LONGEST`` bytes, texts whole.
    Repeated rows are labelled alike; an empty table gives no rows. Input columns that
    have the names of ``to`` are replaced.
    """
    own = [c for c in docs.columns if c not in to]
    at = own.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net)
        for batch in batches:
            done = list(reader.batch(batch.column(at)))
            languages = [x for _, names, _ in done for x in names]
            scores = np.concatenate([s for _, _, s in done]) if done else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(scores)], [*batch.schema.names, *to])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)
    return docs.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(run, f"{kinds}, `{to[0]}` string, `{to[1]}` double")
