"""Quality by a byte-level convolutional network in numpy.

Learned filters of WIDTH bytes slide over the whole text; their responses are max-pooled over overlapping chunks
that cover it, rectified, averaged and maximised over the chunks, and combined by a small dense layer into one
probability. The network is trained here, by Adam, on the whole texts of a bounded sample of labelled rows; training
and scoring read every byte, in bounded segments.

Defined cases: null or empty text -> the network's output for a text without chunks; texts shorter than a filter are
padded with zero bytes; no labelled rows -> score 0.5; repeated rows are scored once per row; null labels, contradicting
labels of one doc_id and rows without doc_id are not learned from; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, labelled_texts, small_batches

#: Bound of the sample: rows of each class (twice as many at most), whose whole texts are learned from.
SAMPLE_PER_CLASS = 600
WIDTH, FILTERS, HIDDEN = 4, 20, 16
#: Filter positions of a chunk; chunks overlap by half.
CHUNK, STEP = 256, 128
SEGMENT = 1 << 18
#: Chunks whose filter responses are held at once in training.
TRAINED_AT_ONCE = 512

SCHEMA = "doc_id long, score double"


@dataclass
class Network:
    table: np.ndarray  # WIDTH x 256 x FILTERS: what each byte adds to each filter, by place
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float = 0.0  # log-odds that the class shares of the sample hide

    def params(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.w1, self.b1, self.w2]

    def pooled(self, data: bytes) -> np.ndarray:
        """Mean and maximum over all chunks of the rectified chunk maxima (2 x FILTERS); chunks overlap by half."""
        if not data:
            return np.zeros(2 * FILTERS, np.float32)
        data += bytes(max(0, WIDTH - len(data)))
        halves = []
        for begin in range(0, len(data) - WIDTH + 1, SEGMENT):
            x = np.frombuffer(data[begin : begin + SEGMENT + WIDTH - 1], np.uint8)
            n = x.size - WIDTH + 1
            r = self.table[0][x[:n]]
            for j in range(1, WIDTH):
                r += self.table[j][x[j : j + n]]
            halves.append(np.maximum.reduceat(r, np.arange(0, n, STEP), axis=0))
        h = np.concatenate(halves)
        c = np.maximum(np.maximum(h[:-1], h[1:]) if len(h) > 1 else h, -self.bias) + self.bias
        return np.concatenate([c.mean(0), c.max(0)])

    def strongest(self, chunks: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk and filter: the place of its strongest response among the first `held`, and that response."""
        n, where, top = CHUNK, [], []
        for lo in range(0, len(chunks), TRAINED_AT_ONCE):
            x = chunks[lo : lo + TRAINED_AT_ONCE]
            r = self.table[0][x[:, :n]]
            for j in range(1, WIDTH):
                r += self.table[j][x[:, j : j + n]]
            for i in np.flatnonzero(held[lo : lo + TRAINED_AT_ONCE] < n).tolist():
                r[i, held[lo + i] :] = -np.inf
            where.append(r.argmax(1))
            top.append(np.take_along_axis(r, where[-1][:, None, :], 1)[:, 0] + self.bias)
        return np.concatenate(where), np.concatenate(top)

    def head(self, f: np.ndarray) -> np.ndarray:
        return np.maximum(f @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, text: str | None) -> float:
        z = float(self.head(self.pooled(text.encode("utf-8", "replace") if text else b""))) + self.prior
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[bytes], labels: np.ndarray, rounds: int = 5, seed: int = 5) -> Network:
    """Adam on log loss over whole texts."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(f32), np.zeros(FILTERS, f32), rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(f32), np.zeros(HIDDEN, f32), rng.normal(0, 0.3, HIDDEN).astype(f32), 0.0)
    m = [np.zeros_like(p) for p in net.params()] + [0.0]
    v = [np.zeros_like(p) for p in net.params()] + [0.0]
    step, size = 0, 32
    for round_ in range(rounds):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), size):
            rows = order[lo : lo + size]
            chunks, held = zip(*(chunked(texts[i]) for i in rows), strict=True)
            x, counts = np.concatenate(chunks), np.array([len(c) for c in chunks])
            at = np.concatenate([[0], np.cumsum(counts)[:-1]])
            owner = np.repeat(np.arange(len(rows)), counts)
            where, top = net.strongest(x, np.concatenate(held))
            act = np.maximum(top, 0)
            mean = np.add.reduceat(act, at) / counts[:, None]
            best = np.maximum.reduceat(act, at)
            f = np.hstack([mean, best])
            z1 = f @ net.w1 + net.b1
            a1 = np.maximum(z1, 0)
            p = 1 / (1 + np.exp(-np.clip(a1 @ net.w2 + net.b2, -30, 30)))
            d = (p - labels[rows]) / len(rows)
            g_w2, g_b2 = a1.T @ d, float(d.sum())
            dz1 = np.outer(d, net.w2) * (z1 > 0)
            g_w1, g_b1 = f.T @ dz1, dz1.sum(0)
            df = dz1 @ net.w1.T
            d_act = (df[:, :FILTERS] / counts[:, None])[owner]
            hit = act == best[owner]
            share = np.add.reduceat(hit, at).astype(f32)
            d_act = (d_act + hit * (df[:, FILTERS:] / np.maximum(share, 1))[owner]) * (top > 0)
            g_table = np.zeros_like(net.table)
            k = np.broadcast_to(np.arange(FILTERS), where.shape)
            c = np.broadcast_to(np.arange(len(x))[:, None], where.shape)
            for j in range(WIDTH):
                np.add.at(g_table[j], (x[c, where + j], k), d_act)
            grads = [g_table, d_act.sum(0), g_w1, g_b1, g_w2, g_b2]
            step += 1
            rate = 0.01 * (0.5 if round_ >= rounds - 2 else 1.0)
            params = [*net.params(), net.b2]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                change = rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
                if i < 5:
                    params[i] -= change.astype(f32)
                else:
                    net.b2 -= float(change)
    return net


def chunked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of a text, rows of CHUNK + WIDTH - 1 bytes, STEP bytes apart; and how many filter positions of each are in the text."""
    data += bytes(max(0, WIDTH - len(data)))
    positions = len(data) - WIDTH + 1
    n, size = max(1, -(-positions // STEP) - 1), CHUNK + WIDTH - 1
    padded = np.zeros((n - 1) * STEP + size, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return padded[np.arange(n)[:, None] * STEP + np.arange(size)], np.minimum(CHUNK, positions - np.arange(n) * STEP)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, seed: int = 23) -> Network | None:
    """Train on the texts of `docs` that `labels` (doc_id, label 0/1) names: about `per_class` rows of each class, which reach the driver."""
    sample, counted = labelled_texts(docs, labels, per_class, seed)
    got = sorted((r["doc_id"], r["label"], r["text"]) for r in sample.collect())
    if not got:
        return None
    y = np.array([label for _, label, _ in got], np.float32)
    net = train([text.encode("utf-8", "replace") for *_, text in got], y)
    n1, n0 = max(float(y.sum()), 1.0), max(float((1 - y).sum()), 1.0)
    net.prior = float(np.log(max(counted.get(1, 0), 1) / max(counted.get(0, 0), 1)) - np.log(n1 / n0))
    return net


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score) of every row; the network (under 100 kB) is the only broadcast."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = [m.score(t) if m else 0.5 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda b: freed(scored(b)), SCHEMA)
