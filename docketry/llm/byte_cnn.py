"""Quality of texts by a convolutional network over bytes, in NumPy.

Filters slide over the UTF-8 bytes of a text. Overlapping chunks cover the whole
text; in each, every filter's response is max-pooled, a small dense layer turns
the pooled responses and the share of the chunk that is text into a logit, and the mean over chunks gives one
probability. Filters and layers are learned by gradient descent from chunks of a
bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import map_texts
from docketry.llm.deobfuscate import bounded_sample

WIDTH = 6  # bytes under a filter; even, as taps are looked up in pairs
FILTERS, HIDDEN = 16, 16
BLOCK = 128  # a chunk is two blocks long, and chunks start a block apart
PAD = 256
# Labelled rows used to fit, and chunks taken of each, spread evenly over the text.
FIT_ROWS, FIT_CHUNKS = 6_000, 6
SHORT = (16, 90)  # bytes of the short piece that a long text adds to the fit as a text of its own
EPOCHS, BATCH, RATE = 16, 64, 4e-3
SLICE = 1 << 17  # positions convolved at a time


@dataclass
class Network:
    taps: np.ndarray  # (WIDTH, 257, FILTERS); the last row belongs to padding and stays zero
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: float

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        taps = rng.normal(0, 0.3, (WIDTH, 257, FILTERS))
        taps[:, PAD] = 0
        return cls(taps, np.zeros(FILTERS), rng.normal(0, 0.25, (FILTERS + 1, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.25, HIDDEN), 0.0)

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden activations and logits of pooled chunks."""
        hidden = np.tanh(pooled @ self.dense + self.dense_bias)
        return hidden, hidden @ self.out + self.out_bias

    def pairs(self) -> list[np.ndarray]:
        """Summed responses of neighbouring taps for every two bytes, in single precision."""
        two = [self.taps[j][:, None, :] + self.taps[j + 1][None, :, :] for j in range(0, WIDTH, 2)]
        return [t.reshape(257 * 257, FILTERS).astype(np.float32) for t in two]


def chunk_rows(data: bytes, most: int) -> list[bytes]:
    """At most ``most`` chunks of a text with the bytes that the last filter position needs, evenly spread."""
    starts = np.unique(np.linspace(0, max(0, len(data) - 2 * BLOCK), most).astype(int))
    return [data[s:s + 2 * BLOCK + WIDTH - 1] for s in starts.tolist()]


def fragment(data: bytes, seed: int) -> list[bytes]:
    """A short piece of a long text, so that the network also learns what short texts look like."""
    if len(data) < 4 * SHORT[1]:
        return []
    rng = np.random.default_rng(seed & (2**63 - 1))
    size = int(rng.integers(*SHORT))
    start = int(rng.integers(len(data) // 4, len(data) - size))
    return [data[start:start + size]]


def train(chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray, seed: int = 7) -> Network:
    """Fit by Adam on the logistic loss of the mean chunk logit of each text.

    ``chunks`` holds padded byte rows, ``owner`` the text of each row, ascending.
    """
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    net.out_bias = float(np.log(share / (1 - share)))
    names = ("taps", "bias", "dense", "dense_bias", "out", "out_bias")
    moments = {n: (np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))) for n in names}
    first = np.searchsorted(owner, np.arange(len(labels) + 1))
    filled = np.minimum(1.0, (chunks != PAD).sum(axis=1) / (2 * BLOCK))
    positions, step = chunks.shape[1] - WIDTH + 1, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(labels))
        rate = RATE * (0.5 if epoch >= EPOCHS * 2 // 3 else 1.0)
        for k in range(0, len(order), BATCH):
            texts = order[k:k + BATCH]
            rows = np.concatenate([np.arange(first[t], first[t + 1]) for t in texts])
            counts = first[texts + 1] - first[texts]
            text_of = np.repeat(np.arange(len(texts)), counts)
            x = chunks[rows]
            response = np.zeros((len(rows), positions, FILTERS), np.float32)
            pairs = net.pairs()
            for j, table in enumerate(pairs):
                response += table[x[:, 2 * j:2 * j + positions] * 257 + x[:, 2 * j + 1:2 * j + 1 + positions]]
            best = response.argmax(axis=1)
            top = np.take_along_axis(response, best[:, None], axis=1)[:, 0].astype(float) + net.bias
            pooled = np.column_stack([np.maximum(top, 0), filled[rows]])
            hidden, logit = net.head(pooled)
            mean = np.bincount(text_of, logit, len(texts)) / counts
            error = 1 / (1 + np.exp(-np.clip(mean, -30, 30))) - labels[texts]
            d_logit = (error / counts / len(texts))[text_of]
            d_hidden = d_logit[:, None] * net.out * (1 - hidden**2)
            d_top = (d_hidden @ net.dense[:FILTERS].T) * (top > 0)
            d_taps = np.zeros_like(net.taps)
            filters = np.broadcast_to(np.arange(FILTERS), best.shape)
            for j in range(WIDTH):
                np.add.at(d_taps[j], (np.take_along_axis(x, best + j, axis=1), filters), d_top)
            d_taps[:, PAD] = 0
            grads = {
                "taps": d_taps + 1e-5 * net.taps, "bias": d_top.sum(axis=0), "dense": pooled.T @ d_hidden + 1e-4 * net.dense,
                "dense_bias": d_hidden.sum(axis=0), "out": hidden.T @ d_logit + 1e-4 * net.out, "out_bias": d_logit.sum(),
            }
            step += 1
            for n, g in grads.items():
                m, v = moments[n]
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                moments[n] = (m, v)
                change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(net, n, getattr(net, n) - change)
    return net


def block_maxima(data: np.ndarray, ends: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
    """Largest response of each filter in each block of ``data``; filters do not look past a text's end."""
    padded = np.append(data, np.full(WIDTH, PAD, data.dtype)).astype(np.int64)
    out = np.empty((len(data) // BLOCK, FILTERS), np.float32)
    index = padded[:-1] * 257 + padded[1:]
    for begin in range(0, len(data), SLICE):
        n = min(SLICE, len(data) - begin)
        response = pairs[0][index[begin:begin + n]]
        for j in range(1, len(pairs)):
            response += pairs[j][index[begin + 2 * j:begin + 2 * j + n]]
        low, high = np.searchsorted(ends, (begin, begin + n), side="left")
        for end in ends[low:high + 1].tolist():
            a, b = max(end - WIDTH + 1, begin), min(end, begin + n)
            if a < b:
                response[a - begin:b - begin] = -np.inf  # these windows reach into the next text
        out[begin // BLOCK:(begin + n) // BLOCK] = response.reshape(-1, BLOCK, FILTERS).max(axis=1)
    return out


class Judge:
    """Scores texts in a task."""

    def __init__(self, net: Network):
        self.net, self.pairs = net, net.pairs()

    def scores(self, texts: list[bytes]) -> np.ndarray:
        sizes = np.array([-(-(len(t) + WIDTH - 1) // BLOCK) * BLOCK for t in texts], np.int64)
        ends = np.cumsum(sizes)
        data = np.full(int(ends[-1]), PAD, np.uint16)
        for text, end, size in zip(texts, ends.tolist(), sizes.tolist()):
            data[end - size:end - size + len(text)] = np.frombuffer(text, np.uint8)
        blocks = block_maxima(data, ends, self.pairs)
        # Chunks of two blocks; a text of one block has one chunk, and no chunk spans two texts.
        chunk = np.maximum(blocks, np.concatenate([blocks[1:], blocks[-1:]]))
        last = ends // BLOCK - 1
        single = sizes == BLOCK
        chunk[last[single]] = blocks[last[single]]
        used = np.ones(len(blocks), bool)
        used[last[~single]] = False
        text_of = np.repeat(np.arange(len(texts)), sizes // BLOCK)[used]
        start = (np.arange(len(blocks)) - np.repeat(last + 1 - sizes // BLOCK, sizes // BLOCK)) * BLOCK
        length = np.repeat([len(t) for t in texts], sizes // BLOCK)
        filled = np.clip((length - start) / (2 * BLOCK), 0, 1)[used]
        logit = self.net.head(np.column_stack([np.maximum(chunk[used] + self.net.bias, 0), filled]))[1]
        mean = np.bincount(text_of, logit, len(texts)) / np.bincount(text_of, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(mean, -30, 30)))


def fit(df: DataFrame, labels: DataFrame, use: Column, label: str = "quality", id_column: str = "doc_id",
        text_column: str = "text", rows: int = FIT_ROWS) -> Network:
    """Learn from at most ``rows`` labelled texts that ``use`` allows.

    The driver receives their chunks, at most ``rows * (FIT_CHUNKS + 1)`` of about
    260 bytes. With no labelled text the network is as it started; with one label
    only it learns the constant.
    """
    sample = bounded_sample(df, labels, label, use, rows, id_column, text_column)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            rows = [(i, y, chunk_rows(t, FIT_CHUNKS)) for i, y, t in zip(ids, labels_, texts)]
            rows += [(i, y, f) for i, y, t in zip(ids, labels_, texts) if (f := fragment(t, i))]
            i, y, chunks = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int64()), pa.array(y, pa.int32()), pa.array(chunks, pa.list_(pa.binary()))], ["id", "y", "chunks"])

    found = sample.select(F.xxhash64("_id").alias("id"), "_label", "_text").mapInArrow(cut, "id long, y int, chunks array<binary>").collect()
    if not found:
        return Network.fresh(np.random.default_rng(7))
    found.sort(key=lambda r: (r["id"], r["y"], r["chunks"]))  # the same order whatever the partitions
    flat = [c for r in found for c in r["chunks"]]
    chunks = np.full((len(flat), 2 * BLOCK + WIDTH - 1), PAD, np.int64)
    for row, c in zip(chunks, flat):
        row[:len(c)] = np.frombuffer(bytes(c), np.uint8)
    owner = np.repeat(np.arange(len(found)), [len(r["chunks"]) for r in found])
    return train(chunks, owner, np.array([min(1, max(0, r["y"])) for r in found], float))


def quality(df: DataFrame, labels: DataFrame, use: Column, label: str = "quality", id_column: str = "doc_id",
            text_column: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """``(id, score)`` of every row by a network learned from the labels that ``use`` allows.

    Null and empty texts get the score of one chunk of padding. Repeated rows each
    get a row, and equal texts equal scores; an id labelled more than once counts
    as 1 when any label is. Texts of any length are read whole. Only the named
    columns are read.
    """
    shared = df.sparkSession.sparkContext.broadcast(fit(df, labels, use, label, id_column, text_column, rows))

    def make():
        judge = Judge(shared.value)
        return lambda ids, texts: {"id": ids, "score": judge.scores(texts)}

    kind = df.schema[id_column].dataType.simpleString()
    return map_texts(df, id_column, text_column, f"id {kind}, score double", make, limit=1_000_000, raw=True)
