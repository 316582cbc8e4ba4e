"""A quality classifier: a small convolutional network over bytes, trained and applied in numpy.

How it scales: the network is trained on a bounded sample on the driver (a few megabytes) and has a few thousand weights, which travel with the function. Scoring is
one narrow pass of matrix products over whole texts, with memory bounded by a slice of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textbytes import slices, spread

#: Labelled documents of each label that the network learns from, and characters of a longer one, in stretches spread over it.
SAMPLE_EACH, SAMPLE_CHARS = 1000, 40_000
#: A filter sees WIDTH bytes, two strides, from every STRIDE-th on; a block has BLOCK bytes, a chunk is two blocks in a row, so chunks overlap by half.
WIDTH, STRIDE, BLOCK = 8, 4, 128
DIMENSIONS, FILTERS = 4, 32
EPOCHS, BATCH, RATE = 8, 32, 0.01
SLICE_BYTES = 1 << 20


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text filled up with zeros (STRIDE at least) to whole blocks, and the first block of each."""
    blocks = -(-(np.diff(offsets) + STRIDE) // BLOCK)
    first = np.cumsum(blocks) - blocks
    out = np.zeros(int(blocks.sum()) * BLOCK + WIDTH, np.uint8)
    out[np.arange(len(data)) + np.repeat(first * BLOCK - offsets[:-1], np.diff(offsets))] = data
    return out, np.append(first, blocks.sum())


@dataclass
class Network:
    embed: np.ndarray  # (256, DIMENSIONS)
    filters: np.ndarray  # (WIDTH * DIMENSIONS, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS + 1,): for the mean over chunks, the largest of all, and a constant

    @classmethod
    def new(cls, seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        f32 = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        return cls(f32(256, DIMENSIONS, scale=0.5), f32(WIDTH * DIMENSIONS, FILTERS, scale=0.25), np.zeros(FILTERS, np.float32), f32(2 * FILTERS + 1, scale=0.1))

    def convolve(self, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors of each STRIDE bytes, filter outputs after rectification at every STRIDE-th byte); a filter sees two such vectors in a row."""
        seen = self.embed[padded].reshape(-1, STRIDE * DIMENSIONS)[: (len(padded) - WIDTH) // STRIDE + 1]
        half = STRIDE * DIMENSIONS
        return seen, np.maximum(seen[:-1] @ self.filters[:half] + seen[1:] @ self.filters[half:] + self.bias, 0)

    def pooled(self, active: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(largest output in each chunk, chunk counts, features of each text). A text of one block is one chunk."""
        per = BLOCK // STRIDE
        active[first[1:] * per - 1] = 0  # the last window of a text, which has none of its bytes, reaches into the next
        block = active.reshape(-1, per, FILTERS).max(axis=1)
        chunk = block.copy()
        chunk[:-1] = np.maximum(block[:-1], block[1:])
        last = first[1:] - 1
        single = np.diff(first) == 1
        chunk[last[single]] = block[last[single]]
        chunk[last[~single]] = 0  # the last block starts no chunk
        count = np.maximum(np.diff(first) - 1, 1)
        mean = np.add.reduceat(chunk, first[:-1], axis=0) / count[:, None]
        most = np.maximum.reduceat(block, first[:-1], axis=0)
        return block, count, np.concatenate([mean, most, np.ones((len(count), 1), np.float32)], axis=1, dtype=np.float32)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        padded, first = layout(data, offsets)
        _, active = self.convolve(padded)
        return 1 / (1 + np.exp(-(self.pooled(active, first)[2] @ self.out).astype(float)))

    def gradients(self, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        padded, first = layout(data, offsets)
        seen, active = self.convolve(padded)
        block, count, features = self.pooled(active, first)
        error = ((1 / (1 + np.exp(-features @ self.out)) - labels) * weights).astype(np.float32)
        d_out = features.T @ error
        d_mean = error[:, None] * self.out[:FILTERS] / count[:, None]
        d_most = error[:, None] * self.out[FILTERS : 2 * FILTERS]
        per, n = BLOCK // STRIDE, len(block)
        text = np.repeat(np.arange(len(count)), np.diff(first))
        at = np.arange(n)
        d_block = np.zeros_like(block)
        starts = np.ones(n, bool)
        starts[first[1:] - 1] = np.diff(first) == 1
        paired = starts & (np.diff(first)[text] > 1)
        nxt = np.minimum(at + 1, n - 1)
        second = paired[:, None] & (block[nxt] > block)
        grad = d_mean[text] * starts[:, None]
        d_block += np.where(second, 0, grad)
        d_block[1:] += np.where(second, grad, 0)[:-1]
        top = block == np.maximum.reduceat(block, first[:-1], axis=0)[text]
        d_block += np.where(top, d_most[text], 0) / np.maximum(np.add.reduceat(top.astype(np.float32), first[:-1], axis=0)[text], 1)
        best = active.reshape(n, per, FILTERS).argmax(axis=1)
        d_active = np.zeros((n, per, FILTERS), np.float32)
        np.put_along_axis(d_active, best[:, None, :], np.where(block > 0, d_block, 0)[:, None, :], axis=1)
        d_active = d_active.reshape(-1, FILTERS)
        d_seen = d_active @ self.filters.T
        d_embed = np.zeros_like(self.embed)
        for k in range(WIDTH):
            byte = padded[k : k + STRIDE * len(d_seen) : STRIDE]
            for c in range(DIMENSIONS):
                d_embed[:, c] += np.bincount(byte, d_seen[:, k * DIMENSIONS + c], 256)
        return [d_embed, np.concatenate([seen[:-1].T @ d_active, seen[1:].T @ d_active]), d_active.sum(0), d_out]


def train(texts: list[bytes], labels: np.ndarray, seed: int = 0) -> Network:
    """A network trained by Adam on logistic loss, both labels weighing the same together; the same for the same input."""
    net, r = Network.new(seed), np.random.default_rng(seed)
    weights = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    state, step = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.embed, net.filters, net.bias, net.out)], 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            data = np.frombuffer(b"".join(texts[k] for k in pick), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(texts[k]) for k in pick])])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for p, g, s in zip((net.embed, net.filters, net.bias, net.out), net.gradients(data, offsets, labels[pick], weights[pick] / len(pick)), state, strict=True):
                s[0] += 0.1 * (g - s[0])
                s[1] += 0.01 * (g * g - s[1])
                p -= (rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fitted(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> Network | None:
    """A network from at most SAMPLE_EACH documents of each label, those with the least hashes of doc_id; None if a label has none.

    Only rows whose crc32(doc_id as text) mod `folds` is not `held` count. A document with several labels takes part with the least, a doc_id of several texts
    with the least text. Of a text over SAMPLE_CHARS characters, stretches from its whole length serve; scoring always sees every byte.
    """
    spark = docs.sparkSession
    usable = labels.where((F.crc32(F.col("doc_id").cast("string")) % folds != held) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    usable = docs.where("text is not null").select("doc_id").join(usable, "doc_id").distinct()
    picked = [r for q in (0, 1) for r in usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_EACH).collect()]
    if len({r.quality for r in picked}) < 2:
        return None
    ids = spark.createDataFrame([(r.doc_id, r.quality) for r in picked], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int")
    rows = docs.select("doc_id", spread("text", SAMPLE_CHARS).alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    return train([r.text.encode() for r in rows], np.array([r.quality for r in rows]))


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs` (doc_id, text; others are not read).

    `labels` (doc_id, quality) serve for training alone, and of those only the rows outside the fold `held`. Every byte of every text is seen. Defined cases: a
    null text is an empty one, which has a score too; a null doc_id is not held out; repeated rows get equal scores; without labels of both kinds every score is
    0.5; an empty table gives no rows.
    """
    net = fitted(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), folds, held)
    out = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False)).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(2), SLICE_BYTES):
                score = np.full(b - a, 0.5) if net is None else net(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return out.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
