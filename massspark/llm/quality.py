"""A quality classifier: a convolutional network over bytes in NumPy, trained on labelled documents.

A text's bytes are embedded and convolved as a whole; responses are max-pooled over overlapping chunks that cover the text,
and the pooled chunks are combined, by their maximum, minimum and mean for each filter, into one probability. A filter that a
chunk of sound prose always answers somewhere is thus as telling as one that only junk answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massspark.llm.common import byte_view, mapped, slices
from massspark.llm.langid import held_out

#: Numbers of a byte's embedding, bytes of a filter, bytes from one place of a filter to the next, and filters.
EMBED, WIDTH, STRIDE, FILTERS = 8, 8, 2, 24
#: Bytes of a chunk, and of what it has in common with the next. Both are multiples of STRIDE.
CHUNK, OVERLAP = 128, 32
#: The learner reads so many labelled documents of each class, chosen by a hash of doc_id, and of them those of at most so many bytes.
FIT_DOCUMENTS, FIT_BYTES = 1500, 20_000
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.01, 1e-4
#: Chunks that are convolved at once.
_BLOCK = 128


@dataclass
class Network:
    """embedding (256, EMBED), filters (WIDTH * EMBED, FILTERS) with their bias, weights (3 * FILTERS) with theirs."""

    embedding: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.filter_bias, self.weights, self.bias]


def chunk_edges(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of a text of n bytes start and end: each shares OVERLAP bytes with the next, the last ends the text."""
    step = CHUNK - OVERLAP
    starts = np.arange(max(1, -(-(n - OVERLAP) // step))) * step
    return starts, np.minimum(starts + CHUNK, n)


def _laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes on end, each with zeros up to a multiple of STRIDE and WIDTH at least; its chunks' edges in them, and their rows."""
    sizes = np.diff(offsets)
    room = np.maximum(WIDTH, -(-sizes // STRIDE) * STRIDE)
    at = np.r_[0, np.cumsum(room)]
    flat = np.zeros(at[-1], np.uint8)
    flat[np.arange(len(data)) + np.repeat(at[:-1] - offsets[:-1], sizes)] = data
    edges = [chunk_edges(int(n)) for n in room]
    starts = np.concatenate([s + a for (s, _), a in zip(edges, at[:-1], strict=True)])
    ends = np.concatenate([e + a for (_, e), a in zip(edges, at[:-1], strict=True)])
    # the last chunk of a text may be shorter than a filter
    row = np.repeat(np.arange(len(sizes)), [len(s) for s, _ in edges])
    starts = np.maximum(np.minimum(starts, ends - WIDTH), at[row])
    return flat, starts, ends, row


def _responses(net: Network, flat: np.ndarray) -> np.ndarray:
    """The filters' answers at every STRIDE-th place of some bytes."""
    steps = len(flat) // STRIDE
    x = net.embedding[flat].reshape(steps, STRIDE * EMBED)
    places, width = steps - WIDTH // STRIDE + 1, STRIDE * EMBED
    out = x[:places] @ net.filters[:width]
    for k in range(1, WIDTH // STRIDE):
        out += x[k : k + places] @ net.filters[k * width : (k + 1) * width]
    return out


def pooled(net: Network, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """tanh of each filter's greatest answer in each chunk; chunks are taken in blocks, so memory doesn't grow with a text."""
    out = np.empty((len(starts), net.filters.shape[1]), np.float32)
    for k in range(0, len(starts), _BLOCK):
        s, e = starts[k : k + _BLOCK], ends[k : k + _BLOCK]
        answers = _responses(net, flat[s[0] : e[-1]])
        answers = np.concatenate([answers, np.full((1, answers.shape[1]), -np.inf, np.float32)])
        span = np.stack([(s - s[0]) // STRIDE, (e - s[0] - WIDTH) // STRIDE + 1], axis=1)
        out[k : k + _BLOCK] = np.maximum.reduceat(answers, span.ravel(), axis=0)[::2]
    return np.tanh(out + net.filter_bias)


def _combined(chunks: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The greatest, least and mean of the chunks of each row; every row has one."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    counts = np.diff(np.r_[first, len(row)])[:, None]
    return np.concatenate([np.maximum.reduceat(chunks, first), np.minimum.reduceat(chunks, first), np.add.reduceat(chunks, first) / counts], axis=1)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_texts(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if len(offsets) < 2:
        return np.zeros(0)
    flat, starts, ends, row = _laid_out(data, offsets)
    return _logistic((_combined(pooled(net, flat, starts, ends), row) @ net.weights + net.bias).astype(np.float64))


def gradients(net: Network, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean logistic loss, and its gradient by each part of the network. A maximum hands its gradient to the first place that has it."""
    flat, starts, ends, row = _laid_out(data, offsets)
    f = net.filters.shape[1]
    answers = _responses(net, flat)
    places = np.empty((len(starts), f), np.int64)
    for c, (s, e) in enumerate(zip(starts // STRIDE, (ends - WIDTH) // STRIDE + 1, strict=True)):
        places[c] = s + answers[s:e].argmax(axis=0)
    chunks = np.tanh(answers[places, np.arange(f)] + net.filter_bias)
    features = _combined(chunks, row)
    p = _logistic(features @ net.weights + net.bias)
    loss = float(-np.mean(np.log(np.where(labels == 1, p, 1 - p))))
    wrong = ((p - labels) / len(labels)).astype(np.float32)
    g = wrong[:, None] * net.weights  # by feature
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    counts = np.diff(np.r_[first, len(row)])
    by_chunk = (g[:, 2 * f :] / counts[:, None])[row]
    for part, pick in ((0, np.argmax), (1, np.argmin)):
        for r, (a, n) in enumerate(zip(first, counts, strict=True)):
            by_chunk[a + pick(chunks[a : a + n], axis=0), np.arange(f)] += g[r, part * f : (part + 1) * f]
    by_answer = by_chunk * (1 - chunks**2)
    codes = flat[places[:, :, None] * STRIDE + np.arange(WIDTH)]  # chunk, filter, byte
    inputs = net.embedding[codes].reshape(len(starts), f, WIDTH * EMBED)
    by_filter = np.einsum("cf,cfi->if", by_answer, inputs, optimize=True)
    by_input = (by_answer[:, :, None] * net.filters.T).reshape(-1, EMBED)
    by_embedding = np.stack([np.bincount(codes.ravel(), by_input[:, k], minlength=256) for k in range(EMBED)], axis=1)
    return loss, [by_embedding, by_filter, by_answer.sum(axis=0), features.T @ wrong, np.array([wrong.sum()])]


def learn(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network trained by Adam with a falling rate; the same texts in the same order give the same network."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(size=shape)
    net = Network(*(x.astype(np.float32) for x in (normal(256, EMBED), normal(WIDTH * EMBED, FILTERS) / np.sqrt(WIDTH * EMBED), np.zeros(FILTERS) - 2.0, 0.1 * normal(3 * FILTERS), np.zeros(1))))
    first, second = ([np.zeros_like(p) for p in net.parts()] for _ in range(2))
    total, turn = epochs * max(1, -(-len(texts) // BATCH)), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            offsets = np.r_[0, np.cumsum([len(texts[i]) for i in own])]
            _, slopes = gradients(net, np.frombuffer(b"".join(texts[i] for i in own), np.uint8), offsets, labels[own])
            turn += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * turn / total))
            for p, g, m, v in zip(net.parts(), slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**turn) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8) + DECAY * p)).astype(np.float32)
    return net


def fit(documents: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS, longest: int = FIT_BYTES) -> Network:
    """Trained on labelled documents that are not held out, about `most` of either class and no longer than `longest` bytes.

    A doc_id whose labels differ, and labels other than 0 and 1, teach nothing. The sample is picked among the labels by a hash
    of doc_id, so what is broadcast and what comes to the driver have the same bound at every size. Classes are learned from
    as many of each as there are; the bias then gets the odds of all labels. With one class alone or no label, all texts get
    one score: the share of label 1 among the labels with one more of each class.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").select("doc_id", "quality")
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    zero = Network(np.zeros((256, EMBED), np.float32), np.zeros((WIDTH * EMBED, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(3 * FILTERS, np.float32), np.array([np.log((ones + 1) / (zeros + 1))], np.float32))
    if not ones or not zeros:
        return zero
    of_class = F.when(F.col("quality") == 1, ones).otherwise(zeros)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) * of_class < most * 1_000_000)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text")).where(F.octet_length("text") <= longest)
    sample = sorted((r["doc_id"], bytes(r["text"]), r["quality"]) for r in texts.join(F.broadcast(chosen), "doc_id").collect())
    y = np.array([q for *_, q in sample])
    if not len(y) or y.min() == y.max():
        return zero
    net = learn([t for _, t, _ in sample], y)
    net.bias += np.float32(np.log(ones / zeros) - np.log(y.sum() / (1 - y).sum()))
    return net


def score(documents: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score (the probability of label 1), predicted (1 from a half on): one row per input row.

    Looks at the whole text only; a null text is scored as an empty one. A null doc_id is kept, as not held out; repeated
    rows are kept; other columns are ignored; an empty table gives an empty result. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            scores = score_texts(net, *byte_view(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.transform(mapped, run, "doc_id long, held_out boolean, score double, predicted int")
