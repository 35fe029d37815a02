"""A quality classifier: random-indexing word vectors, pooled, then a small network.

Words are as they stand, marks between them words of their own; a word that
repeats the one before it counts a mark of its own beside it. Every word has a sparse ternary index vector, drawn from its hash. A word's
vector is its own index vector plus those of its neighbours in the fitting
texts; a document's is the mean of its words'. A two-layer network in numpy,
its probabilities calibrated by a temperature on rows it was not fitted to,
turns that into a score.

Fitting takes a bounded sample of labelled rows and runs in one task; the model
that comes back is of a fixed size and is broadcast. Scoring is a map over the
texts: nothing is shuffled.
"""

from __future__ import annotations

import pickle
import re
import zlib
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_slices

#: labelled rows that are fitted to at most, taken by the md5 of their doc_id
SAMPLE_ROWS = 6000
#: bytes of their texts at about which no further row is taken
SAMPLE_BYTES = 100_000_000
#: words with a vector at most, by frequency in the sample; others go by their shape
VOCABULARY = 20_000
DIMENSIONS = 96
HIDDEN = 32
THRESHOLD = 0.3

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
SHAPES = ["<empty>", "<lower>", "<upper>", "<title>", "<mixed>", "<digits>", "<marks>", "<again>"]
#: the row of the mark that follows a word which is the same as the one before it, and how often it counts
AGAIN, AGAIN_TIMES = 7, 4


def shape(token: str) -> int:
    """The number of a token's shape, for words without a vector of their own."""
    if token.isdigit():
        return 5
    if not token[0].isalnum():
        return 6
    if token.islower():
        return 1
    if token.isupper() and len(token) > 1:
        return 2
    return 3 if token.istitle() else 4


class Rows(dict):
    """Token to row of the vectors; unseen tokens get the row of their shape."""

    KEPT = 200_000

    def __missing__(self, token: str) -> int:
        row = shape(token)
        if len(self) < self.KEPT:
            self[token] = row
        return row


def index_vectors(words: list[str]) -> np.ndarray:
    """Sparse ternary vectors: 8 places of each word's hash, signs alternating."""
    out = np.zeros((len(words), DIMENSIONS), dtype=np.float32)
    for i, w in enumerate(words):
        rng = np.random.default_rng(zlib.crc32(w.encode()))
        out[i, rng.choice(DIMENSIONS, 8, replace=False)] = (1, -1) * 4
    return out


class QualityModel:
    def __init__(self, words: list[str], vectors: np.ndarray, layers: list[np.ndarray], temperature: float, prior: float):
        self.words, self.vectors, self.layers, self.temperature, self.prior = words, vectors, layers, temperature, prior
        self.rows: Rows | None = None

    def pooled(self, text: str) -> np.ndarray:
        if self.rows is None:
            self.rows = Rows({w: i for i, w in enumerate(self.words)})
        tokens = TOKEN.findall(text)
        if not tokens:
            return self.vectors[0]
        ids = np.fromiter(map(self.rows.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        again = AGAIN_TIMES * sum(map(eq, tokens, islice(tokens, 1, None)))
        total = self.vectors[AGAIN] * np.float32(again)
        for at in range(0, len(ids), 16384):
            total += self.vectors[ids[at : at + 16384]].sum(0)
        return total / np.float32(len(ids) + again)

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of label 1 for each text, the empty one too."""
        if not texts:
            return np.zeros(0)
        if not self.layers:
            return np.full(len(texts), self.prior)
        x = np.stack([self.pooled(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(_logits(self.layers, x) / self.temperature, -500, 500)))


def _logits(layers: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2, mean, scale = layers
    return np.tanh(((x - mean) / scale) @ w1 + b1) @ w2 + b2[0]


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> QualityModel:
    """A model of texts and 0/1 labels. With no rows or one label only, every score is the (smoothed) share of label 1."""
    prior = (float(labels.sum()) + 1) / (len(labels) + 2)
    if len(labels) < 20 or labels.min() == labels.max():
        return QualityModel(SHAPES, np.zeros((len(SHAPES), DIMENSIONS), np.float32), [], 1.0, prior)
    counts: dict[str, int] = {}
    tokens = [TOKEN.findall(t) for t in texts]
    for ts in tokens:
        for t in ts:
            counts[t] = counts.get(t, 0) + 1
    frequent = sorted((w for w, c in counts.items() if c >= 3), key=lambda w: (-counts[w], w))[:VOCABULARY]
    words = SHAPES + frequent
    rows = Rows({w: i for i, w in enumerate(words)})
    index = index_vectors(words)
    vectors = index * 1.0
    n = len(words)
    seen = np.zeros(n)
    context = np.zeros_like(index)
    for begin in range(0, len(tokens), 500):
        part = tokens[begin : begin + 500]
        ids = np.concatenate([np.r_[np.fromiter(map(rows.__getitem__, ts), np.int64, len(ts)), -1, -1] for ts in part])
        seen += np.bincount(ids[ids >= 0], minlength=n)
        for far in (1, 2):
            a, b = ids[:-far], ids[far:]
            both = (a >= 0) & (b >= 0)
            for x, y in ((a[both], b[both]), (b[both], a[both])):
                key, times = np.unique(x * n + y, return_counts=True)
                left, right = key // n, key % n
                for at in range(0, len(key), 200_000):
                    l, r = left[at : at + 200_000], right[at : at + 200_000]
                    starts = np.flatnonzero(np.r_[True, l[1:] != l[:-1]])
                    context[l[starts]] += np.add.reduceat(index[r] * times[at : at + 200_000, None].astype(np.float32), starts, axis=0)
    vectors += context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6) * 2
    vectors = vectors.astype(np.float32)
    model = QualityModel(words, vectors, [], 1.0, prior)
    x = np.stack([model.pooled(t) for t in texts]).astype(np.float64)
    y = labels.astype(np.float64)
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), dtype=bool)
    held[rng.permutation(len(y))[: max(4, len(y) // 6)]] = True
    layers = _train(x[~held], y[~held], rng)
    z = _logits(layers, x[held])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, z / t) - y[held] * z / t) for t in grid]
    model.layers, model.temperature = layers, float(grid[int(np.argmin(loss))])
    return model


def _train(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 60, step: float = 3e-3, decay: float = 1e-3) -> list[np.ndarray]:
    """The layers, by Adam on the logistic loss."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            hidden = np.tanh(x[rows] @ layers[0] + layers[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3][0], -500, 500))) - y[rows]) / len(rows)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            grads = [x[rows].T @ back + decay * layers[0], back.sum(0), hidden.T @ error + decay * layers[2], np.array([error.sum()])]
            t += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - step * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return [*layers, mean, scale]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from fitting: crc32 of doc_id as text, mod 5, is 0. A null doc_id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fitted(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """The model of the labelled rows that aren't held out: SAMPLE_ROWS of them at most, by the md5 of doc_id, while their texts are within SAMPLE_BYTES.

    A doc_id with several labels counts by the highest; rows without a text or a
    quality are left out.
    """
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(SAMPLE_ROWS)
    turn = F.md5(F.col("doc_id").cast("string").cast("binary"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("turn", turn)

    def run(frames):
        import pandas as pd

        parts, size = [], 0
        for f in frames:
            before = size + f["text"].str.len().cumsum().shift(fill_value=0)
            parts.append(f[before < SAMPLE_BYTES])
            size += int(f["text"].str.len().sum())
        rows = pd.concat(parts).sort_values(["doc_id", "text"]) if parts else pd.DataFrame({"text": [], "quality": []})
        model = fit(rows["text"].tolist(), rows["quality"].to_numpy(dtype=np.int64) if len(rows) else np.zeros(0, np.int64))
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    made = texts.repartition(1).sortWithinPartitions("turn", "doc_id", "text").mapInPandas(run, "model binary").first()
    return pickle.loads(made["model"]) if made else fit([], np.zeros(0, np.int64))  # without rows there may be no task


def score(docs: DataFrame, model: QualityModel, keep: list[str] | None = None, to: str = "score") -> DataFrame:
    """The columns keep of docs (doc_id alone unless said otherwise), with the score added under the name to.

    A null text counts as the empty one. Rows that repeat stay.
    """
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructField, StructType

    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    held: dict = {}

    def run(batches):
        if "model" not in held:
            held["model"] = pickle.loads(sent.value)
        for b in text_slices(batches, "text"):
            found = held["model"].scores([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(found, pa.float64())], [*keep, to])

    schema = StructType([*(docs.schema[c] for c in keep), StructField(to, DoubleType())])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def classified(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, fitted(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold or more, with all columns of docs."""
    name = fresh(docs.columns, "score")
    return score(docs, fitted(docs, labels), docs.columns, name).where(F.col(name) >= threshold).select(*docs.columns)
