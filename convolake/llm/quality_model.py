"""Quality classifier: supervised subword embeddings with softmax output, trained with numpy.

A document is the average of learned vectors of its words and of the character n-grams (code points)
inside them, all hashed to `buckets` rows. A softmax over two classes reads the average and the logarithm
of its squares: the average of few different features lies far from that of many, whichever they are, so texts
that say the same again and again stand out although their words were never met. Embedding and output layer
are trained together by stochastic gradient descent on a bounded, documented sample of labelled
documents (`most_labels`), drawn by a hash of their ids. A batch looks each distinct word up once.
Buckets that training never met keep their random vectors.

Defined results: null and text without words score the model's bias, as their average is 0; repeated rows score alike;
labels that are null are not learned from; an empty label table scores 0.5; only doc_id and text of
the documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolake.llm.common import held_out
from convolake.llm.kernels import Texts, bracketed, character_ngrams, texts, trimming


@dataclass
class SubwordModel:
    """vectors: buckets x dim; spread: what the average's coordinates are measured by; out: weights of the coordinates and of the logarithms of their squares."""

    vectors: np.ndarray
    spread: np.ndarray
    out: np.ndarray
    bias: float
    lo: int
    hi: int

    def score(self, t: Texts) -> np.ndarray:
        bucket, word, which, where, n = word_features(t, len(self.vectors), self.lo, self.hi)
        many = np.bincount(word, minlength=n).astype(float)
        size = np.maximum(np.bincount(where, many[which], len(t)), 1)
        logit = np.full(len(t), self.bias)
        dim = self.vectors.shape[1]
        for d in range(dim):
            total = np.bincount(word, self.vectors[bucket, d], n)
            x = np.bincount(where, total[which], len(t)) / size / self.spread[d]
            logit += self.out[d] * x + self.out[dim + d] * np.log1p(x * x)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def word_features(t: Texts, buckets: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    starts, ends, where = t.words()
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, where, 0
    code = t.hashes(starts, ends)
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    own = bracketed(t, starts[first], ends[first])
    bucket, word = character_ngrams(own, lo, hi, buckets)
    n = len(first)
    bucket = np.concatenate([bucket, ((code[first] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)])
    return bucket, np.concatenate([word, np.arange(n)]), which, where, n


def fit(sample: list[tuple[str, int]], *, buckets: int = 1 << 17, dim: int = 8, lo: int = 3, hi: int = 5, epochs: int = 12, least_steps: int = 600, batch: int = 32, rate: float = 1.0, l2: float = 1e-5, seed: int = 5) -> SubwordModel:
    """Trains on (text, label) pairs; labels 0 and 1."""
    if not sample:
        return SubwordModel(np.zeros((buckets, dim), np.float32), np.ones(dim), np.zeros(2 * dim), 0.0, lo, hi)
    rng = np.random.default_rng(seed)
    y = np.array([label for _, label in sample], np.int64)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for _, _, t in texts(pa.array([text for text, _ in sample], pa.string())):
        bucket, word, which, where, n = word_features(t, buckets, lo, hi)
        order = np.argsort(word, kind="stable")
        bucket, many = bucket[order], np.bincount(word, minlength=n)
        begin = np.cumsum(many) - many
        cut = np.searchsorted(where, np.arange(len(t) + 1))
        for i in range(len(t)):
            words, times = np.unique(which[cut[i] : cut[i + 1]], return_counts=True)
            size = many[words]
            at = np.repeat(begin[words], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            own, inverse = np.unique(bucket[at], return_inverse=True)
            weight = np.bincount(inverse, np.repeat(times, size), len(own))
            rows.append((own.astype(np.int32), (weight / max(1, weight.sum())).astype(np.float32)))
    met = np.unique(np.concatenate([r[0] for r in rows]))
    rows = [(np.searchsorted(met, f), share) for f, share in rows]
    whole = rng.normal(0, 1, (buckets, dim)).astype(np.float32)
    vectors = whole[met]
    average = lambda f, share, who, n: np.stack([np.bincount(who, vectors[f, d] * share, n) for d in range(dim)], 1)
    first = np.concatenate([average(f, share, np.zeros(len(f), np.int64), 1) for f, share in rows if len(f)] or [np.ones((1, dim))])
    spread = np.sqrt(np.median(first * first, axis=0) + 1e-12)
    out = np.zeros(2 * dim)
    good = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(good / (1 - good)))
    epochs = max(epochs, -(-least_steps * batch // len(rows)))  # few rows are seen more often
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        step = rate * (1 - epoch / epochs)
        for lo_row in range(0, len(order), batch):
            own = order[lo_row : lo_row + batch]
            f = np.concatenate([rows[i][0] for i in own])
            share = np.concatenate([rows[i][1] for i in own])
            who = np.repeat(np.arange(len(own)), [len(rows[i][0]) for i in own])
            x = average(f, share, who, len(own)) / spread
            seen = np.concatenate([x, np.log1p(x * x)], 1)
            error = (1 / (1 + np.exp(-np.clip(seen @ out + bias, -30, 30))) - y[own]) / len(own)
            pull = np.clip(error[:, None] * (out[:dim] + out[dim:] * 2 * x / (1 + x * x)) / spread, -1, 1)  # a step stays bounded
            out -= step * (seen.T @ error + l2 * out)
            bias -= step * float(error.sum())
            for d in range(dim):
                vectors[:, d] -= (step * np.bincount(f, pull[who, d] * share, len(met))).astype(np.float32)
    whole[met] = vectors
    return SubwordModel(whole, spread, out, bias, lo, hi)


def training_sample(docs: DataFrame, labels: DataFrame, most_labels: int) -> list[tuple[str, int]]:
    """Texts of at most most_labels labelled ids that are not held out, the first by a hash of the id; at most twice as many texts."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    found = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # most_labels rows at most
    rows = found.select("doc_id", "text", "quality").limit(2 * most_labels).collect()  # ids may be repeated
    return [(r[1], int(r[2])) for r in sorted(rows, key=lambda r: (r[0], r[1]))]


def score_quality(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """doc_id and score (the probability of label 1) of every whole text; nothing is shuffled."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x dim x 4 bytes

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in trimming(batches):
            for lo, hi, t in texts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(own.score(t))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scores, schema)


def classify_quality(docs: DataFrame, labels: DataFrame, *, most_labels: int = 3000, threshold: float = 0.7, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from at most most_labels documents."""
    model = fit(training_sample(docs, labels, most_labels), **fitting)
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
