"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged per document, softmax.

Features of a text: each word, its byte n-grams of 3 and 4 with word boundaries, and each
word bigram. The vectors and the softmax are trained by minibatch stochastic gradient descent with AdaGrad steps in
numpy, on a sample of at most `most` labelled rows of each label.

The document's logit is linear in the average, so that tasks need one number and one count
for each distinct word of a slice of texts; all texts are scored whole.

Defined results: an empty or null text scores by the prior alone; if only one label (or
none) can be learnt from, every score is the share of label 1 (0.5 without labels). An empty table
gives no rows; a very long text is a slice of its own; rows that repeat, and null ids, get their own (equal) scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ids, as_bytes, fold, slices, table
from .labelled import ngrams, sample

BUCKETS, WIDTH, SIZES = 1 << 16, 16, (3, 4)


def bigrams(whole: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The bucket of each pair of neighbours; whole: the words' buckets, w: the text's words."""
    with np.errstate(over="ignore"):
        pair = (whole[w[:-1]].astype(np.uint64) << np.uint64(17)) + whole[w[1:]].astype(np.uint64) + np.uint64(1)
        return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % BUCKETS


class Model:
    """What tasks need: a number for each feature, and the bias."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value, bias

    def logits(self, texts: list[bytes]) -> np.ndarray:
        ids = Ids()
        words = [np.fromiter(map(ids.__getitem__, w), np.int64, len(w)) for w in (t.split() for t in texts)]
        owner, bucket, whole = ngrams(list(ids), SIZES, BUCKETS)
        total = np.bincount(owner, self.value[bucket], len(ids)) + self.value[whole]
        count = np.bincount(owner, minlength=len(ids)) + 1
        out = np.full(len(texts), self.bias)
        for i, w in enumerate(words):
            if len(w):
                out[i] += (total[w].sum() + self.value[bigrams(whole, w)].sum()) / (count[w].sum() + len(w) - 1)
        return out


def _features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text: its distinct features and their shares of all its features."""
    out = []
    for t in texts:
        ids = Ids()
        w = np.fromiter(map(ids.__getitem__, t.split()), np.int64)
        if not len(w):
            out.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        owner, bucket, whole = ngrams(list(ids), SIZES, BUCKETS)
        times = np.bincount(w)
        pairs = bigrams(whole, w)
        f, where = np.unique(np.concatenate([bucket, whole, pairs]), return_inverse=True)
        n = np.bincount(where, np.concatenate([times[owner], times, np.ones(len(pairs))]))
        out.append((f, n / n.sum()))
    return out


def train(texts: list[bytes], labels: list[int], rounds: int = 8, batch: int = 16, rate: float = 0.5, seed: int = 5) -> Model:
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    rows = _features(texts)
    e = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    out, bias = np.zeros((2, WIDTH)), np.zeros(2)
    e2, out2, bias2 = np.full((BUCKETS, 1), 1e-8), np.full((2, WIDTH), 1e-8), np.full(2, 1e-8)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            hidden = np.stack([rows[i][1] @ e[rows[i][0]] for i in some])
            z = hidden @ out.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some].astype(int)] -= 1
            back = p @ out
            for g, w, s in ((p.T @ hidden / len(some), out, out2), (p.mean(0), bias, bias2)):
                s += g * g
                w -= rate * 0.2 * g / np.sqrt(s)
            for i, g in zip(some, back, strict=True):
                f, share = rows[i]
                e2[f, 0] += share * share * (g @ g) / WIDTH
                e[f] -= rate * 0.2 * (share / np.sqrt(e2[f, 0]))[:, None] * g
    d = out[1] - out[0]
    return Model(e @ d, float(bias[1] - bias[0]))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            p = 1 / (1 + np.exp(-np.clip(model.logits(as_bytes(batch["text"])), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(p)], names=["doc_id", "held_out", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, most: int = 1500) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted. Held out: crc32(doc_id as text) mod 5 is 0."""
    held = fold("doc_id", 5) == 0
    model = train(*sample(docs, labels, "quality", ~held, most))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    scored = d.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
