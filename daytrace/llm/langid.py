"""Language identification by a byte convolutional network.

Filters of widths 2, 3 and 4 run over the bytes of fixed-length windows, each keeps its
largest value in the window, and a softmax turns these into languages. A text's prediction
is the mean of its windows' probabilities, weighted by their bytes, so that a passage in another
language counts by its length alone.

Training is numpy, on windows of a sample of at most `most` rows of each language. For
scoring, byte vectors and filters fold into tables: a filter of width 4 is the sum of two
numbers looked up by byte pairs. Windows overlap by three bytes, so that no filter position of
the whole text is left out; they are scored in batches of equal length.

Defined results: a null text, or one without a letter, is `und` with score 0; if nothing can be
learnt from, every text is `und`. An empty table gives no rows; a very long text is a slice of its own; rows
that repeat, and null ids, get their own (equal) predictions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fold, slices, table
from .labelled import sample_own

WIDTHS, FILTERS, EMBED, WINDOW = (2, 3, 4), 16, 8, 256
STEP = WINDOW - max(WIDTHS) + 1


class Network:
    def __init__(self, languages: list[str], rng: np.random.Generator):
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = {w: rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def step(self, x: np.ndarray, y: np.ndarray, squares: dict, rate: float) -> float:
        """One step of gradient descent on windows x (n, WINDOW) with languages y."""
        n, e = len(x), self.embed[x]
        pooled, where = [], []
        for w in WIDTHS:
            length = WINDOW - w + 1
            c = sum(e[:, j : j + length] @ self.filters[w][j] for j in range(w))
            at = c.argmax(1)
            pooled.append(np.take_along_axis(c, at[:, None], 1)[:, 0])
            where.append(at)
        h = np.maximum(np.concatenate(pooled, 1), 0)
        z = h @ self.out + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = float(-np.log(p[np.arange(n), y] + 1e-9).mean())
        p[np.arange(n), y] -= 1
        p /= n
        dh = (p @ self.out.T) * (h > 0)
        grads = {"out": h.T @ p, "bias": p.sum(0), "embed": np.zeros_like(self.embed)}
        rows = np.arange(n)[:, None]
        for k, w in enumerate(WIDTHS):
            d = dh[:, k * FILTERS : (k + 1) * FILTERS]
            g = np.zeros_like(self.filters[w])
            for j in range(w):
                b = x[rows, where[k] + j]
                v = self.embed[b]
                g[j] = np.einsum("nfe,nf->ef", v, d)
                np.add.at(grads["embed"], b.ravel(), (d[:, :, None] * self.filters[w][j].T[None]).reshape(-1, EMBED))
            grads[w] = g
        for name, g in grads.items():
            s = squares[name] = 0.95 * squares.get(name, 0) + 0.05 * g * g
            change = (rate * g / (np.sqrt(s) + 1e-6)).astype(np.float32)
            if name in self.filters:
                self.filters[name] -= change
            else:
                setattr(self, name, getattr(self, name) - change)
        return loss

    def tables(self) -> dict[str, np.ndarray]:
        """What a byte pair, or a byte, adds to each filter at its place."""
        one = {(w, j): self.embed @ self.filters[w][j] for w in WIDTHS for j in range(w)}
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        return {"2": pair(one[2, 0], one[2, 1]), "3": pair(one[3, 0], one[3, 1]), "3b": one[3, 2], "4": pair(one[4, 0], one[4, 1]), "4b": pair(one[4, 2], one[4, 3])}


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bytes that count, windows) over whole texts, the last window of each padded by zeros."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    n = np.where(lens > 0, np.maximum(0, -(-(lens - WINDOW) // STEP)) + 1, 0)
    flat = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    text = np.repeat(np.arange(len(texts)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(lens) - lens)[text] + k * STEP
    left = np.minimum(WINDOW, lens[text] - k * STEP)
    x = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[first].copy()
    short = np.flatnonzero(left < WINDOW)
    x[short] *= (np.arange(WINDOW) < left[short, None]).astype(np.uint8)
    return text, left, x


def predict(texts: list[bytes], languages: list[str], t: dict[str, np.ndarray], out: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's language number and probability."""
    text, left, x = cut(texts)
    total, weight = np.zeros((len(texts), len(languages))), np.zeros(len(texts))
    for at in range(0, len(x), 48):
        b = x[at : at + 48].T.astype(np.int32)  # bytes first: the largest value is taken over the first axis
        pairs = (b[:-1] << 8) | b[1:]
        h = np.empty((b.shape[1], 3 * FILTERS), np.float32)
        h[:, :FILTERS] = t["2"][pairs].max(0)
        c = t["3"][pairs[:-1]]
        c += t["3b"][b[2:]]
        h[:, FILTERS : 2 * FILTERS] = c.max(0)
        c = t["4"][pairs[:-2]]
        c += t["4b"][pairs[2:]]
        h[:, 2 * FILTERS :] = c.max(0)
        z = np.maximum(h, 0) @ out + bias
        z = z - z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        w = left[at : at + 48]
        np.add.at(total, text[at : at + 48], p * w[:, None])
        np.add.at(weight, text[at : at + 48], w)
    mean = total / np.maximum(weight, 1)[:, None]
    return mean.argmax(1), np.minimum(mean.max(1), 1.0)


def train(texts: list[bytes], labels: list[str], steps: int = 1000, batch: int = 48, rate: float = 0.01, seed: int = 4) -> Network | None:
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    net, squares = Network(languages, rng), {}
    text, left, x = cut(texts)
    y = np.array([languages.index(label) for label in labels])
    by = [np.flatnonzero(y[text] == i) for i in range(len(languages))]
    by = [b for b in by if len(b)]
    for k in range(steps if by else 0):
        some = np.concatenate([rng.choice(b, -(-batch // len(by))) for b in by])
        net.step(x[some], y[text[some]], squares, rate * (1 - 0.9 * k / steps))
    return net


SCORES = "doc_id long, held_out boolean, lang_pred string, score double"


def _predict(languages: list[str], t: dict, out: np.ndarray, bias: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            und = ~np.asarray(batch["letters"].to_pylist(), bool)
            best, p = predict(as_bytes(batch["text"]), languages, t, out, bias)
            names = np.where(und, "und", np.array(languages)[best])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(names.tolist(), pa.string()), pa.array(np.where(und, 0.0, p))], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, most: int = 300) -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred, score. Held out: crc32(doc_id as text) mod 5 is 0."""
    held = fold("doc_id", 5) == 0
    learn = docs.filter(~held & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").alias("label"))
    net = train(*sample_own(learn, most))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), letters.alias("letters"), "text")
    if net is None:
        return d.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return d.mapInArrow(_predict(net.languages, net.tables(), net.out, net.bias), SCORES)


def op7(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
