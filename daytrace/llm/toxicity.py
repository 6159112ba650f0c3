"""A bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is its hashed vector beside the mean of the vectors of its byte n-grams (1.4
with word boundaries: 3, 4 and 6). Texts are cut into overlapping windows of words; both
directions read each window, attention pools the states, a logistic unit scores the window.
A text scores by its strongest window, through a logistic curve fitted on the sample.

Training is numpy: backpropagation through time on windows of a sample of at most `most`
labelled rows of each label. A toxic text's label holds for some window, not for all: at first
all its windows stand for it, then its strongest ones by the network itself; beside them each
round learns from as many of the clean texts' windows that look worst, and from others at random. A
round passes over its windows `passes` times at most, and not beyond `budget` windows. A fifth of
the sample is held back: it fits the curve. In half of the windows some words are made unknown, so
that words which training has not met carry no weight. One network is trained, whatever the size of the sample. Scoring covers all windows of all texts, every word
of them; recurrences run over many windows at once.

Defined results: a null, empty or word-less text scores by the prior of the curve; if only
one label (or none) can be learnt from, every score is the share of label 1 (0 without labels). An empty
table gives no rows; a very long text is a slice of its own, all its windows are read; rows that repeat, and
null ids, get their own (equal) scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ids, as_bytes, fold, slices, table
from .labelled import ngrams, sample

WINDOW, STEP = 48, 36
WORD_BUCKETS, CHAR_BUCKETS, WORD_WIDTH, CHAR_WIDTH, STATE = 1 << 13, 1 << 14, 8, 16, 8
SIZES = (3, 4, 6)
#: The share of training windows some of whose words are made unknown.
UNKNOWN = 0.5
#: Clean windows that a round draws at random, and those that look worst, at least (or all there are).
LEAST_OTHER, LEAST_HARD = 400, 100
#: A text of this score or more is predicted to be toxic.
CUT = 0.7
#: How far the curve's cut lies from the lowest row found towards the next below it: rows learnt by heart leave a wide gap, and toxic texts that training hasn't seen score low in it.
DOWN = 0.75


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def numbered(text: bytes, ids: Ids) -> np.ndarray:
    """The words' numbers."""
    w = text.lower().split()
    return np.fromiter(map(ids.__getitem__, w), np.int32, len(w))


def windows(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, length) of each window over texts of so many words laid end to end. Each text of words has at least one."""
    n = np.where(lens > 0, np.maximum(0, -(-(lens - WINDOW) // STEP)) + 1, 0)
    text = np.repeat(np.arange(len(lens)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    starts = np.cumsum(lens) - lens
    return text, starts[text] + k * STEP, np.minimum(WINDOW, lens[text] - k * STEP)


class Network:
    """Parameters, the forward pass over windows, and its gradient."""

    def __init__(self, rng: np.random.Generator):
        d = WORD_WIDTH + CHAR_WIDTH
        # what training never meets stays zero, the input of an unknown word
        self.words = np.zeros((WORD_BUCKETS, WORD_WIDTH), np.float32)
        self.chars = np.zeros((CHAR_BUCKETS, CHAR_WIDTH), np.float32)
        self.p = {}
        for way in "fb":
            self.p["w" + way] = rng.normal(0, d**-0.5, (d, 3 * STATE)).astype(np.float32)
            self.p["u" + way] = rng.normal(0, STATE**-0.5, (STATE, 3 * STATE)).astype(np.float32)
            self.p["c" + way] = np.zeros(3 * STATE, np.float32)
        self.p["att"] = rng.normal(0, 0.3, 2 * STATE).astype(np.float32)
        self.p["out"] = rng.normal(0, 0.3, 2 * STATE).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)
        self.slope, self.shift, self.prior = 1.0, 0.0, 0.0

    def inputs(self, vocabulary: list[bytes]) -> tuple[np.ndarray, tuple]:
        """The input of each word, and what its gradient needs."""
        owner, bucket, whole = ngrams(vocabulary, SIZES, CHAR_BUCKETS)
        whole = whole % WORD_BUCKETS
        order = np.argsort(owner, kind="stable")
        owner, bucket = owner[order], bucket[order]
        count = np.maximum(np.bincount(owner, minlength=len(vocabulary)), 1).astype(np.float32)
        chars = np.stack([np.bincount(owner, self.chars[bucket, j], len(vocabulary)) for j in range(CHAR_WIDTH)], 1) if len(vocabulary) else np.zeros((0, CHAR_WIDTH))
        return np.concatenate([self.words[whole], (chars / count[:, None]).astype(np.float32)], 1), (owner, bucket, whole, count)

    def forward(self, gates: dict[str, np.ndarray], index: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of windows. gates: for each way, the input part of each word's gates; index: (steps, windows), padded at the end."""
        steps, n = index.shape
        states, tape = np.zeros((steps, n, 2 * STATE), np.float32), {}
        live = np.arange(steps)[:, None] < length
        for way, part, order in (("f", slice(0, STATE), range(steps)), ("b", slice(STATE, 2 * STATE), range(steps - 1, -1, -1))):
            h, u, g = np.zeros((n, STATE), np.float32), self.p["u" + way], gates[way]
            tape[way] = []
            for t in order:
                x = g[index[t]]
                a = h @ u
                zr = _quick(x[:, : 2 * STATE] + a[:, : 2 * STATE])
                z, r = zr[:, :STATE], zr[:, STATE:]
                c = np.tanh(x[:, 2 * STATE :] + r * a[:, 2 * STATE :])
                new = h + z * (c - h)
                new = np.where(live[t][:, None], new, h) if not live[t].all() else new
                if keep:
                    tape[way].append((t, h, z, r, c, a[:, 2 * STATE :]))
                h = new
                states[t, :, part] = h
        e = states @ self.p["att"]
        e = np.where(live, e, -1e9)
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = np.einsum("tn,tnk->nk", alpha, states)
        z = pooled @ self.p["out"] + self.p["bias"][0]
        return (z, states, alpha, pooled, live, tape) if keep else z

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {way: x @ self.p["w" + way] + self.p["c" + way] for way in "fb"}

    def gradient(self, x: np.ndarray, index: np.ndarray, length: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """The gradient of the weighted log loss: of the parameters, and of the words' inputs."""
        z, states, alpha, pooled, live, tape = self.forward(self.gates(x), index, length, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        dz = ((_sigmoid(z) - y) * weight / weight.sum()).astype(np.float32)
        g["out"], g["bias"] = dz @ pooled, np.array([dz.sum()], np.float32)
        dpool = dz[:, None] * self.p["out"]
        ds = alpha[:, :, None] * dpool
        dalpha = np.einsum("tnk,nk->tn", states, dpool)
        de = alpha * (dalpha - (alpha * dalpha).sum(0))
        g["att"] = np.einsum("tn,tnk->k", de, states)
        ds += de[:, :, None] * self.p["att"]
        dx = np.zeros_like(x)
        for way, part in (("f", slice(0, STATE)), ("b", slice(STATE, 2 * STATE))):
            u, w = self.p["u" + way], self.p["w" + way]
            dgates = np.zeros((len(x), 3 * STATE), np.float32)
            dh = np.zeros((index.shape[1], STATE), np.float32)
            for t, h, zt, r, c, ah in reversed(tape[way]):
                dh = dh + ds[t, :, part]
                on = live[t][:, None]
                d = np.where(on, dh, 0)
                dzg = d * (c - h) * zt * (1 - zt)
                dc = d * zt * (1 - c * c)
                drg = dc * ah * r * (1 - r)
                da = np.concatenate([dzg, drg, dc * r], 1)
                g["u" + way] += h.T @ da
                np.add.at(dgates, index[t], np.concatenate([dzg, drg, dc], 1))
                dh = np.where(on, d * (1 - zt), dh) + da @ u.T
            g["w" + way] = x.T @ dgates
            g["c" + way] = dgates.sum(0)
            dx += dgates @ w.T
        return g, dx

    def window_logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, logit) of every window."""
        ids = Ids()
        words = [numbered(t, ids) for t in texts]
        lens = np.fromiter(map(len, words), np.int64, len(words))
        text, first, length = windows(lens)
        out = np.zeros(len(text), np.float32)
        if not len(text):
            return text, out
        flat = np.concatenate([*words, np.zeros(WINDOW, np.int32)])
        gates = self.gates(self.inputs(list(ids))[0])
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(order), 1024):
            some = order[at : at + 1024]
            steps = int(length[some[0]])
            out[some] = self.forward(gates, flat[first[some] + np.arange(steps)[:, None]], length[some])
        return text, out

    def logits(self, texts: list[bytes]) -> np.ndarray:
        text, z = self.window_logits(texts)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, z)
        return np.where(np.isfinite(best), self.slope * np.where(np.isfinite(best), best, 0) + self.shift, self.prior)


def _quick(x: np.ndarray) -> np.ndarray:
    """The logistic function by tanh, which numpy vectorises."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def train(texts: list[bytes], labels: list[int], rounds: int = 6, passes: int = 30, budget: int = 10_000, batch: int = 128, rate: float = 0.02, seed: int = 9) -> Network:
    rng = np.random.default_rng(seed)
    net, y = Network(rng), np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 1e-3
        net.slope, net.shift = 0.0, float(np.log(p / (1 - p)))
        net.prior = net.shift
        return net
    aside = np.arange(len(y)) % 5 == 4
    if y[aside].sum() < 10 or y[~aside].min() == y[~aside].max():  # too few to hold some back
        aside[:] = False
    held = [(t, k) for t, k, of in zip(texts, labels, aside, strict=True) if of or not aside.any()]
    texts, y = [t for t, of in zip(texts, aside, strict=True) if not of], y[~aside]
    ids = Ids()
    words = [numbered(t, ids) for t in texts]
    text, first, length = windows(np.fromiter(map(len, words), np.int64, len(words)))
    flat, vocabulary = np.concatenate([*words, np.zeros(WINDOW, np.int32)]), list(ids)
    toxic = y[text] == 1
    clean, theirs = np.flatnonzero(~toxic), np.flatnonzero(toxic)
    squares = {k: np.zeros_like(v) for k, v in net.p.items()} | {"words": np.zeros((WORD_BUCKETS, 1), np.float32), "chars": np.zeros((CHAR_BUCKETS, 1), np.float32)}
    owner, bucket, whole = ngrams(vocabulary, SIZES, CHAR_BUCKETS)
    order = np.argsort(owner, kind="stable")
    bucket, count = bucket[order], np.bincount(owner, minlength=len(vocabulary))
    begin = np.cumsum(count) - count
    z = np.zeros(len(text), np.float32)
    common = np.zeros(len(vocabulary), bool)
    for t, toxic_text in zip(words, y == 1, strict=True):
        common[t] |= not toxic_text
    for turn in range(rounds):
        if turn:
            z[theirs] = _logits_of(net, vocabulary, flat, first[theirs], length[theirs])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text[theirs], z[theirs])
        use = theirs[z[theirs] >= best[text[theirs]] - 0.5]
        other = rng.choice(clean, min(len(clean), max(2 * len(use), LEAST_OTHER)), replace=False)
        hard = np.zeros(0, np.int64)
        if turn and len(clean):
            zc = _logits_of(net, vocabulary, flat, first[clean], length[clean])
            hard = clean[np.argsort(-zc)[: max(len(use), LEAST_HARD)]]
        chosen = np.concatenate([use, other, hard])
        for _ in range(max(1, min(passes, budget // max(1, len(chosen))))):
            order = rng.permutation(chosen)
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                steps = int(length[some].max())
                index = flat[first[some] + np.arange(steps)[:, None]]
                used, where = np.unique(index, return_inverse=True)
                k = count[used]
                rows = np.repeat(np.arange(len(used)), k)
                b = bucket[np.repeat(begin[used], k) + np.arange(len(rows)) - np.repeat(np.cumsum(k) - k, k)]
                share = 1 / np.maximum(k, 1).astype(np.float32)
                chars = np.stack([np.bincount(rows, net.chars[b, j], len(used)) for j in range(CHAR_WIDTH)], 1) * share[:, None]
                x = np.concatenate([net.words[whole[used] % WORD_BUCKETS], chars.astype(np.float32)], 1)
                weight = np.where(y[text[some]] == 1, 1.0, max(1, len(use)) / max(1, len(other) + len(hard)))
                index, x = _unknown(rng, where.reshape(index.shape), x, y[text[some]] == 1, common[used])
                g, dx = net.gradient(x, index, length[some], y[text[some]], weight)
                dx = dx[: len(used)] + np.concatenate([np.zeros((len(used), WORD_WIDTH), np.float32), dx[len(used) : 2 * len(used), WORD_WIDTH:]], 1)
                for name, grad in g.items():
                    squares[name] = 0.95 * squares[name] + 0.05 * grad * grad
                    net.p[name] = net.p[name] - (rate * 0.5 * grad / (np.sqrt(squares[name]) + 1e-6)).astype(np.float32)
                for name, table_, rows_, grad in (("words", net.words, whole[used] % WORD_BUCKETS, dx[:, :WORD_WIDTH]), ("chars", net.chars, b, dx[rows, WORD_WIDTH:] * share[rows][:, None])):
                    at_rows, back = np.unique(rows_, return_inverse=True)
                    total = np.stack([np.bincount(back, grad[:, j], len(at_rows)) for j in range(grad.shape[1])], 1).astype(np.float32)
                    squares[name][at_rows] += (total * total).mean(1, keepdims=True)
                    table_[at_rows] -= rate * 4 * total / (np.sqrt(squares[name][at_rows]) + 1e-7)
    _calibrate(net, [t for t, _ in held], np.array([k for _, k in held], np.float32))
    return net


def _unknown(rng: np.random.Generator, index: np.ndarray, x: np.ndarray, toxic: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and character dropout: in half of the windows any share of the words becomes unknown, each known by its characters still or not at all.

    So the network learns that unknown words are no evidence. In toxic windows only words that clean texts have, too, become unknown.
    Behind the inputs x come those without the words' vectors, and one of nothing.
    """
    steps, n = index.shape
    share = np.where(rng.random(n) < UNKNOWN, rng.random(n), 0)
    gone = (rng.random((steps, n)) < share) & (~toxic | common[index])
    bare = x.copy()
    bare[:, :WORD_WIDTH] = 0
    to = np.where(rng.random((steps, n)) < 0.5, index + len(x), 2 * len(x))
    return np.where(gone, to, index), np.concatenate([x, bare, np.zeros((1, x.shape[1]), x.dtype)])


def _logits_of(net: Network, vocabulary: list[bytes], flat: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    gates = net.gates(net.inputs(vocabulary)[0])
    out = np.zeros(len(first), np.float32)
    for at in range(0, len(first), 2048):
        a, n = first[at : at + 2048], length[at : at + 2048]
        out[at : at + 2048] = net.forward(gates, flat[a + np.arange(int(n.max()))[:, None]], n)
    return out


def _calibrate(net: Network, texts: list[bytes], y: np.ndarray) -> None:
    """A logistic curve from the strongest window's logit to the label: it passes CUT where the F1 measure of these rows is best.

    Toxic rows weigh a tenth of all in it, about their share among labels; of equally good places the widest gap counts, at DOWN.
    """
    z = net.logits(texts).astype(float)
    p = min(max(float(y.mean()), 1e-3), 0.1)
    net.prior = float(np.log(p / (1 - p)))
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    found, false = np.cumsum(y) / max(y.sum(), 1) * 0.1, np.cumsum(1 - y) / max((1 - y).sum(), 1) * 0.9
    f1 = 2 * found / (found + false + 0.1)
    gap = z - np.append(z[1:], z[-1] - 1)
    at = max(range(len(z)), key=lambda i: (round(float(f1[i]), 9) if gap[i] > 0 else -1, gap[i]))
    net.slope, net.shift = 1.0, float(np.log(CUT / (1 - CUT)) - z[at] + gap[at] * DOWN)


def _score(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            p = _sigmoid(net.logits(as_bytes(batch["text"])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(p)], names=["doc_id", "held_out", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, most: int = 800, **training) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted. Held out: crc32(doc_id as text) mod 3 is 1. training: arguments of train()."""
    held = fold("doc_id", 3) == 1
    net = train(*sample(docs, labels, "toxic", ~held, most), **training)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    scored = d.mapInArrow(_score(net), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op5(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
