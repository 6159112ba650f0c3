"""Bounded samples of labelled rows for fitting, and rows of hashed features of words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the driver holds of a draw: at most so many rows of all labels together, none with a longer text (in bytes).
MOST_ROWS, MOST_BYTES = 8_000, 1 << 18


def _picked(marks: DataFrame, most: int) -> DataFrame | None:
    """About `most` rows of each label of (doc_id, label), by the hash of doc_id; None if there are no rows."""
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}  # one row for each label
    if not counts:
        return None
    most = min(most, MOST_ROWS // len(counts))
    share = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, most / n))])
    return marks.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share[F.col("label")] * 1_000_000)


def _rows(part: DataFrame) -> tuple[list[bytes], list]:
    """In an order that doesn't depend on the run; null ids last."""
    part = part.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= MOST_BYTES)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["label"], r["text"] or "") for r in part.select("doc_id", "label", "text").collect())
    return [t.encode() for *_, t in got], [y for _, _, y, _ in got]


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> tuple[list[bytes], list]:
    """Texts and labels of about `most` documents of each label at most.

    `learn` is a condition on doc_id. The labels are drawn first, so that the draw (its size is
    bounded by `most`) is broadcast to the scan of the texts. Null labels are none; a doc_id
    with several labels gives a row for each.
    """
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).filter(learn)
    picked = _picked(marks, most)
    if picked is None:
        return [], []
    return _rows(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))


def sample_own(rows: DataFrame, most: int) -> tuple[list[bytes], list]:
    """The same of (doc_id, text, label)."""
    picked = _picked(rows, most)
    return ([], []) if picked is None else _rows(picked)


def ngrams(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of words: (index of the word, bucket) of each byte n-gram of <word>, and the bucket of each whole word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64) + np.uint64(1)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lens)
    word = np.repeat(np.arange(len(words)), lens)
    at = np.arange(len(flat))
    left = ends[word] - at
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    spread = np.uint64(0x9E3779B97F4A7C15)
    powers = np.cumprod(np.full(int(lens.max()), 0x100000001B3, np.uint64))
    out_word, out_bucket = [], []
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(flat * powers[(lens[word] - left)], ends - lens)
        h = flat.copy()
        for k in range(1, max(sizes)):
            h = h[:-1] * np.uint64(0x100000001B3) + flat[k:]
            if k + 1 in sizes:
                ok = left[: len(h)] > k
                out_word.append(word[: len(h)][ok])
                out_bucket.append(((h[ok] * spread) >> shift).astype(np.int64))
        return np.concatenate(out_word), np.concatenate(out_bucket), ((whole * spread) >> shift).astype(np.int64)
