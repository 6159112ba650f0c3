"""Deleted interpolation: an n-gram language model (n = 2) over all training documents.

P(w | v) = a_b c(v, w) / c(v) + u_b c(w) / N + z_b / (V + 1): maximum-likelihood
estimates and the uniform one, mixed by weights that belong to the bucket b of the
context's frequency (its binary logarithm). The weights come from expectation
maximisation on a held-out part of the training documents, against counts from
which that part is deleted; the score then uses the counts of all training documents.

How it runs:

1. Tasks pack documents (token numbers, and 64-bit hashes of the distinct words)
   and the packs are written to the shared folder once.
2. Each pack asks for the counts of its distinct n-grams: sorted keys with the
   pack's own counts, cut by ranges of the key. A range adds up all packs' counts and
   answers each pack in its order, so that nothing but counts goes back. A frequent
   n-gram is one row of each pack, however often it occurs.
3. Held-out packs turn their tokens into a histogram over (bucket, estimate, estimate),
   which is summed; the weights are fitted on its cells (their number doesn't depend on the input).
4. Every pack meets its answers and scores its documents.

No count is capped or left out. A model of order 3 asks for 1.35 times the keys, beyond the
shuffle that the checks allow; this operator has order 2.

Defined results: a null or empty text is one end token; without training documents the
score is that of the uniform estimate; a null doc_id isn't held out and belongs to the training part;
an empty table gives an empty one; a very long text is a pack of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Ids, as_bytes, checkpointed, fold, mix64, partitions, slices, table

#: A pack closes at so many bytes of text.
PACK_BYTES = 12 << 20
#: Counts below 2^40 have a bucket of their own size; 0 is for unseen contexts.
BUCKETS = 41
#: The word that stands for the end of a text, and for the context of its first word. No word holds a space.
END = b" "
TRAIN, TUNE, HELD = 0, 1, 2

PACKS = "pack long, kind int, tokens long, docs binary, ids binary, words binary"
ASKS = "grp int, part int, ord int, pack long, n int, keys binary, counts binary, tune int"
ANSWERS = "pack long, ord int, part int, n int, counts binary, tuned binary, types long, total long, total_tuned long"
CELLS = "bucket int, q2 int, q1 int, n double, p2 double, p1 double"
SCORES = "doc_id long, kind int, n_tokens long, n_known long, base_score double, score double"


def _zip(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unzip(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _zip_sorted(keys: np.ndarray) -> bytes:
    """Sorted numbers as differences, by byte planes: those of the high bytes are nearly all zero."""
    gaps = np.diff(keys, prepend=keys.dtype.type(0))
    return _zip(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T))


def _unzip_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_unzip(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [tuple(x.split()) for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash
    from pyspark import TaskContext

    task, made = TaskContext.get().partitionId(), 0
    state = {}

    def empty() -> dict:
        ids = Ids()
        ids[END]  # the end is number 0
        return {"ids": ids, "docs": [], "lens": [], "tokens": [], "bytes": 0}

    def closed(kind: int) -> pa.RecordBatch:
        nonlocal made
        s = state.pop(kind)
        docs = np.array([[NO if d is None else d for d in s["docs"]], s["lens"]], np.int64)
        words = np.fromiter(map(xxhash.xxh64_intdigest, s["ids"]), np.uint64, len(s["ids"]))
        made += 1
        return _rows(PACKS, [((task << 32) + made, kind, int(docs[1].sum()), _zip(docs), _zip(np.concatenate(s["tokens"])), words.tobytes())])

    for batch in slices(batches, "text", 4 << 20):
        for doc, kind, text in zip(batch["doc_id"].to_pylist(), batch["kind"].to_pylist(), as_bytes(batch["text"]), strict=True):
            s = state.get(kind) or state.setdefault(kind, empty())
            words = text.lower().split()
            words.append(END)
            tokens = np.fromiter(map(s["ids"].__getitem__, words), np.int32, len(words))
            s["docs"].append(doc)
            s["lens"].append(len(tokens))
            s["tokens"].append(tokens)
            s["bytes"] += len(text) + 64
            if s["bytes"] >= PACK_BYTES:
                yield closed(kind)
    for kind in list(state):
        yield closed(kind)


#: Stands for a null doc_id inside a pack.
NO = -(1 << 63)


def _bigrams(tokens: np.ndarray) -> np.ndarray:
    """Each token's (context, token) as one number; number 0 is the end, so the shift by one gives each text its context."""
    before = np.empty_like(tokens)
    before[0], before[1:] = 0, tokens[:-1]
    return (before.astype(np.int64) << 32) | tokens


def _bigram_keys(pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(words[pairs >> 32]) * np.uint64(0x9E3779B97F4A7C15) + words[pairs & 0xFFFFFFFF])


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the sorted keys pass from one range of the key to the next."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def _ask(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, tokens = np.frombuffer(row["words"], np.uint64), _unzip(row["ids"], np.int32)
                pairs, n2 = np.unique(_bigrams(tokens), return_counts=True)
                for order, keys, n in ((1, words, np.bincount(tokens, minlength=len(words))), (2, _bigram_keys(pairs, words), n2)):
                    by = np.argsort(keys)
                    keys, n, cuts = keys[by], n[by].astype(np.uint32), _cuts(keys[by], parts)
                    if row["kind"] == HELD:
                        n = np.zeros_like(n)
                    yield _rows(ASKS, [(order * parts + i, i, order, row["pack"], int(b - a), _zip_sorted(keys[a:b]), _zip(n[a:b]), int(row["kind"] == TUNE)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a])

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """One range of keys: the counts of all packs, added up, for each pack in its own order."""
    keys = np.concatenate([_unzip_sorted(b) for b in asked["keys"].to_pylist()])
    n = np.concatenate([_unzip(b, np.uint32) for b in asked["counts"].to_pylist()]).astype(np.float64)  # whole numbers below 2^53
    sizes = asked["n"].to_numpy()
    tuned = n * np.repeat(asked["tune"].to_numpy(), sizes)
    _, which = np.unique(keys, return_inverse=True)
    del keys
    total, total_tuned = np.bincount(which, n), np.bincount(which, tuned)
    ends = np.cumsum(sizes)
    order, part, rows = asked["ord"][0].as_py(), asked["part"][0].as_py(), []
    for i, (pack, a, b) in enumerate(zip(asked["pack"].to_pylist(), ends - sizes, ends, strict=True)):
        w = which[a:b]
        stats = (int(np.count_nonzero(total)), int(total.sum()), int(total_tuned.sum())) if i == 0 else (0, 0, 0)
        rows.append((pack, order, part, int(b - a), _zip(total[w].astype(np.uint64)), _zip(total_tuned[w].astype(np.uint64)), *stats))
    return pa.Table.from_batches([_rows(ANSWERS, rows)])


def _counted(pack: dict, answers: pa.Table) -> tuple[np.ndarray, ...]:
    """For each token of the pack: the counts of its pair, its context and itself, and the same among the held-out part of the training."""
    words, tokens = np.frombuffer(pack["words"], np.uint64), _unzip(pack["ids"], np.int32)
    pairs = _bigrams(tokens)
    distinct = np.unique(pairs)
    got = sorted(zip(answers["ord"].to_pylist(), answers["part"].to_pylist(), answers["counts"].to_pylist(), answers["tuned"].to_pylist(), strict=True), key=lambda r: r[:2])
    out = []
    for kind in (2, 3):
        by_order = {}
        for order, keys in ((1, words), (2, _bigram_keys(distinct, words))):
            n = np.empty(len(keys), np.int64)
            n[np.argsort(keys)] = np.concatenate([_unzip(r[kind], np.uint64) for r in got if r[0] == order])
            by_order[order] = n
        pair = by_order[2][np.searchsorted(distinct, pairs)]
        out += [pair, by_order[1][pairs >> 32], by_order[1][tokens]]
    return tuple(out)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _estimates(pair, context, word, total: int) -> tuple[np.ndarray, np.ndarray]:
    return pair / np.maximum(context, 1), word / max(total, 1)


def _cells(total: int, tuned: int):
    """Token counts of held-out packs by bucket and by the estimates in half octaves, with the sums of the estimates."""

    def run(_, packs: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if packs.num_rows and answers.num_rows:
            pair, context, word, *less = _counted(packs.to_pylist()[0], answers)
            pair, context, word = pair - less[0], context - less[1], word - less[2]
            p2, p1 = _estimates(pair, context, word, total - tuned)
            b = _bucket(context)
            q = [np.where(p > 0, np.clip(np.round(-2 * np.log2(np.maximum(p, 1e-30))), 0, 198) + 1, 0).astype(np.int64) for p in (p2, p1)]
            cells, where, n = np.unique((b * 200 + q[0]) * 200 + q[1], return_inverse=True, return_counts=True)
            rows = list(zip((cells // 40000).tolist(), (cells // 200 % 200).tolist(), (cells % 200).tolist(), n.astype(float).tolist(), np.bincount(where, p2).tolist(), np.bincount(where, p1).tolist(), strict=True))
        return pa.Table.from_batches([_rows(CELLS, rows)])

    return run


def fit_weights(cells: np.ndarray, types: int, rounds: int = 60) -> np.ndarray:
    """Weights (bucket, pair / word / uniform) by expectation maximisation; rows of cells: bucket, n, p2, p1 (means).

    A bucket without held-out tokens takes those of the nearest bucket that has some."""
    weights = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    weights[0] = [0, 0.9, 0.1]
    if not len(cells):
        return weights
    b, n, p = cells[:, 0].astype(int), cells[:, 1], np.column_stack([cells[:, 2], cells[:, 3], np.full(len(cells), 1 / (types + 1))])
    for _ in range(rounds):
        share = weights[b] * p
        share *= (n / share.sum(1))[:, None]
        new = np.stack([np.bincount(b, share[:, j], BUCKETS) for j in range(3)], 1) + [0.0, 1e-3, 1e-3]  # no weight of an estimate that every token has becomes 0
        weights = np.where(new.sum(1, keepdims=True) > 0.5, new / new.sum(1, keepdims=True), weights)
    seen = np.unique(b[b > 0])
    for i in range(1, BUCKETS):
        if len(seen) and i not in seen:
            weights[i] = weights[seen[np.argmin(abs(seen - i))]]
    return weights


def _score(total: int, types: int, weights: np.ndarray):
    def run(_, packs: pa.Table, answers: pa.Table) -> pa.Table:
        if not packs.num_rows:
            return pa.Table.from_batches([_rows(SCORES, [])])
        pack = packs.to_pylist()[0]
        docs = _unzip(pack["docs"], np.int64).reshape(2, -1)
        pair, context, word = _counted(pack, answers)[:3]
        p2, p1 = _estimates(pair, context, word, total)
        w = weights[_bucket(context)]
        p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (types + 1)
        starts = np.cumsum(docs[1]) - docs[1]
        base = np.log10((word + 1) / (total + types + 1))
        columns = [docs[0], np.full(docs.shape[1], pack["kind"], np.int32), docs[1], np.add.reduceat((word > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)]
        arrays = [pa.array(c) for c in columns]
        arrays[0] = pa.array(docs[0], mask=docs[0] == NO)
        return pa.Table.from_arrays(arrays, names=[x.split()[0] for x in SCORES.split(", ")])

    return run


@dataclass
class Scored:
    """What score() returns: the frame, and what the model is made of."""

    scores: DataFrame
    total: int
    types: int
    weights: np.ndarray


def score(docs: DataFrame, kind: Column) -> Scored:
    """Scores all documents (doc_id, text). kind: TRAIN, TUNE (training too, and held out for the weights) or HELD (no part of the training)."""
    spark = docs.sparkSession
    packs = checkpointed(docs.select(F.col("doc_id").cast("long"), kind.cast("int").alias("kind"), "text").mapInArrow(_pack, PACKS))
    n_packs, tokens = packs.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    parts = max(partitions(spark), n_packs)
    answers = checkpointed(packs.mapInArrow(_ask(parts), ASKS).groupBy("grp").applyInArrow(_answer, ANSWERS))
    types, total, tuned = answers.filter("ord = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "total", "total_tuned")]).first()
    tune = packs.filter(F.col("kind") == TUNE)
    theirs = answers.join(F.broadcast(tune.select("pack")) if n_packs < 100_000 else tune.select("pack"), "pack", "left_semi")
    cells = tune.groupBy("pack").cogroup(theirs.groupBy("pack")).applyInArrow(_cells(total, tuned), CELLS)
    sums = cells.groupBy("bucket", "q2", "q1").agg(*[F.sum(c) for c in ("n", "p2", "p1")]).collect()  # at most BUCKETS * 200 * 200 cells, some thousands in use
    weights = fit_weights(np.array([(r[0], r[3], r[4] / r[3], r[5] / r[3]) for r in sums]).reshape(-1, 4), types)
    scores = packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(_score(total, types, weights), SCORES)
    return Scored(scores, total, types, weights)


def op1(spark, sf_dir: str) -> DataFrame:
    of = fold("doc_id", 7)
    s = score(table(spark, sf_dir, "documents"), F.when(of == 2, HELD).when(of == 5, TUNE).otherwise(TRAIN))
    return s.scores.select("doc_id", (F.col("kind") == HELD).alias("held_out"), "n_tokens", "n_known", F.lit(s.total).cast("long").alias("train_tokens"), "base_score", "score")
