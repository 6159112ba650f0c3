"""Exact top-k search by inner product: ball trees in shards, searched by branch and bound.

A component x counts as floor(1024 * x), so scores are whole numbers and ties are real; they go
to the smaller vec_id.

How it runs:

1. One pass packs the vectors into shards of bounded size. Each shard gets a ball tree: a node
   has a centre, a radius, and the smallest id in it; vectors lie in the order of the leaves.
   For a query q the inner products of a node are at most q.centre + |q| * radius.
2. Shards are dealt into groups (tasks); queries come in blocks and are sent to each group, so that memory
   is one shard and one block at a time. Queries grow with the table, so nothing is broadcast.
3. The current kth score of a query is shared: first each block is searched in one group alone. What it
   finds there goes with the block to all other groups, where it drops nodes and whole shards from the start
   and rises from shard to shard.
4. A block goes down a tree together: a level's nodes are bounded for the queries that still need their
   parents. Each query visits its leaves in the order of their bounds, first the best, then those that
   the new kth score leaves. A node whose bound equals the kth score is needed only for a smaller id.
5. The groups' k best of each query meet: groups * k rows a query, ranked by a window over the query.

Where vectors point in all directions of a space of many dimensions, balls are about as wide as the data and
bounds drop little; the search is then a product of blocks and leaves, still exact.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do rows without a
vec_id; a shorter vector counts as followed by zeros; rows that share a vec_id are all candidates
(one rank each), never of a query with that id, and each is a query of its own; scores beyond the
range of a long are cut to it; an empty table, or one of queries alone with no other row, gives no rows; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, partitions, table

SCALE, K, EVERY = 1024, 10, 100
#: A shard holds so many components at most (and one vector at least), a leaf so many vectors, a block so many queries.
SHARD, LEAF, BLOCK = 1 << 19, 128, 256
#: Components and sums up to this are exact in double precision; others are added as whole numbers.
EXACT = 2.0**52

PACKED = "name long, ids binary, vectors binary, width int"


def _parsed(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and scaled vectors of the rows that take part."""
    ids, out = [], []
    for i, v in zip(batch["vec_id"].to_pylist(), batch["embedding"], strict=True):
        x = v.values if v.is_valid and i is not None else None
        if x is None or x.null_count:
            continue
        x = np.floor(SCALE * np.asarray(x.to_numpy(zero_copy_only=False), np.float64))
        if np.isfinite(x).all():
            ids.append(i)
            out.append(x)
    return np.array(ids, np.int64), out


def _packed(size: int, most: int):
    """Packs up to `most` vectors, or `size` components, into a row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, held, n = TaskContext.get().partitionId() << 32, [], [], 0

        def out() -> pa.RecordBatch:
            width = max(map(len, held))
            m = np.zeros((len(held), width))
            for k, x in enumerate(held):
                m[k, : len(x)] = x
            return pa.record_batch([pa.array([name]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([_narrow(m)], pa.binary()), pa.array([width], pa.int32())], names=["name", "ids", "vectors", "width"])

        for batch in batches:
            for i, x in zip(*_parsed(batch), strict=True):
                if held and (n + len(x) > size or len(held) == most):
                    yield out()
                    name, ids, held, n = name + 1, [], [], 0
                ids.append(int(i))
                held.append(x)
                n += len(x)
        if held:
            yield out()

    return rows


def _narrow(m: np.ndarray) -> bytes:
    """The components in two bytes each where they fit, else in eight; the first byte tells which."""
    small = not m.size or np.abs(m).max() < 1 << 15
    return (b"\x02" + m.astype(np.int16).tobytes()) if small else (b"\x08" + m.tobytes())


def _wide(packed: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(packed, np.int16 if packed[0] == 2 else np.float64, offset=1).reshape(rows, width).astype(np.float64)


def _fit(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


class BallTree:
    """Nodes in breadth-first order. Node j: vectors start[j]:stop[j], centre, radius, the smallest id; children child[j] and child[j] + 1, or 0 for a leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        nodes, todo = [], [(0, len(ids))]
        child: list[int] = []
        while todo:
            following = []
            for lo, hi in todo:
                part = order[lo:hi]
                x = vectors[part]
                centre = x.mean(0)
                radius = float(np.sqrt(((x - centre) ** 2).sum(1).max(initial=0)))
                nodes.append((lo, hi, centre, radius, int(ids[part].min())))
                if hi - lo <= leaf:
                    child.append(0)
                    continue
                # the two ends of the longest spread found in two steps part the vectors; equal ones stay in order of id
                a = x[((x - centre) ** 2).sum(1).argmax()]
                b = x[((x - a) ** 2).sum(1).argmax()]
                order[lo:hi] = part[np.argsort(x @ (b - a), kind="stable")]
                child.append(-1)
                following += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
            todo = following
        self.order, self.ids, self.vectors = order, ids[order], vectors[order]
        self.start, self.stop = (np.array([n[k] for n in nodes], np.int64) for k in (0, 1))
        self.centre, self.radius, self.least = np.stack([n[2] for n in nodes]), np.array([n[3] for n in nodes]), np.array([n[4] for n in nodes], np.int64)
        inner = np.array(child) < 0
        self.child = np.where(inner, 2 * np.cumsum(inner) - 1, 0)
        self.largest = float(np.abs(vectors).max(initial=0))

    def bound(self, q: np.ndarray, length: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The largest inner product that each query can have in each node; whole, and never too small for rounding."""
        dot, reach = q @ self.centre[nodes].T, length[:, None] * self.radius[nodes]
        return np.floor(dot + reach + 1e-9 * (np.abs(length)[:, None] * (np.linalg.norm(self.centre[nodes], axis=1) + self.radius[nodes])) + 1e-6)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as int64, cut to its range."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1)
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(v) for v in r] for r in q], object).reshape(q.shape), np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    return np.array([[min(max(sum(a * b for a, b in zip(r, s, strict=True)), -(1 << 63)), (1 << 63) - 1) for s in whole[1]] for r in whole[0]], np.int64).reshape(len(q), len(x))


class Best:
    """The k best of each query of a block so far, in order: scores falling, ids rising. Places that are still free have a null id."""

    def __init__(self, n: int, k: int, kth: np.ndarray, kth_id: np.ndarray):
        self.k, self.score, self.id, self.has = k, np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), np.iinfo(np.int64).max), np.zeros((n, k), bool)
        self.kth, self.kth_id = kth.copy(), kth_id.copy()  # what another group has found already

    def needs(self, bound: np.ndarray, least: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether a node with this bound and smallest id can still change these queries' results."""
        kth, at = self.kth[rows][:, None], self.kth_id[rows][:, None]
        return (bound > kth) | ((bound == kth) & (least <= at))

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        some = (score >= self.kth[rows][:, None]).any(1)
        rows, score, ok = rows[some], score[some], ok[some]
        score = np.concatenate([self.score[rows], score], 1)
        ids = np.concatenate([self.id[rows], np.broadcast_to(ids, ok.shape)], 1)
        has = np.concatenate([self.has[rows], ok], 1)
        # a score of the lowest long is still better than no row, so that rows come first
        order = np.lexsort((ids, np.where(has, ~score, np.iinfo(np.int64).max), ~has), axis=1)[:, : self.k]
        self.score[rows], self.id[rows], self.has[rows] = (np.take_along_axis(x, order, 1) for x in (score, ids, has))
        full = self.has[rows, -1]
        better = full & ((self.score[rows, -1] > self.kth[rows]) | ((self.score[rows, -1] == self.kth[rows]) & (self.id[rows, -1] < self.kth_id[rows])))
        up = rows[better]
        self.kth[up], self.kth_id[up] = self.score[up, -1], self.id[up, -1]


def search(tree: BallTree, own: np.ndarray, q: np.ndarray, length: np.ndarray, best: Best) -> None:
    """Branch and bound of a block of queries (own: their ids) in one tree."""
    low = np.finfo(np.float64).min
    width = max(q.shape[1], tree.vectors.shape[1])
    q, vectors = _fit(q, width), _fit(tree.vectors, width)
    if tree.centre.shape[1] < width:
        tree.centre = _fit(tree.centre, width)
    large = not np.isfinite(tree.largest * np.abs(q).max(initial=0) * width * 4) or tree.largest * np.abs(q).max(initial=0) * width >= EXACT
    everyone = np.arange(len(q))
    nodes, need = np.array([0]), np.ones((len(q), 1), bool)
    leaves, bounds = [], []
    while len(nodes):
        bound = np.full((len(q), len(nodes)), low)
        rows = np.flatnonzero(need.any(1))
        got = np.full((len(rows), len(nodes)), np.inf) if large else tree.bound(q[rows], length[rows], nodes)
        ok = need[rows] & best.needs(got, tree.least[nodes], rows)
        bound[rows] = np.where(ok, got, low)
        need = bound > low
        end = tree.child[nodes] == 0
        leaves.append(nodes[end])
        bounds.append(bound[:, end])
        on = ~end & need.any(0)
        nodes, need = np.stack([tree.child[nodes[on]], tree.child[nodes[on]] + 1], 1).ravel(), np.repeat(need[:, on], 2, 1)
    leaf, bound = np.concatenate(leaves), np.concatenate(bounds, 1)

    def visit(j: int, rows: np.ndarray) -> None:
        a, b = tree.start[leaf[j]], tree.stop[leaf[j]]
        best.add(rows, products(q[rows], vectors[a:b]), tree.ids[a:b], tree.ids[a:b] != own[rows][:, None])

    first = bound.argmax(1)
    for j in np.unique(first[bound[everyone, first] > low]):
        visit(j, np.flatnonzero((first == j) & (bound[:, j] > low)))
    bound[everyone, first] = low
    for j in np.argsort(-bound.max(0, initial=low), kind="stable"):
        rows = np.flatnonzero(bound[:, j] > low)
        rows = rows[best.needs(bound[rows, j : j + 1], tree.least[leaf[j]], rows)[:, 0]]
        if len(rows):
            visit(j, rows)


FOUND = "query long, query_id long, vec_id long, score long"


def _searched(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group, its shards before the blocks."""
        now, trees = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["group"] != now:
                    now, trees = r["group"], []
                ids = np.frombuffer(r["ids"], np.int64)
                m = _wide(r["vectors"], r["width"], len(ids))
                if not r["is_block"]:
                    trees.append(BallTree(ids, m))
                    continue
                low = np.full(len(ids), np.iinfo(np.int64).min), np.full(len(ids), np.iinfo(np.int64).max)
                best = Best(len(ids), k, *(low if r["kth"] is None else (np.array(r["kth"], np.int64), np.array(r["kth_id"], np.int64))))
                length = np.linalg.norm(m, axis=1)
                for tree in trees:
                    search(tree, ids, m, length, best)
                at, _ = np.nonzero(best.has)
                yield pa.record_batch([pa.array((r["name"] << 10) + at), pa.array(ids[at]), pa.array(best.id[best.has]), pa.array(best.score[best.has])], names=["query", "query_id", "vec_id", "score"])

    return rows


def _pack(vectors: DataFrame, size: int, most: int) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_packed(size, most), PACKED)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, groups: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the queries' k best among all (vec_id, embedding). is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    groups = groups or partitions(spark)
    shards = checkpointed(_pack(vectors, SHARD, SHARD))
    blocks = checkpointed(_pack(vectors.filter(is_query).repartition(max(1, groups // 8)), SHARD, BLOCK))
    # each shard is in one group: dealt by its name, so that a group's size follows the number of shards
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")
    none = F.lit(None).cast("array<long>")
    held = shards.select(group(F.col("name")).alias("group"), F.lit(False).alias("is_block"), "*", none.alias("kth"), none.alias("kth_id"))
    # groups that hold a shard (a number for each)
    full = sorted(r[0] for r in held.select("group").distinct().collect())
    if not full:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    numbers = F.array(*[F.lit(g) for g in full])
    home = F.element_at(numbers, (F.pmod(F.xxhash64("name", F.lit(1)), F.lit(len(full))) + 1).cast("int"))

    def searched(sent: DataFrame) -> DataFrame:
        both = held.unionByName(sent).repartition(groups, "group").sortWithinPartitions("group", "is_block")
        return both.mapInArrow(_searched(k), FOUND)

    first = checkpointed(searched(blocks.select(home.alias("group"), F.lit(True).alias("is_block"), "*", none.alias("kth"), none.alias("kth_id"))))
    # the kth score of each query that has k rows; of others nothing is known yet
    worst = first.groupBy("query").agg(F.count("*").alias("n"), F.min(F.struct("score", (-F.col("vec_id")).alias("at"))).alias("w"))
    lowest, last = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    worst = worst.select(F.shiftright("query", 10).alias("name"), (F.col("query") % 1024).alias("at"), F.when(F.col("n") >= k, F.col("w.score")).otherwise(lowest).alias("kth"), F.when(F.col("n") >= k, -F.col("w.at")).otherwise(last).alias("id"))
    known = worst.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("kth", "id")))).alias("known"))  # BLOCK entries at most
    place = F.sequence(F.lit(0), (F.octet_length("ids") / 8).cast("int") - 1)
    of = lambda field, none: F.transform(place, lambda i: F.coalesce(F.col("known")[i.cast("long")][field], none))
    rest = blocks.join(known, "name", "left").select(*blocks.columns, of("kth", lowest).alias("kth"), of("id", last).alias("kth_id"), home.alias("home"))
    others = F.filter(numbers, lambda g: g != F.col("home"))
    second = searched(rest.select(F.explode(others).alias("group"), F.lit(True).alias("is_block"), *blocks.columns, "kth", "kth_id"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return first.union(second).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def op12(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
