"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

A document's set is its distinct 5-word shingles (64-bit hashes); documents link if the
sets' Jaccard similarity is 0.75 or more, which is always confirmed on the full sets.

How it runs:

1. One pass hashes each text: the set's size, a 128-bit hash of the set, its band keys
   and one byte of each of the 128 bins.
2. Documents of equal sets are one class, for which its smallest doc_id stands. So exact
   copies, however many, take part once.
3. Bands with the same members are one bucket (counts and sums of hashed members, added
   before the shuffle, tell that). In a bucket each member is a candidate for its centre,
   the smallest id; one whose bytes don't agree with the centre's nearly everywhere is also
   one for the earlier member it agrees with most. That is at most two edges a member.
   Large buckets are dealt into parts, each with the bucket's centre; the parts meet later.
4. Candidates that are distinct get both texts and are confirmed; the links' connected
   components are found by joins. If a bucket then still has members of different
   components that look alike, their full sets meet in the bucket, where all pairs of
   different components are confirmed. What leaves a bucket are the links that join
   components, fewer than its members. In a large bucket each two parts meet, except
   those of its largest component: what lies outside that one meets all members.

A candidate is left out only if the bytes agree in so few bins that a similarity of 0.75
is five standard deviations away. 32 bands of 4 bins find a pair at 0.75 with probability
1 - 5e-6; sets of up to 32 shingles also get a key for each shingle of their prefix, which
makes the search exact for them.

Defined results: texts without words have an empty set and link with nothing; rows that
share a doc_id count as one node; a null doc_id counts as the largest long and sorts last, its
component is null if it links with no other; an empty table gives an empty one; a very long text
is a slice of its own, and its set meets others only where their bins agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Ids, as_bytes, checkpointed, mix64, slices, table
from .graph import components

WORDS, BINS, ROWS = 5, 128, 4
BANDS = BINS // ROWS
#: Links have 100 * intersection >= 75 * union.
PERCENT = 75
#: Sets up to this size get prefix keys.
SMALL = 32
#: A bucket is dealt into parts of about so many members, and for full sets of about so many shingles.
PART, PART_SHINGLES = 1024, 1 << 20
#: Ids of candidates are broadcast to the scan of the texts up to this number (16 bytes each).
MOST_BROADCAST = 1_000_000

_P = np.uint64(0x9E3779B97F4A7C15)
_EDGES = (np.arange(1, BINS, dtype=np.uint64) << np.uint64(64 - 7)).astype(np.uint64)
#: For an empty bin, the bins to borrow from, in turn: a 2-universal choice, equal for all documents.
_PROBES = (mix64(np.arange(BINS * 64, dtype=np.uint64) + np.uint64(0x5DEECE66D)) >> np.uint64(57)).astype(np.int64).reshape(BINS, 64)


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    import xxhash

    ids = Ids()
    words = [np.fromiter(map(ids.__getitem__, w), np.int64, len(w)) for w in (t.lower().split() for t in texts)]
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))
    out = []
    with np.errstate(over="ignore"):
        for w in words:
            h = hashed[w]
            k = min(WORDS, len(h))
            if k:
                n = len(h) - k + 1
                s = h[:n].copy()
                for j in range(1, k):
                    s *= _P
                    s += h[j : j + n]
                h = np.unique(mix64(s + np.uint64(k)))
            out.append(h)
    return out


def bins(s: np.ndarray) -> np.ndarray:
    """The least hash of each bin (a bin is an equal range of the hashes); empty bins borrow."""
    cuts = np.concatenate([[0], np.searchsorted(s, _EDGES), [len(s)]])
    full = cuts[:-1] < cuts[1:]
    value = s[np.minimum(cuts[:-1], len(s) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        ok = full[_PROBES[empty]]
        lender = _PROBES[empty, ok.argmax(1)]
        none = ~ok.any(1)
        if none.any():
            lender[none] = np.flatnonzero(full)[0]
        value[empty] = value[lender]
    return value


SIGNED = "doc_id long, n long, set binary, keys array<long>, bytes binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    band = mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
    for batch in slices(batches, "text", 4 << 20):
        sets = shingles(as_bytes(batch["text"]))
        names, keys, marks = [], [], []
        for s in sets:
            names.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
            if not len(s):
                keys.append(None)
                marks.append(None)
                continue
            v = bins(s)
            with np.errstate(over="ignore"):
                k = band.copy()
                for col in v.reshape(BANDS, ROWS).T:
                    k = mix64(k * _P + col)
                if len(s) <= SMALL:
                    prefix = len(s) - -(-len(s) * PERCENT // 100) + 1
                    k = np.concatenate([k, mix64(s[:prefix] ^ np.uint64(0xA5A5A5A5))])
            keys.append(k.view(np.int64))
            marks.append(((v >> np.uint64(17)) & np.uint64(255)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())], names=["doc_id", "n", "set", "keys", "bytes"]
        )


CANDIDATES = "a long, b long"


def least_agreement(n: np.ndarray) -> np.ndarray:
    """The share of bins that two sets of similarity 0.75 agree in, less five standard deviations; n: the smaller size."""
    used = np.maximum(1, BINS * (1 - np.exp(-n / BINS)))
    return 0.75 - 5 * np.sqrt(0.75 * 0.25 / used)


def _star(bucket: pa.Table) -> pa.Table:
    bucket = bucket.sort_by("id")
    ids, n = bucket["id"].to_numpy(), bucket["n"].to_numpy().astype(float)
    keep = np.concatenate([[True], ids[1:] != ids[:-1]])
    ids, n = ids[keep], n[keep]
    marks = np.frombuffer(b"".join(bucket["bytes"].to_pylist()), np.uint8).reshape(-1, BINS)[keep]
    a, b = [], []
    if len(ids) > 1:
        def agreement(i: int, to: slice) -> np.ndarray:
            share = (marks[to] == marks[i]).mean(1)
            sizes = np.minimum(n[i], n[to]) * 100 >= PERCENT * np.maximum(n[i], n[to])
            return np.where(sizes & (share >= least_agreement(np.minimum(n[i], n[to]))), share, -1.0)

        to_centre = agreement(0, slice(1, None))
        for i, share in enumerate(to_centre, 1):
            if share >= 0:
                a.append(ids[0])
                b.append(ids[i])
            if share < 0.9 and i > 1:
                others = agreement(i, slice(1, i))
                j = int(others.argmax())
                if others[j] >= 0:
                    a.append(ids[j + 1])
                    b.append(ids[i])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _meeting(placed: DataFrame) -> DataFrame:
    """The members of each bucket with several components, once for each pair (part, part_b) of parts in which they meet others.

    The largest component's parts come first; as it is one already, they don't meet each other.
    """
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    sizes = sizes.groupBy("key").agg(F.count("*").alias("components"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.max(F.struct("m", "s", "component")).alias("most"))
    parts = lambda m, s: F.greatest(F.ceil(m / PART), F.ceil(s / PART_SHINGLES)).cast("int")
    large, rest = F.col("most.m"), F.col("m") - F.col("most.m")
    deal = sizes.filter("components > 1").select("key", F.col("most.component").alias("large"), parts(F.col("m"), F.col("s")).alias("all"), parts(large, F.col("most.s")).alias("p"), parts(rest, F.col("s") - F.col("most.s")).alias("q"))
    deal = deal.select("key", "large", *[F.when(F.col("all") > 1, F.col(c)).otherwise(other).alias(c) for c, other in (("p", 0), ("q", 1))])
    hashed = F.xxhash64("id", "key")
    of_large = (F.col("component") == F.col("large")) & (F.col("p") > 0)
    dealt = placed.join(deal, "key").withColumn("side", F.when(of_large, F.pmod(hashed, F.greatest("p", F.lit(1)))).otherwise(F.col("p") + F.pmod(hashed, F.col("q"))).cast("int"))
    meets = F.explode(F.sequence(F.when(of_large, F.col("p")).otherwise(0), F.col("p") + F.col("q") - 1))
    return dealt.withColumn("with", meets).select("key", F.least("side", "with").alias("part"), F.greatest("side", "with").alias("part_b"), "side", "id", "n", "set", "bytes", "component")


ALIKE = "key long, part int, part_b int, side int, id long, set binary, component long"


def _alike(bucket: pa.Table) -> pa.Table:
    """The members that look like a member of another component; of two parts, one in the other part."""
    side, across = bucket["side"].to_numpy(), bucket["part"][0].as_py() != bucket["part_b"][0].as_py()
    comp, n = bucket["component"].to_numpy(), bucket["n"].to_numpy().astype(float)
    marks = np.frombuffer(b"".join(bucket["bytes"].to_pylist()), np.uint8).reshape(-1, BINS)
    seen = np.zeros(len(n), bool)
    for i in range(1, len(n)):
        other = np.flatnonzero((comp[:i] != comp[i]) & ((side[:i] != side[i]) | (not across)))
        low = np.minimum(n[i], n[other])
        other = other[((marks[other] == marks[i]).mean(1) >= least_agreement(low)) & (low * 100 >= PERCENT * np.maximum(n[i], n[other]))]
        seen[other] = True
        seen[i] |= len(other) > 0
    return bucket.select([c.split()[0] for c in ALIKE.split(", ")]).filter(pa.array(seen))


def _bridges(group: pa.Table) -> pa.Table:
    """Links that join components, on the full sets of all members; a link within what is joined already is left out."""
    ids, comp, side = (group[c].to_numpy() for c in ("id", "component", "side"))
    across = group["part"][0].as_py() != group["part_b"][0].as_py()
    sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(n)), n)
    _, code, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders, first, ends = owner[np.argsort(code, kind="stable")], np.cumsum(held) - held, np.cumsum(n)
    _, joined = np.unique(comp, return_inverse=True)
    a, b = [], []
    for i in range(len(n)):
        if (joined == joined[i]).all():
            continue
        mine = code[ends[i] - n[i] : ends[i]]
        mine = mine[held[mine] > 1]
        m = held[mine]
        both = np.bincount(holders[np.repeat(first[mine] - (np.cumsum(m) - m), m) + np.arange(m.sum())], minlength=len(n))
        for j in np.flatnonzero((both > 0) & (100 * both >= PERCENT * (n[i] + n - both)) & (joined != joined[i]) & ((side != side[i]) | (not across))):
            if joined[j] != joined[i]:
                joined[joined == joined[j]] = joined[i]
                a.append(min(ids[i], ids[j]))
                b.append(max(ids[i], ids[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


SETS = "id long, set binary, shingles binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full sets of the texts, with their 128-bit hashes."""
    import xxhash

    for batch in slices(batches, "text", 4 << 20):
        full = [s.tobytes() for s in shingles(as_bytes(batch["text"]))]
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array([xxhash.xxh128_digest(s) for s in full], pa.binary()), pa.array(full, pa.binary())], names=["id", "set", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs (a, b) with their texts, those that link. Rows of the same a mostly follow each other: its set is kept."""
    last, kept = None, None
    for batch in slices(batches, "text_b", 4 << 20):
        a, b, texts, of_a = batch["a"].to_pylist(), batch["b"].to_pylist(), as_bytes(batch["text_b"]), batch["text_a"]
        sets, link = shingles(texts), []
        for i, s in enumerate(sets):
            text = of_a[i].as_py()
            if text != last or kept is None:
                last, kept = text, shingles([(text or "").encode()])[0]
            both = len(np.intersect1d(kept, s, assume_unique=True))
            link.append(bool(both) and 100 * both >= PERCENT * (len(kept) + len(s) - both))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, ok in zip(c, link, strict=True) if ok], pa.int64()) for c in (a, b)], names=["a", "b"])


def _linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The distinct pairs whose texts link. docs: (id, text)."""
    n = pairs.count()
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = docs.join(F.broadcast(ids) if n <= MOST_BROADCAST else ids, "id", "left_semi")
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return checkpointed(with_both.mapInArrow(_confirm, CANDIDATES).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), "text")
    signed = checkpointed(docs.select(F.col("id").alias("doc_id"), "text").mapInArrow(_sign, SIGNED))
    classes = signed.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("id"))
    reps = signed.join(classes.select("set", F.col("id").alias("doc_id")), ["set", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "n", "keys", "bytes", "set")
    slots = reps.select("id", F.explode("keys").alias("key"))
    buckets = slots.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("sum"), F.min("id").alias("centre")).filter("m > 1")
    buckets = buckets.groupBy("m", "sum", "centre").agg(F.min("key").alias("key"))
    parts = F.ceil(F.col("m") / PART).cast("int")
    buckets = checkpointed(buckets.select("key", "centre", parts.alias("parts")))
    members = slots.join(buckets, "key").select("key", F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int").alias("part"), "id", F.lit(True).alias("own"))
    centres = buckets.filter("parts > 1").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("id"), F.lit(False).alias("own"))
    members = checkpointed(members.union(centres).join(reps.select("id", "n", "bytes", "set"), "id"))
    tried = checkpointed(members.groupBy("key", "part").applyInArrow(_star, CANDIDATES).distinct())
    links = _linked(tried, docs)
    found = components(links)
    placed = members.filter("own").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    alike = checkpointed(_meeting(placed).groupBy("key", "part", "part_b").applyInArrow(_alike, ALIKE))
    ids = alike.select("id").distinct()
    texts = docs.join(F.broadcast(ids) if alike.count() <= MOST_BROADCAST else ids, "id", "left_semi")
    sets = texts.mapInArrow(_sets, SETS).groupBy("id", "set").agg(F.min("shingles").alias("shingles"))
    bridges = checkpointed(alike.join(sets, ["id", "set"]).select("key", "part", "part_b", "side", "id", "component", "shingles").groupBy("key", "part", "part_b").applyInArrow(_bridges, CANDIDATES).distinct())
    if not bridges.isEmpty():
        found = components(links.union(bridges))
    of_set = classes.join(found, "id", "left").select("set", F.coalesce("component", "id").alias("component"))
    out = signed.select("doc_id", "n", "set").join(of_set, "set", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(known("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents with their own columns, of each component only the one with the smallest doc_id."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), e AS (
  SELECT i.a, i.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2) i
  JOIN n p ON p.doc_id = i.a JOIN n q ON q.doc_id = i.b WHERE 100 * shared >= 75 * (p.n + q.n - shared)
), sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(a, b) AS (
  SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a
), c AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(c.m, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op10(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
