"""Filter interaction audit: what each filter removes in every order of the filters, from a sparse document-term matrix.

Five filters look at whole texts; the letters name what makes a text fail: A few words, B few
distinct words, C many capitals, D characters of markup, E the text of a smaller doc_id.

How it runs:

1. One pass over the texts cuts them into shards of bounded bytes. A shard numbers its words
   in the order in which they come and is a CSR matrix over them (one row of the table, packed).
   The same pass notes C, D and a digest of each text, so that no text is shuffled.
2. The words of all shards, each once for each shard, are dealt by word and sorted: a new word is a new
   id. The most frequent word is as many rows as there are shards, so no key is hot; and ids don't
   depend on the order of arrival, so that a part which is computed again gets the same.
3. The ids come back to the shards, whose columns are renumbered. Sums of a row and its number of
   non-zero columns are the words and the distinct words of a document: A and B.
4. E compares ids within a digest by partial minima; copies are added up before they meet.
5. Documents are added up by part, failed filters and labels: 128 rows a part at most. Only
   these meet the orders.

Defined results: a null text is empty (it fails A alone, and E after the first); a null lang and an
empty one are the same part; a null doc_id counts as the largest; rows that repeat a doc_id and a
text don't make each other fail E; several labels of a doc_id count if any says so; a very long
text is a shard of its own; an empty table gives no rows; columns that aren't named here are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NULL_ID, Ids, as_bytes, checkpointed, partitions, slices, table

FILTERS = "ABCDE"
#: A: fewer words fail. B: percent of words that must be distinct. C: percent of capitals that a text may have.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
#: D: none of these may be in a text.
MARKUP = b"#$%&*|"
#: A shard holds so many bytes of text at most, or one longer text.
SHARD_BYTES = 16 << 20
#: So many bytes of a shard's texts are out of the batch at once.
BYTES_AT_ONCE = 1 << 20
#: So many words leave a shard at once.
WORDS_AT_ONCE = 50_000

_CAPITALS, _CONTINUED = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
OWN = "doc_ids array<long>, parts array<string>, digests array<binary>, fails array<string>, indptr binary, indices binary, data binary"
LOCAL, MATRIX = f"shard long, own struct<{OWN}>, words binary", f"shard long, {OWN}"
ROWS = "doc_id long, part string, digest binary, fails string, n_words long, n_distinct long"


def pack(values: np.ndarray) -> bytes:
    """An array of int64 or int32, compressed with its length before it."""
    return values.nbytes.to_bytes(8, "little") + pa.compress(pa.py_buffer(values), codec="zstd", asbytes=True)


def unpack(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True), kind)


def _fails(t: bytes) -> str:
    """C and D of a text."""
    c = 100 * (len(t) - len(t.translate(None, _CAPITALS))) > MOST_CAPITALS * len(t.translate(None, _CONTINUED))
    return "C" * c + "D" * (len(t.translate(None, MARKUP)) < len(t))


def pack_words(words: Iterable[bytes]) -> bytes:
    """Words that hold no white space."""
    return pack(np.frombuffer(b"\n".join(words), np.uint8))


def unpack_words(packed: bytes) -> list[bytes]:
    return unpack(packed, np.uint8).tobytes().split(b"\n")


_OWN = pa.struct([("doc_ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.string())), ("digests", pa.list_(pa.binary())), ("fails", pa.list_(pa.string())), *[(c, pa.binary()) for c in ("indptr", "indices", "data")]])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards with words of their own numbering. A shard's name is its partition and its place there."""
    name = TaskContext.get().partitionId() << 32
    for batch in slices(batches, "text", SHARD_BYTES):
        ids, digests, fails = Ids(), [], []
        ends, indices, data = array("q", [0]), array("i"), array("q")
        for piece in slices([batch], "text", BYTES_AT_ONCE):
            for t in as_bytes(piece["text"]):
                counts = Counter(t.split())
                indices.extend(map(ids.__getitem__, counts))
                data.extend(counts.values())
                ends.append(len(data))
                digests.append(hashlib.sha256(t).digest())
                fails.append(_fails(t))
        own = {"doc_ids": batch["doc_id"].to_pylist(), "parts": batch["part"].to_pylist(), "digests": digests, "fails": fails}
        own |= {"indptr": pack(np.asarray(ends)), "indices": pack(np.asarray(indices)), "data": pack(np.asarray(data))}
        del ends, indices, data
        yield pa.record_batch([pa.array([name]), pa.array([own], _OWN), pa.array([pack_words(ids) if ids else None], pa.binary())], names=["shard", "own", "words"])
        name += 1


def shards(docs: DataFrame) -> DataFrame:
    """LOCAL: the documents as CSR shards, each with a dictionary of its own. Kept in the shared folder, since the names of shards are looked up later."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    return checkpointed(d.mapInArrow(_local, LOCAL))


def _each_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, packed in zip(batch["shard"].to_pylist(), batch["words"], strict=True):
            words = unpack_words(packed.as_py())
            for at in range(0, len(words), WORDS_AT_ONCE):
                part = words[at : at + WORDS_AT_ONCE]
                yield pa.record_batch([pa.array(part, pa.binary()), pa.array(np.full(len(part), shard)), pa.array(np.arange(at, at + len(part), dtype=np.int32))], names=["word", "shard", "local"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words come in order; an id is the partition and the rank of the word there."""
    last, rank, part = None, -1, TaskContext.get().partitionId() << 40
    for batch in batches:
        if batch.num_rows:
            words = batch["word"]
            new = np.concatenate([[words[0].as_py() != last], pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)])
            at = rank + np.cumsum(new)
            last, rank = words[-1].as_py(), int(at[-1])
            yield pa.record_batch([words, batch["shard"], batch["local"], pa.array(part + at)], names=["word", "shard", "local", "id"])


def encoded(local: DataFrame) -> DataFrame:
    """(word, shard, local, id): the words of all shards with their numbers there and their global ids."""
    words = local.filter("words IS NOT NULL").select("shard", "words").mapInArrow(_each_word, "word binary, shard long, local int")
    return words.repartition(partitions(local.sparkSession), "word").sortWithinPartitions("word").mapInArrow(_numbered, "word binary, shard long, local int, id long")


def dictionary(docs: DataFrame) -> DataFrame:
    """(word, id): the distinct words of the documents and the columns of the matrix that they are."""
    return encoded(shards(docs)).select("word", "id").distinct()


def _renumbered(own: pa.Table, found: pa.Table) -> pa.Table:
    """A shard with the global ids of its words."""
    local, ids = found["local"].to_numpy(), np.zeros(found.num_rows, np.int64)
    ids[local] = found["id"].to_numpy()
    (shard,), (r,) = own["shard"].to_pylist(), own["own"].to_pylist()
    r["indices"] = pack(ids[unpack(r["indices"], np.int32)])
    return pa.table([pa.array([shard]), *[pa.array([r[f.name]], f.type) for f in _OWN]], names=["shard", *[f.name for f in _OWN]])


def matrix(docs: DataFrame) -> DataFrame:
    """MATRIX: the document-term matrix as CSR shards over the global dictionary; a row of the table is a shard, a row of the shard a document.

    indptr, indices and data are int64 arrays (see unpack); doc_ids, parts, digests and fails go with the rows.
    """
    local = shards(docs)
    ids = encoded(local).select("shard", "local", "id")  # a group has as many rows as its shard has words
    return local.select("shard", "own").groupBy("shard").cogroup(ids.groupBy("shard")).applyInArrow(_renumbered, MATRIX)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ends, data = unpack(r["indptr"], np.int64), unpack(r["data"], np.int64)
            sums = np.concatenate([[0], np.cumsum(data)])[ends]
            yield pa.record_batch(
                [pa.array(r["doc_ids"], pa.int64()), pa.array(r["parts"], pa.string()), pa.array(r["digests"], pa.binary()), pa.array(r["fails"], pa.string()), pa.array(np.diff(sums)), pa.array(np.diff(ends))],
                names=["doc_id", "part", "digest", "fails", "n_words", "n_distinct"],
            )


def row_sums(shards_: DataFrame) -> DataFrame:
    """ROWS: a row for each document, its words and distinct words from the sum of its matrix row and its number of non-zero columns."""
    return shards_.mapInArrow(_sums, ROWS)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): documents by the letters of all filters that they fail, and by their labels."""
    few = F.when(F.col("n_words") < LEAST_WORDS, "A").otherwise("")
    plain = F.when(100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"), "B").otherwise("")
    d = row_sums(matrix(docs)).select("doc_id", "part", "digest", F.concat(few, plain, "fails").alias("fails"))
    y = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    d = d.join(y, "doc_id", "left").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "part", "digest", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    key = ["digest", "part", "fails", "good", "toxic"]
    d = d.groupBy(*key, "doc_id").agg(F.count("*").alias("n"))
    d = d.groupBy(*key).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    whose = F.min("first.doc_id").over(W.partitionBy("digest"))
    stay = F.when(F.col("first.doc_id") == whose, F.col("first.n")).otherwise(F.lit(0))
    d = d.withColumn("stay", stay)
    both = F.array(F.struct(F.col("fails").alias("fails"), F.col("stay").alias("n")), F.struct(F.concat("fails", F.lit("E")).alias("fails"), (F.col("n") - F.col("stay")).alias("n")))
    return d.select("part", "good", "toxic", F.inline(both)).filter("n > 0").groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: documents kept after it, removed by it, and what that step's filter does beside the others."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    c = failures(docs, labels).withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in orders]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    c = c.withColumn("filter", F.expr("substring(filter_order, step, 1)")).withColumn("before", F.expr("substring(filter_order, 1, step - 1)"))
    fails = F.contains(F.col("fails"), F.col("filter"))
    gone = F.expr("translate(before, fails, '')") != F.col("before")
    n, removed = F.col("n"), fails & ~gone
    counted = lambda ok, n=n: F.sum(F.when(ok, n).otherwise(F.lit(0))).cast("long")
    return c.groupBy("part", "filter_order", "step", "filter").agg(
        counted(~fails & ~gone).alias("kept"), counted(removed).alias("removed"), counted(fails & gone).alias("redundant"), counted(F.col("fails") == F.col("filter")).alias("unique_fails"),
        counted(removed & F.col("good")).alias("good_lost"), counted(removed & F.col("toxic")).alias("toxic_lost"),
        # a document that fails k filters is removed by each of them in 1/k of the orders
        counted(fails, F.expr(f"n * {len(orders)} div length(fails)")).alias("shapley"),
    ).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley", "filter")


ORACLE = r"""
WITH d AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), y AS (
  SELECT doc_id, max(coalesce(quality = 1, FALSE)) AS good, max(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT d.id, part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
      || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
      || CASE WHEN d.id > min(d.id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN y ON y.doc_id = d.id
), c AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)
), s AS (
  SELECT c.*, filter_order, step, substr(filter_order, step, 1) AS filter, contains(fails, substr(filter_order, step, 1)) AS bad, translate(substr(filter_order, 1, step - 1), fails, '') <> substr(filter_order, 1, step - 1) AS gone
  FROM c, o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
)
SELECT part, filter_order, step, CAST(sum(n * (NOT bad AND NOT gone)::INT) AS BIGINT) AS kept, CAST(sum(n * (bad AND NOT gone)::INT) AS BIGINT) AS removed, CAST(sum(n * (bad AND gone)::INT) AS BIGINT) AS redundant,
  CAST(sum(n * (fails = filter)::INT) AS BIGINT) AS unique_fails, CAST(sum(n * (bad AND NOT gone AND good)::INT) AS BIGINT) AS good_lost, CAST(sum(n * (bad AND NOT gone AND toxic)::INT) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN bad THEN n * 120 // length(fails) ELSE 0 END) AS BIGINT) AS shapley, filter
FROM s GROUP BY part, filter_order, step, filter
"""


def op11(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
