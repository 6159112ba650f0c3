"""Mixing sources to target weights by repetition.

Sizes are words. Each source gets a target from its weight; its documents repeat
at the rate target / size: every document is emitted floor(rate) times, and once
more if a number in [0, 1) hashed from its doc_id is below the fraction. So a rerun
makes the same mix, and no list of documents is gathered or sorted.

Defined results: a null text has size 0; a null source is a source of its own and
sorts last; rows that repeat a doc_id share its draw; a null doc_id draws as ``''``; an empty
table gives an empty mix; a very long text is counted in its own row, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed

#: Weights by the rank of the source, repeating.
WEIGHTS = (3, 1, 2)
#: The share of all sizes that the mix takes, and the most that a source is repeated.
SHARE, MOST = 1.5, 2.0
#: The table of sources is broadcast up to so many rows (some 100 bytes each).
MOST_BROADCAST = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = "mix") -> Column:
    """A number in [0, 1): 52 bits of a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources rank by range partitions, each of which numbers its own, shifted by the rows of
    those before it. A target is min(most * size, weight * level): the driver raises the one
    number `level` until the targets add up; each round is one sum over the sources.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = checkpointed(s.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").withColumn("part", F.spark_partition_id()))
    before, shift = 0, []
    for part, n in sorted(tuple(r) for r in s.groupBy("part").count().collect()):  # one row for each partition
        shift += [F.lit(part), F.lit(before)]
        before += n
    rank = F.row_number().over(W.partitionBy("part").orderBy("last", "source")) - 1
    rank = rank + (F.create_map(*shift)[F.col("part")] if shift else F.lit(0))
    s = checkpointed(s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size")))
    total = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, was = 0.0, -1.0
    while level != was:
        was = level
        full = F.col("cap") <= F.col("weight") * level
        capped, rest = s.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        level = max(level, (total - capped) / rest) if rest else level
    return s.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * level).alias("target"))


def with_copies(docs: DataFrame, **mix) -> DataFrame:
    """(doc_id, size, source_size, target, copies) with one row for each document."""
    d = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    s = source_targets(d, **mix)
    few = s.count() <= MOST_BROADCAST
    s = s.withColumnRenamed("source", "of")
    d = d.join(F.broadcast(s) if few else s, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (draw(F.col("doc_id")) < rate - F.floor(rate)).cast("long")
    return d.select("doc_id", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The documents, each as often as the mix takes it, with their own columns."""
    s = source_targets(docs.select("source", n_words(F.col("text")).alias("size")), **how)
    few = s.count() <= MOST_BROADCAST
    s = s.select(F.col("source").alias("__of"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("__rate"))
    d = docs.join(F.broadcast(s) if few else s, docs["source"].eqNullSafe(F.col("__of")))
    rate = F.col("__rate")
    copies = (F.floor(rate) + (draw(docs["doc_id"]) < rate - F.floor(rate)).cast("long")).cast("int")
    return d.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select([docs[f"`{c}`"] for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source
), levels AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS level
  UNION ALL
  SELECT i + 1, (SELECT greatest(l.level, (1.5 * sum(source_size) - coalesce(sum(2.0 * source_size) FILTER (2.0 * source_size <= weight * l.level), 0)) / coalesce(sum(weight) FILTER (2.0 * source_size > weight * l.level), 1)) FROM s)
  FROM levels l WHERE i <= (SELECT count(*) FROM s)
), t AS (SELECT source, source_size, least(2.0 * source_size, weight * (SELECT max(level) FROM levels)) AS target FROM s), r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""


def op9(spark, sf_dir: str) -> DataFrame:
    from .common import table

    d = with_copies(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
