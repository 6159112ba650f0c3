"""The corpus pipeline: documents pass the stages in order, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir); docs are what the stage before wrote. All but the
last return the columns of documents.

Defined results: a null or empty text is not toxic, has no lines, links with nothing, holds no passage and
has size 0 in the mix, where its copies follow the rate of its source like any other's; rows that repeat a doc_id and a text go or stay
together; a text that repeats under another doc_id goes; a null doc_id sorts last; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace.llm import decontaminate, linededup, minhash, mixing, toxicity
from daytrace.llm.common import checkpointed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores 0.7 or more go; it learns from the labels of the documents at hand."""
    toxic = toxicity.classify(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(toxic, docs["doc_id"].eqNullSafe(toxic["__gone"]), "left_anti")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks that an earlier document has are deleted; a document that consists of such blocks alone goes."""
    return linededup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id."""
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mix)]

#: No SQL trains the first stage's network; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage returns is written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
