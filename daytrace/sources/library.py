"""Saved documents: Markdown files with a front matter of title, date and savedAt."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.textfn import nullif_empty, one_line, trimmed, valid_id
from ..functions.timefn import clock, parse_instant

FRONT = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?"


def _field(head: Column, name: str) -> Column:
    return F.nullif(trimmed(F.regexp_extract(head, rf"(?m)^{name}:(.*)$", 1)), F.lit(""))


def new_ids(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """docs (date, ...) with the id: the date, or the first free of date-2, date-3, ...; a date without a letter, digit or hyphen is `summary`.

    The k-th new document of a stem gets the k-th number that isn't taken: taken numbers shift those at or after them.
    """
    stem = F.coalesce(nullif_empty(F.regexp_replace(F.coalesce("date", F.lit("")), "[^A-Za-z0-9-]", "")), F.lit("summary"))
    d = docs.withColumn("__stem", stem).withColumn("__k", F.row_number().over(W.partitionBy("__stem").orderBy("saved_at", "title")))
    stems = d.groupBy("__stem").agg(F.count("*").alias("__new"))
    free = stems.join(taken.select("id").distinct(), F.startswith(F.col("id"), F.col("__stem")), "left")
    n = F.when(F.col("id") == F.col("__stem"), 1).otherwise(F.expr("try_cast(substring(id, length(__stem) + 2) AS INT)"))
    used = free.withColumn("__n", n).groupBy("__stem", "__new").agg(F.array_sort(F.collect_set(F.when((F.col("id") == F.col("__stem")) | ((F.col("__n") >= 2) & (F.col("id") == F.concat_ws("-", "__stem", "__n"))), F.col("__n")))).alias("__used"))
    numbers = used.select("__stem", F.slice(F.array_except(F.sequence(F.lit(1), (F.col("__new") + F.size("__used")).cast("int")), "__used"), F.lit(1), F.col("__new").cast("int")).alias("__free"))
    d = d.join(numbers, "__stem").withColumn("__n", F.element_at("__free", F.col("__k")))
    return d.withColumn("id", F.when(F.col("__n") == 1, F.col("__stem")).otherwise(F.concat_ws("-", "__stem", "__n"))).drop("__stem", "__k", "__free", "__n")


def file_text(title: Column, date: Column, saved_at: Column, body: Column) -> Column:
    return F.concat(F.lit("---\ntitle: "), one_line(title), F.lit("\ndate: "), date, F.lit("\nsavedAt: "), saved_at, F.lit("\n---\n\n"), body)


def save(docs: DataFrame, root: str) -> None:
    """Writes (id, title, date, saved_at, body) as `<id>.md` each: tasks write single files beside their final names, which are renamed.

    A document of the same id is replaced. One that can't be moved to its name stays in the staging folder, which the error names.
    """
    text = file_text(F.col("title"), F.col("date"), F.col("saved_at"), F.col("body"))
    spark = docs.sparkSession
    staging = f"{root}/library/.saving-{time.time_ns()}"
    docs.filter(valid_id(F.col("id"))).select("id", text.alias("value")).write.partitionBy("id").text(staging)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(staging).getFileSystem(spark._jsc.hadoopConfiguration())
    left = []
    for found in fs.globStatus(path(f"{staging}/id=*/part-*")):  # documents that a person saves: few
        to = path(f"{root}/library/{found.getPath().getParent().getName()[3:]}.md")
        if not replaced(fs, found.getPath(), to):
            left.append(to.getName())
    if left:
        raise OSError(f"not saved: {', '.join(left)}; the documents are in {staging}")
    fs.delete(path(staging), True)


def replaced(fs, file, to) -> bool:
    """Moves a file to a name that may be taken: the old one steps aside until the new one is there, and comes back if it can't be."""
    if not fs.exists(to):
        return fs.rename(file, to)
    aside = to.suffix(f".{time.time_ns()}")
    if not fs.rename(to, aside):
        return False
    if fs.rename(file, to):
        fs.delete(aside, True)
        return True
    fs.rename(aside, to)
    return False


def saved_label(saved_at: Column) -> Column:
    """`2024-03-06 at 01:00`, or `an unknown time` if the instant can't be read."""
    at = parse_instant(saved_at)
    return F.when(at.isNotNull(), F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit(" at "), clock(at))).otherwise("an unknown time")


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(id, title, date, saved_at, bytes, body), the latest saved first. The id is the file's name."""
    files = spark.read.text(f"{root}/library", wholetext=True, pathGlobFilter="*.md").select("value", "_metadata.file_path", F.col("_metadata.file_size").alias("bytes"))
    id_ = F.regexp_extract("file_path", r"([^/]+)\.md$", 1)
    head = F.regexp_extract("value", FRONT, 1)
    e = files.select(id_.alias("id"), _field(head, "title").alias("title"), _field(head, "date").alias("date"), _field(head, "savedAt").alias("saved_at"), "bytes", F.regexp_replace(F.regexp_replace("value", FRONT + r"\n?", ""), r"\n\z", "").alias("body"))
    return e.filter(F.col("id") != "").orderBy(F.desc("saved_at"), F.desc("id"))


def export(spark: SparkSession, root: str, id_: str) -> DataFrame:
    return entries(spark, root).filter(F.col("id") == id_).select("body")
