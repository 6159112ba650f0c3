"""The event log: JSON Lines files by day, read with the order of their lines, and what is appended to them.

A day is the file `events/YYYY-MM-DD.jsonl`, then the batches `log/batch=.../date=YYYY-MM-DD/` in
the order of their names, which begin with the time of the append. Files are splittable: a row's
place is (batch, file, block, row in the block), a struct that sorts as the log goes on.

Records are strict, files lenient: a line that isn't a whole event (unreadable, a required
field missing, an unknown kind) is left out and counted; blank lines are nothing; unknown
fields are ignored; a missing file is an empty day.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefn import parse_instant
from ..schema import EVENT, KINDS

DAY_FILE = r"(\d{4}-\d{2}-\d{2})\.jsonl$"


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


SEQ = "struct<batch:string,file:string,block:bigint,place:bigint>"


def _of_path(path: Column) -> tuple[Column, Column, Column]:
    """The batch, the file in it (both empty for a day file) and the date that a path names. The path is cut at its slashes: a pattern that looks for the end tries every place of it, for each line."""
    parts = F.split(path, "/")
    name, of_day, of_batch = (F.try_element_at(parts, F.lit(k)) for k in (-1, -2, -3))
    batched = F.coalesce(F.startswith(of_day, F.lit("date=")) & F.startswith(of_batch, F.lit("batch=")), F.lit(False))
    day = F.when(batched, F.substring(of_day, 6, 1 << 30)).when(F.endswith(name, F.lit(".jsonl")), F.substring(name, -16, 10))
    return F.when(batched, F.substring(of_batch, 7, 1 << 30)).otherwise(""), F.when(batched, name).otherwise(""), F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date"))


def _lines(spark: SparkSession, root: str, names: str = "*") -> DataFrame:
    """(date, seq, line) of the day files and batches whose dates match."""
    paths = [p for p in (f"{root}/events/{names}.jsonl", f"{root}/log/batch=*/date={names}/*.json") if _exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], f"date date, seq {SEQ}, line string")
    batch, file, date = _of_path(F.col("_metadata.file_path"))
    # all in the select that numbers the lines, which no filter passes: so a path is read once for each line
    place = F.struct(batch.alias("batch"), file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    rows = spark.read.text(paths).select(date.alias("date"), place.alias("seq"), F.col("value").alias("line"))
    return rows.filter("date IS NOT NULL").filter(F.trim("line") != "")


def is_event(e: Column) -> Column:
    """A parsed record that has what an event must have."""
    app, browser = e["application"], e["browser"]
    whole = e["version"].isNotNull() & e["id"].isNotNull() & e["timestamp"].isNotNull() & e["kind"].isin(*KINDS)
    named = app.isNull() | (app["name"].isNotNull() & app["path"].isNotNull() & app["pid"].isNotNull())
    return F.coalesce(whole & named & (browser.isNull() | browser["isPrivate"].isNotNull()), F.lit(False))


def events_of(line: Column) -> Column:
    """The line's event in an array, which is empty if the line isn't one: conditions on a parsed column would parse the line again for each field that they name."""
    return F.filter(F.array(F.from_json(line, EVENT)), lambda e: e.isNotNull() & is_event(e))


def read_days(spark: SparkSession, root: str, dates: list[str] | None = None) -> DataFrame:
    """Events (schema.EVENT) with date and seq; only the files of the dates named are opened."""
    names = "{" + ",".join(dates) + "}" if dates else "*"
    return _lines(spark, root, names).select("date", "seq", F.inline(events_of(F.col("line"))))


def read_day(spark: SparkSession, root: str, date: str) -> DataFrame:
    return read_days(spark, root, [date])


def bad_lines(spark: SparkSession, root: str) -> DataFrame:
    """(date, bad): lines left out."""
    return _lines(spark, root).groupBy("date").agg(F.sum(1 - F.size(events_of(F.col("line")))).alias("bad"))


def day_stats(records: DataFrame, *more: Column) -> DataFrame:
    """(date, events, last_event_at): the timestamp of the last record in the order of the log, which isn't the latest one. more: further aggregates."""
    return records.groupBy("date").agg(F.count("*").alias("events"), F.max_by("timestamp", "seq").alias("last_event_at"), *more)


def names(spark: SparkSession, pattern: str) -> list[str]:
    """The last parts of the paths that match."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or [])


def moved(spark: SparkSession, path: str, to: str) -> bool:
    """Renames a file or folder, unless the name is taken."""
    p, q = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(to)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(q.getParent())
    return not fs.exists(q) and fs.rename(p, q)


def _named_days(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], "day string, modified timestamp, length long, mark long")
    files = spark.read.format("binaryFile").load(path)  # the contents aren't read
    return files.select(F.regexp_extract("path", pattern, 1).alias("day"), F.col("modificationTime").alias("modified"), "length", F.xxhash64("path", "modificationTime", "length").alias("mark"))


def _files_of_days(spark: SparkSession, root: str) -> DataFrame:
    files = _named_days(spark, f"{root}/events/*.jsonl", DAY_FILE).union(_named_days(spark, f"{root}/log/batch=*/date=*/*.json", r"/date=(\d{4}-\d{2}-\d{2})/[^/]+$"))
    return files.withColumn("date", F.try_to_date("day", "yyyy-MM-dd")).filter("date IS NOT NULL")


def changed_days(spark: SparkSession, root: str) -> DataFrame:
    """(date, modified): the days of the log, and when the last of their files was written; other names are ignored."""
    return _files_of_days(spark, root).groupBy("date").agg(F.max("modified").alias("modified"))


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """(date, fingerprint): the days of the log, and what changes with any of their files: how many, their bytes, and a sum over names, times and sizes."""
    f = _files_of_days(spark, root).groupBy(F.date_format("date", "yyyy-MM-dd").alias("date"))
    return f.agg(F.concat_ws("-", F.count("*"), F.sum("length"), F.bit_xor("mark")).alias("fingerprint"))


def recorded_days(spark: SparkSession, root: str, folder: str | None = None, suffix: str = "jsonl") -> DataFrame:
    """(date) of the days of the log, or of a folder's files with a suffix, in order."""
    days = changed_days(spark, root) if folder is None else _named_days(spark, f"{root}/{folder}/*.{suffix}", r"(\d{4}-\d{2}-\d{2})\.%s$" % suffix).select(F.try_to_date("day", "yyyy-MM-dd").alias("date"))
    return days.select("date").filter("date IS NOT NULL").distinct().orderBy("date")


def delete(spark: SparkSession, pattern: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(path) or []:
        fs.delete(found.getPath(), True)


def append(records: DataFrame, root: str, name: str | None = None) -> None:
    """Appends records (schema.EVENT) as a batch, in their order, filed under their local date; absent fields are left out of the JSON.

    A record whose timestamp can't be read is filed under today. A batch of a name that is there already
    (a stream's batch that is tried again) takes its place, once the new one is written whole. Files are named
    and filled in the order of the records, so that records need no field for it.
    """
    spark = records.sparkSession
    day = F.coalesce(F.to_date(parse_instant(F.col("timestamp"))), F.current_date())
    batch = f"{time.time_ns() // 1000:017d}-{name or 'append'}"
    staged = f"{root}/log/.writing-{batch}"
    rows = records.withColumn("__place", F.monotonically_increasing_id()).withColumn("date", day).sortWithinPartitions("date", "__place").drop("__place")
    rows.write.partitionBy("date").option("ignoreNullFields", "true").json(staged)
    if name:
        delete(spark, f"{root}/log/batch=*-{name}")
    if not moved(spark, staged, f"{root}/log/batch={batch}"):
        raise OSError(f"the batch stays in {staged}")


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """All of the log, in its order."""
    return read_days(spark, root)


def prune(records: DataFrame, today: str, keep_days: int) -> DataFrame:
    """Records of the days kept; 0 keeps all."""
    return records if keep_days == 0 else records.filter(F.col("date") >= F.date_sub(F.lit(today).cast("date"), keep_days))
