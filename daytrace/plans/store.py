"""The derived tables of a day log: episodes and their index, always rebuilt from the log; and written summaries.

A run writes the episodes, postings, index and days of some dates into folders of its own, beside those of
earlier runs. The ledger tells which run holds each date: one row for each processed day, whether it
has episodes or not, with a fingerprint of the log that it was made from. A new ledger is one folder that is renamed into place when
all tables of its runs are written, so that readers see all of a run or nothing, and may keep the version
that they began with. Rows of runs that no ledger names are dead; vacuum() deletes them.

Postings are segments: files that each hold a range of terms, of all dates of a run. Their first and last terms are listed
beside them, so that a search opens the files of its words alone; compact() merges the segments of many runs. A
date that is forgotten is dead in its segments at once, and gone from the disk with the next compact() and vacuum().
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..adapter import from_records
from ..operators import rollup, search, sessions
from ..sources import jsonl

VERSION = 2
#: Written summaries: they aren't derived from the log alone, so rebuilding leaves them.
HOURS = "stream int, date string, hour int, text string, active_ms long, generated_at string, provider string, model string"
DAYS = "stream int, date string, text string, generated_at string"
TABLES = ("episodes", "postings", "indexed", "days")
#: A processed day: the runs that hold its tables and its postings, the state of its log then, the version of the code, and its episodes.
LEDGER = "date string, run string, postings_run string, fingerprint string, version int, episodes long"
SEGMENTS = "path string, first string, last string, n long, run string"


class Store:
    """at: the ledger to read, the latest by default (None). width: cuts days into ranges of so many rows, for days too large for one sort."""

    def __init__(self, spark: SparkSession, root: str, at: int | None = None, width: int | None = None):
        self.spark, self.root, self.at, self.width = spark, root, at, width

    def path(self, name: str) -> str:
        return f"{self.root}/derived/v{VERSION}/{name}"

    # the ledger

    def versions(self) -> list[int]:
        return sorted(int(n.removeprefix("v=")) for n in jsonl.names(self.spark, f"{self.path('ledger')}/v=*"))

    def ledger(self) -> DataFrame:
        """LEDGER: one row for each processed day."""
        known = self.versions()
        at = self.at if self.at is not None else known[-1] if known else None
        return self.spark.createDataFrame([], LEDGER) if at is None else self.spark.read.schema(LEDGER).parquet(f"{self.path('ledger')}/v={at:08d}")

    def snapshot(self) -> Store:
        """A store that goes on reading what is there now."""
        known = self.versions()
        return Store(self.spark, self.root, known[-1] if known else 0, self.width)

    def _commit(self, ledger: DataFrame) -> None:
        """Makes a ledger the latest: it is written beside the others and renamed into place."""
        known = self.versions()
        to = f"{self.path('ledger')}/v={(known[-1] if known else 0) + 1:08d}"
        staged = f"{self.path('ledger')}/.{uuid.uuid4().hex}"
        ledger.select(*[c.split()[0] for c in LEDGER.split(", ")]).coalesce(1).write.parquet(staged)
        if not jsonl.moved(self.spark, staged, to):
            jsonl.delete(self.spark, staged)
            raise OSError(f"another run has written {to} meanwhile")

    # the tables

    def schema(self, name: str) -> T.StructType:
        none = self.spark.createDataFrame([], T.StructType(jsonl.EVENT.fields)).withColumn("date", F.lit(None).cast("date")).withColumn("seq", F.lit(None).cast(jsonl.SEQ))
        e = sessions.episodes(from_records(none))
        made = {"episodes": e, "postings": search.postings(e), "indexed": search.indexed(e), "days": rollup.daily(e)}[name].schema
        return T.StructType([f for f in made if f.name != "date" or name == "postings"])

    def _run(self, name: str, run: str) -> DataFrame:
        """What one run wrote."""
        schema = self.schema(name)
        schema = schema if name == "postings" else T.StructType([*schema, T.StructField("date", T.StringType())])
        path = f"{self.path(name)}/run={run}"
        return self.spark.read.schema(schema).parquet(path) if jsonl._exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _all(self, name: str, paths: list[str]) -> DataFrame:
        schema = T.StructType([*self.schema(name), T.StructField("run", T.StringType())])
        schema = schema if name == "postings" else T.StructType([*schema, T.StructField("date", T.StringType())])
        return self.spark.read.schema(schema).option("basePath", self.path(name)).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _alive(self, rows: DataFrame, run: str) -> DataFrame:
        live = self.ledger().select("date", F.col(run).alias("run"))  # a row for each day
        return rows.join(F.broadcast(live), ["date", "run"], "left_semi").drop("run")

    def read(self, name: str) -> DataFrame | None:
        """A table as the ledger has it, or None if no day has been processed."""
        if self.ledger().isEmpty():
            return None
        return self._alive(self._all(name, [self.path(name)] if jsonl._exists(self.spark, f"{self.path(name)}/run=*") else []), "postings_run" if name == "postings" else "run")

    def _write(self, df: DataFrame, name: str, run: str) -> None:
        df.write.partitionBy("date").parquet(f"{self.path(name)}/run={run}")

    def _write_segments(self, postings: DataFrame, run: str) -> None:
        """Postings by ranges of terms, and the list of the files with the first and last term of each."""
        path = f"{self.path('postings')}/run={run}"
        postings.select("term", "stream", "date", "id").repartitionByRange("term").sortWithinPartitions("term", "date").write.parquet(path)
        files = self._run("postings", run).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("term").alias("first"), F.max("term").alias("last"), F.count("*").alias("n"))
        files.coalesce(1).write.parquet(f"{self.path('segments')}/run={run}")

    def segments(self, query: str | None = None) -> DataFrame:
        """SEGMENTS that the ledger's runs have: all, or those whose range can hold a word that begins with one of the query's."""
        if not jsonl._exists(self.spark, f"{self.path('segments')}/run=*"):
            return self.spark.createDataFrame([], SEGMENTS)
        live = self.ledger().select(F.col("postings_run").alias("run")).distinct()
        s = self.spark.read.schema(SEGMENTS).option("basePath", self.path("segments")).parquet(self.path("segments")).join(F.broadcast(live), "run", "left_semi").select("path", "first", "last", "n", "run")
        if query is None:
            return s
        hit = F.lit(False)
        for t in sorted(set(search.query_terms(self.spark, query))):
            hit = hit | ((F.col("last") >= t) & ((F.col("first") <= t) | F.startswith("first", F.lit(t))))
        return s.filter(hit)

    def postings(self, query: str) -> DataFrame | None:
        """The postings that a query needs: the segments of its words alone are opened."""
        if self.ledger().isEmpty():
            return None
        paths = sorted(r["path"] for r in self.segments(query).select("path").collect())  # the files of a few ranges of terms
        return self._alive(self._all("postings", paths), "postings_run")

    def search(self, query: str, limit: int = 50) -> DataFrame:
        return search.search(self.postings(query), self.read("indexed"), query, limit)

    # runs

    def process(self, dates: list[str] | None = None) -> None:
        """Sessionises, rolls up and indexes days of the log (all, or those named); days without episodes are processed days, too."""
        seen = jsonl.fingerprints(self.spark, self.root)
        if dates:
            seen = seen.filter(F.col("date").isin(dates))
        # the state of the log before it is read: what is appended meanwhile makes the day stale again. A row for each day
        seen = self.spark.createDataFrame([tuple(r) for r in seen.select("date", "fingerprint").collect()], "date string, fingerprint string")
        run = f"{time.time_ns():019d}"
        records = from_records(jsonl.read_days(self.spark, self.root, dates))
        ranges = sessions.seq_range(records, self.width) if self.width else None
        self._write(sessions.episodes(records, ranges, spread=True), "episodes", run)
        episodes = self._run("episodes", run)
        self._write_segments(search.postings(episodes), run)
        self._write(search.indexed(episodes), "indexed", run)
        self._write(rollup.daily(episodes), "days", run)
        counts = episodes.groupBy("date").agg(F.count("*").alias("episodes"))
        new = seen.join(counts, "date", "left").select("date", F.lit(run).alias("run"), F.lit(run).alias("postings_run"), "fingerprint", F.lit(VERSION).alias("version"), F.coalesce("episodes", F.lit(0)).cast("long").alias("episodes"))
        old = self.ledger().join(F.broadcast(seen.select("date")), "date", "left_anti")
        self._commit(old.unionByName(new))

    def stale(self) -> DataFrame:
        """(date): days whose log isn't as it was when they were processed, or that never were. Days whose log is gone are fresh."""
        log = jsonl.fingerprints(self.spark, self.root).select("date", F.col("fingerprint").alias("now"))
        return log.join(self.ledger(), "date", "left").filter(F.col("fingerprint").isNull() | (F.col("fingerprint") != F.col("now")) | (F.col("version") != VERSION)).select("date")

    def refresh(self) -> list[str]:
        """Processes the stale days; the driver holds their dates alone."""
        dates = sorted(r[0] for r in self.stale().collect())
        if dates:
            self.process(dates)
        return dates

    def rebuild(self) -> None:
        self.process()

    def forget_day(self, date: str) -> None:
        """Takes a day out of the ledger and deletes its rows; its postings are dead, and leave the disk with compact() and vacuum()."""
        if self.versions():
            self._commit(self.ledger().filter(F.col("date") != date))
        for name in TABLES:
            jsonl.delete(self.spark, f"{self.path(name)}/run=*/date={date}")

    def forget_all(self) -> None:
        jsonl.delete(self.spark, f"{self.root}/derived")

    def compact(self) -> None:
        """Merges the segments of all runs into those of one, without dead rows."""
        alive = self.read("postings")
        if alive is not None:
            run = f"{time.time_ns():019d}"
            self._write_segments(alive, run)
            self._commit(self.ledger().withColumn("postings_run", F.lit(run)))

    def vacuum(self) -> list[str]:
        """Deletes the ledgers before the latest and the folders of runs that it doesn't name; returns these. Readers of an older version must be done."""
        known = self.versions()
        runs = {r[0] for r in self.ledger().select("run").distinct().collect()}  # as many as days, at most
        postings = {r[0] for r in self.ledger().select("postings_run").distinct().collect()}
        gone = []
        for name in (*TABLES, "segments"):
            keep = postings if name in ("postings", "segments") else runs
            for folder in jsonl.names(self.spark, f"{self.path(name)}/run=*"):
                if folder.removeprefix("run=") not in keep:
                    jsonl.delete(self.spark, f"{self.path(name)}/{folder}")
                    gone.append(f"{name}/{folder}")
        for v in known[:-1]:
            jsonl.delete(self.spark, f"{self.path('ledger')}/v={v:08d}")
        return gone

    def prune(self, today: str, keep_days: int) -> list[str]:
        """Deletes the log of days older than keep_days (0 keeps all); derived tables stay. Returns the dates."""
        if keep_days == 0:
            return []
        old = jsonl.recorded_days(self.spark, self.root).filter(F.col("date") < F.date_sub(F.lit(today).cast("date"), keep_days))
        dates = [str(r[0]) for r in old.collect()]
        for d in dates:
            jsonl.delete(self.spark, f"{self.root}/events/{d}.jsonl")
            jsonl.delete(self.spark, f"{self.root}/log/batch=*/date={d}")
        return dates

    def _write_summaries(self, rows: DataFrame, name: str) -> None:
        rows.withColumn("version", F.lit(time.time_ns())).write.mode("append").partitionBy("date").parquet(f"{self.root}/summaries/{name}")

    def _summaries(self, name: str, keys: list[str], schema: str) -> DataFrame:
        """The last written row of each key; a row without text takes back what was written."""
        path = f"{self.root}/summaries/{name}"
        if not jsonl._exists(self.spark, f"{path}/date=*"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, version long").parquet(path)
        rest = [c for c in rows.columns if c not in (*keys, "version")]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("last")).select(*keys, "last.*")
        return last.filter(F.col("text").isNotNull()).select(*[c.split()[0] for c in schema.split(", ")])

    def save_hours(self, hours: DataFrame) -> None:
        """Hour summaries (HOURS); those of the same stream, date and hour are replaced."""
        self._write_summaries(hours.select(*[c.split()[0] for c in HOURS.split(", ")]), "hours")

    def save_days(self, days: DataFrame) -> None:
        """Day summaries (DAYS), likewise."""
        self._write_summaries(days.select(*[c.split()[0] for c in DAYS.split(", ")]), "days")

    def hours(self) -> DataFrame:
        return self._summaries("hours", ["stream", "date", "hour"], HOURS)

    def daily(self) -> DataFrame:
        return self._summaries("days", ["stream", "date"], DAYS)

    def forget_summary(self, date: str) -> None:
        """Takes back the summaries of a day."""
        jsonl.delete(self.spark, f"{self.root}/summaries/*/date={date}")
