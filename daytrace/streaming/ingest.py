"""Streams: ingest of a log as it grows, counts by day, refresh of touched days, repeats dropped with state, in any order of the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources import jsonl


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events of JSON Lines files as they appear in a folder; lines that aren't events are left out."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(F.inline(jsonl.events_of(F.col("value"))))


def table_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table's files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def append_by_day(events: DataFrame, root: str, checkpoint: str, name: str = "stream", then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends each batch to the log by date, so that the day turns with the events; a batch that is tried again takes its own place.

    then is called with each batch when it is in the log, for a refresh of what is derived.
    """

    def batch(df: DataFrame, number: int) -> None:
        jsonl.append(df, root, f"{name}-{number}")
        if then:
            then(df, number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def day_counts(rows: DataFrame) -> DataFrame:
    """(date, events): the live counter; for output mode update or complete."""
    return rows.groupBy("date").agg(F.count("*").alias("events"))


def tumbling_counts(rows: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, events) by event time; rows later than the watermark are dropped, so this is opt-in."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w")).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "events")


def refresh_touched(rows: DataFrame, recompute: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For each batch, calls recompute with the distinct dates that it touches: whole days are computed again, so late rows are never lost."""

    def batch(df: DataFrame, number: int) -> None:
        recompute(df.select("date").distinct(), number)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


REPEATS = "stream int, range long, seq long, app string, title string, url string, place int"


class Ranges(StatefulProcessor):
    """Holds the rows of one range of a stream until the watermark has passed all of them, then puts them in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "seq long, app string, title string, url string")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = int(self.due.get()[0]) if self.due.exists() else None
        for pdf in rows:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            self.rows.appendList([(int(s), a, t, u) for s, a, t, u in zip(pdf["seq"], pdf["app"], pdf["title"], pdf["url"], strict=True)])
            latest = max(int(t) for t in pdf["ms"]) + 1
            if due is None or latest > due:
                if due is not None:
                    self.handle.deleteTimer(due)
                due = latest
                self.handle.registerTimer(due)
        self.due.update((due,))
        yield _ordered([], key)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = sorted(self.rows.get(), key=lambda r: r[0])
        kept = [(*r, 0) for before, r in zip([None, *rows], rows, strict=False) if before is None or tuple(before)[1:] != tuple(r)[1:]]
        kept[0] = (*kept[0][:-1], 1)  # the first row of the range
        kept.append((*rows[-1], 2))  # what the next range begins after; not a row that is kept
        self.rows.clear()
        self.due.clear()
        yield _ordered(kept, key)

    def close(self) -> None:
        pass


def _ordered(rows: list[tuple], key: tuple) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["seq", "app", "title", "url", "place"]).astype({"seq": "int64", "place": "int32", "app": object, "title": object, "url": object})
    out.insert(0, "stream", pd.Series([key[0]] * len(out), dtype="int32"))
    out.insert(1, "range", pd.Series([key[1]] * len(out), dtype="int64"))
    return out


def repeats_by_range(rows: DataFrame, late: str, width: int = 1 << 12) -> DataFrame:
    """REPEATS of a stream of (stream, seq, ts, app, title, url) whose rows come in any order and in any files and chunks.

    The state of a (stream, range of `width` numbers of seq) is its rows until the watermark, `late` behind
    the latest time, has passed them; then the rows that differ from the one before in the range leave in order, the
    range's first one (place 1) and a mark of its last one (place 2) with them. Ranges are keys of their own,
    so that they may end in any order: see stitched(). Later rows are dropped, as the watermark says.
    """
    kept = rows.withWatermark("ts", late).select("stream", F.floor(F.col("seq") / width).alias("range"), "seq", "ts", F.unix_millis("ts").alias("ms"), "app", "title", "url")
    return kept.groupBy("stream", "range").transformWithStateInPandas(Ranges(), REPEATS, "Append", "EventTime")


def stitched(ranges: DataFrame) -> DataFrame:
    """(stream, seq, app, title, url) of the table that repeats_by_range fills: a range's first row is kept unless the last row of the range before is equal."""
    what = F.struct("app", "title", "url")
    ends = ranges.groupBy("stream", "range").agg(F.max(F.when(F.col("place") == 2, what)).alias("__last"))
    before = ends.select("stream", "range", F.lag("__last").over(W.partitionBy("stream").orderBy("range")).alias("__before"))
    rows = ranges.filter("place < 2").join(before, ["stream", "range"])
    return rows.filter((F.col("place") == 0) | ~F.col("__before").eqNullSafe(what)).select("stream", "seq", "app", "title", "url")
