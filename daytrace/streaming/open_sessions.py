"""Sessions kept open in a stream: the state of a stream's day is its open episode alone, which leaves once it is closed.

An episode closes with a row of another app or privacy, an away event, or a row after too long a
silence; what is open when its day is over closes by a timer, once the watermark has passed the day. (Silence alone
can't close it earlier: an away event that follows ends it at its own time.)

Rows of a batch are put in the order of the log. A row that belongs before what has been folded already
can't change episodes that have left: its day is reported as late, and is computed again whole from the log.
Rows behind the watermark are dropped by the engine before they get here; they are in the log, so
that the store's ledger finds their day changed (Store.refresh).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.sessions import relevant
from ..schema import CREDIT_MS, IDLE_MS

#: What transformWithState keeps its state in.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED = "stream int, date string, app string, start_ms long, end_ms long, active_ms long, event_count long, is_private boolean, late boolean"
_OPEN = "is_open boolean, app string, private boolean, start long, last long, active long, n long, seq long"
DAY_MS = 86_400_000


class OpenEpisode(StatefulProcessor):
    """Folds a stream's day, row by row; the state is one row."""

    def __init__(self, wait_ms: int = 0):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stream, date = key
        known = self.state.exists()
        is_open, app, private, start, last, active, n, seq = self.state.get() if known else (False, "", False, 0, 0, 0, 0, None)
        out: list[tuple] = []
        late = False

        def close(at: int) -> None:
            end = max(at, start)
            out.append((stream, date, app, start, end, active + min(max(end - last, 0), CREDIT_MS), n, private, False))

        batch = pd.concat(list(rows)).sort_values("seq")  # one batch of one day of one stream
        for s, ms, away, private_, app_ in zip(batch["seq"], batch["ms"], batch["away"], batch["private"], batch["app"], strict=True):
            s, ms, away, private_ = int(s), int(ms), bool(away), bool(private_)
            if seq is not None and s <= seq:
                late = True
                continue
            seq = s
            if is_open and not away and ms - last > IDLE_MS:
                close(last)
                is_open = False
            if is_open and (away or (app, private) != (app_, private_)):
                close(ms)
                is_open = False
            if away:
                continue
            if is_open:
                active, n, last = active + min(max(ms - last, 0), CREDIT_MS), n + 1, max(last, ms)
            else:
                is_open, app, private, start, last, active, n = True, app_, private_, ms, ms, 0, 1
        if seq is not None:
            self.state.update((is_open, app, private, start, last, active, n, seq))
            if not known:
                self.handle.registerTimer(int(pd.Timestamp(date).value // 1_000_000) + DAY_MS + self.wait_ms)
        if late:
            out.append((stream, date, None, None, None, None, None, None, True))
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The day is over."""
        out = []
        if self.state.exists():
            is_open, app, private, start, last, active, n, _ = self.state.get()
            if is_open:
                out.append((*key, app, start, max(last, start), active, n, private, False))
            self.state.clear()
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in CLOSED.split(", ")]
    kinds = {"stream": "int32", "start_ms": "Int64", "end_ms": "Int64", "active_ms": "Int64", "event_count": "Int64", "is_private": "boolean", "late": "bool"}
    return pd.DataFrame(rows, columns=names).astype(kinds)


def closed_episodes(activity: DataFrame, late: str = "1 hour") -> DataFrame:
    """CLOSED: the episodes of a stream of activity rows (seq a number) as they close; a row that is late names a day to compute again.

    late is the watermark's delay. Days are those of the session's zone, which must be UTC for the timer to fall on their end.
    """
    # rows of other kinds move the clock, too: a filter that reads the time isn't moved before the watermark
    rows = activity.withWatermark("ts", late).withColumn("kind", F.when(F.col("ts").isNotNull(), F.col("kind")))
    kept = relevant(rows, keep=("ts",)).withColumn("seq", F.col("seq").cast("long"))
    return kept.select("stream", "date", "seq", "ts", "ms", "away", "private", "app").groupBy("stream", "date").transformWithStateInPandas(OpenEpisode(), CLOSED, "Append", "EventTime")


def keep_sessions(activity: DataFrame, path: str, checkpoint: str, again: Callable[[DataFrame, int], None], late: str = "1 hour") -> StreamingQuery:
    """Appends closed episodes to a table by batch (a batch that is tried again takes its place), and calls again(days, number) with (stream, date) of late rows."""
    spark = activity.sparkSession
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        df.filter("NOT late").drop("late").write.mode("overwrite").parquet(f"{path}/batch={number:08d}")
        days = df.filter("late").select("stream", "date").distinct()
        if not days.isEmpty():
            again(days, number)
        df.unpersist()

    try:
        return closed_episodes(activity, late).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def read_sessions(spark, path: str) -> DataFrame:
    """The episodes that have closed so far, as sessions.core gives them."""
    e = spark.read.parquet(path)
    return e.select("stream", "date", F.concat("date", F.lit("#"), F.col("start_ms").cast("string")).alias("id"), "app", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "active_ms", "event_count", "is_private")
