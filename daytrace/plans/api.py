"""The read API over a store: days, summaries, search, recent episodes, the log and the library, as DataFrames.

`allow_history=False` refuses other days than today where a date is named; with `strict`
it holds for search and recent as well.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import privacy, rollup, search
from ..sources import jsonl, library
from . import narrative
from .store import Store

LIMITS = (1, 200)
LOOK_BACK = 7


def clamped(limit: int | None, default: int) -> int:
    return max(LIMITS[0], min(LIMITS[1], default if limit is None else limit))


def recent(episodes: DataFrame, today: str, limit: int = 10, days: int = LOOK_BACK) -> DataFrame:
    """The latest episodes of the last days, newest first."""
    since = F.date_sub(F.lit(today).cast("date"), days - 1)
    return episodes.filter((F.col("date").cast("date") >= since) & (F.col("date").cast("date") <= F.lit(today).cast("date"))).orderBy(F.desc("date"), F.desc("start"), F.desc("id"), "stream").limit(limit)


class Api:
    def __init__(self, store: Store, today: str, allow_history: bool = True, strict: bool = False):
        self.store, self.today, self.allow_history, self.strict = store, today, allow_history, strict

    def _date(self, date: str) -> str:
        dt.date.fromisoformat(date)
        if date != self.today and not self.allow_history:
            raise PermissionError("history is not shared: only today may be asked for")
        return date

    def _episodes(self) -> DataFrame:
        e = self.store.read("episodes")
        if e is None:
            raise LookupError("no day has been processed")
        return e.filter(F.col("date") == self.today) if self.strict and not self.allow_history else e

    def get_day(self, date: str, with_episodes: bool = True) -> dict[str, DataFrame]:
        """The day with its summaries (day: daily_summary and hourly_summaries), its apps and hours, and its episodes unless only summaries are shared."""
        e = self._episodes().filter(F.col("date") == self._date(date))
        slices = rollup.hour_slices(e)
        daily = self.store.daily().filter(F.col("date") == date).withColumnRenamed("text", "daily")
        day = narrative.day_views(rollup.daily(e), self.store.hours().filter(F.col("date") == date), daily)
        out = {"day": day, "apps": rollup.app_usage(e), "hours": rollup.hourly(slices)}
        return out | ({"episodes": privacy.public_episodes(e)} if with_episodes else {})

    def get_today(self) -> dict[str, DataFrame]:
        return self.get_day(self.today)

    def summary(self, date: str) -> dict[str, DataFrame]:
        return self.get_day(date, with_episodes=False)

    def search_history(self, query: str, limit: int | None = None) -> DataFrame:
        if not query.strip():
            raise ValueError("search_history needs a query")
        self._episodes()
        indexed = self.store.read("indexed")
        if self.strict and not self.allow_history:
            indexed = indexed.filter(F.col("date") == self.today)
        return privacy.search_result(search.search(self.store.postings(query), indexed, query, clamped(limit, 50)))

    def get_recent(self, count: int | None = None) -> DataFrame:
        return privacy.public_episodes(recent(self._episodes(), self.today, clamped(count, 10)))

    def days(self) -> DataFrame:
        """The processed days, with or without episodes."""
        return self.store.ledger().select("date").orderBy("date")

    def recorded_days(self) -> DataFrame:
        return jsonl.recorded_days(self.store.spark, self.store.root)

    def read_day(self, date: str) -> DataFrame:
        """The day's events in the order of the log."""
        return jsonl.read_day(self.store.spark, self.store.root, self._date(date)).orderBy("seq")

    def library(self) -> DataFrame:
        return library.entries(self.store.spark, self.store.root)

    def status(self) -> DataFrame:
        """(days, recorded_today, last_event_at, stale): one row."""
        spark = self.store.spark
        today = jsonl.day_stats(jsonl.read_day(spark, self.store.root, self.today))
        counts = self.recorded_days().agg(F.count("*").alias("days")).crossJoin(self.store.stale().agg(F.count("*").alias("stale")))
        return counts.crossJoin(today.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("recorded_today"), F.max("last_event_at").alias("last_event_at")))  # one row each

    def health(self) -> dict[str, str]:
        return {"status": "ok"}

    def tools(self) -> list[dict]:
        """The tools that run_tool() takes, with the schemas of their arguments."""
        range_ = "Which day, written like 2024-03-05." + ("" if self.allow_history else " Only the current day is shared here.")
        number = {"type": "integer", "minimum": LIMITS[0], "maximum": LIMITS[1]}
        text = {"type": "string"}
        of = lambda name, what, properties, required=(): {"name": name, "description": what, "inputSchema": {"type": "object", "properties": properties, "required": list(required), "additionalProperties": False}}
        return [
            of("get_today", "Today's sessions, the time in each application, and the summaries written.", {}),
            of("get_day", "Sessions, applications and summaries of one day, chosen by its date.", {"date": text | {"description": range_}}, ["date"]),
            of("search_history", "Sessions that hold every word of a query; private ones are found by application alone.", {"query": text, "limit": number}, ["query"]),
            of("get_recent", "The latest sessions of the last week, newest first.", {"count": number}),
        ]

    def run_tool(self, name: str, args: dict):
        listed = {t["name"]: t["inputSchema"] for t in self.tools()}
        if name not in listed:
            raise KeyError(f"no tool is named {name!r}")
        missing = [k for k in listed[name]["required"] if k not in args]
        if missing or set(args) - set(listed[name]["properties"]):
            raise ValueError(f"{name} takes {sorted(listed[name]['properties'])}, needs {listed[name]['required']}")
        return getattr(self, name)(**args)
