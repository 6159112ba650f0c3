"""Summary runs over a store: hours that need one, then the days that they change. Models are any callable."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.textfn import tidy
from ..operators import privacy, rollup
from . import narrative
from .store import Store

KEYS = ["stream", "date"]
Complete = Callable[[str, int], str]
#: The local hour from which on yesterday counts as over.
EARLIEST_HOUR = 5


def due(hour: int, wanted: bool = True) -> bool:
    """Whether a scheduler that asks from time to time should summarise yesterday now."""
    return wanted and hour >= EARLIEST_HOUR


def _asked(plan: DataFrame, complete: Complete) -> DataFrame:
    """plan (stream, date, hour, action, user, max_tokens) with text and error; a day's hours go in order and end with the first failure."""

    def day(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, failed = [], False
        for r in pdf.sort_values("hour").itertuples(index=False):
            text = error = None
            action = r.action
            if failed:
                action = "unreached"
            elif action == "write":
                try:
                    text = narrative.with_retries(lambda r=r: complete(r.user, int(r.max_tokens)))
                except Exception as e:  # whatever a provider raises is the run's failure
                    error, failed = str(e), True
            rows.append((r.stream, r.date, r.hour, action, r.active_ms, text, error))
        return pd.DataFrame(rows, columns=["stream", "date", "hour", "action", "active_ms", "text", "error"])

    return plan.groupBy(*KEYS).applyInPandas(day, "stream int, date string, hour int, action string, active_ms long, text string, error string")


def summarise(store: Store, complete: Complete, provider: str, model: str, now: str, dates: list[str] | None = None, rewrite: bool = False) -> DataFrame:
    """Fills in the hours without a fresh summary, then writes the days that have none or changed; returns the report.

    (stream, date, hours_written, hours_skipped, hours_too_quiet, daily_written, failure). The first failure of a
    day ends that day. Answers are tables of the store before anything reads them, so that no model is asked twice.
    """
    e = store.read("episodes")
    if e is None:
        raise LookupError("no day has been processed")
    e = e.filter(F.col("date").isin(dates)) if dates else e
    slices = rollup.hour_slices(e)
    hours, written = rollup.hourly(slices), store.hours()
    plan = narrative.run_plan(hours, written.limit(0) if rewrite else written)
    prompts = narrative.hour_prompts(privacy.public_episodes(e), rollup.hour_episode_ids(slices), hours).select(*KEYS, "hour", "user", "max_tokens")
    # an hour that has no prompt has nothing worth telling
    todo = plan.join(prompts, [*KEYS, "hour"], "left").withColumn("action", F.when((F.col("action") == "write") & F.col("user").isNull(), "quiet").otherwise(F.col("action")))
    run = f"{store.root}/summaries/runs/{now.replace(':', '')}"
    _asked(todo, complete).write.mode("overwrite").parquet(f"{run}/hours")
    answers = store.spark.read.parquet(f"{run}/hours")
    new = answers.filter("text IS NOT NULL").select(*KEYS, "hour", tidy(F.col("text")).alias("text"), "active_ms", F.lit(now).alias("generated_at"), F.lit(provider).alias("provider"), F.lit(model).alias("model"))
    store.save_hours(new)
    state = answers.groupBy(*KEYS).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("action") == a, F.when(F.col("error").isNull(), F.col("hour"))))).alias(n) for a, n in (("write", "hours_written"), ("skip", "hours_skipped"), ("quiet", "hours_too_quiet"))], F.max("error").alias("failure")
    )
    daily = store.daily().select(*KEYS, F.lit(True).alias("has"))
    ready = state.join(daily, KEYS, "left").filter(F.col("failure").isNull() & (F.lit(rewrite) | (F.size("hours_written") > 0) | F.col("has").isNull())).select(*KEYS)
    asked = narrative.day_prompts(rollup.daily(e), rollup.app_usage(e), store.hours().select(*KEYS, "hour", "active_ms", "text")).join(ready, KEYS, "left_semi")
    days = asked.select(*KEYS, F.lit(0).alias("hour"), F.lit("write").alias("action"), F.lit(0).cast("long").alias("active_ms"), "user", "max_tokens")
    _asked(days, complete).write.mode("overwrite").parquet(f"{run}/days")
    told = store.spark.read.parquet(f"{run}/days")
    store.save_days(told.filter("text IS NOT NULL").select(*KEYS, tidy(F.col("text")).alias("text"), F.lit(now).alias("generated_at")))
    told = told.select(*KEYS, F.col("text").isNotNull().alias("told"), F.col("error").alias("day_error"))
    return state.join(told, KEYS, "left").select(*KEYS, "hours_written", "hours_skipped", "hours_too_quiet", F.coalesce("told", F.lit(False)).alias("daily_written"), F.coalesce("failure", "day_error").alias("failure"))


def summarise_hour(store: Store, date: str, hour: int, complete: Complete, provider: str, model: str, now: str, stream: int = 0) -> str:
    """Replaces one hour's summary; an hour that isn't there, or has nothing worth telling, is an error."""
    e = store.read("episodes")
    e = None if e is None else e.filter((F.col("date") == date) & (F.col("stream") == stream))
    if e is None or e.isEmpty():
        raise LookupError(f"nothing was recorded on {date}")
    slices = rollup.hour_slices(e)
    hours = rollup.hourly(slices).filter(F.col("hour") == hour)
    found = hours.first()
    if found is None:
        raise LookupError(f"nothing was recorded in hour {hour} of {date}")
    prompt = narrative.hour_prompts(privacy.public_episodes(e), rollup.hour_episode_ids(slices), hours).first()
    if prompt is None:
        raise ValueError(f"hour {hour} of {date} is too quiet to summarise")
    said = narrative.with_retries(lambda: complete(prompt["user"], prompt["max_tokens"]))
    row = store.spark.createDataFrame([(stream, date, hour, said, found["active_ms"], now, provider, model)], "stream int, date string, hour int, text string, active_ms long, generated_at string, provider string, model string")
    store.save_hours(row.withColumn("text", tidy(F.col("text"))))
    return store.hours().filter((F.col("date") == date) & (F.col("hour") == hour) & (F.col("stream") == stream)).first()["text"]


def chat(store: Store, date: str, question: str, complete: Complete, turns: DataFrame | None = None) -> str:
    """Answers a question about a day; nothing is stored. turns: (turn, asked, answered) of the conversation so far."""
    if not question.strip():
        raise ValueError("a question is needed")
    e = store.read("episodes")
    e = None if e is None else e.filter(F.col("date") == date)
    if e is None or e.isEmpty():
        raise LookupError(f"nothing was recorded on {date}")
    days = rollup.daily(e)
    said = days.select(*KEYS).crossJoin(turns) if turns is not None else days.select(*KEYS, F.lit(0).alias("turn"), F.lit("").alias("asked"), F.lit("").alias("answered")).limit(0)
    prompt = narrative.chat_prompts(privacy.public_episodes(e), days, rollup.app_usage(e), store.hours(), store.daily().withColumnRenamed("text", "daily"), said, question.strip()).first()
    return narrative.with_retries(lambda: complete(prompt["user"], prompt["max_tokens"]))
