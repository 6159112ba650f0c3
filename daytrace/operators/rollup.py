"""Rollups of episodes by hour, app and day, and the views over them. Sums are of whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import WORTH_MS

HOUR = 3_600_000


def readable(episodes: DataFrame) -> DataFrame:
    return episodes.filter(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())


def hour_slices(episodes: DataFrame) -> DataFrame:
    """(stream, date, id, app, start_ms, ordinal, hour, pos, share_ms): the active time by the hours that the span touches.

    Shares are in proportion to the span, truncated; the first slice takes the rest. Hours are
    those of the session's zone, keyed by number alone: a span over midnight adds to hour 0 of its own day.
    """
    e = readable(episodes)
    if "ordinal" not in e.columns:  # episodes made elsewhere: the order of their starts
        e = e.withColumn("ordinal", F.col("start_ms"))
    start, end = F.timestamp_millis("start_ms"), F.timestamp_millis("end_ms")
    first = F.date_trunc("HOUR", start)
    last = F.greatest(F.timestamp_millis(F.col("end_ms") - 1), start)
    e = e.withColumn("hours", F.sequence(first, last, F.expr("INTERVAL 1 HOUR")))
    span = F.col("end_ms") - F.col("start_ms")

    def share(at: Column) -> Column:
        slice_ = F.least(F.unix_millis(at) + HOUR, F.col("end_ms")) - F.greatest(F.unix_millis(at), F.col("start_ms"))
        product = F.col("active_ms") * slice_
        return F.when(span == 0, F.col("active_ms")).otherwise(((product - F.pmod(product, span)) / span).cast("long"))

    # within the row: other episodes may share the id and the times
    e = e.withColumn("shares", F.transform("hours", share)).withColumn("rest", F.col("active_ms") - F.aggregate("shares", F.lit(0).cast("long"), lambda a, b: a + b))
    e = e.select("*", F.posexplode(F.arrays_zip("hours", "shares")).alias("pos", "of"))
    return e.select("stream", "date", "id", "app", "start_ms", "ordinal", F.hour("of.hours").alias("hour"), "pos", (F.col("of.shares") + F.when(F.col("pos") == 0, F.col("rest")).otherwise(0)).alias("share_ms"))


def daily(episodes: DataFrame) -> DataFrame:
    """Per stream and day: active_ms, idle_ms, screen_ms, episodes, private_episodes, first and last activity."""
    ok = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    idle = F.greatest(F.col("duration_ms") - F.col("active_ms"), F.lit(0))
    zero = lambda c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0))
    d = episodes.groupBy("stream", "date").agg(
        zero(F.col("active_ms")).alias("active_ms"), zero(idle).alias("idle_ms"), F.count("*").alias("episodes"), F.count_if(ok & F.col("is_private")).alias("private_episodes"),
        F.min(F.when(ok, F.col("start_ms"))).alias("first_ms"), F.max(F.when(ok, F.col("end_ms"))).alias("last_ms"),
    )
    return d.withColumn("screen_ms", F.col("active_ms") + F.col("idle_ms"))


def app_usage(episodes: DataFrame) -> DataFrame:
    """Per stream, day and app: active_ms, episodes, and its rank (active time down, then name)."""
    g = readable(episodes).groupBy("stream", "date", "app").agg(F.sum("active_ms").alias("active_ms"), F.count("*").alias("episodes"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy("stream", "date").orderBy(F.desc("active_ms"), "app")))


def hourly(slices: DataFrame) -> DataFrame:
    """Per stream, day and hour touched: active_ms (perhaps 0) and the number of slices."""
    return slices.groupBy("stream", "date", "hour").agg(F.sum("share_ms").alias("active_ms"), F.count("*").alias("slices"))


def hourly_app_usage(slices: DataFrame) -> DataFrame:
    g = slices.groupBy("stream", "date", "hour", "app").agg(F.sum("share_ms").alias("active_ms"), F.count("*").alias("episodes"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy("stream", "date", "hour").orderBy(F.desc("active_ms"), "app")))


def hour_episode_ids(slices: DataFrame) -> DataFrame:
    """Per stream, day and hour: the distinct episode ids in the order of the log, which isn't that of their times where those run backwards."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "pos", "id")))
    return slices.groupBy("stream", "date", "hour").agg(F.array_distinct(F.transform(rows, lambda r: r["id"])).alias("episode_ids"))


def leading_app(usage: DataFrame) -> DataFrame:
    return usage.filter("rank = 1").drop("rank")


def cube_usage(slices: DataFrame) -> DataFrame:
    """Subtotals of time by day, hour and app (an extension: SQL's ROLLUP)."""
    return slices.rollup("date", "hour", "app").agg(F.sum("share_ms").alias("active_ms"), F.grouping_id().alias("level"))


def timeline(episodes: DataFrame, hours: DataFrame) -> DataFrame:
    """Groups by the hour of the start: measured time of the hour, or else the sum of its episodes; episodes newest first."""
    e = readable(episodes).withColumn("hour", F.hour(F.timestamp_millis("start_ms")))
    g = e.groupBy("stream", "date", "hour").agg(F.sum("active_ms").alias("own"), F.count("*").alias("episodes"), F.sort_array(F.collect_list(F.struct("start_ms", "id")), asc=False).alias("rows"))
    g = g.join(hours.select("stream", "date", "hour", F.col("active_ms").alias("measured")), ["stream", "date", "hour"], "left")
    return g.select("stream", "date", "hour", F.coalesce("measured", "own").alias("active_ms"), "episodes", F.transform("rows", lambda r: r["id"]).alias("episode_ids"))


def rounded_percent(part, whole_):
    """Rounded half up; 0 of nothing."""
    return F.when(whole_ > 0, F.floor(F.lit(100) * part / whole_ + F.lit(0.5))).otherwise(0).cast("long")


def app_share(usage: DataFrame, days: DataFrame) -> DataFrame:
    """Apps with a minute or more and their share of the screen time, and how many apps were briefer."""
    j = usage.join(days.select("stream", "date", "screen_ms"), ["stream", "date"])
    j = j.withColumn("brief_apps", F.count_if(F.col("active_ms") < WORTH_MS).over(W.partitionBy("stream", "date")))
    return j.filter(F.col("active_ms") >= WORTH_MS).select("stream", "date", "app", "active_ms", rounded_percent(F.col("active_ms"), F.col("screen_ms")).alias("share"), "brief_apps")


def bar_width(hours: DataFrame) -> DataFrame:
    """Each hour's time in percent of the day's busiest hour."""
    busiest = F.max("active_ms").over(W.partitionBy("stream", "date"))
    return hours.select("stream", "date", "hour", "active_ms", busiest.alias("busiest_ms"), rounded_percent(F.col("active_ms"), busiest).alias("width"))
