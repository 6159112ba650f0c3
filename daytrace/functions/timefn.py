"""Dates, instants and durations as Column functions. Sums of time stay whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import CREDIT_MS

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def parse_instant(text: Column) -> Column:
    """An RFC 3339 instant in ms, or null (Spark alone takes looser texts)."""
    return F.date_trunc("millisecond", F.when(text.rlike(RFC3339), F.try_to_timestamp(F.upper(text))))


def format_instant(ts: Column) -> Column:
    """UTC with milliseconds and a Z."""
    ms = F.unix_millis(ts)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))
    left = F.pmod(ms, F.lit(86_400_000))
    part = lambda size, n, width: F.lpad(F.pmod(F.floor(left / size), F.lit(n)).cast("string"), width, "0")
    # a format string would be read again for each row
    return F.concat(day.cast("string"), F.lit("T"), part(3_600_000, 24, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3), F.lit("Z"))


def ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def credited(gap: Column) -> Column:
    """A gap clamped to what counts as activity."""
    return F.least(F.greatest(gap, F.lit(0)), F.lit(CREDIT_MS)).cast("long")


def whole(a: Column, b: int) -> Column:
    """Whole division of numbers that aren't negative."""
    return ((a - F.pmod(a, F.lit(b))) / b).cast("long")


def human_duration(millis: Column) -> Column:
    """Truncating: 2h 15m, 45m, 2h, 30s; negative is 0s."""
    s = whole(F.greatest(millis, F.lit(0)), 1000)
    h, m = whole(s, 3600), whole(F.pmod(s, F.lit(3600)), 60)
    return (
        F.when((h > 0) & (m > 0), F.format_string("%dh %dm", h, m)).when(h > 0, F.format_string("%dh", h)).when(m > 0, F.format_string("%dm", m)).otherwise(F.format_string("%ds", s))
    )


def rounded_duration(millis: Column) -> Column:
    """Rounding: to seconds below a minute, else to minutes."""
    s = whole(F.greatest(millis, F.lit(0)) + 500, 1000)
    m = whole(s + 30, 60)
    h, rest = whole(m, 60), F.pmod(m, F.lit(60))
    return (
        F.when(s < 60, F.format_string("%ds", s)).when(m < 60, F.format_string("%dm", m)).when(rest == 0, F.format_string("%dh", h)).otherwise(F.format_string("%dh %dm", h, rest))
    )


def clock(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "HH:mm"), F.lit("--:--"))


def long_day(date: Column) -> Column:
    return F.date_format(date, "EEEE d MMMM yyyy")


def hour_label(hour: Column) -> Column:
    return F.format_string("%02d:00", hour)


#: How far apart instants lie at which a zone's clock is looked at; changes of clocks fall on them.
CLOCK_STEP = "INTERVAL 15 MINUTES"


def clock_ranges(spark: SparkSession, zone: str, first: str, last: str) -> DataFrame:
    """(since_ms, until_ms, offset_ms): the ranges of instants between which a zone's clock isn't changed, from a day before first to a day after last."""
    at = F.explode(F.sequence(F.to_timestamp(F.date_sub(F.lit(first).cast("date"), 1)), F.to_timestamp(F.date_add(F.lit(last).cast("date"), 2)), F.expr(CLOCK_STEP)))
    t = spark.range(1).select(at.alias("at")).select(F.unix_millis("at").alias("ms"), (F.unix_millis(F.from_utc_timestamp("at", zone)) - F.unix_millis("at")).alias("offset_ms"))
    by = W.partitionBy("half").orderBy("ms")  # ranges of half a year, so that no task holds all instants
    t = t.withColumn("half", F.floor(F.col("ms") / (183 * 86_400_000)))
    changes = W.orderBy("ms")  # two for each year, and one for each half
    for order in (by, changes):
        t = t.withColumn("was", F.lag("offset_ms").over(order)).filter(~F.col("was").eqNullSafe(F.col("offset_ms"))).select(*[c for c in t.columns if c != "was"])
    new = t.select("ms", "offset_ms")
    return new.select(F.col("ms").alias("since_ms"), F.coalesce(F.lead("ms").over(changes), F.lit(1 << 60)).alias("until_ms"), "offset_ms")


def hour_starts(hours: DataFrame, ranges: DataFrame) -> DataFrame:
    """hours (date, hour, ...) with start_ms: the instant at which the local hour begins; null for one that the clock leaves out or shows twice.

    ranges: clock_ranges of the zone. They are some two for each year: one row holds all of them.
    """
    every = ranges.agg(F.collect_list(F.struct("since_ms", "until_ms", "offset_ms")).alias("__ranges"))
    wall = F.unix_date(F.col("date").cast("date")).cast("long") * 86_400_000 + F.col("hour") * 3_600_000
    j = hours.crossJoin(F.broadcast(every)).withColumn("__wall", wall)
    at = F.filter("__ranges", lambda r: (F.col("__wall") - r["offset_ms"] >= r["since_ms"]) & (F.col("__wall") - r["offset_ms"] < r["until_ms"]))
    j = j.withColumn("__at", at)
    return j.withColumn("start_ms", F.when(F.size("__at") == 1, F.col("__wall") - F.col("__at")[0]["offset_ms"])).drop("__ranges", "__wall", "__at")


def file_size(n: Column) -> Column:
    """820 bytes, 2.1 kB."""
    return F.when(n < 1000, F.format_string("%d bytes", n)).otherwise(F.format_string("%.1f kB", F.floor(n / 100 + F.lit(0.5)) / 10))
