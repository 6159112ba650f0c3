"""The reads that happen, against a plain loop over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from daytrace.operators import capture

from .helpers import C, activity


def reads(rows, every):
    out, last = [], {}
    for stream, seq, ms, window, lines in sorted(rows, key=lambda r: r[1]):
        since = last.get(stream)
        due = since is None or since[0] != window or (ms is not None and ms - since[1] >= every)
        if due and lines > 1 and ms is not None:
            last[stream] = (window, ms)
        if due:
            out.append((stream, seq))
    return sorted(out)


@pytest.mark.parametrize("steps", [(1, 4, 9), (1, 4, 9, 31, 90), (-40, -5, 0, 2, 7, 11, 45), (0, 0, 30)])
def test_throttle(spark, steps):
    rng, t, rows = random.Random(2), 1000.0, []
    for i in range(300):
        t += rng.choice(steps)
        rows.append((i % 2, i, None if rng.random() < 0.02 else round(t * 1000), rng.choice(["x", "x", "x", "x", "y", None]), rng.choice([1, 2, 3])))
    df = spark.createDataFrame([(*r, "z") for r in rows], "stream int, seq long, ms long, w string, n int, starts string").withColumn("ts", F.timestamp_millis("ms"))
    for width in (7, 1000):
        got = capture.throttled(df, "w", "n", 30_000, F.floor(F.col("seq") / width))
        assert sorted((r.stream, r.seq) for r in got.collect()) == reads(rows, 30_000) and got.columns == df.columns
    assert capture.throttled(df.limit(0), "w", "n").count() == 0


def test_no_python_and_no_sort_of_a_stream(spark):
    a = activity(spark, *[(i, C, "x", "t") for i in range(5)]).withColumn("seq", F.col("seq").cast("long")).withColumn("lines", F.lit(2))
    plan = capture.throttled(a, "app", "lines")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
