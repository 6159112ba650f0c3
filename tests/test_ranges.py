"""Days cut into ranges give the same episodes, and lists never gather an episode's rows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daytrace.adapter import from_records
from daytrace.operators import rollup, sessions
from daytrace.plans import narrative
from daytrace.sources import jsonl

from .helpers import A, C, L, P, U, activity


@pytest.mark.parametrize("steps", [(0.5, 2, 6, 15, 16), (-20, -3, 0, 1, 4, 14, 16, 31)])
def test_ranges_of_any_width(spark, steps):
    rng, t, rows = random.Random(4), 200.0, []
    for _ in range(200):
        t += rng.choice(steps)
        rows.append((t, rng.choice([A, C, C, C, U, P, L]), rng.choice(["x", "x", "x", "y"]), rng.choice(["t", "u"])))
    a = activity(spark, *rows).cache()
    want = sorted(map(tuple, sessions.core(a).collect()))
    for width in (1, 3, 25, 200):
        assert sorted(map(tuple, sessions.core(a, sessions.seq_range(a, width)).collect())) == want
    full = sorted(map(str, sessions.episodes(a).collect()))
    assert sorted(map(str, sessions.episodes(a, sessions.seq_range(a, 7)).collect())) == full


def test_lists_are_reduced_before_they_are_gathered(spark):
    a = activity(spark, *[(i / 10, C, "Code", f"t{i % 50}", {"visible_text": [f"line {i % 60}", "bar", None]}) for i in range(300)])
    e = sessions.episodes(a)
    (r,) = e.collect()
    assert len(r.titles) == 50 and r.visible_text == ["line 0", "bar", *[f"line {i}" for i in range(1, 35)]]
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    gathered = [line for line in plan.splitlines() if "collect_list" in line]
    assert gathered and all("place" in line for line in gathered)


def test_ids_of_an_hour_go_by_the_log(spark):
    a = activity(spark, (30, C, "x", "t"), (31, C, "y", "t"), (10, C, "x", "u"), (11, C, "y", "u"))
    ids = rollup.hour_episode_ids(rollup.hour_slices(sessions.core(a))).filter("hour = 9").first().episode_ids
    starts = [r.id for r in sorted(sessions.core(a).collect(), key=lambda r: r.ordinal)]
    assert ids == starts and ids != sorted(ids)


def test_a_written_hour_is_skipped_even_if_it_is_short(spark):
    hours = spark.createDataFrame([(0, "2024-03-05", h, ms) for h, ms in ((1, 40_000), (2, 40_000), (3, 400_000), (4, 400_000))], "stream int, date string, hour int, active_ms long")
    written = spark.createDataFrame([(0, "2024-03-05", 1, 40_000), (0, "2024-03-05", 3, 100_000)], "stream int, date string, hour int, active_ms long")
    assert {r.hour: r.action for r in narrative.run_plan(hours, written).collect()} == {1: "skip", 2: "quiet", 3: "write", 4: "write"}
    assert narrative.run_report(narrative.run_plan(hours, written)).select(F.array_join(F.transform("hours_skip", lambda h: h.cast("string")), ",")).first()[0] == "1"


def test_days_are_dealt_to_as_many_tasks_as_the_session_names(spark):
    """However small they are: merged by their compressed size, repeated rows fill a task's memory. And a day is sorted once by the log, once by its titles."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a = activity(spark, (0, C, "x", "t"), (1, C, "x", "u"), (2, C, "y", "t"), (30, C, "x", "v"))
    for e in (sessions.core(a), sessions.episodes(a), sessions.episodes(a, sessions.seq_range(a, 2))):
        assert e.rdd.getNumPartitions() == n
    plan = sessions.episodes(a).select("title")._jdf.queryExecution().executedPlan().toString()
    assert sum("Sort [" in line and "seq" in line for line in plan.splitlines()) == 1


def test_a_log_of_one_stream_is_dealt_once(spark):
    """A stream that is a literal would leave the sort, and the rows would be dealt again by the date alone."""
    none = spark.createDataFrame([], T.StructType([*jsonl.EVENT.fields, T.StructField("date", T.DateType()), T.StructField("seq", T.LongType())]))
    a = from_records(none)
    assert dict(a.dtypes)["stream"] == "int"
    plan = sessions.episodes(a)._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1


def test_spread_days_give_the_same_episodes(spark, monkeypatch):
    """Rows are dealt again by parts of a day once their episodes are known; an episode stays whole, wherever it begins."""
    rng, t, rows = random.Random(6), 200.0, []
    for _ in range(300):
        t += rng.choice((-20, 0.5, 1, 2, 16))
        rows.append((t, rng.choice([A, C, C, C, U, P, L]), rng.choice(["x", "x", "x", "y"]), rng.choice(["t", "u", "v", " ", None])))
    a = activity(spark, *rows).cache()
    want = sorted(map(str, sessions.episodes(a).collect()))
    for part in (1, 7, 65_536):
        monkeypatch.setattr(sessions, "PART", part)
        e = sessions.episodes(a, spread=True)
        assert sorted(map(str, e.collect())) == want
    plan = e._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 2 and "part#" in dealt[0] and "part#" not in dealt[1]


def test_a_day_is_passed_four_times_in_the_order_of_its_log(spark):
    a = activity(spark, (0, C, "x", "t"), (1, C, "x", "u"))
    plan = sessions.episodes(a)._jdf.queryExecution().executedPlan().toString()
    assert sum("Window [" in line and "seq#" in line for line in plan.splitlines()) == 4
