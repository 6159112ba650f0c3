"""The plans that the design promises."""

import re

from daytrace.operators import rollup, sessions

from .helpers import A, activity


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\((\w+)#\d+, (\w+)#\d+, \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_one_exchange_serves_sessions_and_rollups(spark):
    a = activity(spark, (0, A, "x", "t"), (3, A, "y", "u"))
    core = sessions.core(a)
    slices = rollup.hour_slices(core)
    for df in (core, sessions.episodes(a), rollup.daily(core), rollup.app_usage(core), rollup.hourly(slices), rollup.hourly_app_usage(slices), rollup.bar_width(rollup.hourly(slices))):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1 and exchanges(df) == [("stream", "date")], text


def test_no_python_in_engine_plans(spark):
    e = sessions.episodes(activity(spark, (0, A, "x", "t")))
    assert not re.search("Python|Pandas|Arrow", e._jdf.queryExecution().executedPlan().toString())
