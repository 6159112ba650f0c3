"""Trees read within budgets against a plain queue, and hours at changes of the clock."""

import random
from collections import deque

import pytest

from daytrace.functions import timefn
from daytrace.operators import capture, tree

KINDS = ("Text", "Document", "Group", "Button", "ToolBar", "Pane", "Edit", "MenuBar", None)


def read(rows, budget):
    """A queue, one element after the other."""
    kids = {}
    for r in sorted(rows, key=lambda r: (r[3], r[1])):
        kids.setdefault(r[2], []).append(r)
    queue = deque((r, 0, False) for r in kids.get(None, []))
    out, written = [], 0
    while queue:
        (_, node, _, _, kind, name, hidden), depth, below = queue.popleft()
        if written >= budget.lines or len(out) >= budget.elements:
            break
        kind, named = (kind or "").lower(), bool((name or "").strip(" "))
        under = below or kind in capture.FURNITURE_SUBTREES
        surface = 2 if under or kind in capture.FURNITURE_CONTROLS else 0 if kind in capture.WRITING_CONTROLS else 1
        out.append((node, len(out) + 1, depth, surface, not hidden))
        if hidden:
            continue
        written += named and surface == 0
        if depth < budget.depth and kind not in tree.LEAVES:
            queue += [(r, depth + named, under) for r in kids.get(node, [])[: budget.children]]
    return out


@pytest.mark.parametrize("budget", [tree.GLANCE, tree.Budget(1, 1000, 50, 1000), tree.Budget(9, 15, 50, 1000), tree.Budget(9, 1000, 2, 1000), tree.Budget(9, 1000, 50, 3)])
def test_walk(spark, budget):
    rng, rows = random.Random(1), []
    for t in range(12):
        for n in range(rng.choice([1, 5, 60, 200])):
            parent = None if n == 0 else rng.randrange(max(0, n - 12), n)
            rows.append((t, n, parent, rng.randrange(4), rng.choice(KINDS), rng.choice(["a name", "", " ", None]), rng.random() < 0.1))
    e = spark.createDataFrame([(*r, "x") for r in rows], "tree int, node int, parent int, pos int, kind string, name string, hidden boolean, place string")
    got = {}
    for r in tree.walk(e, budget).collect():
        got.setdefault(r.tree, []).append((r.node, r.place, r.depth, r.surface, r.shown))
    assert {t: sorted(v, key=lambda x: x[1]) for t, v in got.items()} == {t: read([r for r in rows if r[0] == t], budget) for t in range(12)}
    assert tree.walk(e.limit(0), budget).count() == 0


def test_hours_that_the_clock_leaves_out_or_shows_twice(spark):
    from datetime import datetime
    from zoneinfo import ZoneInfo

    for zone, days in (("America/New_York", ["2024-03-10", "2024-11-03", "2024-07-01"]), ("Australia/Lord_Howe", ["2024-04-07", "2024-10-06"]), ("UTC", ["2024-03-10"]), ("Asia/Kolkata", ["2024-03-10"])):
        hours = spark.createDataFrame([(d, h) for d in days for h in range(24)], "date string, hour int")
        got = {(r.date, r.hour): r.start_ms for r in timefn.hour_starts(hours, timefn.clock_ranges(spark, zone, min(days), max(days))).collect()}
        for (d, h), ms in got.items():
            local = [datetime.fromisoformat(d).replace(hour=h, fold=f, tzinfo=ZoneInfo(zone)) for f in (0, 1)]
            real = {int(x.timestamp() * 1000) for x in local if datetime.fromtimestamp(x.timestamp(), ZoneInfo(zone)).hour == h and datetime.fromtimestamp(x.timestamp(), ZoneInfo(zone)).minute == 0}
            assert ms == (real.pop() if len(real) == 1 else None), (zone, d, h)


def test_shell_classes(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("Progman",), ("shell_traywnd",), ("Chrome_WidgetWin_1",), (None,)], "c string")
    assert [r[0] for r in rows.select(capture.not_shell(F.col("c"))).collect()] == [False, False, True, True]
