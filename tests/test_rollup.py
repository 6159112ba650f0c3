import datetime as dt

from daytrace.operators import rollup

from .helpers import MIN

DAY = dt.datetime(2024, 3, 5, tzinfo=dt.timezone.utc)
COLUMNS = "stream int, date string, id string, app string, start_ms long, end_ms long, duration_ms long, active_ms long, is_private boolean"


def episodes(spark, *rows):
    """rows: (hour, minute, length in minutes, active in minutes, app)."""
    out = []
    for i, (h, m, length, active, app) in enumerate(rows):
        start = int((DAY + dt.timedelta(hours=h, minutes=m)).timestamp() * 1000)
        out.append((0, "2024-03-05", f"e{i}", app, start, start + int(length * MIN), int(length * MIN), int(active * MIN), app == "private"))
    return spark.createDataFrame(out, COLUMNS)


def hours(spark, *rows):
    return {r.hour: r.active_ms for r in rollup.hourly(rollup.hour_slices(episodes(spark, *rows))).collect()}


def test_hours_split_in_proportion_and_add_up(spark):
    assert hours(spark, (9, 45, 30, 30, "x")) == {9: 15 * MIN, 10: 15 * MIN}
    h = hours(spark, (8, 37, 143, 100.01, "x"), (13, 11, 7, 7, "y"))
    assert sum(h.values()) == int(100.01 * MIN) + 7 * MIN and set(h) == {8, 9, 10, 13}


def test_remainder_goes_to_the_first_hour(spark):
    e = spark.createDataFrame([(0, "2024-03-05", "a", "x", 1800_000, 3600_000 * 2 + 1800_000, 7200_000, 1001, False)], COLUMNS)
    assert {r.hour: r.share_ms for r in rollup.hour_slices(e).collect()} == {0: 251, 1: 500, 2: 250}


def test_zero_length_end_on_the_hour_and_midnight(spark):
    assert hours(spark, (9, 0, 0, 0, "x")) == {9: 0}
    assert set(hours(spark, (9, 30, 30, 10, "x"))) == {9}
    assert set(hours(spark, (23, 30, 60, 60, "x"))) == {23, 0}


def test_day_totals(spark):
    d = rollup.daily(episodes(spark, (9, 0, 60, 5, "x"), (11, 0, 10, 10, "private"))).first()
    assert (d.active_ms, d.idle_ms, d.screen_ms, d.episodes, d.private_episodes) == (15 * MIN, 55 * MIN, 70 * MIN, 2, 1)


def test_unreadable_times_count_as_episodes_only(spark):
    e = episodes(spark, (9, 0, 60, 5, "x")).unionByName(spark.createDataFrame([(0, "2024-03-05", "bad", "y", None, None, None, 9, True)], COLUMNS))
    d = rollup.daily(e).first()
    assert (d.episodes, d.active_ms, d.private_episodes) == (2, 5 * MIN, 0)
    assert [r.app for r in rollup.app_usage(e).collect()] == ["x"]


def test_rank_by_time_then_name(spark):
    u = rollup.app_usage(episodes(spark, (9, 0, 2, 2, "many"), (9, 10, 2, 2, "many"), (10, 0, 50, 50, "one"), (12, 0, 4, 4, "also")))
    assert [r.app for r in sorted(u.collect(), key=lambda r: r["rank"])] == ["one", "also", "many"]


def test_share_and_bars_and_timeline(spark):
    e = episodes(spark, (9, 0, 50, 30, "a"), (10, 0, 10, 10, "b"), (11, 0, 1, 0.5, "c"))
    s = {r.app: (r.share, r.brief_apps) for r in rollup.app_share(rollup.app_usage(e), rollup.daily(e)).collect()}
    assert s == {"a": (49, 1), "b": (16, 1)}
    slices = rollup.hour_slices(e)
    assert {r.hour: r.width for r in rollup.bar_width(rollup.hourly(slices)).collect()} == {9: 100, 10: 33, 11: 2}
    assert [r.episode_ids for r in rollup.timeline(e, rollup.hourly(slices)).orderBy("hour").collect()] == [["e0"], ["e1"], ["e2"]]


def test_empty(spark):
    e = episodes(spark, (9, 0, 1, 1, "x")).limit(0)
    assert rollup.daily(e).count() == 0 and rollup.hourly(rollup.hour_slices(e)).count() == 0


def test_episodes_of_equal_id_and_times_keep_their_own_remainders(spark):
    e = spark.createDataFrame([(0, "2024-03-05", "x", "a", 1_709_636_400_000, 1_709_643_600_000, 600_001)] * 3, "stream int, date string, id string, app string, start_ms long, end_ms long, active_ms long")
    assert sorted(r.share_ms for r in rollup.hour_slices(e).collect()) == [300_000] * 3 + [300_001] * 3
