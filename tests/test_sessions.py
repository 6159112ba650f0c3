import pytest

from daytrace.operators import sessions

from .helpers import MIN, A, C, L, P, U, activity


def episodes(spark, *rows):
    return sorted(sessions.episodes(activity(spark, *rows)).collect(), key=lambda e: e.start_ms)


def test_one_app_then_another(spark):
    e = episodes(spark, (0, A, "Code", "lib.rs"), (10, C, "Code", "episode.rs"), (30, A, "Slack", "#eng"))
    assert [(x.app, x.event_count, x.titles) for x in e] == [("Code", 2, ["lib.rs", "episode.rs"]), ("Slack", 1, ["#eng"])]
    assert e[0].id == f"2024-03-05#{e[0].start_ms}" and e[0].start == "2024-03-05T09:00:00.000Z"


def test_switch_and_silence_and_lock(spark):
    assert [e.duration_ms for e in episodes(spark, (0, A, "Code", "a"), (4, A, "Slack", "b"))] == [4 * MIN, 0]
    assert [e.duration_ms for e in episodes(spark, (0, A, "Code", "a"), (3, C, "Code", "b"), (43, C, "Code", "c"))] == [3 * MIN, 0]
    e = episodes(spark, (0, A, "Code", "a"), (12, L, "", None), (20, A, "Code", "a"))
    assert [(x.duration_ms, x.active_ms) for x in e] == [(12 * MIN, 5 * MIN), (0, 0)]


def test_away_has_no_idle_split_and_closes_any_app(spark):
    e = episodes(spark, (0, A, "Code", "a"), (480, "applicationTerminated", "Other", None))
    assert [(x.duration_ms, x.active_ms) for x in e] == [(480 * MIN, 5 * MIN)]


def test_fifteen_minutes_exactly_stay_together(spark):
    assert len(episodes(spark, (0, A, "Code", "a"), (15, C, "Code", "b"))) == 1


def test_lifecycle_only(spark):
    assert episodes(spark, (0, "collectorStarted", "", None), (1, "screenWoke", "", None), (2, "sessionUnlocked", "", None)) == []


def test_headline_is_the_title_held_longest_and_ties_go_last(spark):
    e = episodes(spark, (0, C, "Code", "glanced"), (1, C, "Code", "worked"), (4, C, "Code", "glanced"), (5, A, "Slack", "x"))
    assert e[0].title == "worked"
    e = episodes(spark, (0, C, "Code", "first"), (2, C, "Code", "second"), (4, A, "Slack", "x"))
    assert e[0].title == "second"


def test_blank_titles_keep_the_current_one(spark):
    e = episodes(spark, (0, C, "Code", "kept"), (1, C, "Code", "  "), (4, A, "Slack", "x"))
    assert (e[0].title, e[0].titles) == ("kept", ["kept"])


def test_lists_are_distinct_in_order_and_capped(spark):
    e = episodes(spark, *[(i, U, "Web", "t", {"url": u}) for i, u in enumerate(["/a", "/b", "/a"])])
    assert e[0].urls == ["/a", "/b"]
    e = episodes(spark, *[(i / 10, C, "Code", "t", {"visible_text": [f"line {i}"], "doc_path": f"C:\\x\\d{i}.txt"}) for i in range(39)])
    assert len(e[0].visible_text) == 36 and e[0].documents == [f"d{i}.txt" for i in range(8)]


def test_private_in_the_middle_is_empty(spark):
    e = episodes(spark, (0, C, "Web", "open", {"url": "/a"}), (5, P, "Web", "secret", {"url": "/s", "visible_text": ["s"]}), (9, C, "Web", "open", {"url": "/a"}))
    assert [x.is_private for x in e] == [False, True, False]
    m = e[1]
    assert (m.title, m.titles, m.urls, m.documents, m.visible_text, m.event_count, m.active_ms) == (None, [], [], [], [], 1, 4 * MIN)
    assert episodes(spark, (0, C, "Web", "x", {"sensitive": True}))[0].is_private


def test_capped_gap(spark):
    e = episodes(spark, (0, C, "Code", "a"), (12, C, "Code", "a"), (13, A, "Slack", "b"))
    assert (e[0].duration_ms, e[0].active_ms) == (13 * MIN, 6 * MIN)


def test_null_times_and_apps(spark):
    core = sessions.core(activity(spark, (0, C, None, "a"), (None, C, "Code", "b"), (3, C, None, "c"))).collect()
    assert len(core) == 1 and core[0].app == ""


def fold(rows):
    """Episodes of (minute, kind, app, title) by a plain loop: (app, private, start, end, active, events, title, titles)."""
    done, open_ = [], None
    window, away = (A, C, U, P), (L, "screenSlept", "applicationTerminated")

    def credit(until):
        gap = min(max(until - open_["last"], 0), 5)
        open_["active"] += gap
        if open_["now"] is not None:
            open_["held"][open_["now"]] = open_["held"].get(open_["now"], 0) + gap

    def close(at):
        end = max(at, open_["start"])
        credit(end)
        best = max(open_["held"], key=lambda t: (open_["held"][t], open_["titles"].index(t)), default=None)
        done.append((open_["app"], open_["private"], open_["start"], end, open_["active"], open_["n"], best, open_["titles"]))

    for minute, kind, app, title in rows:
        if kind in away:
            if open_:
                close(minute)
            open_ = None
        elif kind in window:
            private = kind == P
            if open_ and minute - open_["last"] > 15:
                close(open_["last"])
                open_ = None
            elif open_ and (open_["app"], open_["private"]) != (app, private):
                close(minute)
                open_ = None
            if not open_:
                open_ = {"app": app, "private": private, "start": minute, "last": minute, "active": 0, "n": 0, "now": None, "held": {}, "titles": []}
            credit(minute)
            open_["n"] += 1
            open_["last"] = max(open_["last"], minute)
            if not private:
                open_["now"] = title
                open_["held"].setdefault(title, 0)
                if title not in open_["titles"]:
                    open_["titles"].append(title)
    if open_:
        close(open_["last"])
    return done


@pytest.mark.parametrize("steps", [(0.5, 2, 6, 15, 16), (-20, -3, 0, 1, 4, 14, 16, 31)])
def test_windows_equal_a_plain_loop_in_any_order_of_time(spark, steps):
    import random

    rng, t, rows = random.Random(3), 200.0, []
    for i in range(250):
        t += rng.choice(steps)
        rows.append((t, rng.choice([A, C, C, U, P, L, "screenWoke"]), rng.choice(["x", "x", "y"]), rng.choice(["t", "u", "v"])))
    want = [(app, private, round(start * MIN), round(end * MIN), round(active * MIN), n, best, titles) for app, private, start, end, active, n, best, titles in fold(rows)]
    e = sessions.episodes(activity(spark, *rows)).collect()
    base = min(r.start_ms for r in e) - min(w[2] for w in want)
    got = [(r.app, r.is_private, r.start_ms - base, r.end_ms - base, r.active_ms, r.event_count, r.title, r.titles) for r in e]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 20


def test_time_that_runs_back_never_moves_an_episode_back(spark):
    rows = [(0, C, "Code", "a"), (10, C, "Code", "b"), (2, C, "Code", "c"), (12, A, "Slack", "d")]
    a = activity(spark, *rows)
    e = sorted(sessions.core(a).collect(), key=lambda x: x.start_ms)
    assert [(x.app, x.event_count, x.duration_ms, x.active_ms) for x in e] == [("Code", 3, 12 * MIN, 7 * MIN), ("Slack", 1, 0, 0)]
    assert sessions.out_of_order_days(a).count() == 1


def test_gap_sessions(spark):
    s = sorted(sessions.gap_sessions(activity(spark, (0, C, "x", "a"), (15, C, "y", "b"), (31, C, "x", "c"))).collect(), key=lambda r: r.start_ms)
    assert [(r.events, r.end_ms - r.start_ms) for r in s] == [(2, 15 * MIN), (1, 0)]
