import json

import pytest
from pyspark.sql import functions as F

from daytrace.plans import narrative, summaries
from daytrace.plans.api import Api, clamped
from daytrace.plans.store import Store
from daytrace.sources import jsonl, library


def event(i, minute, kind="windowChanged", app="Code", title="lib.rs", **more):
    return {"version": 1, "id": f"e{i}", "timestamp": f"2024-03-05T09:{minute:02d}:00.000Z", "kind": kind, "application": {"name": app, "path": f"C:\\{app}.exe", "pid": 7}, "windowTitle": title} | more


@pytest.fixture
def root(tmp_path):
    (tmp_path / "events").mkdir()
    lines = [event(0, 0), event(1, 8), event(2, 10, app="Slack", title="#eng"), event(3, 12, kind="sessionLocked")]
    bad = ["", "{broken", json.dumps(event(9, 1) | {"kind": "nothing"}), json.dumps({k: v for k, v in event(9, 1).items() if k != "id"}), json.dumps(event(9, 1, browser={"url": "x"})), '{"version":1,"id":"cut']
    (tmp_path / "events/2024-03-05.jsonl").write_text("\n".join([*map(json.dumps, lines), *bad]))
    (tmp_path / "events/notes.jsonl").write_text("x")
    return str(tmp_path)


def test_scan(spark, root):
    day = jsonl.read_day(spark, root, "2024-03-05").orderBy("seq").collect()
    assert [r.id for r in day] == ["e0", "e1", "e2", "e3"]
    assert jsonl.bad_lines(spark, root).filter("date = '2024-03-05'").first().bad == 5
    assert jsonl.read_day(spark, root, "2024-03-06").count() == 0
    assert [str(r.date) for r in jsonl.recorded_days(spark, root).collect()] == ["2024-03-05"]
    assert jsonl.day_stats(jsonl.read_days(spark, root)).first().last_event_at == "2024-03-05T09:12:00.000Z"


def test_append_omits_absent_fields(spark, root, tmp_path):
    records = jsonl.read_days(spark, root).drop("date", "seq")
    jsonl.append(records, root)
    text = "".join(p.read_text() for p in tmp_path.glob("log/batch=*/date=2024-03-05/*.json"))
    assert text.count("\n") == 4 and "null" not in text and '"windowTitle"' in text and "browser" not in text
    assert [r.id for r in jsonl.read_log(spark, root).orderBy("seq").collect()] == ["e0", "e1", "e2", "e3"] * 2


def test_process_search_refresh_forget(spark, root):
    store = Store(spark, root)
    assert store.read("episodes") is None and store.refresh() == ["2024-03-05"] and store.refresh() == []
    assert store.read("episodes").count() == 2
    store.process(["2024-03-05"])
    assert store.read("episodes").count() == 2 and store.read("indexed").count() == 2
    api = Api(store, "2024-03-05", allow_history=False)
    assert [r.app for r in api.search_history("cod").collect()] == ["Code"]
    day = api.run_tool("get_today", {})
    assert day["day"].first().active_ms == 9 * 60_000 and day["episodes"].count() == 2 and "episodes" not in api.summary("2024-03-05")
    assert [r.app for r in api.get_recent(1).collect()] == ["Slack"]
    with pytest.raises(PermissionError):
        api.get_day("2024-03-04")
    with pytest.raises(KeyError):
        api.run_tool("nothing", {})
    assert clamped(None, 50) == 50 and clamped(1000, 50) == 200 and clamped(0, 50) == 1
    assert store.prune("2024-03-20", 0) == [] and store.prune("2024-03-20", 5) == ["2024-03-05"]
    assert store.refresh() == [] and store.read("episodes").count() == 2
    store.forget_day("2024-03-05")
    assert store.read("episodes") is None
    store.forget_all()


def test_appended_and_streamed_rows_reach_the_store(spark, root, tmp_path):
    """The log goes on in batches after the day's file, in the order of its lines and not of its times."""
    from daytrace.schema import EVENT
    from daytrace.streaming import ingest

    store = Store(spark, root)
    assert store.refresh() == ["2024-03-05"]
    # out of order: 09:20, 09:10 and 09:30 are one episode that never moves back
    late = [event(20 + i, m, app="Docs", title=t, browser={"url": f"https://x.example/{t}", "isPrivate": False}, visibleText=[f"text {t}"]) for i, (m, t) in enumerate([(20, "alpha"), (10, "beta"), (30, "gamma")])]
    jsonl.append(spark.createDataFrame([json.loads(json.dumps(e)) for e in late], EVENT).coalesce(1), root)
    assert store.refresh() == ["2024-03-05"]
    (e,) = store.read("episodes").filter("app = 'Docs'").collect()
    assert (e.titles, e.urls, e.visible_text) == (["alpha", "beta", "gamma"], [f"https://x.example/{t}" for t in ("alpha", "beta", "gamma")], ["text alpha", "text beta", "text gamma"])
    assert (e.event_count, e.duration_ms, e.active_ms, e.title) == (3, 10 * 60_000, 5 * 60_000, "beta")
    incoming = tmp_path / "incoming"
    incoming.mkdir()
    (incoming / "a.jsonl").write_text("\n".join(json.dumps(event(40 + i, 50 + i, app="Mail", title="streamed") | {"timestamp": f"2024-03-{5 + i:02d}T10:50:00.000Z"}) for i in range(2)))
    refreshed = []
    ingest.append_by_day(ingest.read_stream(spark, str(incoming)), root, str(tmp_path / "cp"), then=lambda df, n: refreshed.extend(store.refresh())).awaitTermination()
    assert refreshed == ["2024-03-05", "2024-03-06"]
    assert [r.app for r in Api(store, "2024-03-06").search_history("streamed").collect()] == ["Mail", "Mail"]
    again = jsonl.read_log(spark, root).count()
    jsonl.append(spark.createDataFrame([json.loads(json.dumps(late[0]))], EVENT), root, "stream-0")  # a batch that is tried again
    assert jsonl.read_log(spark, root).count() == again - 1
    assert [str(r.date) for r in jsonl.recorded_days(spark, root).collect()] == ["2024-03-05"]


def test_a_split_file_keeps_the_order_of_its_lines(spark, tmp_path):
    (tmp_path / "events").mkdir()
    (tmp_path / "events/2024-03-05.jsonl").write_text("\r\n".join(json.dumps(event(i, i % 60)) for i in range(3000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    try:
        rows = jsonl.read_day(spark, str(tmp_path), "2024-03-05")
        assert rows.rdd.getNumPartitions() > 4 and [r.id for r in rows.orderBy("seq").collect()] == [f"e{i}" for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_summary_runs(spark, root):
    store = Store(spark, root)
    lines = [event(50 + i, m, app="Code", title=f"part {i}") | {"timestamp": f"2024-03-05T{h}:{m:02d}:00.000Z"} for i, (h, m) in enumerate([("10", 0), ("10", 4), ("10", 9), ("11", 30)])]
    from daytrace.schema import EVENT

    jsonl.append(spark.createDataFrame([json.loads(json.dumps(e)) for e in lines], EVENT).coalesce(1), root)
    store.process()
    run = lambda complete, **how: summaries.summarise(store, complete, "p", "m", "2024-03-06T05:00:00Z", **how).first()

    def fails_at_ten(user, n):
        if "10:00" in user.split("\n")[0]:
            raise RuntimeError("no answer")
        return "Summary: nine"

    r = run(fails_at_ten)
    assert (r.hours_written, r.hours_too_quiet, r.daily_written, r.failure) == ([9], [], False, "no answer")
    assert [(h.hour, h.text, h.active_ms) for h in store.hours().collect()] == [(9, "nine", 10 * 60_000 - 60_000)] and store.daily().count() == 0
    r = run(lambda user, n: f"tokens {n}")
    assert (r.hours_written, r.hours_skipped, r.hours_too_quiet, r.daily_written, r.failure) == ([10], [9], [11], True, None)
    assert store.daily().first().text == "tokens 1200"
    r = run(lambda user, n: "never asked")
    assert (r.hours_written, r.hours_skipped, r.daily_written) == ([], [9, 10], False)
    assert run(lambda user, n: "new", rewrite=True).hours_written == [9, 10] and store.daily().first().text == "new"
    day = Api(store, "2024-03-05").get_day("2024-03-05")["day"].first()
    assert day.daily_summary == "new" and [(h.hour, h.text) for h in day.hourly_summaries] == [(9, "new"), (10, "new")]
    assert summaries.summarise_hour(store, "2024-03-05", 10, lambda user, n: "one hour", "p", "m", "now") == "one hour"
    for hour, error in ((11, ValueError), (15, LookupError)):
        with pytest.raises(error):
            summaries.summarise_hour(store, "2024-03-05", hour, lambda user, n: "x", "p", "m", "now")
    assert "What took" in summaries.chat(store, "2024-03-05", " What took longest? ", lambda user, n: user)
    with pytest.raises(ValueError):
        summaries.chat(store, "2024-03-05", "  ", lambda user, n: user)
    store.forget_summary("2024-03-05")
    assert store.hours().count() == 0 and store.daily().count() == 0
    assert not summaries.due(4) and summaries.due(5) and not summaries.due(12, wanted=False)


def test_read_api(spark, root):
    store = Store(spark, root)
    store.refresh()
    api = Api(store, "2024-03-05")
    assert [t["name"] for t in api.tools()] == ["get_today", "get_day", "search_history", "get_recent"]
    assert [r.id for r in api.read_day("2024-03-05").collect()] == ["e0", "e1", "e2", "e3"] and api.recorded_days().count() == 1
    assert tuple(api.status().first()) == (1, 0, 4, "2024-03-05T09:12:00.000Z") and api.health() == {"status": "ok"}
    for name, args in (("search_history", {"query": "  "}), ("get_day", {}), ("get_recent", {"limit": 3})):
        with pytest.raises(ValueError):
            api.run_tool(name, args)
    assert api.run_tool("get_recent", {"count": 1}).count() == 1
    day = api.get_day("2024-03-05")["day"].first()
    assert day.daily_summary is None and day.hourly_summaries == []


def test_library(spark, tmp_path):
    root = str(tmp_path)
    docs = spark.createDataFrame([("2024-03-05", "A  day", "2024-03-06T01:00:00Z", "# x\n\nbody"), ("2024-03-05", "Again", "2024-03-06T02:00:00Z", "b")], "date string, title string, saved_at string, body string")
    library.save(library.new_ids(docs, spark.createDataFrame([], "id string")), root)
    e = library.entries(spark, root).collect()
    assert [(r.id, r.title, r.body) for r in e] == [("2024-03-05-2", "Again", "b"), ("2024-03-05", "A day", "# x\n\nbody")]
    assert sorted(p.name for p in (tmp_path / "library").iterdir() if not p.name.startswith(".")) == ["2024-03-05-2.md", "2024-03-05.md"]
    more = library.new_ids(docs.limit(1), library.entries(spark, root).select("id"))
    assert more.first().id == "2024-03-05-3"
    taken = spark.createDataFrame([("2024-03-05",), ("2024-03-05-3",), ("2024-03-05-x",), ("2024-03-05-03",)], "id string")
    both = library.new_ids(docs, taken).orderBy("saved_at")
    assert [r.id for r in both.collect()] == ["2024-03-05-2", "2024-03-05-4"]
    assert library.new_ids(docs.limit(1).withColumn("date", F.lit("/ .")), taken).first().id == "summary"
    labels = spark.createDataFrame([("2024-03-06T01:00:00Z",), ("x",), (None,)], "t string").select(library.saved_label(F.col("t"))).collect()
    assert [r[0] for r in labels] == ["2024-03-06 at 01:00", "an unknown time", "an unknown time"]


def test_retries_and_summaries(spark):
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise narrative.Transient
        return "ok"

    assert narrative.with_retries(call, sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    assert narrative.transient_status(429) and narrative.transient_status(500) and not narrative.transient_status(404)
    p = spark.createDataFrame([(0, "2024-03-05", 9, "u", 300)], "stream int, date string, hour int, user string, max_tokens int")
    s = narrative.summarise(p, lambda u, n: f"Summary: {u}\n{n}", "p", "m", "now").first()
    assert (s.text, s.hour, s.model) == ("u 300", 9, "m")


def test_markdown(spark):
    text = "# T\n#### deep\npara one\ncontinues\n\n- a\n* b\n---\ntail\n- c\nnext"
    b = narrative.markdown_blocks(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("pos").collect()
    assert [(r.kind, r.level, r.text) for r in b] == [
        ("heading", 1, "T"), ("heading", 3, "deep"), ("paragraph", 0, "para one continues"), ("list", 0, "a|b"), ("rule", 0, ""), ("paragraph", 0, "tail"), ("list", 0, "c"), ("paragraph", 0, "next"),
    ]


def test_stream_ingest(spark, root, tmp_path):
    from daytrace.streaming import ingest

    q = ingest.append_by_day(ingest.read_stream(spark, f"{root}/events/2024*.jsonl"), root, str(tmp_path / "cp"))
    q.awaitTermination()
    assert jsonl.read_log(spark, root).count() == 8
    seen = []
    q = ingest.refresh_touched(ingest.read_stream(spark, f"{root}/events/2024*.jsonl").select(F.to_date("timestamp").alias("date")), lambda d, n: seen.extend(str(r[0]) for r in d.collect()), str(tmp_path / "cp2"))
    q.awaitTermination()
    assert seen == ["2024-03-05"]


def log(spark, root, name, *events):
    """A batch of the log; one of the same name takes its place."""
    from daytrace.schema import EVENT

    jsonl.append(spark.createDataFrame([json.loads(json.dumps(e)) for e in events], EVENT).coalesce(1), root, name)


def test_days_without_episodes_are_processed_days(spark, tmp_path):
    root = str(tmp_path)
    store = Store(spark, root)
    assert store.stale().count() == 0 and store.refresh() == [] and store.ledger().count() == 0
    log(spark, root, "a", event(0, 0, kind="sessionLocked"))
    assert store.refresh() == ["2024-03-05"] and store.refresh() == []
    assert store.read("episodes").count() == 0 and [r.date for r in Api(store, "2024-03-05").days().collect()] == ["2024-03-05"]
    assert store.search("code").count() == 0
    log(spark, root, "a", event(0, 0), event(1, 5))
    assert store.refresh() == ["2024-03-05"] and store.read("episodes").count() == 1 and store.read("days").count() == 1
    log(spark, root, "a", event(0, 0, kind="sessionLocked"))  # the day shrinks to none
    assert store.refresh() == ["2024-03-05"] and store.refresh() == []
    assert [store.read(t).count() for t in ("episodes", "postings", "indexed", "days")] == [0, 0, 0, 0]
    assert [(r.date, r.episodes) for r in store.ledger().collect()] == [("2024-03-05", 0)]


def test_a_stopped_run_leaves_the_old_state_whole(spark, root, monkeypatch):
    store = Store(spark, root)
    store.refresh()
    state = lambda s: [sorted(map(str, s.read(t).collect())) for t in ("episodes", "postings", "indexed", "days")]
    old, held = state(store), store.snapshot()
    log(spark, root, "more", event(30, 40, app="New", title="words"))
    write = Store._write

    def stops(self, df, name, run):
        if name == "indexed":
            raise RuntimeError("stopped")
        write(self, df, name, run)

    monkeypatch.setattr(Store, "_write", stops)
    with pytest.raises(RuntimeError):
        store.refresh()
    assert state(store) == old
    monkeypatch.undo()
    assert store.refresh() == ["2024-03-05"] and state(store) != old and state(held) == old
    gone = store.vacuum()
    assert {g.split("/")[0] for g in gone} == {"episodes", "postings", "indexed", "days", "segments"} and len(store.versions()) == 1
    assert [r.app for r in store.search("words").collect()] == ["New"]


def test_a_batch_that_is_tried_again_is_never_missing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    log(spark, root, "a", event(0, 0), event(1, 5))
    monkeypatch.setattr(jsonl, "moved", lambda *a: False)
    with pytest.raises(OSError):
        log(spark, root, "b", event(2, 6))
    monkeypatch.undo()
    assert jsonl.read_log(spark, root).count() == 2
    log(spark, root, "a", event(7, 0))
    assert [r.id for r in jsonl.read_log(spark, root).collect()] == ["e7"]
    assert "__place" not in "".join(p.read_text() for p in tmp_path.glob("log/batch=*/date=*/*.json"))


def test_a_search_opens_the_segments_of_its_words(spark, tmp_path, request):
    root = str(tmp_path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would be one segment
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    store = Store(spark, root)
    words = [f"{a}{b}word" for a in "abcdefghijkl" for b in "xyz"]
    for day in ("05", "06"):
        log(spark, root, f"d{day}", *[event(i, i, app=f"App{i}", title=w) | {"timestamp": f"2024-03-{day}T09:{i:02d}:00.000Z"} for i, w in enumerate(words)])
        store.refresh()
    all_ = store.segments().count()
    assert all_ > 8 and {r.run for r in store.segments().collect()} == {r.postings_run for r in store.ledger().collect()}
    opened = {r.path for r in store.segments("bxword").collect()}
    assert 0 < len(opened) <= 4 and {f.rsplit("/", 1)[1] for f in store.postings("bxword").inputFiles() if "/postings/" in f} == {f.rsplit("/", 1)[1] for f in opened}
    assert [(r.date, r.app) for r in store.search("bxw").collect()] == [("2024-03-06", "App3"), ("2024-03-05", "App3")]
    assert store.search("bx kzw").count() == 0 and store.search("app3 bx").count() == 2 and store.segments("").count() == 0 and store.search("").count() == 0
    store.forget_day("2024-03-05")
    assert [r.date for r in store.search("bxw").collect()] == ["2024-03-06"]
    store.compact()
    assert store.read("postings").filter("date <> '2024-03-06'").count() == 0 and [r.date for r in store.search("bxw").collect()] == ["2024-03-06"]
    store.vacuum()
    assert store.segments().count() < all_ and [r.date for r in store.search("bxw").collect()] == ["2024-03-06"]
    assert spark.read.parquet(store.path("postings")).filter("date = '2024-03-05'").count() == 0


def test_a_document_that_cannot_be_moved_is_kept(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    docs = spark.createDataFrame([("d", "T", "2024-03-05", "2024-03-06T01:00:00Z", "one")], "id string, title string, date string, saved_at string, body string")
    library.save(docs, root)
    library.save(docs.withColumn("body", F.lit("two")), root)
    assert [r.body for r in library.entries(spark, root).collect()] == ["two"]
    monkeypatch.setattr(library, "replaced", lambda *a: False)
    with pytest.raises(OSError, match="d.md"):
        library.save(docs.withColumn("body", F.lit("three")), root)
    assert [r.body for r in library.entries(spark, root).collect()] == ["two"]
    assert "three" in "".join(p.read_text() for p in tmp_path.glob("library/.saving-*/id=d/part-*"))


def test_a_line_of_the_log_is_parsed_once(spark, root):
    for df in (jsonl.read_days(spark, root), jsonl.bad_lines(spark, root)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
