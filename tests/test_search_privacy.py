from daytrace.operators import capture, privacy, search, sessions

from .helpers import A, C, P, U, activity


def index(spark):
    a = activity(
        spark, (0, A, "Visual Studio Code", "lib.rs — project"), (20, U, "Chrome", "Rust docs", {"url": "https://doc.rust-lang.org/std?token=sekret#frag"}), (40, P, "Chrome", "hidden words"), (60, C, "Slack", "#engineering", {"doc_path": "C:\\secret\\plan.md"})
    )
    e = sessions.episodes(a)
    return e, search.postings(e), search.indexed(e)


def found(index_, query, limit=50):
    return [r.app for r in search.search(index_[1], index_[2], query, limit).collect()]


def test_and_prefix_case_limit_empty(spark):
    i = index(spark)
    assert found(i, "VISUAL stud") == ["Visual Studio Code"]
    assert found(i, "rust chrome") == ["Chrome"] and found(i, "rust slack") == []
    assert found(i, "ch") == ["Chrome", "Chrome"] and found(i, "ch", 1) == ["Chrome"]
    assert found(i, "") == [] and found(i, "x") == []


def test_words_with_combining_marks(spark):
    a = activity(spark, (0, A, "Editor", "हिन्दी भाषा — naïve Straße"))
    e = sessions.episodes(a)
    i = e, search.postings(e), search.indexed(e)
    assert found(i, "हिन्दी") == ["Editor"] and found(i, "NAÏVE stra") == ["Editor"]


def test_nothing_private_is_indexed(spark):
    e, p, _ = index(spark)
    terms = {r.term for r in p.collect()}
    assert not terms & {"sekret", "token", "frag", "hidden", "secret"} and {"plan", "md", "std", "rust"} <= terms
    assert {r.term for r in p.join(e.filter("is_private"), ["stream", "date", "id"]).collect()} == {"chrome"}


def test_matched_terms_and_forget(spark):
    _, p, x = index(spark)
    assert search.search(p, x, "code code visual code").first().matched_terms == 3
    assert search.forget_day(p, "2024-03-05").count() == 0


def test_public_form(spark):
    p = {r.start: r for r in privacy.public_episodes(index(spark)[0]).collect()}
    text = str(list(p.values()))
    assert all(x not in text for x in ("sekret", "hidden", "secret"))
    assert "app_path" not in privacy.public_episodes(index(spark)[0]).columns
    assert p["2024-03-05T09:20:00.000Z"].urls == ["https://doc.rust-lang.org/std"]
    assert p["2024-03-05T09:40:00.000Z"].description == "Chrome (private session, nothing recorded)"


def test_repeats_and_exclusion_and_masks(spark):
    a = activity(spark, (0, C, "x", "t"), (1, C, "x", "t"), (2, C, "x", None), (3, C, "x", None), (4, C, "y", "t", {"app_path": "C:\\BitWarden.exe"}))
    assert [r.seq for r in capture.without_repeats(a, "app", "title").orderBy("seq").collect()] == [0, 2, 4]
    assert capture.without_excluded(a).count() == 4
    from pyspark.sql import functions as F

    m = capture.masked(a.withColumn("privacy", F.when(F.col("seq") == 0, "private").when(F.col("seq") == 1, "undetermined").otherwise("recordable"))).orderBy("seq").collect()
    assert [(r.kind, r.title) for r in m[:2]] == [("privacyBoundary", None), (C, None)]
    assert capture.allow(("a", "b"), "A") == ("b",) and capture.exclude(("a",), "A") == ("a",)


def test_throttle_runs_from_the_last_kept_read(spark):
    from pyspark.sql import functions as F

    steady = [(i / 6, C, "x", "t") for i in range(13)]  # every 10 s
    a = activity(spark, *steady).withColumn("lines", F.lit(2))
    assert [r.seq for r in capture.throttled(a, "app", "lines").orderBy("seq").collect()] == [0, 3, 6, 9, 12]
    # a read of one line doesn't start the clock, another window ends it
    a = activity(spark, (0, C, "x", "t"), (0.1, C, "x", "t"), (0.2, C, "x", "t"), (0.3, C, "y", "t"), (0.4, C, "x", "t"), (0.45, C, "x", "t"))
    a = a.withColumn("lines", F.when(F.col("seq") == 0, 1).otherwise(5))
    assert [r.seq for r in capture.throttled(a, "app", "lines").orderBy("seq").collect()] == [0, 1, 3, 4]


def test_surfaces_and_tokens(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("Text", None), ("text", ["Pane"]), ("Edit", ["Group", "ToolBar"]), ("Button", []), ("ListItem", []), ("StatusBar", []), (None, None)], "kind string, around array<string>")
    assert [r[0] for r in rows.select(capture.surface(F.col("kind"), F.col("around"))).collect()] == [0, 0, 2, 2, 1, 2, 1]
    stored = spark.createDataFrame([("a",), ("b",)], "token string").select(F.sha2("token", 256).alias("hash"))
    assert [r.token for r in capture.accepted(spark.createDataFrame([("a",), ("c",), (None,)], "token string"), stored).collect()] == ["a"]


def test_words_of_an_episode_are_looked_for_once(spark):
    e, p, _ = index(spark)
    assert p._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    assert {r.term for r in p.filter("term LIKE '%rs%' OR term LIKE 'visual%' OR term LIKE 'hidden%' OR term LIKE 'sek%'").collect()} == {"visual", "rs"}
