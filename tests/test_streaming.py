"""Streams with state: open sessions, and repeats whose rows come in any order."""

import random

import pytest
from pyspark.sql import functions as F

from daytrace.operators import capture, sessions
from daytrace.streaming import ingest, open_sessions

from .helpers import A, C, L, P, U, activity


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, open_sessions.STATE_STORE)
    yield
    spark.conf.set(key, was)


def rows_of(rng, n):
    t, rows = 0.0, []
    for _ in range(n):
        t += rng.choice([0.5, 2, 6, 14, 16, 40])
        rows.append((t, rng.choice([A, C, C, U, P, L, "screenWoke"]), rng.choice(["x", "x", "y"]), rng.choice(["t", "u"])))
    return rows


def number(df):
    return df.withColumn("seq", F.col("seq").cast("long"))


def fed(spark, parts, path, again):
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        open_sessions.keep_sessions(spark.readStream.schema(part.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/cp", lambda days, n, k=k: again.append((k, sorted(tuple(r) for r in days.collect()))), "1 day").awaitTermination()
    return open_sessions.read_sessions(spark, f"{path}/out")


def test_open_sessions_equal_the_batch_and_late_rows_name_their_day(spark, tmp_path):
    a = number(activity(spark, *rows_of(random.Random(5), 60))).cache()
    clock = a.limit(1).withColumn("ts", F.to_timestamp(F.lit("2024-04-01"))).withColumn("kind", F.lit("screenWoke"))
    again = []
    got = fed(spark, [a.filter("seq < 20"), a.filter("seq >= 20 AND seq < 25"), a.filter("seq >= 25"), clock], str(tmp_path), again)
    want = sessions.core(a).drop("ordinal")
    assert again == [] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 10
    again = []
    late = a.filter("seq = 21")
    fed(spark, [a.filter("seq < 20"), a.filter("seq > 21 AND seq < 24"), late], str(tmp_path / "b"), again)
    assert again == [(2, [(0, "2024-03-05")])]
    assert fed(spark, [a.limit(0), clock], str(tmp_path / "c"), []).count() == 0


def test_repeats_in_any_order_of_rows_files_and_chunks(spark, tmp_path, rocks):
    rng = random.Random(9)
    a = number(activity(spark, *[(i / 10, C, rng.choice("xy"), rng.choice(["t", None])) for i in range(400)]))
    rows = a.select("stream", "seq", "ts", "app", "title", "url").withColumn("stream", F.when(F.col("seq") % 3 == 0, 1).otherwise(0)).cache()
    rows.repartition(4, F.xxhash64("seq")).write.parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, 50)

    def run():
        out = ingest.repeats_by_range(feed, "1 day", 64)
        out.writeStream.outputMode("append").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    try:
        run()
        rows.limit(1).withColumn("stream", F.lit(-1)).withColumn("ts", F.to_timestamp(F.lit("2024-04-01"))).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    finally:
        spark.conf.set(key, was)
    got = ingest.stitched(spark.read.parquet(f"{tmp_path}/out").drop("batch")).filter("stream >= 0")
    want = []
    for s in (0, 1):
        before = None
        for r in sorted((r for r in rows.collect() if r.stream == s), key=lambda r: r.seq):
            if before is None or (r.app, r.title, r.url) != before:
                want.append((s, r.seq))
            before = (r.app, r.title, r.url)
    assert sorted((r.stream, r.seq) for r in got.collect()) == sorted(want)
    for width in (1, 7, 64, 1000):
        batch = capture.without_repeats(rows, "app", "title", "url", range_=F.floor(F.col("seq") / width))
        assert sorted((r.stream, r.seq) for r in batch.collect()) == sorted(want) and batch.columns == rows.columns


def test_no_sort_of_a_whole_stream(spark):
    """Windows over raw rows are by stream and range; only one row for each range is put in order by stream."""
    rows = number(activity(spark, (0, C, "x", "t"))).select("stream", "seq", "app", "title")
    plan = capture.without_repeats(rows, "app", "title")._jdf.queryExecution().executedPlan().toString()
    by_stream = [line for line in plan.splitlines() if "Window [" in line and ", [stream#" in line.split("]", 1)[1] and "__range" not in line.rsplit(", [", 2)[1]]
    assert len(by_stream) == 1 and "__last" in by_stream[0]
