"""Activity rows: from event records, and from the given `events` and `pages` tables.

An activity row: stream, date, seq (the order within a stream and day), ts (ms), kind, app,
app_path, title, url, doc_path, doc_title, sensitive, visible_text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.timefn import parse_instant


def from_records(records: DataFrame) -> DataFrame:
    """Event records (schema.EVENT with date, seq and perhaps stream) as activity rows."""
    # one stream is no literal: Spark drops literals from what a sort or a grouping asks for, and would deal the rows a second time by the rest
    stream = F.col("stream") if "stream" in records.columns else F.coalesce(F.col("version") * 0, F.lit(0))
    return records.select(
        stream.alias("stream"), "date", "seq", parse_instant(F.col("timestamp")).alias("ts"), "kind", F.coalesce("application.name", F.lit("")).alias("app"), F.col("application.path").alias("app_path"),
        F.col("windowTitle").alias("title"), F.col("browser.url").alias("url"), F.col("document.path").alias("doc_path"), F.col("document.title").alias("doc_title"),
        (F.coalesce("isSensitive", F.lit(False)) | F.coalesce("browser.isPrivate", F.lit(False))).alias("sensitive"), F.col("visibleText").alias("visible_text"),
    )


def from_events(events: DataFrame, pages: DataFrame | None) -> DataFrame:
    """The given tables as activity: four streams of some three apps; a purchase shows a page, an error locks, a signup is private.

    A purchase meets its page by rank: pages are numbered 0, 1, ... by page_id there, so the join is an equi-join on event_id modulo their count.
    Other events get keys of their own that no page has, so that they are dealt evenly. Without pages there is no url and no join.
    """
    if pages is None:
        e = events.withColumn("url", F.lit(None).cast("string"))
    else:
        n_pages = pages.agg(F.count("*").alias("n_pages"))  # one row
        page = F.when(F.col("event_type") == "purchase", F.pmod("event_id", F.greatest("n_pages", F.lit(1)))).otherwise(-1 - F.abs("event_id"))
        e = events.crossJoin(F.broadcast(n_pages)).withColumn("page", page).join(pages.select(F.col("page_id").alias("page"), "url"), "page", "left")
    k = F.get_json_object("props", "$.k").cast("long")
    ts = F.date_trunc("millisecond", F.col("ts").cast("timestamp"))
    kind = F.create_map(*[F.lit(x) for pair in (("view", "applicationActivated"), ("click", "windowChanged"), ("purchase", "urlChanged"), ("signup", "privacyBoundary"), ("error", "sessionLocked")) for x in pair])
    return e.select(
        F.pmod("user_id", F.lit(4)).cast("int").alias("stream"), F.to_date(ts).alias("date"), F.col("event_id").alias("seq"), ts.alias("ts"), kind[F.col("event_type")].alias("kind"),
        F.concat(F.lit("app_"), F.pmod("user_id", F.lit(3)).cast("string")).alias("app"), F.lit(None).cast("string").alias("app_path"), F.concat(F.lit("title "), (k % 5).cast("string")).alias("title"), "url",
        F.concat(F.lit("C:\\work\\doc"), (k % 7).cast("string"), F.lit(".txt")).alias("doc_path"), F.lit(None).cast("string").alias("doc_title"), (k % 29 == 0).alias("sensitive"),
        F.array(F.concat(F.lit("line "), (k % 11).cast("string")), F.lit("status bar")).alias("visible_text"),
    )


def activity(spark: SparkSession, sf_dir: str, urls: bool = True) -> DataFrame:
    """Without urls where a query reads none: the pages aren't joined then."""
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet") if urls else None)
