"""Sessionisation: activity rows to episodes.

An episode is a run of window events of one (app, private) in a stream's day, ended by
another app or privacy, by an away event of any app, or by more than 15 minutes of silence.
Order is the order of the log (seq), not of time; times may run backwards, and a silence is
measured from the latest time seen in the open episode.

No fold is needed for that: within a run of rows of one app and privacy, silence ends an episode
only where a time is beyond all before it, so the latest time of the episode is the running
maximum of the run. One exchange and one sort by (stream, date, seq) serve all windows; nothing
of a day is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.textfn import document_label
from ..functions.timefn import credited, format_instant
from ..schema import AWAY_KINDS, IDLE_MS, MAX_DOCUMENTS, MAX_TEXT, TIES_GO_LAST, WINDOW_KINDS
from ..shared import dealt

KEY = ("stream", "date")


def is_window(kind: Column) -> Column:
    return kind.isin(*WINDOW_KINDS)


def is_away(kind: Column) -> Column:
    return kind.isin(*AWAY_KINDS)


def is_private(kind: Column, sensitive: Column) -> Column:
    return F.coalesce(sensitive, F.lit(False)) | (kind == "privacyBoundary")


def relevant(activity: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Window and away rows with a readable time, with ms, away, private and app filled in; keep names columns to leave as they are.

    The date becomes text here, before anything is dealt by it, so that one exchange by (stream, date)
    serves the sessions and all rollups by (stream, date, ...) after them.
    """
    return activity.filter(F.col("ts").isNotNull() & (is_window(F.col("kind")) | is_away(F.col("kind")))).select(
        "stream", F.col("date").cast("string").alias("date"), "seq", F.unix_millis("ts").alias("ms"), is_away(F.col("kind")).alias("away"), is_private(F.col("kind"), F.col("sensitive")).alias("private"), F.coalesce("app", F.lit("")).alias("app"), "app_path",
        "title", "url", document_label(F.col("doc_title"), F.col("doc_path")).alias("document"), "visible_text", *keep,
    )


def marked(activity: DataFrame, ranges: Column | None = None) -> DataFrame:
    """Window rows with their episode number, credit and the time until which they count; of whole days also with their place in the day, their episode's first place, and its current title.

    ranges: for days too large for one sort, a column that never falls as seq rises (see seq_range). A day
    is then cut where it changes; each range is sorted by itself, and what a range must know of the
    others (one row for each range) is found by a pass over the ranges of the day.
    """
    r = relevant(activity)
    return _marked(dealt(r, *KEY)) if ranges is None else _marked_by_ranges(dealt(r.withColumn("range", ranges), *KEY, "range"))


def _marked(r: DataFrame) -> DataFrame:
    order = W.partitionBy(*KEY).orderBy("seq")
    upto, earlier = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    before = {c: F.lag(c).over(order) for c in ("away", "private", "app")}
    # each step asks for all that it can know: a pass over wide rows costs more than what it computes
    r = r.withColumns({"other": _other(before), "next_ms": F.lead("ms").over(order), "next_away": F.lead("away").over(order), "place": F.row_number().over(order)})
    r = r.withColumns({"run": F.sum(F.col("other").cast("long")).over(upto), "named": F.last(F.when(~F.col("away") & _named(), F.struct("place", "title")), ignorenulls=True).over(upto)})
    # the latest time of the run so far: runs are numbered in order, so the largest (run, ms) is of this run
    latest = F.max(F.struct("run", "ms"))
    r = r.withColumns({"last": latest.over(upto)["ms"], "silent": F.coalesce(F.col("ms") - latest.over(earlier)["ms"] > IDLE_MS, F.lit(False))})
    begins = ~F.col("away") & (F.col("other") | F.col("silent"))
    r = r.withColumns({"ep": F.sum(begins.cast("long")).over(upto), "begun": F.max(F.when(begins, F.col("place"))).over(upto)})
    r = r.withColumn("current", F.when(F.col("named.place") >= F.col("begun"), F.col("named.title")))
    return _credited(r).drop("other", "run", "silent", "named")


def _named() -> Column:
    """Whether a row names its window."""
    return ~F.col("private") & (F.trim("title") != "")


def _other(before: dict[str, Column]) -> Column:
    """Whether a row goes on with another app or privacy than the row before, or after none."""
    return before["away"].isNull() | before["away"] | F.col("away") | (before["app"] != F.col("app")) | (before["private"] != F.col("private"))


def _credited(r: DataFrame) -> DataFrame:
    gap = F.col("next_ms") - F.col("last")
    idle = F.col("next_ms").isNull() | (~F.col("next_away") & (gap > IDLE_MS))
    r = r.withColumn("credit", F.when(idle, F.lit(0)).otherwise(credited(gap))).withColumn("until", F.when(idle, F.col("last")).otherwise(F.col("next_ms")))
    return r.filter(~F.col("away")).drop("last")


def seq_range(activity: DataFrame, width: int) -> Column:
    """Ranges of about `width` rows of seq, a number or a place in the log."""
    if "struct" in dict(activity.dtypes)["seq"]:
        return F.struct("seq.batch", "seq.file", "seq.block", F.floor(F.col("seq.place") / width).alias("part"))
    return F.floor(F.col("seq") / width)


def _marked_by_ranges(r: DataFrame) -> DataFrame:
    """The same as _marked, with no sort or window over the rows of a whole day.

    Within a range everything but its first run is known. Of a range others need its first and last row, and
    the latest time of its last run; with these, first the runs and then the episodes of the range get what came before.
    """
    cut = (*KEY, "range")
    order = W.partitionBy(*cut).orderBy("seq")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    day = W.partitionBy(*KEY).orderBy("range")
    earlier = day.rowsBetween(W.unboundedPreceding, -1)
    before = {c: F.lag(c).over(order) for c in ("away", "private", "app")}
    r = r.withColumn("first", before["away"].isNull()).withColumn("other", ~F.col("first") & _other(before)).withColumn("next_ms", F.lead("ms").over(order)).withColumn("next_away", F.lead("away").over(order))
    r = r.withColumn("run", F.sum(F.col("other").cast("long")).over(upto)).withColumn("last", F.max(F.struct("run", "ms")).over(upto)["ms"])
    ends = F.struct("away", "private", "app", "ms")
    s = r.groupBy(*cut).agg(F.min_by(ends, "seq").alias("a"), F.max_by(ends, "seq").alias("z"), F.max("run").alias("runs"), F.max(F.struct("run", "ms"))["ms"].alias("latest"))
    was = F.lag("z").over(day)
    s = s.withColumn("opens", F.coalesce(was["away"] | F.col("a.away") | (was["app"] != F.col("a.app")) | (was["private"] != F.col("a.private")), F.lit(True)))
    s = s.withColumn("number", F.sum(F.col("runs") + F.col("opens").cast("long")).over(day.rowsBetween(W.unboundedPreceding, 0)))
    s = s.withColumn("came", F.max(F.struct("number", "latest")).over(earlier)["latest"])  # the latest time of the run that is open where the range begins
    s = s.withColumn("follows", F.lead("a").over(day))
    s = s.select(*cut, "opens", "came", F.col("follows.ms").alias("follows_ms"), F.col("follows.away").alias("follows_away"))
    r = r.join(s, list(cut))
    end = F.col("next_away").isNull()
    r = r.withColumn("next_ms", F.when(end, F.col("follows_ms")).otherwise(F.col("next_ms"))).withColumn("next_away", F.when(end, F.col("follows_away")).otherwise(F.col("next_away")))
    r = r.withColumn("other", F.when(F.col("first"), F.col("opens")).otherwise(F.col("other")))
    r = r.withColumn("last", F.when((F.col("run") == 0) & ~F.col("opens"), F.greatest("last", "came")).otherwise(F.col("last")))
    silent = F.coalesce(F.col("ms") - F.when(F.col("first"), F.col("came")).otherwise(F.lag("last").over(order)) > IDLE_MS, F.lit(False))
    r = r.withColumn("ep", F.sum((~F.col("away") & (F.col("other") | silent)).cast("long")).over(upto))
    n = r.groupBy(*cut).agg(F.max("ep").alias("eps")).withColumn("base", F.coalesce(F.sum("eps").over(earlier), F.lit(0))).select(*cut, "base")
    r = r.join(n, list(cut)).withColumn("ep", F.col("ep") + F.col("base"))
    return _credited(r).drop("other", "run", "first", "opens", "came", "follows_ms", "follows_away", "base", "range")


def _bounds() -> list[Column]:
    """Aggregates of an episode's rows; its end is never before its start."""
    start = F.min_by("ms", "seq")
    return [F.min_by("app", "seq").alias("app"), F.first("private").alias("is_private"), start.alias("start_ms"), F.greatest(F.max_by("until", "seq"), start).alias("end_ms"), F.sum("credit").alias("active_ms"), F.count("*").alias("event_count")]


#: The lists of an episode, and how many values each holds (None: all).
LISTS = (("titles", None), ("urls", None), ("documents", MAX_DOCUMENTS), ("visible_text", MAX_TEXT))
#: So many rows of an episode are gathered at once.
PIECE = 64
#: Episodes that begin within so many rows of a day stay together where days are spread.
PART = 65_536


def _distinct(values: Column, most: int | None) -> Column:
    """The first appearances, in order, without nulls."""
    found = F.array_distinct(F.array_compact(values))
    return found if most is None else F.slice(found, 1, most)


def _lists_of_rows(rows: Column) -> list[Column]:
    """LISTS of rows in order."""
    empty = F.array().cast("array<string>")
    each = {"titles": F.transform(rows, lambda r: F.when(F.trim(r["title"]) != "", r["title"])), "urls": F.transform(rows, lambda r: r["url"]), "documents": F.transform(rows, lambda r: r["document"])}
    each["visible_text"] = F.flatten(F.transform(rows, lambda r: F.coalesce(r["visible_text"], empty)))
    return [_distinct(each[name], most).alias(name) for name, most in LISTS]


def _placed(rows: DataFrame) -> DataFrame:
    """Adds what whole days have from _marked: the place of each row in the order of its episode, and its episode's current title."""
    order = W.partitionBy(*KEY, "ep").orderBy("seq")
    title = F.last(F.when(_named(), F.col("title")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumns({"place": F.row_number().over(order), "current": title})


def _with_holds(rows: DataFrame, *within: str) -> DataFrame:
    """Adds how long the episode held the row's current title in all, and the place where it came first: a title is held from its event until the next title.

    Windows rather than a join back: all partition within (stream, date), so they need no further exchange, and those of a
    day in its order no further sort. within: what an episode's rows share.
    """
    by_title = W.partitionBy(*within, "current")
    return rows.withColumn("held", F.sum("credit").over(by_title)).withColumn("first", F.min("place").over(by_title))


def episodes(activity: DataFrame, ranges: Column | None = None, spread: bool = False) -> DataFrame:
    """Episodes with their lists, titles and text. ranges: see marked(). spread: rows of whole days are dealt again by PART rows once
    their episodes are known, so that a task holds a day for that pass alone; the result is then not by whole days.

    Rows are gathered by pieces of PIECE rows at most; the lists of a piece hold first appearances alone, and those that
    are capped no more than that, before the pieces of an episode meet. So an episode's rows are never collected.
    """
    rows, within = marked(activity, ranges), (*KEY, "ep")
    if ranges is not None:
        rows = _placed(dealt(rows, *KEY, "ep"))
    elif spread:
        rows = dealt(rows.withColumn("part", F.floor((F.col("begun") - 1) / PART)), *KEY, "part")
        within = (*KEY, "part", "ep")
    rows = _with_holds(rows, *within)
    rank = F.when(F.col("current").isNotNull(), F.struct("held", F.col("first") if TIES_GO_LAST else -F.col("first"), "current"))
    shown = F.when(~F.col("private"), F.struct("place", "title", "url", "document", "visible_text"))
    rows = rows.withColumns({"piece": F.floor((F.col("place") - 1) / PIECE), "rank": rank})
    # a piece by a window over its rows, of which one stays: most episodes are of a row or two, and an aggregate sorts them twice, before and after a shuffle that isn't there
    order = W.partitionBy(*within, "piece").orderBy("place")
    piece = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = lambda c: F.first(c).over(piece)
    p = rows.select(
        *within, "place", first("app").alias("app"), F.col("private").alias("is_private"), first("ms").alias("start_ms"), F.last("until").over(piece).alias("until"), F.sum("credit").over(piece).alias("credit"), F.count("*").over(piece).alias("events"),
        F.max("rank").over(piece).alias("rank"), first("app_path").alias("app_path"), F.collect_list(shown).over(piece).alias("rows"), F.row_number().over(order).alias("nth"),
    ).filter("nth = 1").drop("nth")
    p = p.select(*[c for c in p.columns if c != "rows"], *_lists_of_rows(F.col("rows")))
    start = F.min_by("start_ms", "place")
    e = p.groupBy(*within).agg(
        F.min_by("app", "place").alias("app"), F.first("is_private").alias("is_private"), start.alias("start_ms"), F.greatest(F.max_by("until", "place"), start).alias("end_ms"), F.sum("credit").alias("active_ms"), F.sum("events").alias("event_count"),
        F.max("rank")["current"].alias("title"), F.min_by("app_path", "place").alias("app_path"), F.array_sort(F.collect_list(F.struct("place", *[name for name, _ in LISTS]))).alias("pieces"),
    )
    lists = [F.when(F.size("pieces") == 1, F.col("pieces")[0][name]).otherwise(_distinct(F.flatten(F.col(f"pieces.{name}")), most)).alias(name) for name, most in LISTS]
    return _finished(e.select(*[c for c in e.columns if c != "pieces"], *lists))


def _finished(e: DataFrame) -> DataFrame:
    start, end = F.timestamp_millis("start_ms"), F.timestamp_millis("end_ms")
    return e.select(
        "stream", "date", F.concat("date", F.lit("#"), F.col("start_ms").cast("string")).alias("id"), "app", "app_path", "title", "titles", "urls", "documents", "visible_text",
        format_instant(start).alias("start"), format_instant(end).alias("end"), "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "active_ms", "event_count", "is_private", F.col("ep").alias("ordinal"),
    )


def core(activity: DataFrame, ranges: Column | None = None) -> DataFrame:
    """Episodes without lists and titles: no collected arrays, for rollups of time alone. ordinal counts a day's episodes in the order of the log."""
    e = marked(activity, ranges).groupBy(*KEY, "ep").agg(*_bounds())
    return e.select("stream", "date", F.concat("date", F.lit("#"), F.col("start_ms").cast("string")).alias("id"), "app", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "active_ms", "event_count", "is_private", F.col("ep").alias("ordinal"))


def out_of_order_days(activity: DataFrame) -> DataFrame:
    """(stream, date) of days in which a row's time is before that of the row before."""
    back = F.lag("ms").over(W.partitionBy(*KEY).orderBy("seq")) > F.col("ms")
    return relevant(activity).select(*KEY, back.alias("back")).filter("back").select("stream", F.to_date("date").alias("date")).distinct()


def gap_sessions(activity: DataFrame, gap: str = "15 minutes") -> DataFrame:
    """Sessions by silence alone: (stream, start_ms, end_ms, events). The end is the last event's time; a gap of exactly 15 minutes merges."""
    s = activity.filter(F.col("ts").isNotNull()).groupBy("stream", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.max("ts").alias("last"))
    return s.select("stream", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("last").alias("end_ms"), "events")
