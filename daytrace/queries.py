"""The registered queries over the given tables, one for each operator or group of operators. Lists leave as joined text."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapter import activity
from .functions import textfn, timefn
from .operators import capture, privacy, rollup, search, sessions
from .plans import api, narrative
from .sources import jsonl

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
QUESTION, SEARCH = "What took the longest?", "app title 3"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _core(s: SparkSession, d: str) -> DataFrame:
    return sessions.core(activity(s, d, urls=False))


def _episodes(s: SparkSession, d: str, spread: bool = False) -> DataFrame:
    return sessions.episodes(activity(s, d), spread=spread)


def _slices(s: SparkSession, d: str) -> DataFrame:
    return rollup.hour_slices(_core(s, d))


def _summaries(slices: DataFrame) -> DataFrame:
    """Stands in for written hour summaries: two of three hours, some of them out of date."""
    lead = rollup.leading_app(rollup.hourly_app_usage(slices)).select("stream", "date", "hour", "app")
    h = rollup.hourly(slices).filter(F.col("hour") % 3 != 0).join(lead, ["stream", "date", "hour"])
    return h.select("stream", "date", "hour", F.greatest(F.col("active_ms") - (F.col("hour") % 4) * 40_000, F.lit(0)).alias("active_ms"), F.concat(F.lit("  Mostly "), "app", F.lit(".\n")).alias("text"), F.lit("model-a").alias("model"))


def _daily_texts(days: DataFrame) -> DataFrame:
    return days.filter(F.dayofmonth(F.col("date").cast("date")) % 2 == 0).select("stream", "date", F.concat(F.lit(" A day of "), F.col("episodes").cast("string"), F.lit(" sessions. ")).alias("daily"))


def _ids(e: DataFrame, *more: str) -> DataFrame:
    return e.select("stream", "date", "id", *more)


@query
def flagship_app_minutes(s, d):
    """Per day and app over all streams: active minutes, ranked."""
    g = _core(s, d).groupBy("date", "app").agg(F.sum("active_ms").alias("active_ms"))
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("date").orderBy(F.desc("active_ms"), "app"))
    return g.select("date", "app", "active_ms", timefn.whole(F.col("active_ms"), 60_000).alias("minutes"), rank.alias("rank"))


@query
def day_stats(s, d):
    a = activity(s, d, urls=False)
    return a.groupBy(a.date.cast("string").alias("date")).agg(F.count("*").alias("events"), F.max_by(F.unix_millis("ts"), "seq").alias("last_ms"))


@query
def recorded_days(s, d):
    return activity(s, d, urls=False).select(F.col("date").cast("string").alias("date")).distinct()


@query
def kind_filter_counts(s, d):
    a, k = activity(s, d, urls=False), F.col("kind")
    return a.groupBy("kind").agg(F.count("*").alias("n"), F.max(sessions.is_window(k)).alias("is_window"), F.max(sessions.is_away(k)).alias("is_away"), F.max(capture.emitted_kind(k)).alias("is_emitted"), F.max(capture.known_kind(k)).alias("is_known"))


@query
def privacy_flags(s, d):
    a = activity(s, d, urls=False)
    return a.groupBy("stream").agg(F.count("*").alias("n"), F.count_if(sessions.is_private(F.col("kind"), F.col("sensitive"))).alias("n_private"))


@query
def dedup_consecutive(s, d):
    return capture.without_repeats(activity(s, d, urls=False), "app", "title").select("stream", "seq", "app", "title")


@query
def excluded_apps_anti(s, d):
    a = activity(s, d, urls=False)
    apps = a.select("app").distinct().filter(F.col("app").endswith("1")).withColumn("app", F.upper("app"))
    return capture.without_excluded_apps(a, apps).groupBy("stream", "app").agg(F.count("*").alias("n"))


@query
def excluded_path_filter(s, d):
    a = activity(s, d, urls=False).withColumn("app_path", F.when(F.col("seq") % 5 == 0, F.lit("C:\\Programs\\KeePassXC.exe")).otherwise(F.concat(F.lit("C:\\Programs\\"), "app", F.lit(".exe"))))
    return capture.without_excluded(a).groupBy("stream", F.lower(textfn.file_stem(F.col("app_path"))).alias("stem")).agg(F.count("*").alias("n"))


@query
def read_throttle(s, d):
    """Two of three reads see more than one line."""
    a = activity(s, d, urls=False).withColumn("lines", F.when(F.col("seq") % 3 == 0, 1).otherwise(F.size("visible_text")))
    return capture.throttled(a, "app", "lines").groupBy("stream", "app").agg(F.count("*").alias("n"))


@query
def read_throttle_long(s, d):
    """The same with a clock of ten minutes, so that most streams' rows hang together."""
    a = activity(s, d, urls=False).withColumn("lines", F.when(F.col("seq") % 3 == 0, 1).otherwise(F.size("visible_text")))
    return capture.throttled(a, "app", "lines", 600_000).groupBy("stream", "app").agg(F.count("*").alias("n"))


@query
def masked_observations(s, d):
    a = activity(s, d)
    state = F.when(F.col("seq") % 7 == 0, "private").when(F.col("seq") % 7 == 1, "undetermined").otherwise("recordable")
    m = capture.masked(a.withColumn("privacy", state))
    return m.groupBy("stream", "kind", "privacy").agg(F.count("*").alias("n"), F.count("title").alias("titles"), F.count("url").alias("urls"))


def _page_title(html: str = "html"):
    return F.regexp_extract(F.coalesce(html, F.lit("")), "(?s)<title>(.*?)</title>", 1)


@query
def private_titles(s, d):
    """Pages' titles as browsers show them: with the mark of a private window, of another browser, or none."""
    n = F.col("page_id")
    pick = lambda xs, by: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(by, F.lit(len(xs))) + 1).cast("int"))
    shown = F.concat(_page_title(), pick((" - Incognito", " - InPrivate", " (Private Browsing)", " - Tor", ""), F.floor(n / 6)))
    e = _table(s, d, "pages").select("page_id", pick(("chrome", "msedge", "FireFox", "brave", "opera_gx", "notepad"), n).alias("stem"), shown.alias("title"))
    b = textfn.browser_of(F.col("stem"))
    return e.select("page_id", b.alias("browser"), textfn.title_is_private(b, F.col("title")).alias("private"), capture.privacy(b, F.col("title"), F.when(F.col("page_id") % 2 == 0, F.array("title"))).alias("privacy"))


@query
def control_surfaces(s, d):
    """Lines of pages by the surface that they stand on: an element's kind and those of the elements around it."""
    kinds = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("<(nav|footer|aside|p|h1|li|div|article)[ >]"), F.lit(1)), lambda t: F.create_map(*[F.lit(x) for x in ("nav", "MenuBar", "footer", "statusbar", "aside", "Pane", "p", "Text", "h1", "Document", "li", "MenuItem", "div", "Group", "article", "Window")])[t])
    rows = _table(s, d, "pages").select("page_id", F.posexplode(kinds).alias("pos", "kind"), kinds.alias("all"))
    around = F.slice("all", F.greatest(F.col("pos") - 1, F.lit(1)), F.least(F.col("pos"), F.lit(2)))
    return rows.select("page_id", capture.surface(F.col("kind"), around).alias("surface")).groupBy("page_id", "surface").agg(F.count("*").alias("n"))


def _elements(s: SparkSession, d: str) -> DataFrame:
    """The elements of pages as trees: an open tag's parent is the last open tag before it one level up; its name is the text that follows."""
    tag, html = r"<(/?)([a-z][a-z0-9]*)[^<>]*>([^<]*)", F.coalesce("html", F.lit(""))
    part = lambda k: F.regexp_extract_all(html, F.lit(tag), F.lit(k))
    t = _table(s, d, "pages").select("page_id", F.posexplode(F.arrays_zip(part(1).alias("shut"), part(2).alias("tag"), part(3).alias("name"))).alias("pos", "t")).select("page_id", "pos", "t.*")
    t = t.filter(~F.col("tag").isin("meta", "br", "img", "link", "input", "hr"))
    from pyspark.sql import Window as W

    order = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("depth", F.sum(F.when(F.col("shut") == "/", -1).otherwise(1)).over(order)).filter("shut = ''")
    up = t.select("page_id", F.col("pos").alias("parent"), (F.col("depth") + 1).alias("depth"))
    parents = t.join(up, ["page_id", "depth"]).filter("parent < pos").groupBy("page_id", "pos").agg(F.max("parent").alias("parent"))
    kinds = ("nav", "MenuBar", "footer", "statusbar", "aside", "Pane", "p", "Text", "h1", "Document", "li", "ListItem", "a", "Hyperlink", "b", "Image", "article", "Window")
    kind = F.create_map(*[F.lit(x) for x in kinds])[F.col("tag")]
    return t.join(parents, ["page_id", "pos"], "left").select(F.col("page_id").alias("tree"), F.col("pos").alias("node"), "parent", "pos", F.coalesce(kind, F.lit("Group")).alias("kind"), F.trim("name").alias("name"), F.col("tag").isin("script", "style").alias("hidden"))


def _walked(s: SparkSession, d: str, budget) -> DataFrame:
    from .operators import tree

    w = tree.walk(_elements(s, d), budget)
    return w.select(F.col("tree").alias("page_id"), "node", "place", "depth", "surface", "shown")


@query
def tree_walk(s, d):
    """Elements of each page within the small budget."""
    from .operators import tree

    return _walked(s, d, tree.GLANCE)


@query
def tree_walk_narrow(s, d):
    """The same where each of the budgets binds on some page."""
    from .operators import tree

    return _walked(s, d, tree.Budget(2, 12, 3, 4))


@query
def hours_at_clock_changes(s, d):
    """Where each hour of the orders' days begins in New York: hours that the clock leaves out or shows twice have no instant."""
    days = _table(s, d, "orders").select(F.to_date("o_orderdate").alias("date")).filter("date IS NOT NULL").distinct()
    first, last = days.agg(F.min("date"), F.max("date")).first()
    ranges = timefn.clock_ranges(s, "America/New_York", str(first), str(last))
    hours = days.select("date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return timefn.hour_starts(hours, ranges).select(F.col("date").cast("string").alias("date"), "hour", "start_ms")


@query
def episodes_core(s, d):
    return _core(s, d).drop("ordinal")


@query
def episodes_by_ranges(s, d):
    """Days cut into ranges of 1024 places of the log, which are sorted apart and stitched."""
    a = activity(s, d, urls=False)
    return sessions.core(a, sessions.seq_range(a, 1024)).drop("ordinal")


@query
def episodes_by_ranges_any_order(s, d):
    """The same where times run backwards, with ranges so small that most episodes span several."""
    a = _out_of_order(s, d, urls=False)
    return sessions.core(a, sessions.seq_range(a, 16)).drop("ordinal")


def _out_of_order(s: SparkSession, d: str, urls: bool = True) -> DataFrame:
    """The log with every 50th row's time set back by 20 minutes on half of the days."""
    a = activity(s, d, urls)
    return a.withColumn("ts", F.when((F.col("seq") % 50 == 0) & (F.dayofmonth("date") % 2 == 0), F.col("ts") - F.expr("INTERVAL 20 MINUTES")).otherwise(F.col("ts")))


@query
def episodes_any_order(s, d):
    return sessions.core(_out_of_order(s, d, urls=False)).drop("ordinal")


@query
def episodes_any_order_full(s, d):
    """Titles, urls, documents and text of days whose times run backwards."""
    e = sessions.episodes(_out_of_order(s, d), spread=True)
    return e.select("stream", "date", "id", "app", "title", *[F.array_join(c, "|").alias(c) for c in ("titles", "urls", "documents", "visible_text")], "active_ms", "event_count")


@query
def episode_headline_title(s, d):
    return _ids(_episodes(s, d), "title")


@query
def episode_titles_ordered(s, d):
    return _ids(_episodes(s, d), F.array_join("titles", "|").alias("titles"))


@query
def episode_documents_capped(s, d):
    return _ids(_episodes(s, d), F.array_join("documents", "|").alias("documents"))


@query
def episode_urls_ordered(s, d):
    return _ids(_episodes(s, d), F.array_join("urls", "|").alias("urls"))


@query
def episode_visible_text(s, d):
    return _ids(_episodes(s, d), F.array_join("visible_text", "|").alias("visible_text"))


@query
def episode_descriptions(s, d):
    e = _episodes(s, d)
    return _ids(e, "start", "end", textfn.describe(F.col("app"), F.col("title"), F.col("is_private")).alias("description"))


@query
def session_gap_only(s, d):
    return sessions.gap_sessions(activity(s, d, urls=False))


@query
def app_usage_day(s, d):
    return rollup.app_usage(_core(s, d))


@query
def daily_rollup(s, d):
    return rollup.daily(_core(s, d))


@query
def hour_slices(s, d):
    return _slices(s, d).drop("start_ms", "ordinal")


@query
def hourly_rollup(s, d):
    return rollup.hourly(_slices(s, d))


@query
def hourly_app_usage(s, d):
    return rollup.hourly_app_usage(_slices(s, d))


@query
def hour_episode_ids(s, d):
    return rollup.hour_episode_ids(_slices(s, d)).withColumn("episode_ids", F.array_join("episode_ids", "|"))


@query
def hour_episode_ids_any_order(s, d):
    """Episodes of an hour in the order of the log where times run backwards."""
    return rollup.hour_episode_ids(rollup.hour_slices(sessions.core(_out_of_order(s, d, urls=False)))).withColumn("episode_ids", F.array_join("episode_ids", "|"))


@query
def leading_app_hour(s, d):
    return rollup.leading_app(rollup.hourly_app_usage(_slices(s, d)))


@query
def usage_subtotals(s, d):
    return rollup.cube_usage(_slices(s, d))


@query
def timeline_groups(s, d):
    e = _core(s, d)
    return rollup.timeline(e, rollup.hourly(rollup.hour_slices(e))).withColumn("episode_ids", F.array_join("episode_ids", "|"))


@query
def timeline_headlines(s, d):
    e = _core(s, d)
    return narrative.timeline_headline(rollup.daily(e), rollup.app_usage(e))


@query
def app_share(s, d):
    e = _core(s, d)
    return rollup.app_share(rollup.app_usage(e), rollup.daily(e))


@query
def hour_bar_width(s, d):
    return rollup.bar_width(rollup.hourly(_slices(s, d)))


@query
def tokenize_documents(s, d):
    t = _table(s, d, "documents").select("doc_id", textfn.tokenize(F.coalesce("text", F.lit(""))).alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query
def url_terms(s, d):
    return _table(s, d, "pages").select("page_id", F.array_join(textfn.tokenize_url(F.col("url")), " ").alias("terms"))


@query
def strip_query_urls(s, d):
    return _table(s, d, "pages").select("page_id", textfn.strip_query(F.col("url")).alias("url"))


@query
def normalize_urls(s, d):
    """Addresses as pages have them, without a scheme, with words after them, and of a host without a dot."""
    n, url = F.col("page_id"), F.col("url")
    raw = F.when(n % 3 == 0, textfn.without_scheme(url)).when(n % 7 == 1, F.concat(url, F.lit(" and words"))).when(n % 7 == 2, F.regexp_replace(url, "^.*?://[^/]*", "localhost")).otherwise(url)
    return _table(s, d, "pages").select("page_id", textfn.normalize_url(raw).alias("url"), textfn.document_path(F.concat(F.lit("C:\\pages\\"), F.col("page_id").cast("string"))).alias("path"), textfn.document_path(raw).alias("doc"))


@query
def document_labels(s, d):
    path = F.concat(F.lit("/srv\\files/"), F.regexp_replace(F.element_at(F.split("url", "://"), 2), "[?#].*$", ""))
    title = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("  "), _page_title(), F.lit(" ")))
    window = F.concat(F.when(F.col("page_id") % 8 == 0, _page_title()).otherwise(F.col("url")), F.lit(" - viewer"))
    return _table(s, d, "pages").select("page_id", textfn.document_label(title, path).alias("label"), textfn.document_names_window(title, F.lit(None).cast("string"), window).alias("names_window"))


@query
def postings(s, d):
    return search.postings(_episodes(s, d)).groupBy("term").agg(F.count("*").alias("episodes"), F.countDistinct("date").alias("days"), F.min("id").alias("first_id"))


@query
def index_cardinality(s, d):
    e = _episodes(s, d)
    return search.cardinalities(search.postings(e), search.indexed(e))


@query
def search_and_prefix(s, d):
    e = _episodes(s, d, spread=True)
    return search.search(search.postings(e), search.indexed(e), SEARCH, 200).select("stream", "date", "id", "app", "title", "start", "matched_terms")


@query
def search_results_redacted(s, d):
    e = _episodes(s, d, spread=True)
    return privacy.search_result(search.search(search.postings(e), search.indexed(e), "app", 200)).select("stream", "id", "app", "title", "is_private", "matched_terms")


@query
def forget_day(s, d):
    p = search.postings(_episodes(s, d))
    return search.forget_day(p, "2024-01-05").groupBy("date").agg(F.count("*").alias("n"), F.countDistinct("term").alias("terms"))


@query
def public_episodes(s, d):
    p = privacy.public_episodes(_episodes(s, d))
    return p.select("stream", "date", "id", "app", "title", *[F.array_join(c, "|").alias(c) for c in ("titles", "urls", "documents", "visible_text")], "duration_ms", "active_ms", "is_private", "description")


@query
def recent_episodes(s, d):
    return api.recent(_episodes(s, d), "2024-01-20", 50).select("stream", "date", "id", "app", "active_ms")


def _lines(s, d):
    return _table(s, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "line"))


@query
def redact_lines_scalar(s, d):
    return _lines(s, d).select("doc_id", "seq", textfn.redact_line(F.col("line")).alias("shown"))


@query
def redact_budget(s, d):
    lines = _lines(s, d).groupBy("doc_id").agg(F.collect_list(F.struct((F.col("seq") % 3).alias("surface"), "seq", "line")).alias("lines"), F.min_by("line", "seq").alias("title"))
    return lines.select("doc_id", F.array_join(textfn.redact_lines(F.col("lines"), 12, 1000, F.col("title")), "\n").alias("shown"))


@query
def human_durations(s, d):
    e = _core(s, d)
    return _ids(e, "duration_ms", timefn.human_duration(F.col("duration_ms")).alias("truncated"), timefn.rounded_duration(F.col("duration_ms")).alias("rounded"), timefn.clock(F.timestamp_millis("start_ms")).alias("clock"))


@query
def file_sizes(s, d):
    return _table(s, d, "documents").select("doc_id", timefn.file_size(F.octet_length(F.coalesce("text", F.lit("")))).alias("size"))


@query
def stale_hours(s, d):
    sl = _slices(s, d)
    p = narrative.run_plan(rollup.hourly(sl), _summaries(sl))
    return p.filter("written_ms IS NOT NULL").select("stream", "date", "hour", "active_ms", "written_ms", (F.col("action") == "write").alias("stale"))


@query
def run_plan(s, d):
    sl = _slices(s, d)
    return narrative.run_plan(rollup.hourly(sl), _summaries(sl))


@query
def run_report(s, d):
    sl = _slices(s, d)
    r = narrative.run_report(narrative.run_plan(rollup.hourly(sl), _summaries(sl)))
    return r.select("stream", "date", *[F.array_join(F.transform(c, lambda h: h.cast("string")), ",").alias(c) for c in ("hours_write", "hours_skip", "hours_quiet")])


@query
def hour_prompt(s, d):
    sl = _slices(s, d)
    return narrative.hour_prompts(privacy.public_episodes(_episodes(s, d)), rollup.hour_episode_ids(sl), rollup.hourly(sl))


@query
def day_prompt(s, d):
    e = _core(s, d)
    return narrative.day_prompts(rollup.daily(e), rollup.app_usage(e), _summaries(rollup.hour_slices(e)))


def _turns(s: SparkSession, d: str) -> DataFrame:
    """Every conversation goes to a day: four streams, days of January in turn; turns keep the order of conversations."""
    turns = narrative.pair_turns(_table(s, d, "conversations"))
    return turns.select((F.col("conv") % 4).cast("int").alias("stream"), F.date_add(F.lit("2024-01-01").cast("date"), (F.floor(F.col("conv") / 4) % 30).cast("int")).cast("string").alias("date"), (F.col("conv") * 1000 + F.col("turn")).alias("turn"), "asked", "answered")


@query
def chat_prompt(s, d):
    e = _core(s, d)
    days = rollup.daily(e)
    return narrative.chat_prompts(privacy.public_episodes(_episodes(s, d)), days, rollup.app_usage(e), _summaries(rollup.hour_slices(e)), _daily_texts(days), _turns(s, d), QUESTION)


@query
def chat_tail(s, d):
    return narrative.chat_tail(narrative.pair_turns(_table(s, d, "conversations")))


@query
def day_document(s, d):
    e = _core(s, d)
    days = rollup.daily(e)
    return narrative.day_documents(days, rollup.app_usage(e), _summaries(rollup.hour_slices(e)), _daily_texts(days))


@query
def day_view(s, d):
    """Each day with its written summaries: one row a day, the hours' texts in order."""
    e = _core(s, d)
    days = rollup.daily(e)
    v = narrative.day_views(days, _summaries(rollup.hour_slices(e)), _daily_texts(days))
    hours = F.array_join(F.transform("hourly_summaries", lambda h: F.concat(h["hour"].cast("string"), F.lit(":"), h["active_ms"].cast("string"), F.lit(":"), h["text"])), "|")
    return v.select("stream", "date", "active_ms", "idle_ms", "screen_ms", "episodes", "private_episodes", "daily_summary", hours.alias("hours"))


@query
def summary_upsert(s, d):
    sl = _slices(s, d)
    old = _summaries(sl).drop("model")
    new = rollup.hourly(sl).filter("hour % 5 = 1").select("stream", "date", "hour", "active_ms", F.lit("rewritten").alias("text"))
    return narrative.upsert_summaries(old, new)


@query
def tidy_text(s, d):
    t = F.concat(F.element_at(F.array(F.lit("Summary: "), F.lit("  "), F.lit("here IS the summary:\n")), (F.pmod("turn", F.lit(3)) + 1).cast("int")), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('"'), "text", F.lit('"'))).otherwise(F.concat("text", F.lit("\n \nend\nof it"))))
    return _table(s, d, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", textfn.tidy(t).alias("tidied"))


@query
def paragraphs(s, d):
    t = F.concat_ws("\n\n", "role", F.regexp_replace("text", r"\. ", ".\n \n"))
    return _table(s, d, "conversations").select("conv_id", "turn", F.posexplode(textfn.paragraphs(t)).alias("pos", "paragraph"))


@query
def markdown_blocks(s, d):
    """Documents as Markdown: lines get the marks of headings and bullets, or a rule or a blank line before them, by their place."""
    line = F.col("line")
    n = F.col("seq") % 7
    md = F.when(n == 0, F.concat(F.lit("## "), line)).when((n == 1) | (n == 2), F.concat(F.lit("- "), line)).when(n == 3, F.concat(F.lit("---\n"), line)).when(n == 4, F.concat(F.lit("\n"), line)).otherwise(line)
    docs = _lines(s, d).select("doc_id", "seq", md.alias("line")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("text"))
    b = narrative.markdown_blocks(docs.withColumnRenamed("doc_id", "id"))
    return b.groupBy(F.col("id").alias("doc_id"), "kind").agg(F.count("*").alias("blocks"), F.sum(F.char_length("text")).alias("chars"), F.sum("level").alias("levels"))


def _work(s: SparkSession) -> str:
    """A new folder for a stream's checkpoint: in the shared folder that the session names; a local session may have a temporary one."""
    shared = s.conf.get("spark.checkpoint.dir", None)
    if shared is None and not s.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared}/stream-{os.urandom(6).hex()}" if shared else tempfile.mkdtemp(prefix="spark-")


def _records(a: DataFrame) -> DataFrame:
    """Activity rows as event records, in the order of the log."""
    rows = a.orderBy("date", "seq").select(
        F.lit(1).alias("version"), F.col("seq").cast("string").alias("id"), timefn.format_instant(F.col("ts")).alias("timestamp"), "kind", F.struct(F.col("app").alias("name"), F.lit("C:\\app.exe").alias("path"), F.lit(1).cast("long").alias("pid")).alias("application"),
        F.col("title").alias("windowTitle"), F.col("sensitive").alias("isSensitive"), F.when(F.col("url").isNotNull(), F.struct("url", F.lit(False).alias("isPrivate"))).alias("browser"), F.struct(F.col("doc_path").alias("path")).alias("document"), F.col("visible_text").alias("visibleText"),
    )
    return rows


@query
def log_round_trip(s, d):
    """The events appended to a log in the shared folder and read back: rows, the last record, and whether the order held."""
    root = _work(s)
    jsonl.append(_records(activity(s, d)), root)
    rows = jsonl.read_days(s, root)
    from pyspark.sql import Window as W

    back = rows.withColumn("back", F.coalesce(F.lag(F.col("id").cast("long")).over(W.partitionBy("date").orderBy("seq")) > F.col("id").cast("long"), F.lit(False)))
    stats = jsonl.day_stats(back, F.count_if("back").alias("out_of_order"), F.count("windowTitle").alias("titles"), F.count("browser.url").alias("urls"))
    return stats.withColumn("date", F.col("date").cast("string"))


@query
def store_episodes(s, d):
    """The same log through the store: sessionised, rolled up and indexed; all events are one stream there."""
    from .plans.store import Store

    store = Store(s, _work(s))
    jsonl.append(_records(activity(s, d)), store.root)
    store.refresh()
    terms = store.read("postings").groupBy("date", "id").agg(F.count("*").alias("terms"))
    e = store.read("episodes").join(terms, ["date", "id"], "left")
    return e.select("date", "id", "app", "title", F.array_join("urls", "|").alias("urls"), "duration_ms", "active_ms", "event_count", "is_private", F.coalesce("terms", F.lit(0)).alias("terms"))


@query
def processed_days(s, d):
    """The store's ledger over a log in which every third day has nothing in front, and some of the other days lose their windows afterwards."""
    from .plans.store import Store

    a = activity(s, d, urls=False).filter((F.dayofmonth("date") % 3 != 0) | F.col("kind").isin("sessionLocked"))
    store = Store(s, _work(s))
    jsonl.append(_records(a), store.root, "first")
    store.refresh()
    left = a.filter((F.dayofmonth("date") % 4 != 0) | F.col("kind").isin("sessionLocked"))
    jsonl.append(_records(left), store.root, "first")
    store.refresh()
    e = store.read("episodes").groupBy("date").agg(F.sum("active_ms").alias("active_ms"))
    return store.ledger().join(e, "date", "left").select("date", "episodes", F.coalesce("active_ms", F.lit(0)).alias("active_ms"))


@query
def segment_search(s, d):
    """A search in the store's index that opens the segments of its words alone, after days came in two runs, one was forgotten and the segments were merged."""
    from .plans.store import Store

    store = Store(s, _work(s))
    a = activity(s, d)
    jsonl.append(_records(a), store.root)
    days = sorted(r[0] for r in jsonl.fingerprints(s, store.root).select("date").collect())
    store.process(days[::2])
    store.refresh()
    store.forget_day("2024-01-05")
    store.compact()
    store.vacuum()
    return store.search(SEARCH, 200).select("date", "id", "app", "title", "start", "matched_terms")


@query
def parsed_instants(s, d):
    """The events' times as RFC 3339 texts in several shapes, some of them none."""
    ts, n = F.date_trunc("millisecond", F.col("ts").cast("timestamp")), F.col("event_id") % 6
    z = timefn.format_instant(ts)
    local = timefn.format_instant(ts + F.expr("INTERVAL 150 MINUTES"))
    text = F.when(n == 0, z).when(n == 1, F.regexp_replace(local, "Z$", "+02:30")).when(n == 2, F.lower(z)).when(n == 3, F.regexp_replace(z, "T", " ")).when(n == 4, F.regexp_replace(z, "Z$", "")).otherwise(F.substring(z, 1, 10))
    return _table(s, d, "events").select("event_id", F.coalesce(F.unix_millis(timefn.parse_instant(text)).cast("string"), F.lit("none")).alias("ms"))


@query
def capture_filters(s, d):
    """Per app: rows that an edited exclusion list leaves, that are read deeply, and that aren't shell surfaces."""
    a = activity(s, d, urls=False).withColumn("app_path", F.concat(F.lit("C:\\bin\\"), F.initcap("app"), F.lit(".exe")))
    listed = capture.allow(capture.exclude(capture.exclude(capture.EXCLUDED, "App_1"), "app_2"), "APP_2")
    left = capture.without_excluded(a, excluded=listed)
    deep = capture.deep_read(True, textfn.file_stem(F.col("app_path")), F.col("title"), ("APP_0", "title 3"))
    return left.groupBy("stream", "app").agg(F.count("*").alias("n"), F.count_if(deep).alias("n_deep"), F.count_if(capture.not_shell(F.col("title"), ("Title 1", "TITLE 2"))).alias("n_shown"))


@query
def retained_days(s, d):
    return jsonl.prune(activity(s, d, urls=False), "2024-01-25", 10).groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"))


@query
def message_helpers(s, d):
    """Messages as titles, editing surfaces, tokens, headers and identifiers."""
    t = F.coalesce("text", F.lit(""))
    header = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("bearer   "), "role")).when(F.col("turn") % 3 == 1, F.concat(F.lit("Basic "), "role")).otherwise(F.lit("Bearer "))
    name = F.when(F.col("conv_id") % 2 == 0, F.concat_ws("-", "role", "turn")).otherwise(F.substring(t, 1, 9))
    shown = F.array_join(textfn.element_writing(F.regexp_replace(t, r"\. ", ".\n"), 3), "|")
    return _table(s, d, "conversations").select("conv_id", "turn", textfn.one_line(t).alias("title"), shown.alias("writing"), textfn.token_digest(t).alias("digest"), textfn.bearer(header).alias("bearer"), textfn.valid_id(name).alias("valid"))


@query
def accepted_tokens(s, d):
    """Documents presented as tokens; those of every third id are stored by their digests."""
    docs = _table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("token"))
    stored = docs.filter(F.col("doc_id") % 3 == 0).select(textfn.token_digest(F.col("token")).alias("hash"))
    return capture.accepted(docs, stored).select("doc_id")


def _streamed(s: SparkSession, d: str, change, mode: str) -> DataFrame:
    """Runs a stream over the events table to its end; the sink is a table in the shared folder."""
    from .streaming import ingest

    work = _work(s)
    path = f"{d}/events.parquet"
    rows = ingest.table_stream(s, f"{path}*", s.read.parquet(path).schema)

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{work}/out/{number:06d}")

    change(rows).writeStream.outputMode(mode).option("checkpointLocation", f"{work}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{work}/out/*")


@query
def stream_day_counts(s, d):
    from .streaming import ingest

    out = _streamed(s, d, lambda r: ingest.day_counts(r.withColumn("date", F.to_date(F.col("ts").cast("timestamp")))), "update")
    return out.groupBy(F.col("date").cast("string").alias("date")).agg(F.max("events").alias("events"))


@query
def stream_hour_counts(s, d):
    from .streaming import ingest

    # no row of the table may be dropped, however its files are ordered: the watermark lies beyond its span
    out = _streamed(s, d, lambda r: ingest.tumbling_counts(r.withColumn("ts", F.col("ts").cast("timestamp")), late="36500 days"), "update")
    return out.groupBy(F.unix_millis("start").alias("start_ms")).agg(F.max("events").alias("events"))


@query
def stream_episodes(s, d):
    """Episodes kept up to date by a stream: each batch names the days it touches, which are computed again whole."""
    from .streaming import ingest

    work = _work(s)
    path = f"{d}/events.parquet"
    rows = ingest.table_stream(s, f"{path}*", s.read.parquet(path).schema).select(F.to_date(F.col("ts").cast("timestamp")).alias("date"))
    batch_activity = activity(s, d)

    def recompute(dates: DataFrame, number: int) -> None:
        touched = batch_activity.join(F.broadcast(dates), "date", "left_semi")
        sessions.core(touched).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{work}/episodes")

    ingest.refresh_touched(rows, recompute, f"{work}/checkpoint").awaitTermination()
    e = s.read.parquet(f"{work}/episodes")
    return e.groupBy(F.col("date").cast("string").alias("date"), "stream").agg(F.count("*").alias("episodes"), F.sum("active_ms").alias("active_ms"))


def _with_state(s: SparkSession, run: Callable[[], None]) -> None:
    """Runs streams whose state needs the store that lists and timers are kept in."""
    from .streaming.open_sessions import STATE_STORE

    key = "spark.sql.streaming.stateStore.providerClass"
    was = s.conf.get(key)
    s.conf.set(key, STATE_STORE)
    try:
        run()
    finally:
        s.conf.set(key, was)


@query
def stream_dedup(s, d):
    """Repeats dropped by a stateful stream that reads the events from four files, dealt at random, one a batch."""
    from .streaming import ingest

    work = _work(s)
    rows = activity(s, d, urls=False).select("stream", "seq", "ts", "app", "title", "url")
    rows.repartition(4, F.xxhash64("seq")).write.parquet(f"{work}/in")
    # a row long after the others lets the watermark pass them
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts")).select(F.lit(-1).alias("stream"), F.lit(0).cast("long").alias("seq"), "ts", *[F.lit(None).cast("string").alias(c) for c in ("app", "title", "url")])

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{work}/out/batch={number:08d}")

    def run() -> None:
        feed = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in")
        start = lambda: ingest.repeats_by_range(feed, "366 days").writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        start()
        end.write.mode("append").parquet(f"{work}/in")
        start()

    _with_state(s, run)
    out = ingest.stitched(s.read.parquet(f"{work}/out").drop("batch"))
    return out.filter("stream >= 0").groupBy("stream").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query
def stream_open_sessions(s, d):
    """Episodes from a stream that holds only what is open: the events come in six batches, and a last one moves the clock past the last day."""
    from .streaming import open_sessions

    work = _work(s)
    rows = activity(s, d, urls=False)
    first, last = rows.agg(F.min("seq"), F.max("seq")).first()
    step = ((last or 0) - (first or 0)) // 6 + 1
    clock = rows.limit(1).select(*[(F.to_timestamp(F.lit("2100-01-01")) if c == "ts" else F.lit("collectorStarted") if c == "kind" else F.col(c)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    again: list[int] = []
    for k in range(7):
        part = clock if k == 6 else rows.filter(F.floor((F.col("seq") - (first or 0)) / step) == k)
        part.coalesce(2).write.mode("append").parquet(f"{work}/in")
        feed = s.readStream.schema(rows.schema).parquet(f"{work}/in")
        open_sessions.keep_sessions(feed, f"{work}/out", f"{work}/checkpoint", lambda days, number: again.append(number)).awaitTermination()
    return open_sessions.read_sessions(s, f"{work}/out")


@query
def stream_ingest_log(s, d):
    """Events that arrive as JSON Lines files, streamed into the log by their days, two files a batch, and read back."""
    from .streaming import ingest

    root = _work(s)
    _records(activity(s, d, urls=False)).repartition(6, "id").write.option("ignoreNullFields", "true").json(f"{root}/incoming")
    ingest.append_by_day(ingest.read_stream(s, f"{root}/incoming", 2), root, f"{root}/checkpoint").awaitTermination()
    rows = jsonl.read_days(s, root).groupBy("date").agg(F.count("*").alias("events"), F.count("windowTitle").alias("titles"), F.max("timestamp").alias("latest"), F.countDistinct("seq.batch").alias("batches"))
    days = jsonl.recorded_days(s, root).join(rows, "date", "left").join(jsonl.bad_lines(s, root), "date", "left")
    return days.select(F.col("date").cast("string").alias("date"), "events", "titles", "latest", (F.col("batches") <= 3).alias("few_batches"), "bad")


@query
def store_summaries(s, d):
    """Hour summaries written, some written again, some taken back, and a day forgotten."""
    from .plans.store import Store

    store = Store(s, _work(s))
    h = _summaries(_slices(s, d)).select("stream", "date", "hour", "text", "active_ms", F.lit("t1").alias("generated_at"), F.lit("p").alias("provider"), "model")
    store.save_hours(h)
    store.save_hours(h.filter("hour % 5 = 1").withColumns({"text": F.lit("again"), "generated_at": F.lit("t2")}))
    store.save_hours(h.filter("hour % 7 = 2").withColumn("text", F.lit(None).cast("string")))
    store.forget_summary("2024-01-05")
    return store.hours()


@query
def library_documents(s, d):
    """Day texts saved as documents, those of a day under its next free name, and read back with their labels."""
    from .sources import library

    root = _work(s)
    daily = _daily_texts(rollup.daily(_core(s, d)))
    docs = daily.select("date", F.concat(F.lit("Stream   "), "stream").alias("title"), F.concat("date", F.lit("T0"), 9 - F.col("stream"), F.lit(":30:00.000Z")).alias("saved_at"), F.concat(F.lit("# Day\n\n"), "daily").alias("body"))
    first = docs.filter("title LIKE '%0'")
    library.save(library.new_ids(first, s.createDataFrame([], "id string")), root)
    library.save(library.new_ids(docs.filter("title NOT LIKE '%0'"), library.entries(s, root).select("id")), root)
    return library.entries(s, root).select("id", "title", "date", "saved_at", "body", library.saved_label(F.col("saved_at")).alias("label"))


@query
def api_tools(s, d):
    """What the tools of the read API give over the store: recent episodes and hits (both at most 200, whatever is asked), and today's episodes."""
    from .plans.store import Store

    store = Store(s, _work(s))
    jsonl.append(_records(activity(s, d)), store.root)
    store.refresh()
    a = api.Api(store, "2024-01-20", allow_history=False)
    of = lambda tool, df: df.select(F.lit(tool).alias("tool"), "date", "id", "app", "title", "is_private")
    rows = of("get_recent", a.run_tool("get_recent", {"count": 1000})).union(of("search_history", a.run_tool("search_history", {"query": "App, TITLE", "limit": 999}))).union(of("get_today", a.run_tool("get_today", {})["episodes"]))
    status = a.status().select(F.lit("status").alias("tool"), F.lit(a.today).alias("date"), "last_event_at", F.concat_ws(" ", "days", "stale").alias("app"), F.col("recorded_today").cast("string").alias("title"), F.lit(False).alias("is_private"))
    return rows.union(status)
