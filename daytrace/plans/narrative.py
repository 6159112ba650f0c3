"""Text from a day: prompts for hours, days and questions, the day document, and the plan of a summary run.

Every function returns rows with finished text, built by string functions over ordered lists;
`instructions` (what the model is told to write) is the caller's.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.textfn import trimmed
from ..functions.timefn import clock, hour_label, human_duration, long_day
from ..schema import WORTH_MS

HOUR_EPISODES, CHAT_EPISODES, CHAT_TURNS, DAY_APPS, CHAT_APPS = 25, 120, 8, 5, 8
HOUR_TOKENS, DAY_TOKENS, CHAT_TOKENS = 300, 1_200, 800
ASK_HOUR = "Describe in two or three sentences what these entries show was worked on."
ASK_DAY = "Write four paragraphs about the day: its subjects, where attention held and broke, its course, and a conclusion."
ASK_CHAT = "Answer from the log above alone; where it says nothing, say that."

# The wording of prompts, lines and documents.
HOUR_HEAD = "Activity for %s between %02d:00 and %02d:59, %s of it active.\n\n"
DAY_HEAD = "Hour-by-hour summaries for %s, %s active in total across %d sessions.\n\n"
CHAT_HEAD = "Activity for %s, %s active in total across %d sessions.\n\n"
OMITTED = "\n(%d further short entries omitted.)\n"
UNLISTED = "\n(%d further entries are not listed.)\n"
BRIEF = "\n(%d briefer switches, each under a minute, are counted in the total above but are not listed: they were not worked in.)\n"
PRIVATE_LINE = " — private session, nothing recorded\n"
PRIVATE_TIME = "%d private sessions were recorded as time only."
WRITTEN, BY_HOUR, FRONT, EARLIER = "The summary already written for this day:\n", "Hour by hour:\n", "What was in front, in the order it happened:\n", "Earlier in this conversation:\n"
NOTHING_LONG = "Nothing was in front for longer than a minute on this day.\n\n"
TURN = "They asked: %s\nYou answered: %s\n"
NO_SUMMARY, NO_RECORD = "No whole-day summary was written.\n\n", "Nothing was recorded on this day.\n\n"
SPENT = "%s at the machine, %s of it working.\n\n"

KEYS = ("stream", "date")


def _joined(values: Column, by: str) -> Column:
    return F.array_join(values, by)


def _details(public: dict[str, Column]) -> Column:
    part = lambda label, values, by: F.when(F.size(values) > 0, F.concat(F.lit(f"    {label}: "), F.array_join(values, by), F.lit("\n"))).otherwise("")
    return F.concat(part("visited", public["urls"], ", "), part("document", public["documents"], ", "), part("on screen", public["visible_text"], " · "))


def episode_line(when: Column, e: dict[str, Column]) -> Column:
    head = F.concat(F.lit("- "), when, F.lit(" "), e["app"])
    named = F.when(e["title"].isNotNull(), F.concat(head, F.lit(": "), e["title"], F.lit("\n"))).otherwise(F.concat(head, F.lit("\n")))
    return F.when(e["is_private"], F.concat(head, F.lit(PRIVATE_LINE))).otherwise(F.concat(named, _details(e)))


def _cols(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


SHOWN = ("app", "title", "urls", "documents", "visible_text", "is_private")


def line_in_hour() -> Column:
    """Says of an episode that it began before or runs past the hour of its row."""
    start, end = F.to_timestamp("start"), F.to_timestamp("end")
    spent = human_duration(F.col("active_ms"))
    at = clock(start)
    when = (
        F.when(~F.hour(start).eqNullSafe(F.col("hour")), F.concat(at, F.lit(", began before this hour ("), spent, F.lit(" in all)")))
        .when(~F.hour(end).eqNullSafe(F.col("hour")), F.concat(at, F.lit(", runs past this hour ("), spent, F.lit(" in all)")))
        .otherwise(F.concat(at, F.lit(" ("), spent, F.lit(")")))
    )
    return episode_line(when, _cols(*SHOWN))


def line_in_day() -> Column:
    return episode_line(F.concat(clock(F.to_timestamp("start")), F.lit(" ("), human_duration(F.col("active_ms")), F.lit(")")), _cols(*SHOWN))


def _brief(n: Column) -> Column:
    return F.when(n > 0, F.format_string(BRIEF, n)).otherwise("")


def hour_prompts(public: DataFrame, hour_ids: DataFrame, hours: DataFrame, instructions: str = ASK_HOUR) -> DataFrame:
    """(stream, date, hour, user, max_tokens) for hours of a minute or more. hour_ids: (stream, date, hour, episode_ids).

    Episodes are told in the order of their starts, whatever the order of the ids; of episodes that share an id one is told.
    """
    ids = hour_ids.select(*KEYS, "hour", F.explode("episode_ids").alias("id"))
    e = public.dropDuplicates([*KEYS, "id"]).join(ids, [*KEYS, "id"])
    worth = F.col("active_ms") >= WORTH_MS
    group = W.partitionBy(*KEYS, "hour")
    any_worth = F.max(worth).over(group)
    e = e.withColumn("named", worth | ~any_worth)
    e = e.withColumn("rank", F.sum(F.col("named").cast("int")).over(group.orderBy("start", "id").rowsBetween(W.unboundedPreceding, 0)))
    listed = F.col("named") & (F.col("rank") <= HOUR_EPISODES)
    # only the lines that are told go on to be gathered
    e = e.select(*KEYS, "hour", "named", F.when(listed, F.struct("rank", line_in_hour().alias("line"))).alias("told"))
    g = e.groupBy(*KEYS, "hour").agg(F.array_sort(F.collect_list("told")).alias("lines"), F.count_if("named").alias("n_named"), F.count_if(~F.col("named")).alias("n_brief"))
    h = g.join(hours.select(*KEYS, "hour", F.col("active_ms").alias("hour_ms")), [*KEYS, "hour"]).filter(F.col("hour_ms") >= WORTH_MS)
    head = F.format_string(HOUR_HEAD, long_day(F.col("date").cast("date")), "hour", "hour", human_duration(F.col("hour_ms")))
    over = F.when(F.col("n_named") > HOUR_EPISODES, F.format_string(OMITTED, F.col("n_named") - HOUR_EPISODES)).otherwise("")
    user = F.concat(head, _joined(F.transform("lines", lambda x: x["line"]), ""), over, _brief(F.col("n_brief")), F.lit("\n" + instructions))
    return h.select(*KEYS, "hour", user.alias("user"), F.lit(HOUR_TOKENS).alias("max_tokens"))


def _hour_lines(summaries: DataFrame) -> DataFrame:
    line = F.format_string("%s (%s) — %s\n", hour_label(F.col("hour")), human_duration(F.col("active_ms")), trimmed(F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("hour", line.alias("line"))))
    return summaries.groupBy(*KEYS).agg(_joined(F.transform(rows, lambda x: x["line"]), "").alias("hour_lines"), F.count("*").alias("n_hours"))


def leaders(usage: DataFrame, most: int) -> DataFrame:
    """(stream, date, leaders): the first apps with their times, in order of rank."""
    one = F.format_string("%s (%s)", "app", human_duration(F.col("active_ms")))
    rows = F.array_sort(F.collect_list(F.struct("rank", one.alias("x"))))
    return usage.filter(F.col("rank") <= most).groupBy(*KEYS).agg(_joined(F.transform(rows, lambda r: r["x"]), ", ").alias("leaders"))


def _apps(by: str) -> Column:
    return F.when(F.col("leaders").isNotNull(), F.concat(F.lit(f"{by}Time by application: "), F.col("leaders"), F.lit(".\n"))).otherwise("")


def _private(end: str) -> Column:
    return F.when(F.col("private_episodes") > 0, F.format_string(PRIVATE_TIME + end, F.col("private_episodes"))).otherwise("")


def day_prompts(days: DataFrame, usage: DataFrame, summaries: DataFrame, instructions: str = ASK_DAY) -> DataFrame:
    """(stream, date, user, max_tokens) for days with a summarised hour. summaries: (stream, date, hour, active_ms, text)."""
    j = days.join(_hour_lines(summaries), list(KEYS)).join(leaders(usage, DAY_APPS), list(KEYS), "left")
    head = F.format_string(DAY_HEAD, long_day(F.col("date").cast("date")), human_duration(F.col("active_ms")), F.col("episodes"))
    return j.select(*KEYS, F.concat(head, F.col("hour_lines"), _apps("\n"), _private("\n"), F.lit("\n" + instructions)).alias("user"), F.lit(DAY_TOKENS).alias("max_tokens"))


def chat_tail(turns: DataFrame, most: int = CHAT_TURNS) -> DataFrame:
    """The last turns of each conversation: (conv, turn, asked, answered)."""
    last = F.row_number().over(W.partitionBy("conv").orderBy(F.desc("turn")))
    return turns.withColumn("__n", last).filter(F.col("__n") <= most).drop("__n")


def pair_turns(messages: DataFrame) -> DataFrame:
    """Of (conv_id, turn, role, text), each user's turn with the assistant's turn that follows it directly."""
    order = W.partitionBy("conv_id").orderBy("turn")
    m = messages.withColumn("next_role", F.lead("role").over(order)).withColumn("answered", F.lead("text").over(order))
    return m.filter("role = 'user' AND next_role = 'assistant'").select(F.col("conv_id").alias("conv"), "turn", F.col("text").alias("asked"), "answered")


def chat_prompts(public: DataFrame, days: DataFrame, usage: DataFrame, summaries: DataFrame, daily: DataFrame, turns: DataFrame, question: str, instructions: str = ASK_CHAT) -> DataFrame:
    """(stream, date, user, max_tokens): one question asked of every day given.

    daily: (stream, date, daily); turns: (stream, date, turn, asked, answered), of which the last eight are carried.
    """
    order = W.partitionBy(*KEYS).orderBy("start", "id", "app")
    named = public.filter(F.col("active_ms") >= WORTH_MS).withColumn("rank", F.row_number().over(order))
    told = named.select(*KEYS, F.when(F.col("rank") <= CHAT_EPISODES, F.struct("rank", line_in_day().alias("line"))).alias("told"))
    lines = told.groupBy(*KEYS).agg(F.array_sort(F.collect_list("told")).alias("lines"), F.count("*").alias("n_named"))
    turn = F.format_string(TURN, trimmed(F.col("asked")), trimmed(F.col("answered")))
    carried = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("turn"))) <= CHAT_TURNS
    said = turns.withColumn("__in", carried).filter("__in").groupBy(*KEYS).agg(_joined(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("x")))), lambda r: r["x"]), "").alias("said"))
    j = days
    for other in (lines, _hour_lines(summaries), leaders(usage, CHAT_APPS), daily.select(*KEYS, "daily"), said):
        j = j.join(other, list(KEYS), "left")
    n_named = F.coalesce("n_named", F.lit(0))
    head = F.format_string(CHAT_HEAD, long_day(F.col("date").cast("date")), human_duration(F.col("active_ms")), F.col("episodes"))
    written = F.when(F.col("daily").isNotNull(), F.concat(F.lit(WRITTEN), trimmed(F.col("daily")), F.lit("\n\n"))).otherwise("")
    by_hour = F.when(F.col("hour_lines").isNotNull(), F.concat(F.lit(BY_HOUR), F.col("hour_lines"), F.lit("\n"))).otherwise("")
    over = F.when(n_named > CHAT_EPISODES, F.format_string(UNLISTED, n_named - CHAT_EPISODES)).otherwise("")
    front = F.when(n_named == 0, F.lit(NOTHING_LONG)).otherwise(
        F.concat(F.lit(FRONT), _joined(F.transform("lines", lambda x: x["line"]), ""), over, _brief(F.col("episodes") - n_named), F.lit("\n"))
    )
    apps = F.when(F.col("leaders").isNotNull(), F.concat(F.lit("Time by application: "), F.col("leaders"), F.lit(".\n\n"))).otherwise("")
    earlier = F.when(F.col("said").isNotNull(), F.concat(F.lit(EARLIER), F.col("said"), F.lit("\n"))).otherwise("")
    user = F.concat(head, written, by_hour, front, apps, _private("\n\n"), earlier, F.lit(f"Their question: {question.strip()}\n\n{instructions}"))
    return j.select(*KEYS, user.alias("user"), F.lit(CHAT_TOKENS).alias("max_tokens"))


def day_documents(days: DataFrame, usage: DataFrame, summaries: DataFrame, daily: DataFrame) -> DataFrame:
    """(stream, date, title, body): the day in Markdown. summaries also hold model."""
    one = F.format_string("- %s — %s\n", "app", human_duration(F.col("active_ms")))
    apps = usage.groupBy(*KEYS).agg(_joined(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("x")))), lambda r: r["x"]), "").alias("apps"))
    hour = F.format_string("### %s — %s\n\n%s\n\n", hour_label(F.col("hour")), human_duration(F.col("active_ms")), trimmed(F.col("text")))
    hours = summaries.groupBy(*KEYS).agg(_joined(F.transform(F.array_sort(F.collect_list(F.struct("hour", hour.alias("x")))), lambda r: r["x"]), "").alias("hours"), F.min_by("model", "hour").alias("model"))
    j = days.join(apps, list(KEYS), "left").join(hours, list(KEYS), "left").join(daily.select(*KEYS, "daily"), list(KEYS), "left")
    title = long_day(F.col("date").cast("date"))
    text = F.coalesce(F.concat(trimmed(F.col("daily")), F.lit("\n\n")), F.lit(NO_SUMMARY))
    spent = F.format_string(SPENT, human_duration(F.col("screen_ms")), human_duration(F.col("active_ms")))
    idle = F.when(F.col("idle_ms") > 0, F.format_string("- Idle — %s\n", human_duration(F.col("idle_ms")))).otherwise("")
    time_ = F.when(F.col("screen_ms") == 0, F.lit(NO_RECORD)).otherwise(F.concat(spent, F.coalesce("apps", F.lit("")), idle, F.lit("\n")))
    by_hour = F.coalesce(F.concat(F.lit("## Hours\n\n"), F.col("hours")), F.lit(""))
    model = F.coalesce("model", F.when(F.col("daily").isNotNull(), F.lit("an unnamed model")))
    foot = F.coalesce(F.concat(F.lit("---\n\nSummaries written by "), model, F.lit(".\n")), F.lit(""))
    return j.select(*KEYS, title.alias("title"), F.concat(F.lit("# "), title, F.lit("\n\n"), text, F.lit("## Where the time went\n\n"), time_, by_hour, foot).alias("body"))


def timeline_headline(days: DataFrame, usage: DataFrame) -> DataFrame:
    """`2h active · 9 episodes · mostly A · 1 private session`: the leader if there are several apps, private sessions if any."""
    lead = usage.groupBy(*KEYS).agg(F.count("*").alias("n_apps"), F.min_by("app", "rank").alias("leader"))
    j = days.join(lead, list(KEYS), "left")
    plural = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    parts = F.array(
        F.concat(human_duration(F.col("active_ms")), F.lit(" active")), plural(F.col("episodes"), "episode"), F.when(F.col("n_apps") > 1, F.concat(F.lit("mostly "), F.col("leader"))),
        F.when(F.col("private_episodes") > 0, plural(F.col("private_episodes"), "private session")),
    )
    return j.select(*KEYS, F.array_join(F.array_compact(parts), " · ").alias("headline"))


def run_plan(hours: DataFrame, written: DataFrame) -> DataFrame:
    """(stream, date, hour, action): skip if the written summary covers the hour within a minute, however short the hour; quiet under a minute; else write."""
    j = hours.select(*KEYS, "hour", "active_ms").join(written.select(*KEYS, "hour", F.col("active_ms").alias("written_ms")), [*KEYS, "hour"], "left")
    action = F.when(F.col("written_ms").isNotNull() & (F.col("active_ms") - F.col("written_ms") < WORTH_MS), "skip").when(F.col("active_ms") < WORTH_MS, "quiet").otherwise("write")
    return j.select(*KEYS, "hour", "active_ms", "written_ms", action.alias("action"))


def day_views(days: DataFrame, summaries: DataFrame, daily: DataFrame) -> DataFrame:
    """days with daily_summary (null if none is written) and hourly_summaries, structs in order of the hour. daily: (stream, date, daily)."""
    columns = ["hour", *[c for c in ("text", "active_ms", "generated_at", "provider", "model") if c in summaries.columns]]
    hours = summaries.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("hourly_summaries"))
    j = days.join(daily.select(*KEYS, trimmed(F.col("daily")).alias("daily_summary")), list(KEYS), "left").join(hours, list(KEYS), "left")
    none = F.filter("hourly_summaries", lambda h: F.lit(False))
    return j.withColumn("hourly_summaries", F.coalesce("hourly_summaries", none, F.array().cast(hours.schema["hourly_summaries"].dataType)))


def run_report(plan: DataFrame) -> DataFrame:
    """Per day: the hours of each action, in order."""
    of = lambda a: F.array_sort(F.collect_list(F.when(F.col("action") == a, F.col("hour")))).alias(f"hours_{a}")
    return plan.groupBy(*KEYS).agg(of("write"), of("skip"), of("quiet"))


def upsert_summaries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new replace those of old with the same (stream, date, hour)."""
    return old.join(new.select(*KEYS, "hour"), [*KEYS, "hour"], "left_anti").unionByName(new, allowMissingColumns=True)


class Transient(Exception):
    """An error worth another attempt: transport, timeout, status 429 or 500 and above."""


def transient_status(status: int | None) -> bool:
    return status is None or status == 429 or status >= 500


def with_retries(call: Callable[[], str], waits: Iterable[float] = (2.0, 4.0), sleep: Callable[[float], None] = time.sleep) -> str:
    for wait in waits:
        try:
            return call()
        except Transient:
            sleep(wait)
    return call()


def summarise(prompts: DataFrame, complete: Callable[[str, int], str], provider: str, model: str, now: str) -> DataFrame:
    """(stream, date, hour, text, provider, model, generated_at) by asking `complete(user, max_tokens)` for each prompt, in the tasks."""
    from ..functions.textfn import tidy

    def ask(batches):
        for pdf in batches:
            pdf["text"] = [with_retries(lambda u=u, n=n: complete(u, int(n))) for u, n in zip(pdf["user"], pdf["max_tokens"], strict=True)]
            yield pdf[["stream", "date", "hour", "text"]]

    said = prompts.mapInPandas(ask, "stream int, date string, hour int, text string")
    return said.select("stream", "date", "hour", tidy(F.col("text")).alias("text"), F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(now).alias("generated_at"))


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """(id, pos, kind, level, text) of (id, text): headings (1 to 3), bullets, rules and paragraphs, by runs of lines of the same kind."""
    lines = docs.select("id", F.posexplode(F.split("text", r"\r?\n")).alias("n", "raw")).withColumn("line", trimmed(F.col("raw")))
    line = F.col("line")
    heading, bullet = r"^(#{1,6})\s+(.*)$", r"^[-*]\s+(.*)$"
    kind = F.when(line == "", "blank").when(line.rlike(r"^-{3,}$"), "rule").when(line.rlike(heading), "heading").when(line.rlike(bullet), "list").otherwise("paragraph")
    text = F.when(kind == "heading", trimmed(F.regexp_extract(line, heading, 2))).when(kind == "list", trimmed(F.regexp_extract(line, bullet, 1))).when(kind == "paragraph", line).otherwise("")
    level = F.when(kind == "heading", F.least(F.char_length(F.regexp_extract(line, heading, 1)), F.lit(3))).otherwise(0)
    rows = lines.select("id", "n", kind.alias("kind"), text.alias("text"), level.alias("level"))
    order = W.partitionBy("id").orderBy("n")
    single = F.col("kind").isin("heading", "rule", "blank")
    rows = rows.withColumn("new", (single | ~F.lag("kind").over(order).eqNullSafe(F.col("kind"))).cast("int")).withColumn("block", F.sum("new").over(order))
    items = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda r: r["text"])
    blocks = rows.filter("kind <> 'blank'").groupBy("id", "block", "kind", "level").agg(items.alias("items"), F.min("n").alias("n"))
    pos = F.row_number().over(W.partitionBy("id").orderBy("n")) - 1
    return blocks.select("id", pos.alias("pos"), "kind", "level", F.when(F.col("kind") == "list", F.array_join("items", "|")).otherwise(F.array_join("items", " ")).alias("text"))
