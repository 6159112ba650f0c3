"""What happens to raw observations before they are recorded: exclusion, repeats, privacy, masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.textfn import file_stem, title_is_private, token_digest
from ..schema import EMITTED_KINDS, KINDS
from ..shared import checkpointed

# Programs that are never recorded, and window classes of shell surfaces.
EXCLUDED = ("1password", "bitwarden", "keepass", "keepassxc", "lastpass", "dashlane", "enpass", "nordpass", "protonpass", "credentialuibroker", "consent", "lsass")
SHELL_CLASSES = ("TaskSwitcherWnd", "TaskSwitcherOverlayWnd", "MultitaskingViewFrame", "XamlExplorerHostIslandWindow", "Windows.UI.Core.CoreWindow", "Shell_TrayWnd", "Shell_SecondaryTrayWnd", "ForegroundStaging", "WorkerW", "Progman")


def known_kind(kind: Column) -> Column:
    return kind.isin(*KINDS)


def emitted_kind(kind: Column) -> Column:
    return kind.isin(*EMITTED_KINDS)


def allow(excluded: tuple[str, ...], stem: str) -> tuple[str, ...]:
    return tuple(x for x in excluded if x.lower() != stem.lower())


def exclude(excluded: tuple[str, ...], stem: str) -> tuple[str, ...]:
    return excluded if stem.lower() in (x.lower() for x in excluded) else (*excluded, stem.lower())


def without_excluded(rows: DataFrame, path: str = "app_path", excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Rows of programs that aren't excluded (by the stem of their file, whatever the case)."""
    return rows.filter(~F.coalesce(F.lower(file_stem(F.col(path))).isin(*[x.lower() for x in excluded]), F.lit(False)))


def without_excluded_apps(rows: DataFrame, apps: DataFrame) -> DataFrame:
    """The same with the exclusion list as a table (app): a left anti join."""
    return rows.join(apps.select(F.lower("app").alias("__x")).distinct(), F.lower(F.col("app")) == F.col("__x"), "left_anti")


def deep_read(enabled: bool, stem: Column, name: Column, listed: tuple[str, ...]) -> Column:
    low = [x.lower() for x in listed]
    return F.lit(enabled) & (F.coalesce(F.lower(stem).isin(*low), F.lit(False)) | F.coalesce(F.lower(name).isin(*low), F.lit(False)))


def not_shell(window_class: Column, surfaces: tuple[str, ...] = SHELL_CLASSES) -> Column:
    """Whether a window is none of the shell's own, by its class; a window whose class can't be read is none."""
    return ~F.coalesce(F.lower(window_class).isin(*[s.lower() for s in surfaces]), F.lit(False))


#: Rows of a stream that are put in order together.
RANGE = 1 << 16


def _range(range_: Column | None) -> Column:
    return F.floor(F.col("seq") / RANGE) if range_ is None else range_


def without_repeats(rows: DataFrame, *what: str, range_: Column | None = None) -> DataFrame:
    """Without rows that are equal to the one before in their stream.

    A stream is cut into ranges of seq (range_: a column that never falls as seq rises; by default RANGE
    numbers), which are sorted apart. A range's first row meets the last row of the range before it:
    one row for each range is all that a stream has in order.
    """
    marked = _changes(rows.withColumn("__range", _range(range_)), F.struct(*what))
    return marked.filter("__new").drop("__range", "__new")


def _changes(rows: DataFrame, what: Column) -> DataFrame:
    """rows with __new: whether what differs from that of the row before in the stream."""
    cut = ["stream", "__range"]
    order = W.partitionBy(*cut).orderBy("seq")
    rows = rows.withColumn("__what", what)
    last = rows.groupBy(*cut).agg(F.max_by("__what", "seq").alias("__last"))
    before = last.select(*cut, F.lag("__last").over(W.partitionBy("stream").orderBy("__range")).alias("__before"))
    rows = rows.withColumn("__first", F.lag("seq").over(order).isNull()).withColumn("__was", F.lag("__what").over(order)).join(before, cut, "left")
    was = F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__was"))
    return rows.withColumn("__new", ~was.eqNullSafe(F.col("__what"))).drop("__what", "__first", "__was", "__before")


def _so_far(rows: DataFrame, keys: list[str], value: Column, name: str, own: bool) -> DataFrame:
    """rows with the largest value of the rows before in order of seq (own: the row itself included) that have the same keys; ranges are sorted apart and stitched."""
    cut = [*keys, "__range"]
    order = W.partitionBy(*cut).orderBy("seq").rowsBetween(W.unboundedPreceding, 0 if own else -1)
    rows = rows.withColumn("__value", value)
    most = rows.groupBy(*cut).agg(F.max("__value").alias("__most"))
    came = most.select(*cut, F.max("__most").over(W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)).alias("__came"))
    rows = rows.withColumn("__here", F.max("__value").over(order)).join(came, cut, "left")
    larger = F.when(F.col("__here").isNull() | (F.col("__came") > F.col("__here")), F.col("__came")).otherwise(F.col("__here"))
    return rows.withColumn(name, larger).drop("__value", "__here", "__came")


def throttled(rows: DataFrame, window: str, lines: str, every_ms: int = 30_000, range_: Column | None = None) -> DataFrame:
    """The reads that happen: a window isn't read again within `every_ms` of the last read of more than one line, if that was of this window.

    window and lines name columns; rows are (stream, seq, ts, ...). The reads that start the clock are found without going
    through the rows one by one:

    * the first read of each run of one window starts it, so runs are independent;
    * within a run only a read later than all before it can be the next one, and what follows a gap of `every_ms` always is;
    * each of these knows the next read that would start the clock if it did itself: it lies in the next or the
      next but one stretch of `every_ms`. From the starts, pointers are followed by doubling.

    Every row then compares with the last start before it. Ranges of seq (range_, see without_repeats) are sorted apart.
    A row without a time is read if the window is another one, and starts no clock.
    """
    keys = ["stream", "__run"]
    r = rows.withColumn("__range", _range(range_)).select("stream", "seq", "__range", F.col(window).cast("string").alias("window"), F.unix_millis("ts").alias("ms"), (F.col(lines) > 1).alias("many"))
    s = _changes(r.filter(F.col("many") & F.col("ms").isNotNull()), F.struct("window"))
    s = _so_far(s, ["stream"], F.when(F.col("__new"), F.col("seq")), "__run", own=True)
    s = _so_far(s, keys, F.col("ms"), "latest", own=False).filter(F.col("latest").isNull() | (F.col("ms") > F.col("latest")))
    s = checkpointed(s.select(*keys, "seq", "ms", F.floor(F.col("ms") / every_ms).alias("at")))
    ends = s.groupBy(*keys, "at").agg(F.min("ms").alias("first"), F.max("ms").alias("last"))
    to = lambda by, c: ends.select(*keys, (F.col("at") - by).alias("at"), F.col(c).alias(f"{c}{abs(by)}"))
    own = W.partitionBy(*keys, "at").orderBy("ms")
    s = s.withColumn("before", F.lag("ms").over(own)).join(to(-1, "last"), [*keys, "at"], "left").join(to(2, "first"), [*keys, "at"], "left")
    starts = s.filter(~F.coalesce(F.col("ms") - F.coalesce("before", "last1") < every_ms, F.lit(False))).select(*keys, "ms")
    # the first time in the next stretch that is due, by a row of its own among the times of that stretch
    asks = s.select(*keys, (F.col("at") + 1).alias("at"), (F.col("ms") + every_ms).alias("t"), F.col("ms").alias("asks"), "first2")
    times = s.select(*keys, "at", F.col("ms").alias("t"), F.lit(None).cast("long").alias("asks"), F.lit(None).cast("long").alias("first2"))
    later = W.partitionBy(*keys, "at").orderBy(F.desc("t"), F.col("asks").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    found = asks.union(times).withColumn("next", F.min(F.when(F.col("asks").isNull(), F.col("t"))).over(later)).filter("asks IS NOT NULL")
    jump = checkpointed(found.select(*keys, F.col("asks").alias("ms"), F.coalesce("next", "first2").alias("next")).filter("next IS NOT NULL"))
    starts = checkpointed(starts)
    while not jump.isEmpty():
        starts = checkpointed(starts.union(starts.join(jump, [*keys, "ms"]).select(*keys, F.col("next").alias("ms"))).distinct())
        jump = checkpointed(jump.join(jump.select(*keys, F.col("ms").alias("next"), F.col("next").alias("then")), [*keys, "next"]).select(*keys, "ms", F.col("then").alias("next")))
    clock = s.join(starts, [*keys, "ms"], "left_semi").select("stream", "seq", F.lit(True).alias("starts"))
    r = r.join(clock, ["stream", "seq"], "left")
    r = _so_far(r, ["stream"], F.when(F.col("starts"), F.struct("seq", "ms", "window")), "since", own=False)
    held = F.col("since.window").eqNullSafe(F.col("window")) & ~F.coalesce(F.col("ms") - F.col("since.ms") >= every_ms, F.lit(False))
    kept = r.filter(F.col("since").isNull() | ~held).select("stream", "seq")
    return rows.join(kept, ["stream", "seq"], "left_semi")


def privacy(browser: Column, title: Column, names: Column) -> Column:
    """recordable, private or undetermined. names: what the window's elements are called, null if they can't be read."""
    marked = title_is_private(browser, title) | F.coalesce(F.exists(names, lambda n: title_is_private(browser, n)), F.lit(False))
    return F.when(browser.isNull(), "recordable").when(marked, "private").when(names.isNull(), "undetermined").otherwise("recordable")


def masked(rows: DataFrame) -> DataFrame:
    """By the column privacy: a private window becomes a boundary without title, url, document and text; an undetermined one keeps its app alone."""
    private, open_ = F.col("privacy") == "private", (F.col("privacy") == "recordable") & ~F.coalesce("sensitive", F.lit(False))
    hide = {c: F.when(open_, F.col(c)).alias(c) for c in ("title", "url", "doc_path", "doc_title", "visible_text") if c in rows.columns}
    return rows.select(*[F.when(private, "privacyBoundary").otherwise(F.col("kind")).alias("kind") if c == "kind" else hide.get(c, F.col(c)) for c in rows.columns])


# Control kinds of windows by their roles. Furniture passes to what these containers hold.
FURNITURE_SUBTREES = ("toolbar", "menubar", "menu", "titlebar", "statusbar")
FURNITURE_CONTROLS = (
    "button", "splitbutton", "menuitem", "checkbox", "radiobutton", "combobox", "scrollbar", "slider", "spinner", "thumb", "progressbar", "tooltip", "separator", "header", "headeritem", "image", "window", "pane",
)
WRITING_CONTROLS = ("text", "document", "edit")
WRITING, CONTENT, FURNITURE = 0, 1, 2


def surface(kind: Column, containers: Column) -> Column:
    """0 writing, 1 content, 2 furniture, by a control's kind and the kinds of those around it (an array, perhaps null)."""
    held = F.coalesce(F.exists(containers, lambda c: F.lower(c).isin(*FURNITURE_SUBTREES)), F.lit(False))
    low = F.lower(kind)
    return F.when(held | low.isin(*FURNITURE_SUBTREES, *FURNITURE_CONTROLS), FURNITURE).when(low.isin(*WRITING_CONTROLS), WRITING).otherwise(CONTENT)


def accepted(presented: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of presented (token, ...) whose digest is among those stored (hash)."""
    return presented.withColumn("__hash", token_digest(F.col("token"))).join(stored.select(F.col("hash").alias("__hash")).distinct(), "__hash", "left_semi").drop("__hash")
