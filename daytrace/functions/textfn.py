"""Text functions, each Column to Column and on the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a line of screen text is judged by.
SECRET_PREFIXES = ("sk-", "sk_", "pk_", "ghp_", "gho_", "ghu_", "ghs_", "github_pat_", "xox", "aiza", "bearer ", "basic ", "-----begin")
KNOWN_SCHEMES = ("http://", "https://", "file://", "about:", "chrome://", "edge://")
OPENERS = ("Here is a summary:", "Here's a summary:", "Here is the summary:", "Here's the summary:", "Summary:")
BROWSERS = {"chrome": "chrome", "msedge": "edge", "firefox": "firefox", "brave": "brave", "opera": "opera", "opera_gx": "opera", "vivaldi": "vivaldi", "arc": "arc"}
PRIVATE_MARKERS = {
    "chrome": ("incognito",), "edge": ("inprivate",), "firefox": ("private browsing",), "brave": ("private window", "private browsing", "tor"), "opera": ("private",), "vivaldi": ("private window",), "arc": ("incognito",),
}
MAX_LINE, DIGIT_RUN = 120, 12


def nullif_empty(c: Column) -> Column:
    return F.when(c != "", c)


#: Unicode's white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """Without white space (Unicode's) at either end."""
    return F.trim(c, F.lit(SPACE))


def words(c: Column) -> Column:
    """Lower-case words of two code points or more, split at all but letters and digits. They are found, not split: a split compiles its pattern for each text."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"[\p{IsAlphabetic}\p{N}]{2,}"), F.lit(0)), F.lower)


def tokenize(c: Column) -> Column:
    """The words; only consecutive repeats are dropped."""
    found = words(c)
    # each word beside the one before it; the pairs are one longer than the words, where the word is null
    kept = F.zip_with(found, F.concat(F.array(F.lit("")), found), lambda w, before: F.when(w != before, w))
    return F.filter(kept, lambda w: w.isNotNull())


def without_scheme(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)^.*?://", "")


def host_and_path(url: Column) -> Column:
    return F.element_at(F.split(without_scheme(url), "[?#]"), 1)


def tokenize_url(c: Column) -> Column:
    """Words of host and path: what follows ? or # is never indexed."""
    return tokenize(host_and_path(c))


def strip_query(c: Column) -> Column:
    """Cut at the first ? or #, without trailing slashes."""
    return F.regexp_replace(F.element_at(F.split(trimmed(c), "[?#]"), 1), "/+$", "")


def reduced_urls(urls: Column, most: int) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(urls, strip_query), lambda u: u != "")), 1, most)


def document_label(title: Column, path: Column) -> Column:
    """The title, or the last segment of the path, or null."""
    name = trimmed(F.regexp_extract(path, r"([^/\\]*+)[/\\]*+$", 1))
    return F.coalesce(nullif_empty(trimmed(title)), nullif_empty(name))


def document_names_window(title: Column, path: Column, window_title: Column) -> Column:
    """A document with a path, or with a title of 3 characters or more that the window title holds."""
    t = trimmed(title)
    held = (F.char_length(t) >= 3) & F.contains(F.lower(window_title), F.lower(t))
    return F.coalesce(trimmed(path) != "", F.lit(False)) | F.coalesce(held, F.lit(False))


def describe(app: Column, title: Column, private: Column, note: str = "private") -> Column:
    return F.when(private, F.concat(app, F.lit(f" ({note})"))).when(title.isNotNull(), F.concat(app, F.lit(" — "), title)).otherwise(app)


def collapse(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"(?U)\s+", " "))


def looks_secret(line: Column) -> Column:
    """A known prefix, or a word of 20 characters or more of letters and digits and + / = _ -, with both."""
    known = F.lower(line).rlike("^(?:" + "|".join(re.escape(p) for p in SECRET_PREFIXES) + ")")
    return known | F.coalesce(line.rlike(r"(?:^| )(?=[A-Za-z0-9+/=_-]{20,}(?: |$))(?=[^ ]*[0-9])(?=[^ ]*[A-Za-z])"), F.lit(False))


def names_location(line: Column) -> Column:
    return line.rlike(r"(?i)^file:") | line.rlike(r"^\\\\") | (line.rlike(r"^[A-Za-z]:[\\/]") & (F.octet_length(line) > 3))


def mask_digits(line: Column) -> Column:
    """A run of 12 digits or more, separated by spaces, hyphens or points at most, becomes an ellipsis."""
    return F.regexp_replace(line, r"[0-9](?:[ .-]*[0-9]){%d,}" % (DIGIT_RUN - 1), "…")


def truncate(line: Column) -> Column:
    return F.when(F.char_length(line) > MAX_LINE, F.concat(F.substring(line, 1, MAX_LINE - 1), F.lit("…"))).otherwise(line)


def may_be_shown(line: Column) -> Column:
    return (F.char_length(line) >= 2) & ~looks_secret(line) & ~names_location(line)


def redact_line(raw: Column) -> Column:
    """The line as it may be shown, or null."""
    line = collapse(raw)
    return F.when(may_be_shown(line), truncate(mask_digits(line)))


def redact_lines(lines: Column, max_lines: int, max_chars: int, window_title: Column | None = None) -> Column:
    """Lines of array<struct<surface:int, seq:int, line:string>> as shown: surfaces in order, redacted, without the window's title and repeats, within the budget.

    Beyond max_lines it stops; a line that would exceed max_chars is skipped, and later ones may still fit.
    """
    title = collapse(window_title) if window_title is not None else F.lit(None).cast("string")
    # redact_line() by a pass for each of its steps: a lambda computes what it uses several times each time
    shown = F.filter(F.transform(F.array_sort(lines), lambda x: collapse(x["line"])), may_be_shown)
    shown = F.transform(F.transform(shown, mask_digits), truncate)
    shown = F.array_distinct(F.filter(shown, lambda x: x.isNotNull() & ~x.eqNullSafe(title)))
    zero = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("total"))

    def step(acc: Column, line: Column) -> Column:
        n = F.char_length(line)
        fits = (F.size(acc["kept"]) < max_lines) & (acc["total"] + n <= max_chars)
        return F.when(fits, F.struct(F.concat(acc["kept"], F.array(line)).alias("kept"), (acc["total"] + n).alias("total"))).otherwise(acc)

    return F.aggregate(shown, zero, step, lambda acc: acc["kept"])


def normalize_url(raw: Column) -> Column:
    """An address with its scheme, or null for what isn't one."""
    t = trimmed(raw)
    known = F.lit(False)
    for s in KNOWN_SCHEMES:
        known = known | F.startswith(t, F.lit(s))
    host = F.element_at(F.split(t, "/"), 1)
    bare = ~F.contains(t, F.lit(" ")) & F.contains(host, F.lit(".")) & ~F.startswith(host, F.lit(".")) & ~F.endswith(host, F.lit("."))
    return F.when(known & (t != ""), t).when(bare & (t != ""), F.concat(F.lit("https://"), t))


def document_path(raw: Column) -> Column:
    t = trimmed(raw)
    local = t.rlike(r"^\\\\") | (t.rlike(r"^[A-Za-z]:[\\/]") & (F.octet_length(t) > 3))
    ok = (t != "") & ~t.rlike(r"[\n\r\t]") & (F.char_length(t) <= MAX_LINE)
    return F.when(ok & local, t).when(ok, normalize_url(t))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"[^/\\]*$", 0), r"(?<=.)\.[^.]*$", "")


def browser_of(stem: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in BROWSERS.items() for x in pair])[F.lower(stem)]


def title_is_private(browser: Column, title: Column) -> Column:
    low, out = F.lower(title), F.lit(False)
    for name, markers in PRIVATE_MARKERS.items():
        for m in markers:
            out = out | ((browser == name) & F.contains(low, F.lit(m)))
    return F.coalesce(out, F.lit(False))


def tidy(raw: Column) -> Column:
    """A model's answer without an opener or quotes around it; lines of a paragraph join by a space, paragraphs by a blank line."""
    t = trimmed(raw)
    for o in OPENERS:
        t = F.when(F.lower(F.substring(t, 1, len(o))) == o.lower(), F.regexp_replace(F.substring(t, len(o) + 1, 1 << 30), r"(?U)^\s+", "")).otherwise(t)
    inner = F.substring(t, F.lit(2), F.char_length(t) - 2)
    t = F.when((F.char_length(t) > 1) & F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"')) & ~F.contains(inner, F.lit('"')), trimmed(inner)).otherwise(t)
    parts = F.transform(F.split(t, r"\r?\n(?:[ \t\r]*\n)+"), lambda p: F.array_join(F.filter(F.transform(F.split(p, r"\r?\n"), trimmed), lambda x: x != ""), " "))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), trimmed), lambda p: p != "")


def one_line(text: Column) -> Column:
    return F.coalesce(nullif_empty(collapse(text)), F.lit("Untitled"))


def element_writing(value: Column, max_lines: int) -> Column:
    return F.slice(F.filter(F.split(F.substring(value, 1, 4000), r"[\r\n]"), lambda x: trimmed(x) != ""), 1, max_lines)


def token_digest(token: Column) -> Column:
    return F.sha2(token.cast("binary"), 256)


def bearer(header: Column) -> Column:
    return nullif_empty(trimmed(F.regexp_extract(header, r"(?i)^bearer\s+(.*)$", 1)))


def valid_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9_-]+$")
