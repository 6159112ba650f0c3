"""Equivalence-class template deduction: tokens of same-host pages with equal occurrence vectors make nested classes, whose slots hold the text.

1. Tokens. A page is a run of tags and texts between block tags; a token's role is its path of open block
   elements (with their classes) and, for a text, its words as well. Raw text (scripts,
   styles) and comments are one token. Inline elements don't change the path.
2. Occurrence vectors. For each host and role, every page adds hash(page, count) to a sum:
   roles with equal sums, page numbers and counts have the same vector over the host's pages. Tasks add
   up first, so a host with a third of all pages sends one row for each role and task.
3. Classes. Roles of one vector on 80 % of the host's pages are an equivalence class. Its slot is
   the innermost element around all its roles; a class nests there. The class of the elements that
   are on each page once, in order of their mean position, is the root.
4. Slots. Texts that are in a class themselves are the same on the pages and no slot's text. The
   main slot is the innermost container of the root that holds 70 % of the slots' text; links and
   page furniture don't count. A paragraph inside the main slot is kept, however often pages repeat
   it. A container of a class nested there is furniture if pages of different text give it nothing
   but texts of the template, or links: its slots are empty. It holds under 30 % of the slot's text.
5. A page takes its host's main slot if its tokens of the root come once each and in the root's
   order; else the same rule picks from the page's own elements. An article (or main) element
   around the slot, or else those within it, bound the text. Inside, furniture by element or class,
   forms, reader comments and the template's furniture are left out. The last needs two pages of
   different text, as no template can be told from one; the other rules hold for hosts of any size.

Text is decoded, white space inside a block becomes one space, blocks (block elements and
line breaks part them) join by a newline. Templates are broadcast if their measured bytes are few;
beyond, pages join them by host, and a hot host is split as a skewed join.

Defined results: a null or empty html has the empty text; null urls are one host; pages that
repeat are counted as they come; an empty table gives an empty one; a very long page is its task's
slice alone; other columns are never read.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices, table

#: A class is on this share of a host's pages; the main slot holds this share of the slots' text.
SUPPORT, MASS = 0.8, 0.7
#: A container inside the main slot with this share of its characters in links is a menu of the template.
LINKED = 0.8
#: Templates are broadcast up to so many bytes, the hosts' numbers of pages up to so many hosts.
MOST_BYTES, MOST_HOSTS = 32 << 20, 500_000

# Fixed values of HTML: elements without content, of raw text, inside a line, and of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
FURNITURE = frozenset("nav footer aside form head title menu dialog button select option fieldset object figure-actions".split())
#: A class, id or role of these words alone, and of others that say nothing of the content, marks furniture.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo sidebar side nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer notice notices cookie cookies consent gdpr comment comments commentlist disqus reply replies popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended toolbar widget".split())
NEUTRAL = frozenset("site page main top bottom left right global local primary secondary inner outer wrap wrapper container box block area section list item items links link buttons button bar panel form row col content inline block fixed sticky mobile desktop js".split())
BODIES = ("article", "main")
#: Elements of these classes hold an article, so that a header in them is its own.
POSTS = frozenset("article post entry story hentry".split())
#: Elements of text, which are no containers of an article; headings are never furniture by class.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("p li dt dd blockquote pre figcaption caption".split())
#: Inside an article these words mark its own heading.
OWN = frozenset("header masthead topbar".split())
WITHIN = MARKS - OWN

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
P_CLOSERS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def _names(attrs: str) -> tuple[str, ...]:
    return tuple(w for m in ATTR.finditer(attrs) for w in (m[2] or m[3] or m[4] or "").lower().split()) if attrs else ()


@functools.lru_cache(10_000)
def _marks(name: str, marks: frozenset) -> bool:
    """Whether a whole class name marks furniture: site-nav and cookie-banner do, related-work and login-guide don't."""
    words = [w for w in re.split("[_-]+", name) if w]
    return not marks.isdisjoint(words) and all(w in marks or w in NEUTRAL or w.isdigit() for w in words)


Path = tuple[tuple[str, tuple[str, ...]], ...]


def tokens(page: str) -> Iterator[tuple[str, str, str, Path, int]]:
    """(kind, name, text, open elements, characters of text outside links) of each token; kind: open, close, break or text. Text goes on over inline elements and comments."""
    text, at, plain = [], (), 0
    for kind, name, words, path in _tokens(page):
        if kind == "text":
            text.append(words)
            at = path
            if not name:
                plain += len(words.strip())
            continue
        if text:
            yield "text", "", "".join(text), at, plain
            text.clear()
            plain = 0
        yield kind, name, "", path, 0
    if text:
        yield "text", "", "".join(text), at, plain


def _tokens(page: str) -> Iterator[tuple[str, str, str, Path]]:
    """A text's name is 'a' inside a link."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    at, n = 0, len(page)
    path, link = (), ""
    while at <= n:
        m = TOKEN.search(page, at)
        begin = m.start() if m else n
        if begin > at:
            yield "text", link, page[at:begin], path
        if not m:
            return
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in RAW and not m[1]:
            if m[3].endswith("/"):
                continue
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            yield "break", name, "", path
            at = close.end() if close else n
            continue
        if name in INLINE:
            if name == "a":
                link = "" if m[1] else "a"
            continue
        if name in VOID:
            if name in ("br", "hr"):
                yield "break", name, "", path
            continue
        if m[1]:
            if any(e[0] == name for e in stack):
                while stack.pop()[0] != name:
                    pass
                path = tuple(stack)
            yield "close", name, "", path
            continue
        if name in P_CLOSERS and stack and stack[-1][0] == "p":
            stack.pop()
        if name in ("li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
            stack.pop()
        stack.append((name, _names(m[3])))
        path = tuple(stack)
        yield "open", name, "", path


class Roles:
    """Hashes of roles; what is known of a path is remembered."""

    def __init__(self):
        import xxhash

        self.hash, self.paths = xxhash.xxh64_intdigest, {}

    def of(self, path: Path) -> tuple[tuple[int, ...], bool, bool]:
        """The roles of a path's elements (outermost first), whether it is furniture, and whether its last element can hold an article."""
        known = self.paths.get(path)
        if known is None:
            if len(self.paths) > 100_000:
                self.paths.clear()
            up = self.of(path[:-1])[0] if path else ()
            if path:
                name, words = path[-1]
                up = (*up, self.hash("/".join([str(up[-1] if up else 0), name, *words])) - (1 << 63))
            furniture = _furniture(path)
            known = self.paths[path] = up, furniture, bool(path) and not furniture and not any(e[0] in TEXTUAL for e in path)
        return known

    def text(self, path: Path, text: str) -> int:
        up = self.of(path)[0]
        return self.hash(f"{up[-1] if up else 0}#{' '.join(text.split())}") - (1 << 63)


def _furniture(path: Path) -> bool:
    """Whether an element of the path is furniture; a header inside an article is part of it."""
    inside = False
    for name, words in path:
        if name in FURNITURE or (name == "header" and not inside):
            return True
        if name not in ("html", "body", *BODIES, *HEADINGS) and any(_marks(w, WITHIN if inside else MARKS) for w in words):
            return True
        inside = inside or name in BODIES or not POSTS.isdisjoint(words)
    return False


def host_of(url: str | None) -> str:
    return (url or "").split("://", 1)[-1].split("/", 1)[0].split("?", 1)[0].split("#", 1)[0].lower()


COUNTS = "host string, role long, text boolean, holds boolean, up array<long>, pages long, times long, sum long, chars long, at double, words long, least long, most long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's sums; the pages of a host are the role 0. least and most: of the hashes of the pages' texts, which differ unless all pages are copies."""
    import xxhash

    roles, sums = Roles(), {}
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def flushed() -> pa.RecordBatch:
        rows = [(host, role, v[0], v[1], v[2], v[3], v[4], v[5] - (1 << 64) if v[5] >> 63 else v[5], *v[6:]) for (host, role), v in sums.items()]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=[c.split()[0] for c in COUNTS.split(", ")])

    for batch in slices(batches, "html", 8 << 20):
        for page, url, html in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True):
            host, counts, n, story = host_of(url), {}, 0, []
            for kind, _, words, path, plain in tokens(html or ""):
                if kind not in ("open", "text") or (kind == "text" and not words.strip()):
                    continue
                n += 1
                up, furniture, holds = roles.of(path)
                role = roles.text(path, words) if kind == "text" else up[-1]
                c = counts.get(role)
                if c is None:
                    c = counts[role] = [kind == "text", holds and kind == "open", up, 0, 0, n, 0]
                c[3] += 1
                if kind == "text" and not furniture:
                    story.append(str(role))
                    held = (c, counts[up[-1]]) if up and up[-1] in counts else (c,)
                    for h in held:
                        h[4] += plain
                        h[6] += len(words.strip())
            if n:
                counts[0] = [False, False, (), 1, 0, 0, 0]
            content = roles.hash(" ".join(story)) - (1 << 63)
            for role, (text, holds, up, times, chars, at, all_) in counts.items():
                mark = xxhash.xxh64_intdigest(f"{page}|{url}|{times}") if role else 0
                s = sums.get((host, role))
                if s is None:
                    sums[host, role] = [text, holds, up, 1, times, mark, chars, at / max(n, 1), all_, content, content]
                else:
                    s[3] += 1
                    s[4] += times
                    s[5] = (s[5] + mark) & 0xFFFFFFFFFFFFFFFF
                    s[6] += chars
                    s[7] += at / max(n, 1)
                    s[8] += all_
                    s[9], s[10] = min(s[9], content), max(s[10], content)
            if len(sums) > 200_000:
                yield flushed()
    yield flushed()


def classes(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The roles of each host's pages with their sums, and the valid classes: (host, root, pages, times, slot, roles).

    roles: structs (role, text, holds, at, up), in order of their mean position; slot: the innermost element around them all.
    """
    counted = pages.select("page_id", "url", "html").mapInArrow(_count, COUNTS)
    # the wrapping sum of 64-bit hashes: halves are added apart, so that no sum overflows
    half = F.lit(0xFFFFFFFF)
    sums = [F.sum(c).alias(c) for c in ("pages", "times", "chars", "at", "words")] + [F.min("least").alias("least"), F.max("most").alias("most")] + [F.first(c).alias(c) for c in ("text", "holds", "up")]
    by_role = checkpointed(counted.groupBy("host", "role").agg(*sums, F.sum(F.col("sum").bitwiseAND(half)).alias("low"), F.sum(F.shiftrightunsigned("sum", 32)).alias("high")))
    total = checkpointed(by_role.filter("role = 0").select("host", F.col("pages").alias("all")))
    total = F.broadcast(total) if total.count() <= MOST_HOSTS else total
    carried = (F.col("high") + F.shiftrightunsigned("low", 32)).bitwiseAND(half)
    vector = F.struct("pages", "times", F.col("low").bitwiseAND(half).alias("low"), carried.alias("high"))
    frequent = by_role.filter("role <> 0").join(total, "host").filter(F.col("pages") >= F.col("all") * SUPPORT)
    by_class = frequent.groupBy("host", vector.alias("vector")).agg(F.sort_array(F.collect_list(F.struct((F.col("at") / F.col("pages")).alias("at"), "role", "text", "holds", "up"))).alias("roles"))
    outside = F.transform("roles", lambda r: F.filter(r["up"], lambda u: u != r["role"]))
    around = F.reduce(outside, outside[0], lambda a, b: F.filter(a, lambda u: F.array_contains(b, u)))
    valid = by_class.filter(F.size("roles") >= 2).select("host", (F.col("vector.pages") == F.col("vector.times")).alias("root"), "vector.pages", "vector.times", F.try_element_at(around, F.lit(-1)).alias("slot"), "roles")
    return by_role, checkpointed(valid)


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, root, quiet): the role of each host's main slot, the roles of the root's elements in order, and those of furniture in the main slot."""
    by_role, valid = classes(pages)
    members = valid.select("host", "root", F.explode("roles").alias("r")).select("host", "root", "r.*")
    own = by_role.filter(~F.col("text") & (F.col("words") > 0)).select("host", "chars", "words", "up", F.lit(0).alias("same"))
    # a text of a class is no slot's text
    constant = members.filter("text").select("host", "role").join(by_role.filter("text"), ["host", "role"]).select("host", "chars", F.lit(0).cast("long").alias("words"), "up", F.lit(1).alias("same"))
    new, given = F.when(F.col("same") == 0, F.col("chars")).otherwise(0), F.when(F.col("same") == 0, 0).otherwise(F.col("chars"))
    mass = own.union(constant).select("host", F.explode("up").alias("role"), "chars", "words", "same").groupBy("host", "role")
    mass = checkpointed(mass.agg(F.sum(new).alias("chars"), F.sum(new - given).alias("varying"), F.sum("words").alias("words")))
    held = members.filter("root AND holds AND NOT text").select("host", "role", "at", F.size("up").alias("depth")).join(mass, ["host", "role"], "left").fillna(0, ["chars", "varying", "words"])
    top = held.groupBy("host").agg(F.max("varying").alias("varying"), F.max("chars").alias("chars"), F.array_sort(F.collect_list(F.struct("at", "depth", "role", F.col("varying").alias("v"), F.col("chars").alias("c"), F.col("words").alias("w")))).alias("held"))
    enough = F.filter("held", lambda h: F.when(F.col("varying") > 0, h["v"] >= F.col("varying") * MASS).otherwise(h["c"] >= F.col("chars") * MASS))
    main = F.try_element_at(F.array_sort(F.transform(enough, lambda h: F.struct(h["depth"], h["v"], h["role"], h["w"]))), F.lit(-1))
    top = checkpointed(top.filter("chars > 0").select("host", main.alias("slot"), F.transform("held", lambda h: h["role"]).alias("root")))
    slot = top.filter("slot.v > 0").select("host", F.col("slot.role").alias("main"), F.col("slot.w").alias("all"))
    # elements of any class that nest in the main slot: what the pages fill them with decides
    differing = by_role.filter("NOT text AND least < most").select("host", "role")
    nested = members.filter("holds AND NOT text").join(slot, "host").filter(F.array_contains("up", F.col("main")) & (F.col("role") != F.col("main")))
    nested = nested.select("host", "role", "all").join(differing, ["host", "role"]).join(mass, ["host", "role"])
    empty = ((F.col("chars") > 0) & (F.col("varying") == 0)) | (F.col("chars") <= F.col("words") * (1 - LINKED))
    quiet = nested.filter(empty & (F.col("words") < F.col("all") * (1 - MASS))).groupBy("host").agg(F.collect_set("role").alias("quiet"))
    return top.join(quiet, "host", "left").select("host", F.col("slot.role").alias("main"), "root", F.coalesce("quiet", F.array().cast("array<long>")).alias("quiet"))


def _own_slot(found: list, roles: Roles) -> int | None:
    """The main slot by a page's own elements: those that come once are its root."""
    times, mass, depth = {}, {}, {}
    for kind, _, _, path, plain in found:
        up, furniture, holds = roles.of(path)
        if kind == "open" and holds:
            times[up[-1]] = times.get(up[-1], 0) + 1
            depth[up[-1]] = len(up)
        elif kind == "text" and not furniture:
            for u in up:
                mass[u] = mass.get(u, 0) + plain
    held = [u for u in times if times[u] == 1]
    most = max((mass.get(u, 0) for u in held), default=0)
    return max((u for u in held if mass.get(u, 0) >= MASS * most), key=lambda u: (depth[u], mass[u], u), default=None) if most else None


def _bounds(paths: set[Path], main: int | None, roles: Roles) -> set[int]:
    """The elements that bound the text: an article around the main slot, or those in it; else the same of main elements, else the slot itself."""
    for body in BODIES:
        around, within = set(), set()
        for path in paths:
            up = roles.of(path)[0]
            outer = next((u for (name, _), u in zip(path, up, strict=True) if name == body), None)
            if outer is not None and up[-1] == main:
                around.add(outer)
            elif outer is not None and (main is None or main in up):
                within.add(outer)
        if around or within:
            return around or within
    return set() if main is None else {main}


def main_text(page: str, main: int | None, root: tuple[int, ...], quiet: frozenset[int], roles: Roles) -> tuple[str, int]:
    """The main text, and the number of slots that it came from: slots lie between the tokens of the root. Elements of quiet roles are the template's furniture."""
    found = list(tokens(page))
    order = {r: i for i, r in enumerate(root)}
    opened = [roles.of(path)[0][-1] for kind, _, _, path, _ in found if kind == "open"]
    met = [order[r] for r in opened if r in order]
    if main not in opened or any(a >= b for a, b in zip(met, met[1:])):
        main, quiet = _own_slot(found, roles), frozenset()
    bounds = _bounds({path for kind, _, _, path, _ in found if kind == "open"}, main, roles)
    blocks: list[tuple[int, str]] = []
    buffer: list[str] = []
    slot = 0

    def closed() -> None:
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            blocks.append((slot, text))

    for kind, _, text, path, _ in found:
        up, furniture, _ = roles.of(path)
        if kind != "text":
            closed()
            slot += kind == "open" and up[-1] in order
        elif not furniture and (not bounds or not bounds.isdisjoint(up)) and quiet.isdisjoint(up):
            buffer.append(text)
    closed()
    return "\n".join(text for _, text in blocks), len({s for s, _ in blocks})


TEXTS = "page_id long, url string, text string, slots long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roles, cache = Roles(), {}
    for batch in slices(batches, "html", 8 << 20):
        texts, counts = [], []
        main, root, quiet = batch["main"], batch["root"], batch["quiet"]
        for i, (url, page) in enumerate(zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True)):
            host = host_of(url)
            if host not in cache:
                if len(cache) > 10_000:
                    cache.clear()
                cache[host] = main[i].as_py(), tuple(root[i].as_py() or ()), frozenset(quiet[i].as_py() or ())
            text, n = main_text(page or "", *cache[host], roles)
            texts.append(text)
            counts.append(n)
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["page_id", "url", "text", "slots"])


def extract(pages: DataFrame) -> DataFrame:
    """Per page row: page_id, url, text, slots."""
    deduced = checkpointed(templates(pages))
    size = deduced.agg(F.coalesce(F.sum(64 + F.length("host") + 8 * F.size("root") + 8 * F.size("quiet")), F.lit(0))).first()[0]
    own = deduced.withColumnRenamed("host", "of")
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"^.*?://", "")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)).alias("host"))
    p = p.join(F.broadcast(own) if size <= MOST_BYTES else own, F.col("host") == F.col("of"), "left")
    return p.select("page_id", "url", "html", "main", "root", "quiet").mapInArrow(_extract, TEXTS)


ORACLE = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article(?:\s[^>]*)?>(.*?)</article>', 1), '</?(h[1-6]|p|li|ul|ol|div|section|blockquote|table|tr|td|br)(?:\s[^>]*)?/?>', chr(1), 'g'), '<[^>]*>', '', 'g') AS t FROM pages
), b AS (
  SELECT page_id, url, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '&amp;?', chr(2), 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), chr(2), '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM a
)
SELECT page_id, url, coalesce(array_to_string(l, chr(10)), '') AS text, CAST(length(coalesce(array_to_string(l, chr(10)), '')) AS BIGINT) AS n_chars FROM b
"""


def op6(spark, sf_dir: str) -> DataFrame:
    e = extract(table(spark, sf_dir, "pages"))
    return e.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
