"""Line dedup by pairwise alignment.

A line is a stretch of text up to a newline or the end of a sentence. A later document loses the
blocks of 20 words or more that align with an earlier one (the order is that of doc_id).

1. Tasks hash the lines of each text (the low byte of a hash is the line's number of words). Of
   texts that are equal, the one with the smallest doc_id stands for all; the others, if of 20
   words or more, are blocks as a whole.
2. Overlapping documents are found in two ways. A rare line (of 4 words or more, in at most 8
   texts) pairs all its holders. Frequent lines make no pairs by themselves, but runs of shared
   lines do: each shortest run of 20 words or more that starts or ends at a line pairs its holders
   with its first holder. So n holders make n - 1 pairs, none is too frequent to count, and each
   line of a shared run of 20 words lies in such a run and thus in a pair.
3. The pairs get both texts: the later one travels, the earlier one goes once to up to 500 pairs.
   Patience diff aligns their lines: lines that both hold
   exactly once, in their longest common order, are anchors that grow over equal lines, and the
   gaps between are aligned likewise. Aligned runs then grow word by word into the lines around.
   What has moved or repeats, and so isn't in that order, is aligned by its runs of 20 words.
4. Aligned blocks of 20 words or more are deleted from the later document.

Pairs are aligned one by one, and what they delete of a document is united afterwards; so a
document's pairs may lie in different tasks. Lines in very many texts are joined by a broadcast of
at most MOST_HEAVY lines, so that no task gets all holders of one.

Defined results: a null or empty text has no lines and stays as it is; rows that share a doc_id
don't pair with each other (copies of a row get the same result); a null doc_id counts as the largest
long, later than all others; an empty table gives an empty one; a very long text is aligned alone in its slice.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import NULL_ID, checkpointed, slices, table

#: A line of fewer words isn't rare; blocks of fewer words aren't deleted.
LINE_WORDS, BLOCK_WORDS = 4, 20
#: A line in at most so many texts is rare: all its holders are pairs.
RARE = 8
#: So many lines or runs, the most frequent ones, are broadcast at most (24 bytes each).
MOST_HEAVY = 200_000
#: What parts lines, a newline or a single end mark before a space: the same pattern for Spark and Python.
PARTS = r"\n|(?<=[^.!?][.!?]) "
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Ids of paired documents are broadcast to the scan of the texts up to this number (16 bytes each).
MOST_BROADCAST = 1_000_000
#: Pairs of one owner that go together.
PER_SALT = 500


def _lis(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in order of their first number, the longest run in which the second rises too."""
    tails, at, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        i = bisect_left(tails, j)
        if i == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[i], at[i] = j, k
        back.append(at[i - 1] if i else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int, int]]:
    """Aligned runs (start in a, start in b, length) of equal lines, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        n = 0
        while a0 + n < a1 and b0 + n < b1 and a[a0 + n] == b[b0 + n]:
            n += 1
        if n:
            out.append((a0, b0, n))
            a0, b0 = a0 + n, b0 + n
        n = 0
        while a0 < a1 - n and b0 < b1 - n and a[a1 - n - 1] == b[b1 - n - 1]:
            n += 1
        if n:
            out.append((a1 - n, b1 - n, n))
            a1, b1 = a1 - n, b1 - n
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {line: i for i, line in enumerate(a[a0:a1], a0) if in_a[line] == 1}
        once = sorted((where[line], j) for j, line in enumerate(b[b0:b1], b0) if in_b[line] == 1 and line in where)
        pa_, pb = a0, b0
        for i, j in [*_lis(once), (a1, b1)]:
            if i < pa_ or j < pb:
                continue  # a run before has grown over this anchor
            n = 0
            while i + n < a1 and j + n < b1 and a[i + n] == b[j + n]:
                n += 1
            back = 0
            while i - back > pa_ and j - back > pb and a[i - back - 1] == b[j - back - 1]:
                back += 1
            if (pa_, i, pb, j) != (a0, a1, b0, b1):  # no anchor: nothing more to align
                todo.append((pa_, i - back, pb, j - back))
            if n + back:
                out.append((i - back, j - back, n + back))
            pa_, pb = i + n, j + n
    return sorted(out, key=lambda r: r[1])


_SPLIT = re.compile(PARTS)
#: Texts without two end marks in a row, or one at their start, are parted by plain replacement.
_PAIRS = tuple(a + b for a in ".!?" for b in ".!?")


def _parts(text: str) -> list[str]:
    if text[:1] in _ENDS or any(p in text for p in _PAIRS):
        return _SPLIT.split(text)
    return text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n")


_ENDS = tuple(".!?")


def _lines(text: str) -> tuple[list[bytes], list[bytes], list[int]]:
    """The lines without blank ones (as words joined by a space), all words, and the first word of each line. Bytes split at ASCII white space alone."""
    lines, words, first = [], [], []
    for part in _parts(text):
        w = part.encode().split()
        if w:
            first.append(len(words))
            words += w
            lines.append(b" ".join(w))
    first.append(len(words))
    return lines, words, first


def _shortest_runs(lines: list[bytes], first: list[int], least: int) -> Iterator[tuple[int, int, tuple[bytes, ...]]]:
    """From each line on, the shortest run of lines with so many words: (start, end, lines)."""
    j = 0
    for i in range(len(lines)):
        while j < len(lines) and first[j] - first[i] < least:
            j += 1
        if first[j] - first[i] < least:
            return
        yield i, j, tuple(lines[i:j])


def common_blocks(earlier: str, later: str, least: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """Word ranges of the later text that align with the earlier one, of at least so many words.

    Blocks that stand in another order, or of lines that repeat, aren't part of the longest common
    order; they are looked up by their shortest runs of lines and grow likewise.
    """
    return _blocks(_lines(earlier), _lines(later), {}, least)


def _blocks(a: tuple, b: tuple, where: dict, least: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """The same of parsed texts; where holds the earlier text's shortest runs once they have been needed."""
    la, wa, fa = a
    lb, wb, fb = b
    runs = [(fa[i], fb[j], fb[j + n] - fb[j]) for i, j, n in patience(la, lb)]
    out, end_a, end_b = [], 0, 0
    for k, (i, j, n) in enumerate(runs):
        to_a, to_b = runs[k + 1][:2] if k + 1 < len(runs) else (len(wa), len(wb))
        while i > end_a and j > end_b and wa[i - 1] == wb[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < to_a and j + n < to_b and wa[i + n] == wb[j + n]:
            n += 1
        end_a, end_b = i + n, j + n
        if out and out[-1][1] == j and out[-1][2] == i:
            out[-1] = (out[-1][0], j + n, i + n)
        else:
            out.append((j, j + n, i + n))
    blocks, k = [(s, e) for s, e, _ in out if e - s >= least], 0
    moved, start, end = [], 0, 0
    for i, j, run in _shortest_runs(lb, fb, least):
        while k < len(blocks) and blocks[k][1] < fb[j]:
            k += 1
        if (k < len(blocks) and blocks[k][0] <= fb[i]) or (start <= fb[i] and fb[j] <= end):
            continue
        if not where:
            for at, _, key in _shortest_runs(la, fa, least):
                where.setdefault(key, at)
            where[()] = 0
        if run in where:
            x, start, end = fa[where[run]], fb[i], fb[j]
            n = end - start
            while x + n < len(wa) and end < len(wb) and wa[x + n] == wb[end]:
                n, end = n + 1, end + 1
            while x and start and wa[x - 1] == wb[start - 1]:
                x, start = x - 1, start - 1
            moved.append((start, end))
    return sorted(blocks + moved)


SPANS = "id long, h long, start int, end int"


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Character spans to delete: from the first word of a block up to the next word that stays. Pairs of an owner follow each other: its text is parsed once."""
    last, parsed, where = None, None, {}
    for batch in slices(batches, "later", 4 << 20):
        rows = []
        owners = batch["earlier"].dictionary_encode()
        texts = owners.dictionary.to_pylist()
        for id_, h, k, b in zip(*(batch[c].to_pylist() for c in ("id", "h")), owners.indices.to_pylist(), batch["later"].to_pylist(), strict=True):
            if texts[k] is not last and texts[k] != last:
                last, where = texts[k], {}
                parsed = _lines(last)
            blocks = _blocks(parsed, _lines(b), where)
            if blocks:
                at = [m.start() for m in WORD.finditer(b)] + [len(b)]
                rows += [(id_, h, at[s], at[e]) for s, e in blocks]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=[x.split()[0] for x in SPANS.split(", ")])


LINES = "id long, h long, lines array<long>"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines' hashes of each text, in order."""
    from xxhash import xxh64_intdigest

    for batch in slices(batches, "text", 4 << 20):
        lines, ends = [], [0]
        for text in batch["text"].to_pylist():
            for part in _parts(text):
                w = part.encode().split()
                if w:
                    lines.append(xxh64_intdigest(b" ".join(w)) & ~0xFF | min(len(w), 255))
            ends.append(len(lines))
        flat = pa.array(np.array(lines, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch["id"], batch["h"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["id", "h", "lines"])


RUNS = "id long, run long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document's shared lines: the hashes of the shortest runs of consecutive lines with BLOCK_WORDS words, from each line on and up to each line."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        ids, runs = [], []
        for id_, shared in zip(batch["id"].to_pylist(), batch["shared"], strict=True):
            at, line = (shared.values.field(k).to_numpy() for k in (0, 1))
            by = np.argsort(at)
            at, line = at[by], line[by]
            found = set()
            for run in np.split(line, np.flatnonzero(np.diff(at) != 1) + 1):
                ends = np.concatenate([[0], np.cumsum(run & 255)])
                if ends[-1] < BLOCK_WORDS:
                    continue
                to = np.searchsorted(ends, ends[:-1] + BLOCK_WORDS)
                since = np.searchsorted(ends, ends[1:] - BLOCK_WORDS, "right") - 1
                spans = {(i, int(j)) for i, j in enumerate(to) if j < len(ends)} | {(int(i), j) for j, i in enumerate(since, 1) if i >= 0}
                found |= {xxh64_intdigest(run[i:j].tobytes()) - (1 << 63) for i, j in spans}
            ids += [id_] * len(found)
            runs += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, pa.int64())], names=["id", "run"])


def _holders(rows: DataFrame, key: str) -> DataFrame:
    """(key, owner, n): what several ids hold, with the smallest id; n counts the rows."""
    found = rows.groupBy(key).agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count("*").alias("n"))
    return checkpointed(found.filter("owner <> last").select(key, "owner", "n"))


def _joined(rows: DataFrame, holders: DataFrame, key: str, total: int) -> DataFrame:
    """rows with their holders' columns; what more than total / MOST_HEAVY rows hold is joined by a broadcast."""
    heavy = holders.filter(F.col("n") > max(10_000, total / MOST_HEAVY))
    if heavy.isEmpty():
        return rows.join(holders, key)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(holders.join(F.broadcast(heavy.select(key)), key, "left_anti"), key)
    return light.union(rows.join(F.broadcast(heavy), key).select(light.columns))


def pairs(docs: DataFrame) -> DataFrame:
    """(id, owner): later documents and the earlier ones that they may overlap with. docs: (id, h, text) with distinct texts."""
    hashed = checkpointed(docs.mapInArrow(_hashed, LINES)).withColumn("doc", F.monotonically_increasing_id())
    total = hashed.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    lines = _holders(hashed.select("id", F.explode(F.array_distinct("lines")).alias("line")), "line")
    shared = _joined(hashed.select("id", "doc", F.posexplode("lines").alias("at", "line")), lines, "line", total).select("id", "doc", "at", "line", "n")
    shared = checkpointed(shared)
    rare = shared.filter((F.col("n") <= RARE) & (F.col("line").bitwiseAND(F.lit(255)) >= LINE_WORDS))
    rare = rare.groupBy("line").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.posexplode("ids").alias("i", "id"), "ids")
    rare = rare.select("id", F.explode(F.slice("ids", F.lit(1), F.col("i"))).alias("owner"))
    runs = shared.groupBy("id", "doc").agg(F.sum(F.col("line").bitwiseAND(F.lit(255))).alias("words"), F.collect_list(F.struct("at", "line")).alias("shared"))
    runs = checkpointed(runs.filter(F.col("words") >= BLOCK_WORDS).select("id", "shared").mapInArrow(_runs, RUNS))
    frequent = _joined(runs, _holders(runs, "run"), "run", 2 * total).filter("id <> owner").select("id", "owner")
    return rare.union(frequent).distinct()


def copies(docs: DataFrame) -> DataFrame:
    """(id, h) of the texts that an earlier document equals. docs: (id, h, text)."""
    keys = docs.select("id", "h", F.xxhash64(F.lit(1), "text").alias("h2"))
    first = checkpointed(keys.groupBy("h", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last").select("h", "h2", "first"))
    few = first.count() <= MOST_BROADCAST
    return checkpointed(keys.join(F.broadcast(first) if few else first, ["h", "h2"]).filter("id <> first").select("id", "h").distinct())


def deletions(docs: DataFrame) -> DataFrame:
    """(id, h, copy, head, keeps, removed, blocks) of each text with deletions; h is the hash of the text.

    A copy is equal to an earlier text. Of the others, the first `head` characters stay, and then the
    spans `keeps` (at, length); removed counts characters.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).filter("text <> ''")
    docs = docs.select("id", F.xxhash64("text").alias("h"), "text")
    copied = copies(docs)
    few = copied.count() <= MOST_BROADCAST
    docs = docs.join(F.broadcast(copied) if few else copied, ["id", "h"], "left_anti")
    found = checkpointed(pairs(docs))
    few = found.count() <= MOST_BROADCAST
    laters, holders = (found.select(F.col(c).alias("id")).distinct() for c in ("id", "owner"))
    texts, owner_texts = (docs.join(F.broadcast(ids) if few else ids, "id", "left_semi") for ids in (laters, holders))
    # the later text travels with its pair; the earlier one goes once to each PER_SALT pairs of an owner
    busy = checkpointed(found.groupBy("owner").agg(F.count("*").alias("n")).filter(F.col("n") > PER_SALT).select("owner", F.ceil(F.col("n") / PER_SALT).cast("int").alias("salts")))
    busy = F.broadcast(busy) if busy.count() <= MOST_BROADCAST else busy
    later = found.join(busy, "owner", "left").select("id", "owner", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0)).cast("int").alias("salt"))
    later = later.join(texts.dropDuplicates(["id", "h"]).withColumnRenamed("text", "later"), "id")
    owners = owner_texts.dropDuplicates(["id", "h"]).select(F.col("id").alias("owner"), F.col("text").alias("earlier")).join(busy, "owner", "left")
    owners = owners.select("owner", "earlier", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    both = later.join(owners, ["owner", "salt"]).select("id", "h", "earlier", "later")
    spans = checkpointed(both.mapInArrow(_align, SPANS))
    # unite overlapping spans: a span starts a new one if it begins after all ends before it
    by = W.partitionBy("id", "h").orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    united = spans.withColumn("new", (F.col("start") > reach).cast("int")).withColumn("group", F.sum("new").over(by))
    united = united.groupBy("id", "h", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    after = F.lead("start").over(W.partitionBy("id", "h").orderBy("start"))
    first = F.row_number().over(W.partitionBy("id", "h").orderBy("start")) == 1
    # what is kept stands before the first span and after each one; substring counts from 1, and a length of 2^30 means to the end
    united = united.select("id", "h", "start", "end", F.coalesce(after - F.col("end"), F.lit(1 << 30)).alias("length"), first.alias("first"))
    cut = united.groupBy("id", "h").agg(
        F.max(F.when(F.col("first"), F.col("start"))).alias("head"), F.sort_array(F.collect_list(F.struct((F.col("end") + 1).alias("at"), "length"))).alias("keeps"), F.sum(F.col("end") - F.col("start")).alias("removed"), F.count("*").alias("blocks")
    )
    return cut.withColumn("copy", F.lit(False)).unionByName(copied.withColumn("copy", F.lit(True)), allowMissingColumns=True)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs' columns with the remaining text, and __removed (characters), __blocks: all rows are kept.

    Only texts with deletions are shuffled, as long as their ids are few enough to be broadcast.
    """
    cut = deletions(docs).select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("copy").alias("__copy"), F.col("head").alias("__head"), F.col("keeps").alias("__keeps"), F.col("removed").alias("__n"), F.col("blocks").alias("__b"))
    cut = checkpointed(cut)
    text, columns = docs["text"], [docs[f"`{c}`"] for c in docs.columns]
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == F.col("__id")) & (F.xxhash64(text) == F.col("__h"))
    rest = F.concat(F.substring(text, F.lit(1), F.col("__head")), F.array_join(F.transform("__keeps", lambda k: F.substring(text, k["at"], k["length"])), ""))
    gone = F.when(F.col("__copy"), F.regexp_count(text, F.lit(WORD.pattern)) >= BLOCK_WORDS).otherwise(False)
    left = F.when(gone, F.lit("")).when(F.col("__copy").isNull() | F.col("__copy"), text).otherwise(F.rtrim(rest, F.lit(" \t\n\x0b\f\r")))
    removed = F.when(gone, F.char_length(text)).otherwise(F.coalesce("__n", F.lit(0)))
    counts = [removed.cast("long").alias("__removed"), F.when(gone, F.lit(1)).otherwise(F.coalesce("__b", F.lit(0))).cast("long").alias("__blocks")]
    out = [left.alias(c) if c == "text" else x for c, x in zip(docs.columns, columns, strict=True)]
    if cut.count() > MOST_BROADCAST:
        return docs.join(cut, same, "left").select(*out, *counts)
    ids = F.broadcast(cut.select("__id", "__h"))
    whole = docs.join(ids, same, "left_anti").select(*columns, F.lit(0).cast("long").alias("__removed"), F.lit(0).cast("long").alias("__blocks"))
    touched = docs.join(ids, same, "left_semi").select(*columns)
    touched = touched.join(cut, (F.coalesce(touched["doc_id"].cast("long"), F.lit(NULL_ID)) == F.col("__id")) & (F.xxhash64(touched["text"]) == F.col("__h")), "left")
    return touched.select(*out, *counts).union(whole)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents with their own columns and the text that remains; those of which nothing but white space remains go. n_chars, where there is one, counts the new text."""
    d = deduplicated(docs)
    d = d.filter((F.col("__removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    length = F.when(F.col("__removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return d.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def op4(spark, sf_dir: str) -> DataFrame:
    d = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.col("__removed").alias("n_removed"), F.col("__blocks").alias("n_blocks"), "text")
