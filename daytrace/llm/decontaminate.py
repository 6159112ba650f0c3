"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, joined to every token window.

DataFrame functions only. A word is a run of characters other than ASCII
punctuation, space and controls, after lower-casing A-Z. The windows of an item
are its runs of ``n`` consecutive words; an item of fewer words, but not none,
is a window as a whole. Each document window is looked up by the 64-bit hash of
its words, and a hit counts only if the words themselves are equal.

Defined results: a null or empty text has no words; an empty benchmark leaves
every document clean; a null item_id counts as the id ``''``; rows that repeat
doc_id and text get equal results; an empty table gives an empty one; a very long
text's windows come from one array of words, whose size is that of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed

#: What stands between words, once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word in its own case, and what follows it up to the next word.
BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
#: The windows are broadcast up to so many bytes of words and item ids; beyond, keys are joined by a shuffle.
MOST_BYTES = 48 << 20
#: Beyond that, the documents that met a key are broadcast to the scan of the texts up to this number (24 bytes each).
MOST_DOCUMENTS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(len, words, key, items): each distinct window with the ids of the items that hold it."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))
    windows = items.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), F.lit(n)).alias("words"))
    return windows.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.size("words").alias("len"), "words", F.xxhash64("words").alias("key"), "items")


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, h, at, len, items): each place (counted from 1) where a benchmark window occurs; h is the hash of the text.

    If the windows are too large to broadcast, only places and keys of document windows are shuffled; what
    meets a key is checked against its document's words afterwards.
    """
    windows = checkpointed(benchmark_windows(benchmark, n))
    joined = F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("items", " "))
    size = windows.agg(F.coalesce(F.sum(joined + 100), F.lit(0))).first()[0]
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # n numbers at most
    found = windows.select(F.col("key").alias("b_key"), F.col("words").alias("b_words"), "items")
    d = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("words"))
    words = d
    if len(lengths) > 1:
        d = d.withColumn("len", F.explode(F.array(*map(F.lit, lengths))))
    else:
        d = d.withColumn("len", F.lit(lengths[0] if lengths else n))
    starts = F.when(F.size("words") >= F.col("len"), F.sequence(F.lit(1), F.size("words") - F.col("len") + 1))
    d = d.select("id", "h", "words", "len", F.explode(starts).alias("at"))
    window = F.slice("words", F.col("at"), F.col("len"))
    d = d.withColumn("key", F.xxhash64(window))
    if size <= most_bytes:
        return d.join(F.broadcast(found), (F.col("key") == F.col("b_key")) & (window == F.col("b_words"))).select("id", "h", "at", "len", "items")
    met = checkpointed(d.select("id", "h", "at", "len", "key").join(found.select("b_key", F.size("b_words").alias("b_len")).distinct(), (F.col("key") == F.col("b_key")) & (F.col("len") == F.col("b_len"))).select("id", "h", "at", "len", "key"))
    met = met.select(F.col("id").alias("m_id"), F.col("h").alias("m_h"), "at", "len", "key").distinct()
    whose = checkpointed(met.select("m_id", "m_h").distinct())
    whose = F.broadcast(whose) if whose.count() <= MOST_DOCUMENTS else whose
    # the words of documents that met a key alone go on
    near = words.join(whose, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("h") == F.col("m_h")), "left_semi")
    seen = near.dropDuplicates(["id", "h"]).join(met, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("h") == F.col("m_h"))).select("id", "h", "at", "len", "key", window.alias("words"))
    return seen.join(found, (F.col("key") == F.col("b_key")) & (F.col("words") == F.col("b_words"))).select("id", "h", "at", "len", "items")


def annotate(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit (words inside any hit), items (sorted ids), spans (array of at, len)."""
    by_doc = hits(docs, benchmark, n).groupBy("id", "h").agg(
        F.sort_array(F.collect_set(F.struct("at", "len"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    ).select(F.col("id").alias("b_id"), F.col("h").alias("b_h"), "spans", "items")
    d = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1))))
    none = F.array().cast("array<string>")
    return d.join(by_doc, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("h") == F.col("b_h")), "left").select(
        F.col("id").alias("doc_id"), "h", "n_words", F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), "spans"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """The documents without contamination, with their own columns.

    remove="documents" drops each document with a hit; "spans" keeps all documents and cuts the words
    that are hit, with what stands between them and the next word, out of the text; the rest stays as it is.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    key, h = "__hit_id", "__hit_h"
    found = hits(docs, benchmark, n).groupBy(F.col("id").alias(key), F.col("h").alias(h)).agg(F.collect_set(F.struct("at", "len")).alias("__hit_spans"))
    text = docs["text"]
    same = docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(h))
    if remove == "documents":
        return docs.join(found.select(key, h), same, "left_anti")
    covered = F.flatten(F.transform("__hit_spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(1), F.size(pieces)), covered)
    rest = F.concat(F.regexp_extract(text, f"^{BETWEEN_ANY_CASE}*", 0), F.array_join(F.transform(kept, lambda i: F.element_at(pieces, i)), ""))
    cut = F.when(F.col("__hit_spans").isNull(), text).otherwise(rest)
    return docs.join(found, same, "left").select(*[cut.alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, array_to_string(list_slice(w, p, p + 9), ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM b WHERE len(w) > 0)
), ns AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT rid, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
  FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, ns WHERE len(w) >= n)
), hit AS (SELECT rid, p, dw.n AS n, item FROM dw JOIN bw USING (win, n)), cov AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY rid
), its AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""


def op3(spark, sf_dir: str) -> DataFrame:
    from .common import table

    a = annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return a.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
