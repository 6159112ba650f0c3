"""Full-text search over episodes: postings of words, AND of prefixes.

The index is two tables, written by date: `postings` (term, id, date) and `indexed`
(one row for each episode). A query is a filtered scan of postings sorted by term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.textfn import host_and_path, tokenize, words


def terms_of(app: Column, titles: Column, urls: Column, documents: Column, visible_text: Column, private: Column) -> Column:
    """The distinct words of an episode; of a private one, only its app's."""
    # joined by line ends, which no word holds, so that words are looked for once in an episode
    shown = F.concat_ws("\n", titles, F.transform(urls, host_and_path), documents, visible_text)
    return F.array_distinct(words(F.concat_ws("\n", app, F.when(~private, shown))))


def postings(episodes: DataFrame) -> DataFrame:
    """(term, stream, date, id), distinct."""
    terms = terms_of(*[F.col(c) for c in ("app", "titles", "urls", "documents", "visible_text", "is_private")])
    return episodes.select(F.explode(terms).alias("term"), "stream", "date", "id").distinct()


def indexed(episodes: DataFrame) -> DataFrame:
    """One row for each (stream, id): of episodes that share an id the last one counts."""
    e = episodes.groupBy("stream", "date", "id").agg(F.max_by(F.struct("app", "title", "start", "end", "active_ms", "is_private"), F.struct("end_ms", "app")).alias("e"))
    return e.select("stream", "date", "id", "e.*")


def cardinalities(postings_: DataFrame, indexed_: DataFrame) -> DataFrame:
    return indexed_.agg(F.count("*").alias("episodes")).crossJoin(postings_.agg(F.countDistinct("term").alias("terms")))  # one row each


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The query's words: the index's own expression splits them."""
    return list(spark.range(1).select(tokenize(F.lit(query)).alias("terms")).first()[0])


def search(postings_: DataFrame, indexed_: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Episodes that hold a word with each of the query's words as its prefix, the latest first; none for an empty query."""
    terms = query_terms(postings_.sparkSession, query)
    distinct = sorted(set(terms))
    hit = F.lit(False)
    for t in distinct:
        hit = hit | F.startswith("term", F.lit(t))
    which = [F.max(F.startswith("term", F.lit(t)).cast("int")) for t in distinct]
    found = postings_.filter(hit).groupBy("stream", "date", "id").agg(sum(which, F.lit(0)).alias("n")).filter(F.col("n") == len(distinct)).drop("n")
    rows = indexed_.join(found, ["stream", "date", "id"]) if terms else indexed_.limit(0)
    return rows.withColumn("matched_terms", F.lit(len(terms)).cast("long")).orderBy(F.desc("start"), "id", "stream").limit(limit)


def forget_day(table: DataFrame, date: str) -> DataFrame:
    return table.filter(F.col("date") != date)
