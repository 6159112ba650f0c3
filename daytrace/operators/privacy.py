"""The public form of episodes. Columns are listed: what isn't named here never leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.textfn import describe, reduced_urls
from ..schema import PUBLIC_DOCUMENTS, PUBLIC_TEXT, PUBLIC_TITLES, PUBLIC_URLS


def public_episodes(episodes: DataFrame) -> DataFrame:
    """Private episodes keep app and times; others lose queries, paths and counts, and their lists are capped."""
    empty = F.array().cast("array<string>")
    shown = ~F.col("is_private")
    title = F.when(shown, F.col("title"))
    lists = lambda c, n: F.when(shown, F.slice(c, 1, n)).otherwise(empty)
    others = F.filter("titles", lambda t: ~t.eqNullSafe(F.col("title")))
    return episodes.select(
        "stream", "date", "id", "app", title.alias("title"), lists(others, PUBLIC_TITLES).alias("titles"), F.when(shown, reduced_urls(F.col("urls"), PUBLIC_URLS)).otherwise(empty).alias("urls"),
        lists(F.col("documents"), PUBLIC_DOCUMENTS).alias("documents"), lists(F.col("visible_text"), PUBLIC_TEXT).alias("visible_text"), "start", "end", "duration_ms", "active_ms", "is_private",
        describe(F.col("app"), title, F.col("is_private"), "private session, nothing recorded").alias("description"),
    )


def search_result(hits: DataFrame) -> DataFrame:
    return hits.select("stream", "date", "id", "app", F.when(~F.col("is_private"), F.col("title")).alias("title"), "start", "end", "active_ms", "is_private", "matched_terms")


def other_titles(titles, title):
    """Titles besides the headline, all of them."""
    return F.filter(titles, lambda t: ~t.eqNullSafe(title))
