"""Compositions of the operators: M4, M5 and the keyword report.

One lazy plan: posts -> forum -> keyword hits (inlined) -> top-n per keyword
-> timestamp, clean -> score A and B (row-local) -> keyword tag. Without a
top-n, each matching post is scored once and tagged after. A single scan of
the posts table replaces the reference's per-keyword loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions.text import clean_text, epoch_to_timestamp
from postlens.operators.keywords import posts_with_keyword_table, tag_keyword_table
from postlens.operators.scoring import score_posts
from postlens.operators.search import (
    DEFAULT_LIMIT, by_forum, posts_with_keywords, search_posts, tag_keywords, top_per_keyword,
)
from postlens.schemas import POST_COLUMNS, SCORED_COLUMNS


def clean_posts(df: DataFrame, text_col: str = "selftext") -> DataFrame:
    """C1 + C2 on the post body, in place (titles are not cleaned)."""
    return df.withColumn(text_col, clean_text(F.col(text_col)))


def with_timestamp(df: DataFrame, col: str = "created_utc") -> DataFrame:
    """C3 in place."""
    return df.withColumn(col, epoch_to_timestamp(F.col(col)))


def search_posts_clean(posts: DataFrame, forum: str | None, keyword: str,
                       limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """M5: search one keyword and clean, without scoring."""
    return clean_posts(search_posts(posts, forum, keyword, limit))


def analyze_keywords(posts: DataFrame, keywords: list[str], scorer_a, scorer_b,
                     forum: str | None = None, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """M4 for all keywords at once: SCORED rows (``keyword`` last).

    ``limit`` caps posts per keyword as the search did (``None``: every match).
    Matching runs on the text before cleaning, as the search did. With a
    limit, the per-keyword top-n comes first and only those rows are cleaned
    and scored. Without one, every matching post is cleaned and scored once,
    however many keywords it matches, and its keywords are exploded after.
    """
    selected = by_forum(posts, forum)
    if limit is not None:
        tagged = top_per_keyword(tag_keywords(selected, keywords), limit)
        prepared = clean_posts(with_timestamp(tagged.select(*POST_COLUMNS, "keyword")))
        return score_posts(prepared, scorer_a, scorer_b).select(*SCORED_COLUMNS)
    return _scored_once(posts_with_keywords(selected, keywords, "_keywords"), scorer_a, scorer_b)


def analyze_keyword_table(posts: DataFrame, keywords: DataFrame, scorer_a, scorer_b, forum: str | None = None,
                          limit: int | None = DEFAULT_LIMIT, keyword_col: str = "keyword") -> DataFrame:
    """M4 for a keyword table of any length: the rows of ``analyze_keywords``, at one pass over the posts."""
    selected = by_forum(posts, forum)
    if limit is not None:
        tagged = top_per_keyword(tag_keyword_table(selected, keywords, keyword_col), limit)
        prepared = clean_posts(with_timestamp(tagged.select(*POST_COLUMNS, "keyword")))
        return score_posts(prepared, scorer_a, scorer_b).select(*SCORED_COLUMNS)
    return _scored_once(posts_with_keyword_table(selected, keywords, keyword_col, "_keywords"), scorer_a, scorer_b)


def _scored_once(matched: DataFrame, scorer_a, scorer_b) -> DataFrame:
    """Posts with an array ``_keywords`` cleaned and scored, then one row per keyword."""
    prepared = clean_posts(with_timestamp(matched.select(*POST_COLUMNS, "_keywords")))
    scored = score_posts(prepared, scorer_a, scorer_b)
    # explode_outer + null filter: no inferred size filter pushed below the scorers
    return (scored.select("*", F.explode_outer("_keywords").alias("keyword"))
            .where(F.col("keyword").isNotNull()).select(*SCORED_COLUMNS))
