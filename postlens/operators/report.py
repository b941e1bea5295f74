"""Report aggregates: A1-A7 with C9, F3, F4, F5, L3.

The reference computes these in pandas/seaborn/plotly on the driver; here
each is a distributed aggregate (partial, map-side, then final), and the
per-keyword plus overall agreement counts come from one grouping-sets pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.labels import agreement
from postlens.operators.search import NEWEST_LIMIT, by_forum, newest

# The label of the all-keywords row and option.
ALL = "All"
COUNT = "n_posts"


def with_agreement(df: DataFrame, column: str = "agreement") -> DataFrame:
    """C9 as a column."""
    return df.withColumn(column, agreement("sentiment1", "sentiment2"))


def flair_counts(posts: DataFrame, newest_n: int = NEWEST_LIMIT, forum: str | None = None) -> DataFrame:
    """A1 + S2 + F3 + L3: posts per flair among the newest ``newest_n`` of a forum (or all), descending."""
    flair = F.col("link_flair_text")
    recent = newest(by_forum(posts, forum).select("id", "created_utc", "link_flair_text"), newest_n)
    return (recent.where(flair.isNotNull() & (flair != ""))
            .groupBy(flair.alias("flair")).agg(F.count(F.lit(1)).alias(COUNT))
            .orderBy(F.col(COUNT).desc(), F.col("flair").asc()))


def sentiment_by_keyword(scored: DataFrame) -> DataFrame:
    """A2: posts per (keyword, sentiment1); rows missing either are not counted.

    Null labels are dropped after the aggregate (``count(sentiment1) > 0``):
    a plain ``sentiment1 IS NOT NULL`` filter would be pushed through the
    projections into the scan and make the scorers run twice per row.
    """
    return (scored.where(F.col("keyword").isNotNull())
            .groupBy("keyword", "sentiment1")
            .agg(F.count(F.lit(1)).alias(COUNT), F.count("sentiment1").alias("_labelled"))
            .where(F.col("_labelled") > 0).drop("_labelled"))


def agreement_counts(scored: DataFrame) -> DataFrame:
    """Posts per agreement value."""
    return (with_agreement(scored).groupBy("agreement")
            .agg(F.count(F.lit(1)).alias(COUNT)).orderBy(F.col(COUNT).desc(), "agreement"))


def agreement_for_keyword(scored: DataFrame, keyword: str) -> DataFrame:
    """F4 + A3: agreement counts of one keyword.

    When ``scored`` comes from ``analyze_keywords`` without a limit, analyze
    ``[keyword]`` alone: the filter cannot reach below the scorers.
    """
    return agreement_counts(scored.where(F.col("keyword") == F.lit(keyword)))


def agreement_by_keyword(scored: DataFrame) -> DataFrame:
    """A4: agreement counts per keyword and for ``All``, in one pass.

    ``GROUPING SETS ((keyword, agreement), (agreement))``: one Expand and one
    hash aggregate instead of a loop of filters.
    """
    flagged = with_agreement(scored).select("keyword", "agreement")
    grouped = flagged.groupingSets([["keyword", "agreement"], ["agreement"]], "keyword", "agreement")
    return grouped.agg(F.count(F.lit(1)).alias(COUNT), F.grouping("keyword").alias("_g")).select(
        F.when(F.col("_g") == 1, F.lit(ALL)).otherwise(F.col("keyword")).alias("keyword"),
        "agreement", COUNT,
    ).orderBy("keyword", F.col(COUNT).desc(), "agreement")


def keyword_options(scored: DataFrame) -> DataFrame:
    """A5: ``All`` then the distinct keywords, sorted; ``position`` gives the order.

    The window runs over the distinct keywords only (bounded by the keyword list).
    """
    options = (scored.select("keyword").where(F.col("keyword").isNotNull()).distinct()
               .select(F.col("keyword").alias("option"), F.lit(1).alias("_rank"))
               .unionByName(scored.sparkSession.range(1).select(
                   F.lit(ALL).alias("option"), F.lit(0).alias("_rank"))))
    w = Window.orderBy("_rank", "option")
    return options.select("option", (F.row_number().over(w) - 1).cast("bigint").alias("position"))


def posts_per_keyword(scored: DataFrame, keywords: DataFrame) -> DataFrame:
    """Rows per keyword; keywords without rows show 0 (left join from the list)."""
    counts = scored.groupBy("keyword").agg(F.count(F.lit(1)).alias(COUNT))
    return (keywords.select("keyword").distinct().join(counts, "keyword", "left")
            .select("keyword", F.coalesce(F.col(COUNT), F.lit(0)).cast("bigint").alias(COUNT)))


def empty_keywords(scored: DataFrame, keywords: DataFrame) -> DataFrame:
    """F5 per keyword: ``is_empty`` when a keyword found no posts."""
    return posts_per_keyword(scored, keywords).select(
        "keyword", (F.col(COUNT) == 0).alias("is_empty"))


def is_empty(df: DataFrame) -> bool:
    """F5 at an API edge: one short job that stops at the first row."""
    return df.isEmpty()
