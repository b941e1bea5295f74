"""Posts tables (S1's data side, P1, P2) and the fixture adapter.

The forum search of the reference becomes a filter over a posts table; this
module produces that table. ``posts_from_documents`` derives posts from the
test ``documents`` and ``conversations`` tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.schemas import POST_COLUMNS, POST_TABLE
from postlens.session import default_parallelism, estimated_bytes, max_partition_bytes

# Text written for a missing author (Python's str(None)),
# the base epoch of the fixture posts (2024-01-01 00:00:00 UTC) and its step.
MISSING_AUTHOR = "None"
FIXTURE_EPOCH = 1704067200
FIXTURE_STEP_SECONDS = 60
# Smallest input share per task when a one-split input is spread over cores.
SPREAD_MIN_BYTES = 256 << 10


def author_text(c) -> F.Column:
    """A missing author becomes the text ``None``, never null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("string"), F.lit(MISSING_AUTHOR))


def read_posts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored posts table with the fixed ``POST_TABLE`` schema."""
    reader = spark.read.format(fmt).schema(POST_TABLE)
    if fmt == "csv":
        reader = reader.option("header", "true").option("multiLine", "true").option("escape", '"')
    return reader.load(path)


def store_posts(posts: DataFrame, path: str) -> None:
    """A posts table that ``read_posts`` reads."""
    posts.select(*[f.name for f in POST_TABLE.fields]).write.parquet(path)


def project_post(df: DataFrame) -> DataFrame:
    """The eight post columns, author rule applied."""
    return df.select(*[author_text("author").alias("author") if c == "author" else F.col(c)
                       for c in POST_COLUMNS])


def comment_counts(conversations: DataFrame) -> DataFrame:
    """Turns per conversation, keyed by the post id text ``_cid``.

    Partial (map-side) aggregation before the shuffle; grouping on the join
    key itself lets the join reuse the aggregate's hash partitioning.
    """
    return (conversations.groupBy(F.col("conv_id").cast("string").alias("_cid"))
            .agg(F.count(F.lit(1)).alias("_turns")))


def posts_from_documents(documents: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Posts derived from ``documents`` (fixture adapter, POST_TABLE columns).

    ``num_comments`` is attached by a left join on the pre-aggregated turn
    counts; Catalyst removes that join when a plan does not use the column,
    and pushes filters on post columns below it.
    """
    d = documents
    doc_id = F.col("doc_id")
    url = F.concat(F.lit("http://example.org/"), F.col("source"), F.lit("/"), doc_id.cast("string"))
    raw_author = F.when(doc_id % 11 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("user"), (doc_id % 97).cast("string")))
    flair = (F.when(doc_id % 7 == 0, F.lit(None).cast("string"))
             .when(doc_id % 7 == 1, F.lit(""))
             .otherwise(F.col("lang")))
    base = d.select(
        doc_id,
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        author_text(raw_author).alias("author"),
        F.col("n_chars").cast("bigint").alias("score"),
        doc_id.cast("string").alias("id"),
        url.alias("url"),
        (F.lit(FIXTURE_EPOCH) + doc_id * FIXTURE_STEP_SECONDS).cast("double").alias("created_utc"),
        F.concat(F.col("text"), F.lit(" see "), url, F.lit(" now")).alias("selftext"),
        F.col("source").alias("forum"),
        flair.alias("link_flair_text"),
    )
    if conversations is None:
        # Unknown until attach_comment_counts runs.
        with_comments = base.withColumn("num_comments", F.lit(None).cast("bigint"))
    else:
        counts = comment_counts(conversations)
        with_comments = base.join(counts, base.id == counts._cid, "left").withColumn(
            "num_comments", F.coalesce(F.col("_turns"), F.lit(0)).cast("bigint"))
    return with_comments.select(*[f.name for f in POST_TABLE.fields])


def spread_small_input(df: DataFrame, min_bytes: int = SPREAD_MIN_BYTES) -> DataFrame:
    """Round-robin a small scan over the cores before heavy per-row text work.

    An input that fits in one split (below ``spark.sql.files.maxPartitionBytes``)
    is read by a single task. Only such inputs are spread, so the extra shuffle
    is bounded by one split's size, and into at most one partition per
    ``min_bytes`` of input (a small file is not cut into thousands of tiny
    tasks on a large cluster). Larger inputs already arrive in many splits
    and are left alone: no shuffle is added.
    """
    spark = df.sparkSession
    size = estimated_bytes(df)
    if size is None or size >= max_partition_bytes(spark):
        return df
    parts = min(default_parallelism(spark), -(-size // max(1, min_bytes)))
    return df.repartition(parts) if parts > 1 else df


def load_fixture_posts(spark: SparkSession, sf_dir: str, with_comments: bool = True) -> DataFrame:
    """Posts for one test scale-factor folder.

    ``with_comments=False`` leaves ``num_comments`` null, for plans that
    attach it after their selective steps (``attach_comment_counts``).
    """
    docs = spread_small_input(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet") if with_comments else None
    return posts_from_documents(docs, conv)


def keyword_frame(spark: SparkSession, keywords: list[str]) -> DataFrame:
    """A keyword list as a one-column table (small by construction)."""
    return spark.createDataFrame([(k,) for k in keywords], "keyword string")


def attach_comment_counts(df: DataFrame, conversations: DataFrame, key: str = "id") -> DataFrame:
    """Fill ``num_comments`` from conversation turns (0 when none).

    Meant to run after selective steps (search, per-keyword limit) so that
    only the selected posts take part in the join.
    """
    counts = comment_counts(conversations)
    cols = df.columns
    joined = df.join(counts, df[key] == counts["_cid"], "left")
    return joined.select(*[
        F.coalesce(F.col("_turns"), F.lit(0)).cast("bigint").alias(c) if c == "num_comments"
        else df[c] for c in cols])
