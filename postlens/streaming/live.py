"""A4 and A6 over T1: a report that follows the stream, and C7's malformed messages kept aside.

Whatever a micro-batch writes goes to a folder named by its batch number and
replaces an earlier attempt of the same batch, so each sink has every batch exactly once
however often the stream is stopped and started.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postlens.functions.labels import agreement
from postlens.functions.text import clean_text
from postlens.operators.report import ALL, COUNT
from postlens.operators.scoring import score_posts
from postlens.plans.analysis import analyze_keywords
from postlens.schemas import MESSAGE, POST
from postlens.sources.topic import decode_messages
from postlens.streaming.sink import TABLE_COLUMNS

_COUNTS = f"of_all boolean, keyword string, agreement string, {COUNT} long"
_BAD = "_malformed"


def _by_batch(write: Callable[[DataFrame, int], None], frame: DataFrame, checkpoint: str, mode: str) -> StreamingQuery:
    return (frame.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def agreement_stream(messages: DataFrame, keywords: list[str], scorer_a, scorer_b) -> DataFrame:
    """Running counts by keyword, and over all, and agreement of the posts in a stream of messages.

    Each (post, keyword) adds one to its keyword and one to the whole, in the state store; the state is as
    large as the list of keywords.
    """
    scored = analyze_keywords(decode_messages(messages, POST), keywords, scorer_a, scorer_b, limit=None)
    both = F.array(F.struct(F.lit(False).alias("of_all"), F.col("keyword")), F.struct(F.lit(True).alias("of_all"), F.lit(ALL).alias("keyword")))
    rows = scored.select(agreement("sentiment1", "sentiment2").alias("agreement"), F.explode(both).alias("g"))
    return rows.groupBy("g.of_all", "g.keyword", "agreement").agg(F.count(F.lit(1)).alias(COUNT))


def run_live_report(messages: DataFrame, path: str, keywords: list[str], scorer_a, scorer_b,
                    written: Callable[[int], None] | None = None) -> None:
    """Bring the report at ``path`` up to date with the stream: each batch's changed counts, in update mode."""
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/counts/batch={batch}")
        if written:
            written(batch)

    _by_batch(write, agreement_stream(messages, keywords, scorer_a, scorer_b), f"{path}/checkpoint", "update").awaitTermination()


def live_counts(spark: SparkSession, path: str) -> DataFrame:
    """(of_all, keyword, agreement, n_posts): each key's count from the last batch that changed it."""
    rows = spark.read.schema(f"{_COUNTS}, batch long").parquet(f"{path}/counts")
    return rows.groupBy("of_all", "keyword", "agreement").agg(F.max_by(COUNT, "batch").alias(COUNT))


def live_agreement_by_keyword(spark: SparkSession, path: str) -> DataFrame:
    """A4 of the stream so far: the rows of ``report.agreement_by_keyword``."""
    return live_counts(spark, path).drop("of_all").orderBy("keyword", F.col(COUNT).desc(), "agreement")


def live_posts_per_keyword(spark: SparkSession, path: str, keywords: DataFrame) -> DataFrame:
    """A6 of the stream so far: keywords without posts show 0."""
    counts = live_counts(spark, path).where(~F.col("of_all")).groupBy("keyword").agg(F.sum(COUNT).alias(COUNT))
    return (keywords.select("keyword").distinct().join(counts, "keyword", "left")
            .select("keyword", F.coalesce(F.col(COUNT), F.lit(0)).cast("bigint").alias(COUNT)))


def with_malformed(messages: DataFrame, schema: T.StructType = POST, value: Column | str = "value") -> DataFrame:
    """The decoded value as ``data`` and the text of one that is no such object as ``malformed``.

    Malformed: no JSON object, cut off, or a field that is not of its type.
    A message without a value is malformed with an empty text. Missing and unknown fields are not errors.
    """
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    wide = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    data = F.from_json(text, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    parsed = messages.withColumn("data", data)
    no_object = F.col("data").isNull() | ~F.coalesce(F.ltrim(text).startswith("{"), F.lit(False))
    bad = F.when(no_object, F.coalesce(text, F.lit(""))).otherwise(F.col(f"data.{_BAD}"))
    return parsed.withColumn("malformed", bad)


def run_with_dead_letters(messages: DataFrame, path: str, scorer_a, scorer_b, clean: bool = True,
                          written: Callable[[int], None] | None = None) -> None:
    """T1 with two sinks: scored posts to ``path/table``, malformed messages to ``path/dead``.

    A dead letter keeps its topic, partition and offset, so it can be found and sent again.
    """
    def write(rows: DataFrame, batch: int) -> None:
        marked = with_malformed(rows).persist()
        try:
            bad = marked.where("malformed IS NOT NULL").select("topic", "partition", "offset", "timestamp", "key", "malformed")
            bad.write.mode("overwrite").parquet(f"{path}/dead/batch={batch}")
            posts = marked.where("malformed IS NULL").select("topic", "partition", "offset", *[f"data.{f.name}" for f in POST.fields])
            if clean:
                posts = posts.withColumn("selftext", clean_text(F.col("selftext")))
            good = score_posts(posts, scorer_a, scorer_b).select("topic", "partition", "offset", *TABLE_COLUMNS)
            good.write.mode("overwrite").parquet(f"{path}/table/batch={batch}")
        finally:
            marked.unpersist()
        if written:
            written(batch)

    _by_batch(write, messages, f"{path}/checkpoint", "append").awaitTermination()


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """The malformed messages so far."""
    fields = [f for f in MESSAGE.fields if f.name != "value"]
    schema = T.StructType([*fields, T.StructField("malformed", T.StringType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(f"{path}/dead")


def living_letters(spark: SparkSession, path: str) -> DataFrame:
    """The scored posts so far, with where they came from."""
    where = "topic string, partition int, offset long"
    texts = ", ".join(f"{c} string" for c in TABLE_COLUMNS)
    return spark.read.schema(f"{where}, {texts}, batch long").parquet(f"{path}/table")
