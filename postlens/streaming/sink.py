"""T1, T2, T3 and K4.

The stream is map-only (decode, clean, two row-local scorers), so it needs no
state and no watermark. The reference decoded a stream of unscored posts as
if it held labels; here the stream decodes posts and scores them in flight.
Position is kept by the checkpoint (the role of the consumer group): a second
run on the same checkpoint adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postlens.functions.text import clean_text
from postlens.operators.scoring import score_posts
from postlens.schemas import POST, STREAM
from postlens.sources.topic import (
    DEFAULT_SERVERS, decode_messages, kafka_sink_options, subscribe, to_messages,
)

# The table keeps the reference's three stream columns, plus the post id.
TABLE_COLUMNS = ["id"] + [f.name for f in STREAM.fields]


def decode_stream(messages: DataFrame, schema=STREAM) -> DataFrame:
    """C6 + C7 + P7 on a stream (the reference's three-column decode)."""
    return decode_messages(messages, schema)


def scored_stream(messages: DataFrame, scorer_a, scorer_b, clean: bool = True) -> DataFrame:
    """Decode posts, clean their body (unless the producer did) and add both labels.

    Cleaning is not idempotent (``h@ttp://x`` -> ``httpx`` -> empty), so
    messages that were cleaned before publishing are not cleaned again.
    """
    posts = decode_messages(messages, POST)
    if clean:
        posts = posts.withColumn("selftext", clean_text(F.col("selftext")))
    return score_posts(posts, scorer_a, scorer_b).select(*TABLE_COLUMNS)


def write_table(stream: DataFrame, table: str, path: str, checkpoint: str,
                available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """K4: append to a Parquet table at ``path``, registered as ``table``.

    ``availableNow`` processes what is there and stops (T3 "until caught
    up"); a processing-time trigger runs until stopped.
    """
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint).option("path", path))
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.toTable(table)


def run_stream_to_table(spark: SparkSession, topic: str, table: str, path: str, checkpoint: str,
                        scorer_a, scorer_b, source: str | None = None, fmt: str = "parquet",
                        bootstrap_servers: str = DEFAULT_SERVERS,
                        max_per_trigger: int | None = None,
                        timeout_seconds: float | None = None,
                        processing_time: str | None = None,
                        clean: bool = True) -> StreamingQuery:
    """Subscribe, decode, clean, score and append to the table.

    With the default ``availableNow`` trigger it returns once the stream has
    caught up (T3 "nothing more to read"), however long that takes; when a
    ``timeout_seconds`` is given and runs out first, the query is stopped and
    ``TimeoutError`` raised, so a partial table is never taken for a whole one
    (the checkpoint keeps the position for the next run). With
    ``processing_time`` it runs until ``timeout_seconds`` (T3 "time is up").
    """
    messages = subscribe(spark, topic, target=source, fmt=fmt,
                         bootstrap_servers=bootstrap_servers, max_per_trigger=max_per_trigger)
    query = write_table(scored_stream(messages, scorer_a, scorer_b, clean=clean), table, path, checkpoint,
                        processing_time=processing_time)
    finished = query.awaitTermination(timeout_seconds) if timeout_seconds else query.awaitTermination()
    if timeout_seconds and not finished:
        query.stop()
    if query.exception() is not None:
        raise query.exception()
    if timeout_seconds and not finished and not processing_time:
        raise TimeoutError(f"stream into {table} stopped after {timeout_seconds} s before it had caught up")
    return query


def publish_stream(stream: DataFrame, topic: str, checkpoint: str, target: str | None = None,
                   fmt: str = "parquet", bootstrap_servers: str = DEFAULT_SERVERS,
                   available_now: bool = True) -> StreamingQuery:
    """K1 on a stream: each row becomes one JSON message, no key.

    A Kafka sink writes ``value`` to ``topic``. A file stand-in writes each
    micro-batch to its own folder below ``target`` (a repeated batch replaces
    itself), with the offsets a broker would assign: increasing from batch to
    batch, unique in a batch.
    """
    if fmt == "kafka":
        messages = to_messages(stream, topic, partition=F.lit(0), offset=F.lit(None))
        writer = messages.select("value").writeStream.format("kafka").options(
            **kafka_sink_options(topic, bootstrap_servers))
    else:
        def write(rows: DataFrame, batch: int) -> None:
            # the low 46 bits hold 2^13 partitions of 2^33 rows
            offset = F.shiftleft(F.lit(batch).cast("bigint"), 46) + F.monotonically_increasing_id()
            to_messages(rows, topic, partition=F.lit(0), offset=offset).write.format(fmt).mode("overwrite").save(
                f"{target}/batch-{batch:012d}")

        writer = stream.writeStream.foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
