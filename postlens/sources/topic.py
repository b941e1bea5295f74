"""Message topics: producer (K1), bounded read (S4, C5, L4), subscription.

The transport is a Spark source/sink format. With ``fmt="kafka"`` the Kafka
connector is used (``kafka.bootstrap.servers`` + ``topic``/``subscribe``);
any file format (``parquet``, ``json``) stands in for a topic with the same
columns (``key, value, topic, partition, offset, timestamp``), which is how
the tests run: the Kafka connector jar is not on this runtime.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions.json import decode_json, encode_json
from postlens.schemas import MESSAGE
from postlens.session import scratch_path

# The reference's transport defaults.
DEFAULT_SERVERS = "localhost:9092"
DEFAULT_MAX_MESSAGES = 100
DEFAULT_TIMEOUT_SECONDS = 600


def kafka_source_options(topic: str, bootstrap_servers: str = DEFAULT_SERVERS,
                         starting: str = "earliest", ending: str | None = None,
                         max_per_trigger: int | None = None) -> dict[str, str]:
    """Options of a Kafka source: batch when ``ending`` is given, else streaming.

    The checkpoint keeps the stream's position (the role of the consumer
    group); ``maxOffsetsPerTrigger`` caps each micro-batch.
    """
    opts = {"kafka.bootstrap.servers": bootstrap_servers, "subscribe": topic,
            "startingOffsets": starting}
    if ending is not None:
        opts["endingOffsets"] = ending
    if max_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return opts


def kafka_sink_options(topic: str, bootstrap_servers: str = DEFAULT_SERVERS) -> dict[str, str]:
    """Options of a Kafka sink (rows carry ``value``; no key is set)."""
    return {"kafka.bootstrap.servers": bootstrap_servers, "topic": topic}


def to_messages(df: DataFrame, topic: str, offset: Column | None = None,
                partition: Column | None = None) -> DataFrame:
    """K1 + C4: one JSON message per row, no key.

    For a file stand-in the producer also writes what a broker would assign:
    ``partition`` (default: the Spark partition) and ``offset`` (default: a
    per-partition increasing id). A Kafka sink ignores both.
    """
    return df.select(
        F.lit(None).cast("binary").alias("key"),
        encode_json().cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        (partition if partition is not None else F.spark_partition_id()).cast("int").alias("partition"),
        (offset if offset is not None else F.monotonically_increasing_id()).cast("bigint").alias("offset"),
        F.current_timestamp().alias("timestamp"),
    )


def send(df: DataFrame, topic: str, target: str | None = None, fmt: str = "parquet",
         bootstrap_servers: str = DEFAULT_SERVERS, offset: Column | None = None,
         mode: str = "append") -> None:
    """K1: publish ``df`` to a topic as a batch job (rows never reach the driver)."""
    messages = to_messages(df, topic, offset=offset)
    if fmt == "kafka":
        messages.select("value").write.format("kafka").options(
            **kafka_sink_options(topic, bootstrap_servers)).save()
    else:
        messages.write.format(fmt).mode(mode).save(target)


def _batch_source(spark: SparkSession, topic: str, target: str | None, fmt: str,
                  bootstrap_servers: str, timeout_seconds: int) -> DataFrame:
    if fmt == "kafka":
        return spark.read.format("kafka").options(
            **kafka_source_options(topic, bootstrap_servers, ending="latest")).option(
            "kafkaConsumer.pollTimeoutMs", str(1000 * timeout_seconds)).load()
    return (spark.read.format(fmt).schema(MESSAGE).option("recursiveFileLookup", "true").load(target)
            .where(F.col("topic") == topic))


def read_bounded(spark: SparkSession, topic: str, schema: T.StructType,
                 target: str | None = None, fmt: str = "parquet",
                 bootstrap_servers: str = DEFAULT_SERVERS,
                 max_messages: int | None = DEFAULT_MAX_MESSAGES,
                 group_id: str | None = None, position_store: str | None = None,
                 timeout_seconds: int = DEFAULT_TIMEOUT_SECONDS) -> DataFrame:
    """S4 + C5 + L4: decode at most ``max_messages`` messages, exactly; ``None`` reads the whole topic.

    The cap takes the first messages by (offset, partition): a top-k with a
    per-task bound, never the whole topic in one task. With a ``group_id``
    the read goes on where the group's last one ended: the group is a stream
    with its checkpoint below ``position_store``, and a read is one of its
    micro-batches (``streaming.consumer``). A capped Kafka read always is one: it takes at
    most ``max_messages`` offsets, not the retained topic. ``timeout_seconds`` is how long
    a Kafka poll waits for messages.
    """
    from postlens.operators.search import top_k
    from postlens.streaming.consumer import next_batch, next_messages

    if group_id and (max_messages is None or not position_store):
        raise ValueError("a consumer group needs a cap and a place for its stream")
    store = f"{position_store}/{group_id}" if group_id else scratch_path(spark, "read")
    if fmt == "kafka" and max_messages is not None:
        stream = spark.readStream.format("kafka").options(
            **kafka_source_options(topic, bootstrap_servers, max_per_trigger=max_messages)).option(
            "kafkaConsumer.pollTimeoutMs", str(1000 * timeout_seconds)).load()
        rows = next_batch(stream, store)
        src = spark.createDataFrame([], MESSAGE) if rows is None else rows
    else:
        src = _batch_source(spark, topic, target, fmt, bootstrap_servers, timeout_seconds)
        if group_id:
            src = next_messages(src, store, max_messages)
        elif max_messages is not None:
            src = top_k(src, max_messages, [F.col("offset").asc(), F.col("partition").asc()])
    return src.select(decode_json("value", schema).alias("data")).select("data.*")


def subscribe(spark: SparkSession, topic: str, target: str | None = None,
              fmt: str = "parquet", bootstrap_servers: str = DEFAULT_SERVERS,
              max_per_trigger: int | None = None) -> DataFrame:
    """An unbounded (streaming) read of a topic."""
    if fmt == "kafka":
        return spark.readStream.format("kafka").options(
            **kafka_source_options(topic, bootstrap_servers, max_per_trigger=max_per_trigger)).load()
    reader = spark.readStream.format(fmt).schema(MESSAGE).option("recursiveFileLookup", "true")
    if max_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_per_trigger))
    return reader.load(target).where(F.col("topic") == topic)


def decode_messages(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """C6 + C7 + P7: ``CAST(value AS STRING)`` -> ``from_json`` -> ``data.*``."""
    return messages.select(decode_json("value", schema).alias("data")).select("data.*")
