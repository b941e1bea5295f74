"""Bounded reads whose position is the stream's own.

A consumer group is a checkpointed stream: the engine's offset and commit logs
say what the group has read, and whatever a micro-batch writes is keyed by its
batch number, so a batch that is run again after a failure replaces what it
wrote before. One read is one micro-batch.

* A Kafka topic is streamed with ``maxOffsetsPerTrigger``; a read takes the
  next batch and leaves the following one, already planned, to the next read.
* The file stand-in of a topic has no offset-capped source, so its stream is
  that of the read requests: batch ``n`` serves request ``n`` with the messages
  after the positions that batch ``n - 1`` wrote, at most the cap, by (offset, partition).

A read that was cut off between its write and its commit is finished by the
next call, which returns those messages: none is lost, none comes twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators.search import top_k
from postlens.schemas import MESSAGE

_REQUEST = "cap long"
_POSITION = "partition int, next long"
_ENOUGH = "the next micro-batch is left to the next read"


def next_batch(stream: DataFrame, store: str, written: Callable[[int], None] | None = None) -> DataFrame | None:
    """The rows of the next micro-batch of a stream whose checkpoint is below ``store``; ``None``: nothing new.

    The batch is written to its own folder, replacing an earlier attempt, and
    committed; the stream stops before it works on another. ``written`` is called between the two.
    """
    done: list[int] = []

    def write(rows: DataFrame, batch: int) -> None:
        if done:
            raise RuntimeError(_ENOUGH)
        rows.write.mode("overwrite").parquet(f"{store}/read/batch={batch}")
        if written:
            written(batch)
        done.append(batch)

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{store}/checkpoint")
             .trigger(availableNow=True).start())
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if not done or _ENOUGH not in str(e):
            raise
    if not done:
        return None
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{store}/read/batch={done[0]}")


def _positions(spark: SparkSession, store: str, batch: int) -> DataFrame:
    """The next offset of each topic partition after a batch (one row per partition)."""
    if batch < 0:
        return spark.createDataFrame([], _POSITION)
    return spark.read.schema(_POSITION).parquet(f"{store}/positions/batch={batch}")


def _serve(source: DataFrame, store: str, written: Callable[[int], None] | None):
    """The batch function of the request stream, and the list of the batches it has served."""
    served: list[int] = []

    def serve(requests: DataFrame, batch: int) -> None:
        spark = requests.sparkSession
        cap = requests.agg(F.max("cap")).first()[0]
        before = _positions(spark, store, batch - 1)
        after = before
        if cap is not None:
            rest = source.join(F.broadcast(before), "partition", "left").where(F.col("offset") >= F.coalesce("next", F.lit(0)))
            chosen = top_k(rest.select(*source.columns), cap, [F.col("offset").asc(), F.col("partition").asc()])
            chosen.write.mode("overwrite").parquet(f"{store}/read/batch={batch}")
            got = spark.read.schema(source.schema).parquet(f"{store}/read/batch={batch}")
            ends = got.groupBy("partition").agg((F.max("offset") + 1).alias("next"))
            after = before.unionByName(ends).groupBy("partition").agg(F.max("next").alias("next"))
        after.coalesce(1).write.mode("overwrite").parquet(f"{store}/positions/batch={batch}")
        if written:
            written(batch)
        if cap is not None:
            served.append(batch)

    return serve, served


def next_messages(source: DataFrame, store: str, cap: int, written: Callable[[int], None] | None = None) -> DataFrame:
    """The next ``cap`` messages of a file topic for the group whose stream lies below ``store``."""
    spark = source.sparkSession
    path = f"{store}/requests"

    def ask(rows: list) -> None:
        spark.createDataFrame(rows, _REQUEST).coalesce(1).write.mode("append").parquet(path)

    def run() -> list[int]:
        serve, served = _serve(source, store, written)
        requests = spark.readStream.schema(_REQUEST).option("maxFilesPerTrigger", "1").parquet(path)
        (requests.writeStream.foreachBatch(serve).option("checkpointLocation", f"{store}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
        return served

    try:
        spark.read.schema(_REQUEST).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        ask([])  # the group's first read; an empty request is served with nothing
    served = run()  # a read that was cut off is finished first
    if not served:
        ask([(cap,)])
        served = run()
    return spark.read.schema(MESSAGE).parquet(f"{store}/read/batch={served[-1]}")
