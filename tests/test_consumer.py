"""Bounded reads of a consumer group: cut off between write and commit, no message is lost or comes twice."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from conftest import SF_SMALL
from postlens.schemas import MESSAGE, POST
from postlens.session import scratch_path
from postlens.sources import topic
from postlens.sources.posts import load_fixture_posts
from postlens.streaming.consumer import next_batch, next_messages


class Killed(Exception):
    pass


def kill(batch):
    raise Killed


def publish(spark, rows=200, partitions=3):
    target = scratch_path(spark, "topic")
    posts = load_fixture_posts(spark, SF_SMALL).select(*[f.name for f in POST.fields]).where(F.col("id").cast("long") < rows)
    number = F.col("id").cast("bigint")
    topic.to_messages(posts, "t", offset=F.floor(number / partitions), partition=(number % partitions).cast("int")).write.parquet(target)
    return target


def ids(df):
    return sorted(int(r.id) for r in topic.decode_messages(df, POST).collect())


def test_reads_survive_a_kill_between_write_and_commit(spark):
    source, store = spark.read.schema(MESSAGE).parquet(publish(spark)), scratch_path(spark, "group")
    got = [ids(next_messages(source, store, 30))]
    with pytest.raises(StreamingQueryException):
        next_messages(source, store, 50, written=kill)
    got.append(ids(next_messages(source, store, 7)))  # the read that was cut off, with its own cap
    assert len(got[0]) == 30 and len(got[1]) == 50
    with pytest.raises(StreamingQueryException):
        next_messages(source, store, 20, written=kill)
    with pytest.raises(StreamingQueryException):  # killed again while it is finished
        next_messages(source, store, 20, written=kill)
    while got[-1]:
        got.append(ids(next_messages(source, store, 40)))
    assert sorted(i for part in got for i in part) == list(range(200))
    assert [len(part) for part in got] == [30, 50, 20, 40, 40, 20, 0]


def test_messages_come_by_offset_over_all_partitions(spark):
    source, store = spark.read.schema(MESSAGE).parquet(publish(spark, 30)), scratch_path(spark, "group")
    assert ids(next_messages(source, store, 7)) == list(range(7))
    assert ids(next_messages(source, store, 20)) == list(range(7, 27))


def test_later_messages_are_read_later(spark):
    target, store = scratch_path(spark, "topic"), scratch_path(spark, "group")
    posts = load_fixture_posts(spark, SF_SMALL).select(*[f.name for f in POST.fields])
    number = F.col("id").cast("bigint")
    read = lambda cap: sorted(int(r.id) for r in topic.read_bounded(
        spark, "t", POST, target=target, max_messages=cap, group_id="g", position_store=store).collect())
    topic.send(posts.where("cast(id as long) < 20"), "t", target=target, offset=number)
    assert read(15) == list(range(15)) and read(15) == list(range(15, 20)) and read(15) == []
    topic.send(posts.where("cast(id as long) >= 20"), "t", target=target, offset=number)
    assert read(100) == list(range(20, 120))


def lots(spark):
    """A topic of 6 files, as a stream of one file per micro-batch (in place of a broker's capped offsets)."""
    target = publish(spark, 60)
    source = scratch_path(spark, "lots")
    spark.read.schema(MESSAGE).parquet(target).repartition(6, "offset").write.parquet(source)
    return lambda: topic.subscribe(spark, "t", target=source, max_per_trigger=1)


def test_one_batch_a_read(spark):
    stream, store = lots(spark), scratch_path(spark, "group")
    got, sizes = [], []
    while (rows := next_batch(stream(), store)) is not None:
        part = ids(rows)
        got += part
        sizes.append(len(part))
        if len(sizes) in (2, 4):  # cut off before the commit, then finished by the next read
            with pytest.raises(StreamingQueryException):
                next_batch(stream(), store, written=kill)
    assert sorted(got) == list(range(60)) and max(sizes) < 60 and len(sizes) > 3
    assert next_batch(stream(), store) is None


def test_a_group_needs_a_cap_and_a_place(spark):
    target = publish(spark, 5)
    for kw in ({"max_messages": None, "position_store": "x"}, {"max_messages": 5}):
        with pytest.raises(ValueError):
            topic.read_bounded(spark, "t", POST, target=target, group_id="g", **kw)
