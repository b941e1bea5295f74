from pyspark.sql import functions as F

from conftest import SF_SMALL
from postlens.operators.scoring import LexiconScorer, NaiveBayesScorer, score_posts
from postlens.plans.analysis import clean_posts
from postlens.schemas import MESSAGE, POST
from postlens.session import scratch_path
from postlens.sources import topic
from postlens.sources.posts import load_fixture_posts
from postlens.streaming.sink import TABLE_COLUMNS, run_stream_to_table


def _model(spark):
    rows = [("idiot trash", 1)] * 10 + [("nice calm", 0)] * 10
    return NaiveBayesScorer(min_z=1.0).fit(spark.createDataFrame(rows, "text string, toxic int"))


def test_stream_to_table_equals_batch_and_restart_adds_nothing(spark):
    posts = load_fixture_posts(spark, SF_SMALL).select(*[f.name for f in POST.fields])
    source = scratch_path(spark, "stream-src")
    topic.send(posts.repartition(3), "s", target=source)
    base = scratch_path(spark, "stream-out")
    table = "t_" + base.rsplit("-", 1)[-1]
    model = _model(spark)
    run_stream_to_table(spark, "s", table, f"{base}/t", f"{base}/c", LexiconScorer(), model,
                        source=source, max_per_trigger=1, timeout_seconds=300)
    got = sorted(map(tuple, spark.read.table(table).select(*TABLE_COLUMNS).collect()))
    batch = score_posts(clean_posts(posts), LexiconScorer(), model).select(*TABLE_COLUMNS)
    assert got == sorted(map(tuple, batch.collect()))
    # same checkpoint, nothing new in the topic: the table does not grow
    run_stream_to_table(spark, "s", table, f"{base}/t", f"{base}/c", LexiconScorer(), model,
                        source=source, timeout_seconds=300)
    assert spark.read.table(table).count() == len(got)


def test_stream_keeps_malformed_messages(spark):
    source = scratch_path(spark, "stream-bad")
    msgs = spark.createDataFrame(
        [(None, bytearray(b"not json"), "b", 0, 0, None),
         (None, bytearray(b'{"id":"9","title":"t","selftext":"you idiot"}'), "b", 0, 1, None)], MESSAGE)
    msgs.write.parquet(source)
    base = scratch_path(spark, "stream-bad-out")
    table = "t_" + base.rsplit("-", 1)[-1]
    run_stream_to_table(spark, "b", table, f"{base}/t", f"{base}/c", LexiconScorer(), _model(spark),
                        source=source, timeout_seconds=300)
    got = sorted(spark.read.table(table).collect(), key=lambda r: r.id or "")
    assert [tuple(r) for r in got] == [(None, None, None, None), ("9", "t", "neg", "neg")]


def test_short_time_limit_is_never_a_quiet_partial_table(spark):
    import pytest
    posts = load_fixture_posts(spark, SF_SMALL).select(*[f.name for f in POST.fields])
    source = scratch_path(spark, "stream-limit")
    topic.send(posts.repartition(60), "q", target=source)
    base = scratch_path(spark, "stream-limit-out")
    table, model = "t_" + base.rsplit("-", 1)[-1], _model(spark)
    run = lambda **kw: run_stream_to_table(spark, "q", table, f"{base}/t", f"{base}/c", LexiconScorer(), model,
                                           source=source, max_per_trigger=1, **kw)
    with pytest.raises(TimeoutError):
        run(timeout_seconds=2)
    run()  # goes on where the stopped run was
    ids = [r.id for r in spark.read.table(table).select("id").collect()]
    assert len(ids) == len(set(ids)) == posts.count()


def test_published_stream_has_an_order(spark):
    from postlens.streaming.sink import publish_stream
    posts = load_fixture_posts(spark, SF_SMALL).select(*[f.name for f in POST.fields])
    src, target = scratch_path(spark, "order-src"), scratch_path(spark, "order-topic")
    posts.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 1).parquet(src)
    publish_stream(stream, "o", f"{target}-ckpt", target=target).awaitTermination(300)
    messages = spark.read.schema(MESSAGE).option("recursiveFileLookup", "true").parquet(target)
    offsets = [r.offset for r in messages.select("offset").collect()]
    assert None not in offsets and len(offsets) == len(set(offsets)) == posts.count()
    assert topic.read_bounded(spark, "o", POST, target=target, max_messages=5).count() == 5


def test_kafka_options():
    # The Kafka connector is not on this runtime: the options are checked, the
    # Kafka path itself does not run here.
    assert topic.kafka_source_options("posts") == {
        "kafka.bootstrap.servers": "localhost:9092", "subscribe": "posts", "startingOffsets": "earliest"}
    assert topic.kafka_source_options("posts", "b:1", ending="latest", max_per_trigger=100) == {
        "kafka.bootstrap.servers": "b:1", "subscribe": "posts", "startingOffsets": "earliest",
        "endingOffsets": "latest", "maxOffsetsPerTrigger": "100"}
    assert topic.kafka_sink_options("out") == {"kafka.bootstrap.servers": "localhost:9092", "topic": "out"}


def test_processing_time_trigger_stops_on_timeout(spark):
    import time
    posts = load_fixture_posts(spark, SF_SMALL).select(*[f.name for f in POST.fields])
    source = scratch_path(spark, "stream-src-pt")
    topic.send(posts, "p", target=source)
    base = scratch_path(spark, "stream-out-pt")
    table = "t_" + base.rsplit("-", 1)[-1]
    t0 = time.time()
    q = run_stream_to_table(spark, "p", table, f"{base}/t", f"{base}/c", LexiconScorer(), _model(spark),
                            source=source, processing_time="1 second", timeout_seconds=6)
    assert not q.isActive
    assert time.time() - t0 >= 5
    assert spark.read.table(table).count() == posts.count()


def test_publish_stream_then_bounded_read(spark):
    from postlens.streaming.sink import publish_stream
    posts = load_fixture_posts(spark, SF_SMALL).select(*[f.name for f in POST.fields])
    src = scratch_path(spark, "posts-src")
    posts.write.parquet(src)
    stream = spark.readStream.schema(posts.schema).parquet(src)
    target = scratch_path(spark, "topic-out")
    q = publish_stream(stream, "out", f"{target}-ckpt", target=target)
    q.awaitTermination(300)
    back = topic.read_bounded(spark, "out", POST, target=target, max_messages=None)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, posts.collect()))


def test_stream_does_not_clean_twice(spark):
    from pyspark.sql import Row
    posts = spark.createDataFrame([Row(title="t", author="a", score=1, id="1", url="u",
                                       created_utc=0.0, selftext="idiot httpx", num_comments=0)], POST)
    source = scratch_path(spark, "stream-clean")
    topic.send(posts, "c", target=source)
    base = scratch_path(spark, "stream-clean-out")
    table = "t_" + base.rsplit("-", 1)[-1]
    run_stream_to_table(spark, "c", table, f"{base}/t", f"{base}/c", LexiconScorer(), _model(spark),
                        source=source, timeout_seconds=300, clean=False)
    # a second cleaning would have removed 'httpx' but the labels come from 'idiot'
    assert [tuple(r) for r in spark.read.table(table).collect()] == [("1", "t", "neg", "neg")]


def test_interrupted_stream_resumes_exactly_once(spark):
    """Stop a running stream after its first micro-batch, publish more, restart on
    the same checkpoint: every message lands in the table exactly once."""
    import time
    from postlens.streaming.sink import scored_stream, write_table
    posts = load_fixture_posts(spark, SF_SMALL).select(*[f.name for f in POST.fields])
    first, second = posts.where(F.col("id").cast("int") % 2 == 0), posts.where(F.col("id").cast("int") % 2 == 1)
    source = scratch_path(spark, "stream-src-int")
    topic.send(first.repartition(4), "i", target=source)
    base = scratch_path(spark, "stream-out-int")
    table = "t_" + base.rsplit("-", 1)[-1]
    model = _model(spark)
    stream = scored_stream(topic.subscribe(spark, "i", target=source, max_per_trigger=1), LexiconScorer(), model)
    q = write_table(stream, table, f"{base}/t", f"{base}/c", processing_time="2 seconds")
    deadline = time.time() + 120
    while time.time() < deadline and not any(p["numInputRows"] > 0 for p in q.recentProgress):
        time.sleep(0.2)
    q.stop()  # interrupted part-way: at most a few of the four files are in
    partial = spark.read.table(table).count()
    assert 0 < partial < first.count()
    topic.send(second, "i", target=source)  # more messages arrive while stopped
    run_stream_to_table(spark, "i", table, f"{base}/t", f"{base}/c", LexiconScorer(), model,
                        source=source, timeout_seconds=300)
    ids = [r.id for r in spark.read.table(table).select("id").collect()]
    assert len(ids) == len(set(ids)) == posts.count()


def test_two_runs_take_many_files_per_trigger(spark, monkeypatch):
    """A trigger works on as many files as fit its cap, not on one: each run has one trigger here, and all posts come."""
    from postlens.plans import registry

    triggers = []

    def run(spark, topic, table, path, checkpoint, *args, **kw):
        query = run_stream_to_table(spark, topic, table, path, checkpoint, *args, **kw)
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(kw["source"]).count()
        triggers.append((files, sum(p.numInputRows > 0 for p in query.recentProgress)))
        return query

    monkeypatch.setattr(registry, "run_stream_to_table", run)
    rows = registry.q_stream_two_runs(spark, SF_SMALL)
    assert rows.count() == rows.select("id").distinct().count() == load_fixture_posts(spark, SF_SMALL).count()
    assert len(triggers) == 2 and all(1 < files <= registry.FILES_PER_TRIGGER for files, _ in triggers)
    assert [n for _, n in triggers] == [1, 1]
