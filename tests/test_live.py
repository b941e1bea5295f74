"""Live report and dead letters: after any number of triggers and restarts the same as the batch result."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from conftest import SF_SMALL
from postlens.operators import report
from postlens.operators.scoring import LexiconScorer, NaiveBayesScorer
from postlens.plans.analysis import analyze_keywords
from postlens.schemas import MESSAGE, POST
from postlens.session import scratch_path
from postlens.sources import topic
from postlens.sources.posts import keyword_frame, load_fixture_posts
from postlens.streaming import live

KEYWORDS = ["idiot", "that", "license", "unheardof"]


@pytest.fixture(scope="module")
def model(spark):
    rows = [("idiot trash", 1)] * 10 + [("nice calm", 0)] * 10
    return NaiveBayesScorer(min_z=1.0).fit(spark.createDataFrame(rows, "text string, toxic int"))


def kill(batch):
    raise RuntimeError("killed between write and commit")


def test_live_report_equals_the_batch_report_after_every_run(spark, model):
    posts = load_fixture_posts(spark, SF_SMALL).select(*[f.name for f in POST.fields])
    target, path = scratch_path(spark, "topic"), scratch_path(spark, "live")
    sent = None
    for lot in range(3):
        mine = posts.where(F.col("id").cast("long") % 3 == lot)
        sent = mine if sent is None else sent.unionByName(mine)
        topic.send(mine.repartition(2), "t", target=target)
        run = lambda **kw: live.run_live_report(
            topic.subscribe(spark, "t", target=target, max_per_trigger=1), path, KEYWORDS, LexiconScorer(), model, **kw)
        if lot == 1:
            with pytest.raises(StreamingQueryException):
                run(written=kill)
        run()
        scored = analyze_keywords(sent, KEYWORDS, LexiconScorer(), model, limit=None)
        want = sorted(map(tuple, report.agreement_by_keyword(scored).collect()))
        assert sorted(map(tuple, live.live_agreement_by_keyword(spark, path).collect())) == want
        frame = keyword_frame(spark, KEYWORDS)
        want = sorted(map(tuple, report.posts_per_keyword(scored, frame).collect()))
        assert sorted(map(tuple, live.live_posts_per_keyword(spark, path, frame).collect())) == want
    assert ("unheardof", 0) in want


def test_a_keyword_named_like_the_whole_keeps_its_own_count(spark, model):
    target, path = scratch_path(spark, "topic"), scratch_path(spark, "live")
    topic.send(spark.createDataFrame([("All of it", "a", 1, "1", "u", 1.0, "x y", 0)], POST), "t", target=target)
    live.run_live_report(topic.subscribe(spark, "t", target=target), path, ["All", "it", "x"], LexiconScorer(), model)
    got = sorted((r.of_all, r.keyword, r.n_posts) for r in live.live_counts(spark, path).collect())
    assert got == [(False, "All", 1), (False, "it", 1), (False, "x", 1), (True, "All", 3)]


BAD = ["", "not json", '{"id": "cut', '{"id": "9", "score": "many"}', "[1, 2]", "null", '"text"', "12", '{"created_utc": {}}']
GOOD = ["{}", '{"id": "1", "unknown": 3}', ' {"id": "2", "score": null, "title": "idiot"}', '{"id": "3", "selftext": "you idiot"}']


def test_malformed(spark):
    rows = [(None, bytearray(v.encode()), "t", 0, i, None) for i, v in enumerate([*BAD, *GOOD])] + [(None, None, "t", 0, 99, None)]
    got = {r.offset: r.malformed for r in live.with_malformed(spark.createDataFrame(rows, MESSAGE)).collect()}
    assert got == {**dict(enumerate(BAD)), **{len(BAD) + i: None for i in range(len(GOOD))}, 99: ""}


def test_good_and_dead_letters_are_all_messages(spark, model):
    target, path = scratch_path(spark, "topic"), scratch_path(spark, "letters")
    values = [*BAD, *GOOD] * 4
    rows = [(None, bytearray(v.encode()), "t", i % 2, i, None) for i, v in enumerate(values)]
    run = lambda **kw: live.run_with_dead_letters(
        topic.subscribe(spark, "t", target=target, max_per_trigger=1), path, LexiconScorer(), model, **kw)
    messages = spark.createDataFrame(rows, MESSAGE)
    messages.where("offset < 30").repartition(3).write.parquet(target)
    run()
    messages.where("offset >= 30").repartition(3).write.mode("append").parquet(target)
    with pytest.raises(StreamingQueryException):
        run(written=kill)
    run()
    run()
    dead = {(r.partition, r.offset): r.malformed for r in live.dead_letters(spark, path).collect()}
    good = {(r.partition, r.offset): r for r in live.living_letters(spark, path).collect()}
    assert live.dead_letters(spark, path).count() == len(dead) and live.living_letters(spark, path).count() == len(good)
    for i, v in enumerate(values):
        if v in BAD:
            assert dead[i % 2, i] == v and (i % 2, i) not in good
        else:
            assert good[i % 2, i].id == json.loads(v).get("id") and (i % 2, i) not in dead
    assert {good[k].sentiment1 for k in good if good[k].id == "3"} == {"neg"}
