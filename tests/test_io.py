import datetime
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from postlens.functions.json import decode_json, encode_json
from postlens.schemas import POST, STREAM
from postlens.session import scratch_path
from postlens.sources import files, topic
from postlens.sources.posts import load_fixture_posts


def test_json_decode_cases(spark):
    df = spark.createDataFrame([(0, '{"title":"x","score":3}'), (1, "not json"), (2, None),
                                (3, '{"title":"x","sentiment1":"pos"'), (4, '{"title":5}')], "i int, v string")
    got = [tuple(r) for r in df.orderBy("i").select(decode_json("v", STREAM).alias("d")).select("d.*").collect()]
    assert got == [("x", None, None), (None, None, None), (None, None, None), (None, None, None), ("5", None, None)]


def test_json_decode_bytes(spark):
    df = spark.createDataFrame([(bytearray(b'{"title":"t"}'),)], "v binary")
    assert df.select(decode_json("v", STREAM)["title"]).first()[0] == "t"


def test_json_encode_keeps_nulls(spark):
    df = spark.createDataFrame([("a", None)], "title string, s string")
    assert df.select(encode_json()).first()[0] == '{"title":"a","s":null}'


def test_json_roundtrip_posts(spark):
    posts = load_fixture_posts(spark, SF_SMALL).select(*[f.name for f in POST.fields])
    back = topic.decode_messages(topic.to_messages(posts, "t"), POST)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, posts.collect()))


def test_encode_timestamp_column(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, 0, 1),)], "ts timestamp_ntz")
    assert json.loads(df.select(encode_json()).first()[0]) == {"ts": "2024-01-01T00:00:01.000000"}


def test_csv_roundtrip_cases(spark):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("t", T.StringType())])
    rows = [(0, 'he said "hi", ok'), (1, "two\nlines"), (2, None), (3, ""), (4, "a,b")]
    path = scratch_path(spark, "csv-test")
    files.write_csv(spark.createDataFrame(rows, schema), path, single_file=True)
    back = dict(tuple(r) for r in files.read_csv(spark, path, schema).collect())
    assert back == {0: 'he said "hi", ok', 1: "two\nlines", 2: None, 3: "", 4: "a,b"}


def test_csv_skip_bad_lines(spark, tmp_path):
    """Only lines with too many fields go; every way of asking sees the same rows."""
    p = tmp_path / "bad.csv"
    p.write_text("i,t\n1,ok\nx,bad\n2,fine\n4\n5,a,b\n6,a,b,c\n")
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("t", T.StringType())])
    rows = files.read_csv(spark, str(p), schema, skip_bad_lines=True)
    want = [(None, "bad"), (1, "ok"), (2, "fine"), (4, None)]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r) for r in rows.collect()), key=key) == want
    assert rows.count() == 4
    assert sorted((r.t for r in rows.select("t").collect()), key=str) == [None, "bad", "fine", "ok"]
    assert sorted((r.i for r in rows.select("i").collect()), key=str) == [1, 2, 4, None]


def test_report_is_computed_once(spark):
    """The range sort samples its input; the rows it samples are already written."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(500).mapInArrow(count, "id long")
    files.export_report(df, scratch_path(spark, "once"), ["id"])
    assert seen.value == 500


def test_timestamps_survive_a_message(spark):
    from postlens.plans.analysis import with_timestamp
    from postlens.schemas import POST_TS
    posts = with_timestamp(load_fixture_posts(spark, SF_SMALL).select(*[f.name for f in POST.fields]))
    back = topic.decode_messages(topic.to_messages(posts, "t"), POST_TS)
    assert back.where("created_utc is null").count() == 0
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, posts.collect()))


def test_bounded_reads_continue(spark):
    posts = load_fixture_posts(spark, SF_SMALL).select(*[f.name for f in POST.fields])
    target, store = scratch_path(spark, "topic-pos"), scratch_path(spark, "pos")
    topic.send(posts, "t2", target=target, offset=F.col("id").cast("bigint"))
    read = lambda group: sorted(int(r.id) for r in topic.read_bounded(
        spark, "t2", POST, target=target, max_messages=60, group_id=group, position_store=store).collect())
    assert read("a") == list(range(60)) and read("a") == list(range(60, 120))
    assert read("b") == list(range(60))
    rest = read("a") + read("a")
    assert rest == list(range(120, 200)) and read("a") == []


def test_posts_table_round_trip(spark):
    from postlens.sources.posts import project_post, read_posts, store_posts
    posts = load_fixture_posts(spark, SF_SMALL)
    path = scratch_path(spark, "posts-table")
    store_posts(posts.withColumn("author", F.when(F.col("id") != "3", F.col("author"))), path)
    back = read_posts(spark, path)
    assert back.count() == posts.count()
    assert project_post(back).where("id = '3'").first().author == "None"
    assert project_post(back).columns == [f.name for f in POST.fields]


def test_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    import pytest
    from postlens.session import checkpoint_root
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError):
        checkpoint_root(session)


def test_row_index_is_global_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    indexed = files.with_row_index(df, ["k"])
    rows = indexed.collect()
    assert sorted((r.row_index, r.k) for r in rows) == [(i, i) for i in range(1000)]


def test_bounded_read_exact_cap(spark):
    posts = load_fixture_posts(spark, SF_SMALL).select(*[f.name for f in POST.fields]).repartition(4)
    target = scratch_path(spark, "topic-test")
    topic.send(posts, "t1", target=target, offset=F.col("id").cast("bigint"))
    got = topic.read_bounded(spark, "t1", POST, target=target, max_messages=7)
    assert sorted(int(r.id) for r in got.collect()) == list(range(7))
    assert topic.read_bounded(spark, "other", POST, target=target).count() == 0


from hypothesis import given, settings
from hypothesis import strategies as st

_text = st.one_of(st.none(), st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=30))
_post = st.tuples(_text, _text, st.one_of(st.none(), st.integers(-2**62, 2**62)), _text, _text,
                  st.one_of(st.none(), st.floats(allow_nan=False, allow_infinity=False)), _text,
                  st.one_of(st.none(), st.integers(0, 10**9)))


@settings(max_examples=25, deadline=None)
@given(st.lists(_post, min_size=1, max_size=15))
def test_json_encode_decode_is_identity(spark, rows):
    df = spark.createDataFrame(rows, POST)
    back = topic.decode_messages(topic.to_messages(df, "h"), POST)
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, back.collect()), key=key) == sorted(map(tuple, df.collect()), key=key)
