import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlens.functions.text import clean_text, epoch_to_timestamp, strip_urls, tokens
from postlens.sources.posts import author_text


def py_clean(t):
    t = re.sub(r"http\S+", "", t)
    return re.sub(r"[^\w\s\.,!?]", "", t)


def _clean_all(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", clean_text("t").alias("c")).orderBy("i").collect()
    return [r["c"] for r in rows]


def test_clean_fixture_rows(spark):
    cases = [
        ("see http://a.b/c?d now", "see  now"),
        ("xhttpfoo bar", "x bar"),
        ("HTTP://A b", "HTTPA b"),
        ("it's 5€ - ok, yes! no? a_b.", "its 5  ok, yes! no? a_b."),
        ("naïve ½ café", "naïve ½ café"),
        ("h@ttp://x", "httpx"),
        (None, None),
    ]
    assert _clean_all(spark, [c[0] for c in cases]) == [c[1] for c in cases]


def test_clean_twice_differs_when_new_url_appears(spark):
    once = _clean_all(spark, ["h@ttp://x"])[0]
    assert once == "httpx"
    assert _clean_all(spark, [once])[0] == ""


def test_strip_urls_only(spark):
    df = spark.createDataFrame([("a http://x.y/z b\thttps://q",)], "t string")
    assert df.select(strip_urls("t")).first()[0] == "a  b\t"


# Code points assigned long before Unicode 13 (the JVM's tables), including the
# whitespace that Python and Java classify differently.
ALPHABET = (
    [chr(c) for c in range(0x20, 0x7F)]
    + [chr(c) for c in range(0xA0, 0x250)]
    + [chr(c) for c in range(0x370, 0x3FF) if c not in (0x378, 0x379, 0x380, 0x381, 0x382, 0x383, 0x38B, 0x38D, 0x3A2)]
    + [chr(c) for c in range(0x400, 0x4FF)]
    + list("\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85        　")
    + list("½²³¼€–—‘’“”…•→✓中文字日本語한국어")
    + ["http", "https://", "h@ttp", "http:"]
)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), min_size=1, max_size=20))
def test_clean_matches_python_re(spark, texts):
    assert _clean_all(spark, texts) == [py_clean(t) for t in texts]


def test_tokens(spark):
    df = spark.createDataFrame([(" Hello, wOrld_x 12 é!",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(tokens("t")).collect()]
    assert got == [["hello", "world_x", "12", "é"], [], None]


def test_epoch_to_timestamp_is_zone_free(spark):
    import datetime
    df = spark.createDataFrame([(1700000000.5,)], "s double")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = df.select(epoch_to_timestamp("s")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == datetime.datetime(2023, 11, 14, 22, 13, 20, 500000)


def test_missing_author_is_text_none(spark):
    df = spark.createDataFrame([(None,), ("bob",)], "a string")
    assert [r[0] for r in df.select(author_text("a")).collect()] == ["None", "bob"]
